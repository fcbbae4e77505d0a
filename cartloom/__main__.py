"""Command line: ``python -m cartloom features|train|nightly|answer ...`` (or spark-submit)."""

from __future__ import annotations

import argparse

from cartloom.operators.recommend import score_requests
from cartloom.plans import jobs
from cartloom.session import session
from cartloom.sources.package import load_package
from cartloom.sources.stage import scratch_path
from cartloom.sources.tables import load_all
from cartloom.streaming.scoring import read_requests, score_stream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cartloom")
    p.add_argument("--master", help="Spark master; leave out under spark-submit")
    sub = p.add_subparsers(dest="job", required=True)

    features = sub.add_parser("features", help="write the four feature tables")
    features.add_argument("root")
    features.add_argument("out")
    features.add_argument("--input-format", default="csv")
    features.add_argument("--format", default="parquet")

    train = sub.add_parser("train", help="fit the boosted model and save the package")
    train.add_argument("root")
    train.add_argument("package")
    train.add_argument("--input-format", default="csv")
    train.add_argument("--users", type=int, help="train on a sample of users")
    train.add_argument("--rounds", type=int, default=200)

    nightly = sub.add_parser("nightly", help="rank all pairs and write the top lists")
    nightly.add_argument("package")
    nightly.add_argument("out")
    nightly.add_argument("run_date")
    nightly.add_argument("-k", type=int, default=10)

    answer = sub.add_parser("answer", help="answer JSON requests, one per line")
    answer.add_argument("package")
    answer.add_argument("ranked")
    answer.add_argument("requests")
    answer.add_argument("out")
    answer.add_argument("--stream", action="store_true", help="only files not seen before")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session(f"cartloom-{args.job}", args.master)
    if args.job == "features":
        tables = load_all(spark, args.root, args.input_format)
        jobs.feature_batch(tables, args.out, scratch_path(spark, "features"), args.format)
    elif args.job == "train":
        tables = load_all(spark, args.root, args.input_format)
        jobs.train_package(tables, args.package, args.users, args.rounds)
    elif args.job == "nightly":
        package = load_package(spark, args.package)
        ranked = jobs.write_ranked(package, f"{args.out}/ranked")
        jobs.nightly(package, ranked, f"{args.out}/lists", args.run_date, args.k)
    else:
        package, ranked = load_package(spark, args.package), spark.read.parquet(args.ranked)
        if args.stream:
            score_stream(
                read_requests(spark, args.requests),
                ranked,
                package.product_features,
                package.products,
                f"{args.out}/responses",
                f"{args.out}/checkpoint",
            ).awaitTermination()
        else:
            raw = spark.read.text(args.requests).selectExpr("uuid() as request_id", "value as raw")
            # ids must not change between the passes over the requests
            path = scratch_path(spark, "requests")
            raw.write.mode("overwrite").parquet(path)
            score_requests(
                spark.read.parquet(path), ranked, package.product_features, package.products
            ).write.mode("overwrite").parquet(f"{args.out}/responses")


if __name__ == "__main__":
    main()
