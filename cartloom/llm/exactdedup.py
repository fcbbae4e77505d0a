"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.

1. Key file: a row per document with the 64-bit hash and the SHA-256 of its normalised text.
2. Directory: the hashes, top bits first, address buckets. The directory starts with one
   bucket and doubles while one holds more than its capacity; only overfull buckets are split,
   so several entries of the directory may lead to one bucket. The capacity is raised with the
   number of hashes so that the directory stays within 2^16 entries.
3. Owners: each bucket, a range of hashes, belongs to one task. Only texts whose hash occurs
   more than once travel there. The readers first fold copies of a text into one row, so a
   text that a third of all rows hold arrives as a row or a few per reader. The owner walks the
   bucket in order of hash, chains different texts of one hash and compares their bytes.
4. The classes found are joined back to the key file.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import ascii_lower, staged, text_or_empty

#: Bits of the largest directory.
MOST_BITS = 16
#: Hashes whose broadcast is safe: 8 bytes each.
BROADCAST_HASHES = 1_000_000
#: Bytes of texts that a reader folds at a time.
FOLD_BYTES = 32 << 20


def build_directory(counts: dict[int, int], capacity: int, bits: int = MOST_BITS) -> list[int]:
    """The bucket of each directory entry, from the number of hashes by their top ``bits``
    bits. Doubles from one entry until no bucket is overfull or the bits are used up."""
    sums = [0] * (1 << bits)
    for prefix, n in counts.items():
        sums[prefix] += n
    ahead = [0]
    for n in sums:
        ahead.append(ahead[-1] + n)
    buckets, depth = [(0, 0)], 0  # local depth, prefix; in order of the prefix

    def held(local: int, prefix: int) -> int:
        return ahead[(prefix + 1) << (bits - local)] - ahead[prefix << (bits - local)]

    while depth < bits and any(held(*b) > capacity for b in buckets):
        depth += 1  # the directory doubles
        split = []
        for local, prefix in buckets:
            if held(local, prefix) > capacity:
                split += [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
            else:
                split.append((local, prefix))
        buckets = split
    return [number for number, (local, _) in enumerate(buckets) for _ in range(1 << (depth - local))]


def duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = 20_000
) -> DataFrame:
    """One row per row of ``docs``: ``key``, keep_id (the largest key among equal texts),
    group_size (rows), kept, text_sha256 of the normalised text.

    Rows that repeat a key with the same text are all kept or all dropped. An empty table
    gives an empty one. ``bucket_rows`` is the least capacity of a bucket.
    """
    spark = docs.sparkSession
    normal = ascii_lower(text_or_empty(text))
    hashed = docs.select(F.col(key).alias("id"), normal.alias("body")).withColumn("h", F.xxhash64("body"))
    keys = staged(hashed.select("id", "h", F.sha2("body", 256).alias("sha")), "keys")

    counted = keys.groupBy("h").agg(F.count("*").alias("n"))
    prefix = F.shiftrightunsigned("h", 64 - MOST_BITS).cast("int")
    per_prefix = counted.groupBy(prefix.alias("p")).agg(
        F.count("*").alias("hashes"), F.sum((F.col("n") > 1).cast("int")).alias("repeated")
    )
    found = per_prefix.collect()  # at most 2^16 rows
    repeated = sum(r["repeated"] for r in found)
    capacity = max(bucket_rows, 4 * sum(r["hashes"] for r in found) >> MOST_BITS)
    entries = build_directory({r["p"]: r["hashes"] for r in found}, capacity)
    depth = (len(entries) - 1).bit_length()
    directory = spark.createDataFrame(list(enumerate(entries)), "entry int, bucket int")
    entry = F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)
    wanted = counted.filter("n > 1").select("h", entry.alias("entry"))
    wanted = wanted.join(F.broadcast(directory), "entry").select("h", "bucket")
    # a checked size is sent to all readers; beyond it texts and hashes meet in a shuffle
    wanted = F.broadcast(wanted) if repeated <= BROADCAST_HASHES else wanted
    texts = hashed.join(wanted, "h").select("bucket", "h", "id", F.col("body").cast("binary").alias("body"))

    def fold(parts):
        import pyarrow as pa

        schema = pa.schema(
            [("bucket", pa.int32()), ("h", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64()), ("body", pa.binary())]
        )
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            rows = [(*v, k) for k, v in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in parts:
            for bucket, h, i, body in zip(*(c.to_pylist() for c in batch.columns)):
                known = held.get(body)
                if known is None:
                    held[body] = [bucket, h, i, 1]
                    size += len(body)
                    if size > FOLD_BYTES:
                        yield flush()
                        held.clear()
                        size = 0
                else:
                    known[2] = i if known[2] is None else known[2] if i is None else max(known[2], i)
                    known[3] += 1
        if held:
            yield flush()

    folded = texts.mapInArrow(fold, "bucket int, h long, keep_id long, n long, body binary")

    def chain(parts):
        import pyarrow as pa

        last, chained = None, []  # texts of one hash: body, largest id, rows

        def closed(rows):
            return [(last, hashlib.sha256(b).hexdigest(), i, n) for b, i, n in rows]

        def out(rows):
            columns = zip(*rows) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["h", "sha", "keep_id", "group_size"]
            )

        for batch in parts:
            done = []
            for h, i, n, body in zip(*(batch.column(c).to_pylist() for c in ("h", "keep_id", "n", "body"))):
                if h != last:
                    done += closed(chained)
                    last, chained = h, []
                for link in chained:
                    if link[0] == body:
                        link[1] = i if link[1] is None else link[1] if i is None else max(link[1], i)
                        link[2] += n
                        break
                else:
                    chained.append([body, i, n])
            yield out(done)
        yield out(closed(chained))

    owned = folded.repartition("bucket").sortWithinPartitions("bucket", "h")
    classes = owned.mapInArrow(chain, "h long, sha string, keep_id long, group_size long")
    joined = keys.join(classes, ["h", "sha"], "left")
    keep = F.coalesce("keep_id", "id")
    return joined.select(
        F.col("id").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
