from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from cartloom.plans.queries import _sums
from cartloom.schemas import TABLES
from cartloom.operators import features as X
from cartloom.sources import star
from cartloom.sources.stage import bucket_count, forget_staged, shared_folder, staged
from cartloom.sources.tables import MissingColumn, load_all, load_table, read_csv, write_csv
from tests.conftest import rows


@pytest.fixture(scope="module")
def csv_root(shop, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("csv"))
    for name, df in shop.named().items():
        write_csv(df, f"{root}/{name}.csv")
    return root


def test_load_all_equals_written(spark, shop, csv_root):
    loaded = load_all(spark, csv_root).named()
    assert set(loaded) == set(TABLES)
    for name, df in shop.named().items():
        assert loaded[name].schema == df.schema
        assert rows(loaded[name]) == rows(df)


def test_columns_and_row_limit(spark, csv_root):
    df = load_table(spark, csv_root, "orders", usecols=["user_id", "order_id"], nrows=3)
    assert df.columns == ["user_id", "order_id"]
    assert [tuple(r) for r in df.collect()] == [(1, 1), (1, 2), (1, 3)]


def test_several_folders_are_one_table(spark, shop, csv_root):
    df = load_table(spark, [csv_root, csv_root], "aisles")
    assert df.count() == 2 * shop.aisles.count()


def test_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException):
        load_table(spark, str(tmp_path), "orders").count()
    empty = load_table(spark, str(tmp_path), "orders", permissive=True)
    assert empty.schema == TABLES["orders"] and empty.count() == 0


def _csv(path, *lines):
    path.mkdir()
    (path / "part.csv").write_text("\n".join(lines) + "\n")


HEADER = "user_id,order_id,extra,order_number,eval_set,order_dow,order_hour_of_day,days_since_prior_order"


def test_columns_are_found_by_name(spark, tmp_path):
    _csv(tmp_path / "orders.csv", HEADER, "7,1,x,2,prior,3,4,5.5", "8,2,,1,train,0,0,")
    df = load_table(spark, str(tmp_path), "orders")
    assert df.columns == TABLES["orders"].names
    assert rows(df) == [(1, 7, "prior", 2, 3, 4, 5.5), (2, 8, "train", 1, 0, 0, None)]


def test_folders_with_other_column_orders(spark, tmp_path):
    for i, lines in enumerate((("aisle_id,aisle", "1,a"), ("aisle,aisle_id", "b,2"))):
        (tmp_path / str(i)).mkdir()
        _csv(tmp_path / str(i) / "aisles.csv", *lines)
    df = load_table(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], "aisles")
    assert rows(df) == [(1, "a"), (2, "b")]


def test_missing_column(spark, tmp_path):
    _csv(tmp_path / "aisles.csv", "aisle_id,name", "1,a")
    with pytest.raises(MissingColumn, match="aisle"):
        load_table(spark, str(tmp_path), "aisles")
    assert load_table(spark, str(tmp_path), "aisles", permissive=True).count() == 0


def test_bad_number(spark, tmp_path, caplog):
    _csv(tmp_path / "orders.csv", HEADER, "7,1,x,2.0,prior,3,4,5.5", "8,2,x,1,prior,0,0,1")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|Malformed"):
        load_table(spark, str(tmp_path), "orders").collect()
    df = load_table(spark, str(tmp_path), "orders", permissive=True)
    assert "1 rows" in caplog.text
    assert sorted(r.order_number or 0 for r in df.collect()) == [0, 1]


def test_header_of_a_later_file_differs(spark, tmp_path):
    _csv(tmp_path / "aisles.csv", "aisle_id,aisle", "1,a")
    (tmp_path / "aisles.csv" / "zzz.csv").write_text("aisle,aisle_id\nb,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        load_table(spark, str(tmp_path), "aisles").collect()


def test_no_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = spark.conf, Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Session())


def test_parquet_format(spark, shop, tmp_path):
    shop.orders.write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(load_table(spark, str(tmp_path), "orders", fmt="parquet")) == rows(shop.orders)


def test_csv_keeps_doubles_and_nulls(spark, tmp_path):
    df = spark.sql("select 1L as k, 1/3D as a, cast(null as string) as b union all select 2, 0.1D, 'x,\"y\"'")
    write_csv(df, f"{tmp_path}/t")
    assert rows(read_csv(spark, f"{tmp_path}/t", df.schema)) == rows(df)


def test_staged_builds_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "x")

    first = staged(spark, "once", "test-origin", build)
    again = staged(spark, "once", "test-origin", build)
    assert len(calls) == 1 and rows(first) == rows(again)
    assert shared_folder(spark)


def test_forget_staged(spark):
    df = staged(spark, "short", "forget", lambda: spark.range(9), bucket_by="id")
    assert df.count() == 9
    tables = {t.name for t in spark.catalog.listTables() if t.name.endswith("_short")}
    assert len(tables) == 1
    forget_staged(spark)
    assert not {t.name for t in spark.catalog.listTables() if t.name.startswith("cartloom_")}
    again = staged(spark, "short", "forget", lambda: spark.range(4), bucket_by="id")
    assert again.count() == 4


def test_star_orders_split_hot_users(spark):
    """Numbering in slices gives what one window gives."""
    raw = star.raw(spark, "/root/testdata/sf0.001", "orders")
    assert rows(star.map_orders(raw, group_rows=3)) == rows(star.map_orders(raw))


def test_column_sums_show_columns_that_change_places(spark):
    table = spark.createDataFrame([(1, 2, "a"), (3, 4, None)], "a long, b long, c string")
    swapped = table.select(table["b"].alias("a"), table["a"].alias("b"), "c")
    assert rows(_sums({"t": table})) != rows(_sums({"t": swapped}))
    assert rows(_sums({"t": table}).filter("column_name = 'c'")) == [("t", 2, "c", 1, 1.0)]


def test_buckets_hold_as_much_of_a_larger_table(spark, monkeypatch):
    """A task's share of the lines stays the same from 62 to 620 MB of files."""
    monkeypatch.setattr(star, "raw", lambda *_: None)
    per_bucket = []
    for size in (62 << 20, 620 << 20, 3720 << 20):
        monkeypatch.setattr(star, "input_bytes", lambda _, size=size: size)
        per_bucket.append(size / bucket_count(star.Star(spark, "").size()))
    assert max(per_bucket) <= 16 << 20


def test_flags_and_labels_with_repeated_and_null_keys(spark):
    """One order of two users, an order that comes twice, and null keys, against plain code."""
    lines = [
        (1, 7, 1, 10, 1, "prior"), (1, 7, 1, 11, 1, "prior"), (2, 7, 1, 10, 2, "prior"), (2, 8, 2, 10, 2, "prior"),
        (3, 8, 1, 10, 3, "train"), (3, 8, 1, 10, 4, "train"), (4, 7, 1, None, 1, "prior"), (5, None, 1, 11, 2, "prior"),
    ]
    names = "order_id long, product_id long, add_to_cart_order int, user_id long, order_number int, eval_set string"
    first = {}
    for _, p, _, u, n, _ in lines:
        first[u, p] = min(n, first.get((u, p), n))
    expected = [
        (o, p, c, int(None in (u, p) or first[u, p] != n), s) for o, p, c, u, n, s in lines
    ]
    found = star.flag_reorders(spark.createDataFrame(lines, names))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))

    pairs = [(10, 7, 3), (10, 8, 3), (11, 7, 3), (None, 7, 3), (12, 8, None), (13, None, 6), (13, 9, 6)]
    train = [(3, 8, 1), (3, 8, 0), (6, None, 1), (6, 9, None), (None, 8, 1)]
    orders = [(3, 10), (3, 11), (6, 13), (None, 12), (3, None)]
    found = X.labelled(
        spark.createDataFrame(pairs, "user_id long, product_id long, order_id long"),
        spark.createDataFrame(orders, "order_id long, user_id long"),
        spark.createDataFrame(train, "order_id long, product_id long, reordered int"),
    )
    owns = {(u, o) for o, u in orders}
    expected = []
    for u, p, o in pairs:
        hits = [r for a, b, r in train if None not in (u, p, o) and (a, b) == (o, p) and (u, o) in owns]
        expected += [(u, p, o, r or 0) for r in hits or [0]]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
