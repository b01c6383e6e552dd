from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon.functions import documents as d
from quillon.functions import exact
from quillon.operators.recursion import TooDeep, recursive_union, recursive_union_all
from quillon.operators.windows import rows_window
from quillon.plans.matviews import MaterialisedView
from quillon.sources import files
from quillon.sources.store import Conflict, VersionedTable, checked, delete_parent, orphans
from quillon.streaming.changefeed import Replica, drain, follow, subscribe


@pytest.fixture(scope="module")
def emp(spark):
    return spark.createDataFrame([(1, "eng", 100), (2, "eng", 200), (3, "eng", 200), (4, "ops", 150), (5, "ops", 150), (6, "ops", 300)], "id long, dept string, salary long")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_windows(emp):
    from pyspark.sql import Window

    w = Window.orderBy("salary")
    assert column(emp.withColumn("r", F.rank().over(w)), "r") == [1, 4, 4, 2, 2, 6]
    assert column(emp.withColumn("r", F.dense_rank().over(w)), "r") == [1, 3, 3, 2, 2, 4]
    two = rows_window(None, ["id"], -1, 0)
    assert column(emp.withColumn("s", F.sum("salary").over(two)), "s") == [100, 300, 400, 350, 300, 450]
    assert column(emp.withColumn("s", F.sum("salary").over(rows_window(None, ["id"], -2, 2))), "s") == [500, 650, 800, 1000, 800, 600]
    assert column(emp.withColumn("s", F.sum("salary").over(rows_window(None, ["id"]))), "s") == [100, 300, 500, 650, 800, 1100]


def test_exact_arithmetic(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (1, 3)], "a long, b long")
    assert [r[0] for r in df.select(exact.divide(F.col("a"), F.col("b"))).collect()] == [Decimal("3.5000"), Decimal("-3.5000"), Decimal("0.3333")]
    assert df.agg(exact.average("a").alias("x")).first()["x"] == 0 and df.limit(0).agg(exact.average("a").alias("x")).first()["x"] is None
    price = F.lit("-1.05").cast("decimal(18,2)")
    assert df.limit(1).select(exact.multiply(price, price, 2)).first()[0] == Decimal("1.10")
    assert df.limit(1).select(exact.truncate(F.lit("-1.059").cast("decimal(18,3)"), 2)).first()[0] == Decimal("-1.05")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        df.select(exact.divide(F.col("a"), F.lit(0))).collect()


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    step = lambda new: new.join(edges, new["node"] == edges["src"]).select("dst")
    start = spark.createDataFrame([(1,)], "node long")
    assert sorted(r[0] for r in recursive_union(start, step).collect()) == [1, 2, 3]
    with pytest.raises(TooDeep):
        recursive_union(start, lambda new: new.select(F.col("node") + 1), depth=3)
    text = "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 150) SELECT n FROM r"
    assert recursive_union_all(spark, text).count() == 150


@pytest.mark.parametrize(("path", "want"), [("$", '{"a": [1, {"b c": null}], "d": 1.50}'), ("$.a[1]", '{"b c": null}'), ('$.a[1]."b c"', "null"), ("$.d", "1.50"), ("$.x", None), ("$.a[7]", None)])
def test_json_paths(path, want):
    node = d.walk(d.parse('{"a":[1,{"b c":null}],"d":1.50}'), d.parse_path(path))
    assert (None if node is d.MISSING else d.render(node)) == want


def test_json_changes():
    doc = d.parse('{"a":[1],"b":{}}')
    assert d.render(d.put(doc, d.parse_path("$.a[1]"), "x")) == '{"a": [1, "x"], "b": {}}'
    assert d.render(d.put(doc, d.parse_path("$.a[2]"), "x")) == d.render(doc) == d.render(d.put(doc, d.parse_path("$.c.d"), "x"))
    for bad in ("{", "[1,]", "NaN", "'a'"):
        with pytest.raises(d.BadDocument):
            d.parse(bad)
    with pytest.raises(d.BadDocument):
        d.parse_path("a.b")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, Decimal("1.50")), (2, "", None), (3, 'q"uo,te\nline', Decimal("-2.25"))], "id long, t string, p decimal(18,2)")
    files.export_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, files.import_csv(spark, f"{tmp_path}/c", df.schema).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "bad.csv").write_text("id,t,p\n1,a,1.234\nx,b,1\n2,c,2\n2,d,3\n")
    kept = files.import_csv(spark, f"{tmp_path}/bad.csv", df.schema, key=["id"], ignore_errors=True).collect()
    assert [tuple(r) for r in kept] == [(2, "c", Decimal("2.00"))]
    with pytest.raises(Exception):  # noqa: B017
        files.import_csv(spark, f"{tmp_path}/bad.csv", df.schema).collect()


def test_store_constraints(spark, tmp_path):
    parent = VersionedTable.create(spark.createDataFrame([(1,), (2,), (3,)], "id long"), f"{tmp_path}/p", ["id"])
    child = VersionedTable.create(spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, pid long"), f"{tmp_path}/c", ["id"])
    assert orphans(child.read(), "pid", parent.read(), "id").count() == 0
    with pytest.raises(Conflict):
        delete_parent(parent, child, "pid", F.col("id") == 1)
    delete_parent(parent, child, "pid", F.col("id") == 1, "SET NULL")
    delete_parent(parent, child, "pid", F.col("id") == 2, "CASCADE")
    assert sorted((r[0], r[1]) for r in child.read().collect()) == [(10, None), (12, None)]
    with pytest.raises(Conflict):
        VersionedTable.create(spark.createDataFrame([(1,), (1,)], "id long"), f"{tmp_path}/d", ["id"])
    with pytest.raises(Exception, match="outside"):
        checked(parent.read(), F.col("id") > 5).collect()


def test_unique_upsert(spark, tmp_path):
    t = VersionedTable.create(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, mail string, n long"), f"{tmp_path}/u", ["id"], [["mail"]])
    t.upsert(spark.createDataFrame([(7, "b", 5), (8, "c", 6)], "id long, mail string, n long"), {"n": F.col("n")})
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", 0), (2, "b", 5), (8, "c", 6)]
    t.replace(spark.createDataFrame([(9, "a", 1)], "id long, mail string, n long"))
    assert sorted(map(tuple, t.read().collect())) == [(2, "b", 5), (8, "c", 6), (9, "a", 1)]


def test_views_refresh_by_row(spark, tmp_path):
    t = VersionedTable.create(spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("v")), f"{tmp_path}/t", ["id"])
    view = MaterialisedView(spark, f"{tmp_path}/v", {"t": t}, lambda s: s["t"].filter("v > 2").select("id", "v"), ["id"])
    assert view.refresh() == "full" and view.refresh() == "skipped"
    t.update(F.col("id") == 3, {"v": F.lit(0)})
    t.insert(spark.createDataFrame([(500, 6)], "id long, v long"))
    assert view.refresh() == "incremental"
    assert sorted(map(tuple, view.read().collect())) == sorted(map(tuple, t.read().filter("v > 2").collect()))
    t.update(F.lit(True), {"v": F.lit(5)})
    assert view.refresh() == "full"


def test_feed_goes_on_where_it_was(spark, tmp_path):
    t = VersionedTable.create(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), f"{tmp_path}/t", ["id"])
    replica = Replica(spark, f"{tmp_path}/r", ["id"], t.read())
    for change in (lambda: None, lambda: t.update(F.col("id") == 1, {"x": F.lit("z")}), lambda: t.delete(F.col("id") == 2)):
        change()
        drain(subscribe(t, limit=1), replica.apply, f"{tmp_path}/at")
        assert sorted(map(tuple, replica.read().collect())) == sorted(map(tuple, t.read().collect()))


def test_a_feed_is_followed(spark, tmp_path):
    import time

    t = VersionedTable.create(spark.createDataFrame([(1, "a")], "id long, x string"), f"{tmp_path}/t", ["id"])
    seen = []
    query = follow(subscribe(t), lambda batch, n: seen.extend((r["op"], r["id"]) for r in batch.collect()), f"{tmp_path}/at")
    try:
        t.insert(spark.createDataFrame([(2, "b")], "id long, x string"))
        t.delete(F.col("id") == 1)
        end = time.time() + 60
        while len(seen) < 3 and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted(seen) == [("DELETE", 1), ("PUT", 1), ("PUT", 2)]


def test_dump_modes(spark):
    with pytest.raises(ValueError, match="duplicate"):
        files.read_dump(spark, "CREATE TABLE t (a int, b text); INSERT INTO t VALUES (1,'x'),(1,'y');")
    got = files.read_dump(spark, "CREATE TABLE `t` (`a` int, `d` datetime, `e` blob); INSERT INTO t VALUES (-1,'2024-02-03 04:05:06',0x41);")["t"].first()
    assert got["a"] == -1 and str(got["d"]) == "2024-02-03" and bytes(got["e"]) == b"A"
