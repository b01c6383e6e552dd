"""All queries for the engine's operators, and their oracle SQL.

Names begin with the number in the operator inventory. ``same`` registers one portable text
for both engines, ``pair`` a DataFrame query beside the oracle's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import documents as docs
from quillon.functions import exact
from quillon.operators.recursion import recursive_union, recursive_union_all
from quillon.operators.windows import range_window, rows_window, top_per_group
from quillon.session import scratch, sql_over, table
from quillon.sources import files
from quillon.sources.catalog import columns_of, tables_of
from quillon.sources.store import Conflict, VersionedTable, replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def same(name: str, text: str, *tables: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: sql_over(spark, sf_dir, text, *tables)
    ORACLES[name] = text


def pair(name: str, oracle: str | None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return register


def D(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,4))"


# --- A. scans, sources, sinks -----------------------------------------------------------

same("a1_full_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders", "orders")
same("a2_projection_scan", "SELECT l_orderkey, l_linenumber FROM lineitem", "lineitem")
same("a3_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 100", "orders")
same("a4_prefix_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7", "lineitem")
same("a5_prefix_range_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber >= 2 AND l_linenumber < 5", "lineitem")
same("a6_prefix_in_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (1, 7, 100, 5000)", "lineitem")
same("a7_secondary_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 10 AND o_custkey < 20 AND o_orderstatus <> 'F'", "orders")
same("a9_count_all", "SELECT COUNT(*) AS n FROM lineitem", "lineitem")
same("a10_constant_row", "SELECT 1 + 2 AS a, 'x' AS b, CAST(NULL AS BIGINT) AS c")
same("a11_derived_table", f"SELECT s.o_custkey, s.total FROM (SELECT o_custkey, CAST(SUM({D('o_totalprice')}) AS DECIMAL(38,4)) AS total FROM orders GROUP BY o_custkey) s WHERE s.total > 300000", "orders")


@pair("a8_ordered_scan", "SELECT c_custkey, c_name FROM customer")
def _ordered_scan(spark, sf_dir):
    """All of a table written in key order, in that order."""
    path = scratch(spark)
    files.export_parquet(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path, sort_by=["c_custkey"])
    return spark.read.parquet(path).orderBy("c_custkey")


@pair("a12_information_schema", "SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS ordinal_position FROM information_schema.columns WHERE table_name IN ('region','nation','customer','supplier')")
def _information_schema(spark, sf_dir):
    names = ["region", "nation", "customer", "supplier"]
    return columns_of(spark, {n: table(spark, sf_dir, n) for n in names}).select("table_name", "column_name", "ordinal_position")


@pair("a12_information_schema_tables", "SELECT table_name, CAST(count(*) AS BIGINT) AS n_columns FROM information_schema.columns WHERE table_name IN ('orders','part') GROUP BY 1")
def _information_schema_tables(spark, sf_dir):
    return tables_of(spark, {n: table(spark, sf_dir, n) for n in ["orders", "part"]}).select("table_name", "n_columns")


NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@pair("a13_csv_import", NATION)
def _csv_import(spark, sf_dir):
    source, path = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), scratch(spark)
    files.export_csv(source, path)
    return files.import_csv(spark, path, source.schema, key=["n_nationkey"])


@pair("a14_csv_export", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name FROM customer")
def _csv_export(spark, sf_dir):
    source, path = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("c_name")), scratch(spark)
    files.export_csv(source, path)
    return files.import_csv(spark, path, source.schema)


@pair("a15_json_lines_export", f"SELECT p_partkey, p_name, {D('p_retailprice')} AS price FROM part")
def _json_export(spark, sf_dir):
    source, path = table(spark, sf_dir, "part").select("p_partkey", "p_name", exact.decimal("p_retailprice").alias("price")), scratch(spark)
    files.export_json(source, path)
    return spark.read.schema(source.schema).json(path)


@pair("a16_parquet_export", f"SELECT o_orderkey, {D('o_totalprice')} AS total FROM orders")
def _parquet_export(spark, sf_dir):
    path = scratch(spark)
    files.export_parquet(table(spark, sf_dir, "orders").select("o_orderkey", exact.decimal("o_totalprice").alias("total")), path)
    return spark.read.parquet(path)


DUMP = """-- a dump
SET NAMES utf8mb4;
DROP TABLE IF EXISTS `legacy`;
CREATE TABLE `legacy` (`id` int NOT NULL, `name` varchar(20) DEFAULT NULL, `price` decimal(10,2), PRIMARY KEY (`id`)) ENGINE=InnoDB;
INSERT INTO `legacy` VALUES (1,'O\\'Hara',1.50),(2,'semi;colon',NULL);
REPLACE INTO `legacy` (`id`,`name`) VALUES (2,'two');
INSERT IGNORE INTO `legacy` VALUES (1,'late',9.99),(3,NULL,-3.25);
"""


@pair("a17_dump_import", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'O''Hara', CAST(1.50 AS DECIMAL(18,2))), (2, 'two', NULL), (3, NULL, -3.25)) t(id, name, price)")
def _dump_import(spark, sf_dir):
    return files.read_dump(spark, DUMP)["legacy"]


same("a18_values", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b'), (3, NULL)) t(id, name)")


@pair("a19_backup_restore_point_in_time", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE n_name END AS n_name, n_regionkey FROM nation")
def _backup(spark, sf_dir):
    """A snapshot, an update, a deletion; restored to just after the update."""
    path = scratch(spark)
    t = VersionedTable.create(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{path}/t", ["n_nationkey"])
    t.backup(f"{path}/backup")
    lsn = t.update(F.col("n_regionkey") == 1, {"n_name": F.lit("moved")})
    t.delete(F.col("n_regionkey") == 2)
    t.restore(f"{path}/backup", to_lsn=lsn)
    return t.read()


# --- B. projections, filters, predicates ------------------------------------------------

same("b1_projection", "SELECT n.n_name, n.n_regionkey FROM nation n", "nation")
same("b2_star", "SELECT * FROM region", "region")
same("b3_alias", "SELECT c.c_custkey AS id, c.c_mktsegment AS segment FROM customer AS c", "customer")
same("b4_arithmetic", "SELECT o_orderkey, o_orderkey * (o_custkey - 1) AS a, -o_orderkey AS b, o_orderkey % 7 AS c, +o_custkey AS d FROM orders", "orders")
same("b5_comparison", "SELECT o_orderkey FROM orders WHERE o_orderkey >= o_custkey + 1 AND o_custkey <> 5", "orders")
same("b6_conjunction", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 30 AND p_brand = 'Brand#11'", "part")
same("b7_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 10", "part")
same("b8_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", "orders")
same("b9_row_value_in", "SELECT COUNT(*) AS n FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A','F'), ('N','O'))", "lineitem")
same("b10_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A_%' AND p_name LIKE 'p%'", "part")
same("b11_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "orders", "customer")
same("b12_exists", "SELECT COUNT(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1)", "orders", "customer")
same("b13_scalar_subquery", f"SELECT p_partkey FROM part WHERE {D('p_retailprice')} > (SELECT SUM({D('p_retailprice')}) / COUNT(*) FROM part)", "part")
same("b14_case", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' AND o_custkey > 700 THEN 'open' ELSE '' END AS state FROM orders", "orders")
same("b17_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "orders")
same("b18_ordered_distinct", "SELECT DISTINCT l_shipdate FROM lineitem ORDER BY l_shipdate", "lineitem")


@pair("b4_quotient", "SELECT o_orderkey, CAST(CAST(o_orderkey * 10000 // (o_custkey + 3) AS DECIMAL(18,0)) / 10000 AS DECIMAL(18,4)) AS q FROM orders")
def _quotient(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", exact.divide(F.col("o_orderkey"), F.col("o_custkey") + 3).alias("q"))


@pair("b4_decimal_product", "SELECT l_orderkey, l_linenumber, CAST(trunc(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) * 100) / 100 AS DECIMAL(18,2)) AS p FROM lineitem")
def _product(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", exact.multiply(exact.decimal("l_extendedprice", 2), exact.decimal("l_discount", 2), 2).alias("p"))


@pair("b15_variables", "SELECT o_orderkey FROM orders WHERE o_custkey = 42")
def _variables(spark, sf_dir):
    return sql_over(spark, sf_dir, "SELECT o_orderkey FROM orders WHERE o_custkey = :v", "orders", v=42)


@pair("b16_prepared", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'MACHINERY'")
def _prepared(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey FROM customer WHERE c_nationkey = ? AND c_mktsegment = ?", args=[3, "MACHINERY"])


@pair("b19_for_update", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _for_update(spark, sf_dir):
    return _engine(spark, sf_dir, "nation").execute("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 FOR UPDATE")


# --- C. joins ---------------------------------------------------------------------------

same("c1_inner_theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
same("c2_left_join", "SELECT n.n_name, COUNT(c.c_custkey) AS n FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey AND c.c_mktsegment = 'BUILDING' GROUP BY n.n_name", "nation", "customer")
same("c3_cartesian", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", "region", "nation")
same("c4_lookup_join", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "orders", "customer")
same("c5_prefix_range_join", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber >= a.l_linenumber - 2 AND b.l_linenumber < a.l_linenumber", "lineitem")
same("c6_join_mixed", "SELECT COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal", "orders", "customer")
same("c7_derived_join", "SELECT c.c_name, d.n FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) d ON d.o_custkey = c.c_custkey WHERE d.n > 15", "customer", "orders")
same("c8_multi_join", f"SELECT r.r_name, CAST(SUM({D('l.l_extendedprice')}) AS DECIMAL(38,4)) AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", "lineitem", "orders", "customer", "nation", "region")
same("c9_self_join", "SELECT COUNT(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", "supplier")


@pair("c10_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def _semi(spark, sf_dir):
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_size = 1")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"], "left_semi").select("l_orderkey", "l_linenumber")


# --- D. aggregation ---------------------------------------------------------------------


@pair("agg_pricing", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM({D('l_quantity')}) AS DECIMAL(38,4)) AS sum_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def _agg_pricing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(exact.decimal("l_quantity")).cast("decimal(38,4)").alias("sum_qty")).orderBy("l_returnflag", "l_linestatus")


same("d1_count_rows", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O'", "orders")
same("d2_count_expression", "SELECT COUNT(CASE WHEN p_size > 25 THEN p_size END) AS n FROM part", "part")
same("d3_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", "lineitem")
same("d4_sum", f"SELECT CAST(SUM(l_linenumber) AS BIGINT) AS a, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS b, CAST(SUM({D('l_tax')}) AS DECIMAL(38,4)) AS c FROM lineitem", "lineitem")
same("d6_min_max", "SELECT MIN(o_orderdate) AS a, MAX(o_orderdate) AS b, MIN(o_orderpriority) AS c, MAX(o_custkey) AS d FROM orders", "orders")
same("d7_aggregate_expression", f"SELECT l_linestatus, CAST(SUM(CAST({D('l_extendedprice')} * (1 - {D('l_discount')}) AS DECIMAL(30,8))) AS DECIMAL(38,8)) AS revenue FROM lineitem GROUP BY l_linestatus", "lineitem")
same("d8_global_aggregate", "SELECT COUNT(*) AS n, MIN(p_size) AS lo, MAX(p_size) AS hi FROM part", "part")
same("d9_group_by", "SELECT l_suppkey, l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag", "lineitem")
same("d10_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) BETWEEN 12 AND 15 AND MAX(o_orderkey) > 1000", "orders")
same("d11_having_global", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 10", "orders")
same("d13_order_groups", "SELECT p_brand, p_size, COUNT(*) AS n FROM part GROUP BY p_brand, p_size ORDER BY p_brand, p_size DESC", "part")
same("d8_empty_aggregate", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_custkey) AS m FROM orders WHERE o_orderkey < 0", "orders")


@pair("d5_average", "SELECT o_orderstatus, CAST(SUM(o_custkey) // COUNT(o_custkey) AS BIGINT) AS a FROM orders GROUP BY 1")
def _average(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(exact.average("o_custkey").alias("a"))


@pair("d5_decimal_average", "SELECT l_returnflag, CAST(trunc(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) * 100 // COUNT(*)) / 100 AS DECIMAL(18,2)) AS a FROM lineitem GROUP BY 1")
def _decimal_average(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(exact.decimal_average(exact.decimal("l_extendedprice", 2), 2).alias("a"))


@pair("d12_having_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey > 14000")
def _having_rows(spark, sf_dir):
    """HAVING without an aggregate filters rows."""
    return table(spark, sf_dir, "orders").select("o_orderkey").filter("o_orderkey > 14000")


@pair("d15_inferred_schema", "SELECT n_regionkey, CAST(COUNT(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def _inferred(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).write.parquet(path)
    return spark.read.parquet(path)


# The shapes of the published benchmark: count, full and half range scans, order, sum.
same("bench_count", "SELECT COUNT(*) AS n FROM lineitem", "lineitem")
same("bench_range_full", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 0", "lineitem")
same("bench_range_half", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= (SELECT MAX(l_orderkey) FROM lineitem) / 2", "lineitem")
same("bench_order_by", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber", "lineitem")
same("bench_sum", "SELECT CAST(SUM(l_orderkey) AS BIGINT) AS s FROM lineitem", "lineitem")


@pair("d14_result_types", "SELECT * FROM (VALUES ('n', 'bigint'), ('s', 'decimal(38,4)'), ('lo', 'bigint'), ('a', 'decimal(22,4)')) t(name, kind)")
def _result_types(spark, sf_dir):
    """Types that aggregates have before any row is read."""
    text = f"SELECT COUNT(*) AS n, CAST(SUM({D('o_totalprice')}) AS DECIMAL(38,4)) AS s, MIN(o_orderkey) AS lo, CAST(AVG({D('o_totalprice')}) AS DECIMAL(22,4)) AS a FROM orders"
    shape = sql_over(spark, sf_dir, text, "orders").schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in shape], "name string, kind string")



# --- E. windows -------------------------------------------------------------------------

TOTAL = D("o_totalprice")
same("e1_row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders", "orders")
QUERIES["e1_row_number"] = lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("rn"))


same("e11_window_projection", "SELECT o_orderkey, UPPER(o_orderpriority) AS p, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 10 + 1 AS place FROM orders", "orders")
QUERIES["e11_window_projection"] = lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", F.upper("o_orderpriority").alias("p"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") * 10 + 1).alias("place"))


@pair("e2_e3_ranks", "SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part")
def _ranks(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"))


@pair("e4_window_aggregates", f"SELECT o_orderkey, COUNT(*) OVER w AS n, CAST(SUM({TOTAL} + 1) OVER w AS DECIMAL(38,4)) AS s, MIN(o_orderkey) OVER w AS lo, MAX(o_orderkey) OVER w AS hi, CAST(SUM(o_orderkey) OVER w // COUNT(*) OVER w AS BIGINT) AS a FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _window_aggregates(spark, sf_dir):
    w = rows_window(["o_custkey"], ["o_orderkey"])
    total = exact.decimal("o_totalprice")
    average = F.call_function("div", F.sum("o_orderkey").over(w), F.count("*").over(w))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.count("*").over(w).alias("n"), F.sum(total + 1).over(w).cast("decimal(38,4)").alias("s"), F.min("o_orderkey").over(w).alias("lo"), F.max("o_orderkey").over(w).alias("hi"), average.alias("a"))


@pair("e5_partition_by", "SELECT l_orderkey, l_linenumber, COUNT(*) OVER (PARTITION BY l_returnflag, l_suppkey) AS n FROM lineitem")
def _partition(spark, sf_dir):
    w = Window.partitionBy("l_returnflag", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("n"))


@pair("e6_window_order", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC, o_orderkey) AS rn FROM orders")
def _window_order(spark, sf_dir):
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_orderpriority"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"))


@pair("e7_default_frame", "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
def _default_frame(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum("o_orderkey").over(rows_window(["o_custkey"], ["o_orderkey"])).alias("s"))


@pair("e8_rows_frame", f"SELECT o_orderkey, CAST(SUM({TOTAL}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS DECIMAL(38,4)) AS s, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING) AS n FROM orders")
def _rows_frame(spark, sf_dir):
    a, b = rows_window(["o_custkey"], ["o_orderkey"], -2, 2), rows_window(["o_custkey"], ["o_orderkey"], 2, 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum(exact.decimal("o_totalprice")).over(a).cast("decimal(38,4)").alias("s"), F.count("*").over(b).alias("n"))


@pair("e9_range_frame", "SELECT o_orderkey, CAST(SUM(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
def _range_frame(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum("o_custkey").over(range_window(["o_orderstatus"], "o_orderkey", 10, 0)).alias("s"))


@pair("e10_window_over_groups", "SELECT o_orderpriority, n, RANK() OVER (ORDER BY n, o_orderpriority) AS r FROM (SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1) g")
def _window_over_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return groups.withColumn("r", F.rank().over(Window.orderBy("n", "o_orderpriority")).cast("long"))


# --- F. sort, limit, top-k --------------------------------------------------------------

same("f1_order_by", "SELECT c_custkey, c_name FROM customer ORDER BY c_nationkey, c_custkey DESC", "customer")
same("f2_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35", "orders")
same("f4_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")


@pair("f5_limit", "SELECT CAST(10 AS BIGINT) AS n")
def _limit(spark, sf_dir):
    """Any ten rows; their number is what is fixed."""
    return table(spark, sf_dir, "orders").limit(10).agg(F.count("*").alias("n"))


@pair("f6_top_k_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 3")
def _top_k(spark, sf_dir):
    return top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rn").cast("long"))


# --- G. common table expressions --------------------------------------------------------

same("g1_cte", "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey FROM a WHERE n > 12) SELECT c.c_name FROM customer c JOIN b ON b.o_custkey = c.c_custkey", "orders", "customer")
CHAIN = "WITH RECURSIVE r(id, depth) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT r.id * 2, r.depth + 1 FROM r WHERE r.id < 10000) SELECT id, depth FROM r"


@pair("g2_recursive_union_all", CHAIN)
def _recursive_all(spark, sf_dir):
    return recursive_union_all(spark, CHAIN)


@pair("g2_recursive_join", "WITH RECURSIVE t(id, lvl) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.lvl + 1 FROM t JOIN nation n ON n.n_nationkey = t.id * 2 + 1 OR n.n_nationkey = t.id * 2 + 2) SELECT id, lvl FROM t")
def _recursive_join(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return recursive_union_all(spark, ORACLES["g2_recursive_join"])


@pair("g3_recursive_union", "WITH RECURSIVE n AS (SELECT MAX(c_custkey) + 1 AS n FROM customer), e AS (SELECT c_custkey AS src, c_custkey * 2 % n AS dst FROM customer, n UNION ALL SELECT c_custkey, (c_custkey * 2 + 1) % n FROM customer, n), r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def _recursive_set(spark, sf_dir):
    """Reachability over a graph with cycles of all customers."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    twice = F.col("c_custkey") * 2
    n = customers.agg(F.max("c_custkey") + 1).first()[0] or 1
    edges = customers.select(F.col("c_custkey").alias("src"), F.explode(F.array(twice % n, (twice + 1) % n)).alias("dst"))
    start = spark.range(1, 2).select(F.col("id").alias("node"))
    return recursive_union(start, lambda new: new.join(edges, new["node"] == edges["src"]).select("dst"))


# --- H. scalar functions ----------------------------------------------------------------


@pair("h1_json_valid", "SELECT event_id, CAST(json_valid(CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END) AS BIGINT) AS v FROM events")
def _json_valid(spark, sf_dir):
    broken = F.when(F.col("event_id") % 3 == 0, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", docs.valid(broken).alias("v"))


@pair("h2_h3_json_extract_unquote", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS quoted, json_extract_string(props, '$.k') AS plain FROM events")
def _json_extract(spark, sf_dir):
    found = docs.extract("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", found.alias("quoted"), docs.unquote(found).alias("plain"))


@pair("h4_json_type", "SELECT event_id, json_type(props) AS t FROM events")
def _json_type(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", docs.kind("props").alias("t"))


@pair("h5_json_length", "SELECT event_id, CAST(len(json_keys(props)) AS BIGINT) AS n FROM events")
def _json_length(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", docs.length("props").alias("n"))


@pair("h6_h7_json_build", """SELECT n_nationkey, '{"name": "' || n_name || '", "region": ' || n_regionkey || ', "none": null}' AS o, '[' || n_nationkey || ', "' || n_name || '"]' AS a FROM nation""")
def _json_build(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", docs.build_object("name", F.col("n_name"), "region", F.col("n_regionkey"), "none", F.lit(None).cast("string")).alias("o"), docs.build_array(F.col("n_nationkey"), F.col("n_name")).alias("a"))


@pair("h8_json_set", """SELECT event_id, rtrim(props, '}') || ', "seen": ' || user_id || '}' AS doc FROM events""")
def _json_set(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", docs.assign("props", "$.seen", F.col("user_id")).alias("doc"))


@pair("h3_json_path_native", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", docs.unquoted("props", "$.k").alias("k"))


same("h11_coercion", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey AS VARCHAR(20)) AS t FROM orders", "orders")
QUERIES["h11_coercion"] = lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").cast("string").alias("t"))
same("h12_decimal", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p2, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,0)) AS p0 FROM orders", "orders")


@pair("h13_dates", "SELECT * FROM (VALUES ('2024-02-29', DATE '2024-02-29'), ('2023-02-29', NULL), ('2024-1-xx', NULL)) t(s, d)")
def _dates(spark, sf_dir):
    return spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-1-xx",)], "s string").select("s", F.expr("try_to_date(s, 'yyyy-MM-dd')").alias("d"))


@pair("h10_version", "SELECT 'quillon 1' AS v, 'VERSION()' AS quoted")
def _version(spark, sf_dir):
    return _engine(spark, sf_dir).execute("SELECT VERSION() AS v, 'VERSION()' AS quoted")


@pair("h14_unhex", "SELECT n_nationkey, decode(unhex(hex(n_name))) AS t FROM nation")
def _unhex(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.unhex(F.hex("n_name")).cast("string").alias("t"))


same("h14_hex", "SELECT n_nationkey, hex(n_name) AS h FROM nation", "nation")


# --- I. statements that change rows -----------------------------------------------------

CUSTOMER = "c_custkey", "c_name", "c_nationkey"
#: The customers of a nation under their own keys, which the table has, and under new ones.
INCOMING = "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 1 UNION ALL SELECT c_custkey + 20000000000, c_name, c_nationkey FROM customer WHERE c_nationkey = 1"


def _customers(spark, sf_dir) -> VersionedTable:
    rows = table(spark, sf_dir, "customer").select(*CUSTOMER)
    return VersionedTable.create(rows, scratch(spark), ["c_custkey"])


@pair("i1_insert", "SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL VALUES (CAST(10000000001 AS BIGINT), 'new', 3), (10000000002, 'new too', NULL)")
def _insert(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.insert(spark.createDataFrame([(10000000001, "new", 3), (10000000002, "new too", None)], "c_custkey long, c_name string, c_nationkey int"))
    return t.read()


@pair("i2_insert_select", "SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT c_custkey + 20000000000, c_name, c_nationkey FROM customer WHERE c_nationkey = 1")
def _insert_select(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.insert(table(spark, sf_dir, "customer").filter("c_nationkey = 1").select((F.col("c_custkey") + 20000000000).alias("c_custkey"), "c_name", "c_nationkey"))
    return t.read()


@pair("i3_create_as_select", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY 1")
def _ctas(spark, sf_dir):
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return VersionedTable.create(counted, scratch(spark), ["c_nationkey"]).read()


@pair("i4_upsert", "SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN c_name || '!' ELSE c_name END AS c_name, c_nationkey FROM customer UNION ALL SELECT c_custkey + 20000000000, c_name, c_nationkey FROM customer WHERE c_nationkey = 1")
def _upsert(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.upsert(sql_over(spark, sf_dir, INCOMING, "customer"), {"c_name": F.concat("c_name", F.lit("!"))})
    return t.read()


@pair("i5_replace", "SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'r' ELSE c_name END AS c_name, c_nationkey FROM customer UNION ALL SELECT c_custkey + 20000000000, 'r', c_nationkey FROM customer WHERE c_nationkey = 1")
def _replace(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.replace(sql_over(spark, sf_dir, INCOMING, "customer").withColumn("c_name", F.lit("r")))
    return t.read()


@pair("i6_update", "SELECT c_custkey, CASE WHEN c_nationkey = 2 THEN 'n' || (c_nationkey + 1) ELSE c_name END AS c_name, CASE WHEN c_nationkey = 2 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer")
def _update(spark, sf_dir):
    """The second assignment sees the first."""
    t = _customers(spark, sf_dir)
    t.update(F.col("c_nationkey") == 2, {"c_nationkey": F.col("c_nationkey") + 1, "c_name": F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))})
    return t.read()


@pair("i7_delete", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE NOT (c_nationkey < 5)")
def _delete(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.delete(F.col("c_nationkey") < 5)
    return t.read()


@pair("i8_key_check", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def _key_check(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@pair("i9_reference_check", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 2)")
def _reference_check(spark, sf_dir):
    from quillon.sources.store import orphans

    return orphans(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").filter("c_nationkey > 2"), "c_custkey").select("o_orderkey")


def _engine(spark, sf_dir, *names: str):
    from quillon.plans.engine import Engine

    e = Engine(spark, scratch(spark))
    for name in names:
        e.register(name, table(spark, sf_dir, name))
    return e


def _members(spark, sf_dir, action: str):
    """Nations and their customers, with a reference between them."""
    e = _engine(spark, sf_dir, "nation", "customer")
    e.execute("CREATE TABLE land (id INT PRIMARY KEY, name TEXT NOT NULL)")
    e.execute(f"CREATE TABLE member (id INT PRIMARY KEY, land INT, FOREIGN KEY (land) REFERENCES land (id) ON DELETE {action} ON UPDATE CASCADE)")
    e.execute("INSERT INTO land SELECT n_nationkey, n_name FROM nation")
    e.execute("INSERT INTO member SELECT c_custkey, c_nationkey FROM customer")
    e.execute("DELETE FROM land WHERE id < 5")
    e.execute("UPDATE land SET id = 100 WHERE id = 7")
    return e.execute("SELECT id, land FROM member")


@pair("i9_reference_cascade", "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(CASE WHEN c_nationkey = 7 THEN 100 ELSE c_nationkey END AS BIGINT) AS land FROM customer WHERE c_nationkey >= 5")
def _cascade(spark, sf_dir):
    return _members(spark, sf_dir, "CASCADE")


@pair("i9_reference_set_null", "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(CASE WHEN c_nationkey < 5 THEN NULL WHEN c_nationkey = 7 THEN 100 ELSE c_nationkey END AS BIGINT) AS land FROM customer")
def _set_null(spark, sf_dir):
    return _members(spark, sf_dir, "SET NULL")


@pair("i9_reference_refused", "SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AS refused FROM nation")
def _refused(spark, sf_dir):
    """Which nations a deletion is refused for: those that a customer refers to."""
    e = _engine(spark, sf_dir, "nation", "customer")
    e.execute("CREATE TABLE land (id INT PRIMARY KEY)")
    e.execute("CREATE TABLE member (id INT PRIMARY KEY, land INT REFERENCES land (id))")
    e.execute("INSERT INTO land SELECT n_nationkey FROM nation")
    e.execute("INSERT INTO member SELECT c_custkey, c_nationkey FROM customer")
    try:
        e.execute("DELETE FROM land")
        raise AssertionError("the deletion went through")
    except Conflict:
        left = e.execute("SELECT id FROM land")
    used = e.execute("SELECT DISTINCT land FROM member")
    return left.join(used, left["id"] == used["land"], "left").select(F.col("id").cast("int").alias("n_nationkey"), F.col("land").isNotNull().alias("refused"))


@pair("i11_check_option", "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS land FROM customer")
def _check_option(spark, sf_dir):
    """Rows that a view with a check option wouldn't show are refused; the others go in."""
    e = _engine(spark, sf_dir, "customer")
    e.execute("CREATE TABLE member (id INT PRIMARY KEY, land INT)")
    e.execute("CREATE VIEW low AS SELECT id, land FROM member WHERE land < 10 WITH CHECK OPTION")
    e.execute("CREATE VIEW rest AS SELECT id, land FROM member WHERE land >= 10 WITH CHECK OPTION")
    try:
        e.execute("INSERT INTO low SELECT c_custkey, c_nationkey FROM customer")
        raise AssertionError("rows outside the view went in")
    except Exception as found:  # noqa: BLE001 - the check fails within a task
        if "outside" not in str(found):
            raise
    e.execute("INSERT INTO low SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 10")
    e.execute("INSERT INTO rest SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey >= 10")
    return e.execute("SELECT id, land FROM member")


# --- J. definitions ---------------------------------------------------------------------


@pair("j1_column_options", "SELECT CAST(row_number() OVER () AS BIGINT) AS id, 'none' AS note, CAST(7 AS BIGINT) AS n FROM customer")
def _column_options(spark, sf_dir):
    """Numbers and defaults for rows that leave their columns out."""
    e = _engine(spark, sf_dir, "customer")
    e.execute("CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, land INT, note VARCHAR(8) NOT NULL DEFAULT 'none', n INT DEFAULT 7)")
    e.execute("INSERT INTO t (land) SELECT c_nationkey FROM customer")
    return e.execute("SELECT id, note, n FROM t")


@pair("j3_unique_index", "SELECT n_name, CAST(COUNT(*) AS BIGINT) AS n FROM nation GROUP BY n_name")
def _unique_index(spark, sf_dir):
    """A repeated name is refused once the index is there."""
    e = _engine(spark, sf_dir, "nation")
    e.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    e.execute("INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    e.execute("CREATE UNIQUE INDEX by_name ON t (name)")
    try:
        e.execute("INSERT INTO t SELECT n_nationkey + 1000, n_name FROM nation")
        raise AssertionError("repeated names went in")
    except Conflict:
        return e.execute("SELECT name AS n_name, COUNT(*) AS n FROM t GROUP BY name")


@pair("j10_show_index", "SELECT * FROM (VALUES ('PRIMARY', CAST(1 AS BIGINT), 'id', CAST(0 AS BIGINT)), ('by_name', 1, 'name', 0), ('by_both', 1, 'id', 1), ('by_both', 2, 'name', 1)) t(index_name, seq_in_index, column_name, non_unique)")
def _show_index(spark, sf_dir):
    e = _engine(spark, sf_dir)
    e.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    e.execute("CREATE UNIQUE INDEX by_name ON t (name)")
    e.execute("CREATE INDEX by_both ON t (id, name)")
    return e.execute("SHOW INDEX FROM t").select("index_name", "seq_in_index", "column_name", "non_unique")


@pair("j2_alter_table", "SELECT c_custkey, c_name AS title, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(0 AS BIGINT) AS points FROM customer")
def _alter(spark, sf_dir):
    e = _engine(spark, sf_dir, "customer")
    e.execute("CREATE TABLE t AS SELECT c_custkey, c_name, c_nationkey FROM customer")
    e.execute("ALTER TABLE t RENAME COLUMN c_name TO title")
    e.execute("ALTER TABLE t MODIFY COLUMN c_nationkey TEXT")
    e.execute("ALTER TABLE t ADD COLUMN points INT")
    e.execute("ALTER TABLE t ADD COLUMN spare DATE")
    e.execute("ALTER TABLE t DROP COLUMN spare")
    e.execute("ALTER TABLE t RENAME TO member")
    return e.execute("SELECT * FROM member")


@pair("j5_view", "SELECT n_name, COUNT(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _view(spark, sf_dir):
    sql_over(spark, sf_dir, "SELECT n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey", "nation", "customer").createOrReplaceTempView("v_members")
    return spark.sql("SELECT n_name, COUNT(*) AS n FROM v_members GROUP BY n_name")


@pair("j6_j7_materialised_view", "SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def _matview(spark, sf_dir):
    from quillon.plans.matviews import MaterialisedView

    t = _customers(spark, sf_dir)
    view = MaterialisedView(spark, scratch(spark), {"t": t}, lambda s: s["t"].groupBy("c_nationkey").agg(F.count("*").alias("n")))
    view.refresh()
    t.delete(F.col("c_custkey") % 2 == 1)
    view.refresh()
    return view.read()


@pair("j8_incremental_refresh", "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'seven' ELSE c_name END AS c_name FROM customer WHERE c_nationkey > 3 AND c_custkey <> 11")
def _incremental(spark, sf_dir):
    from quillon.plans.matviews import MaterialisedView

    t = _customers(spark, sf_dir)
    view = MaterialisedView(spark, scratch(spark), {"t": t}, lambda s: s["t"].filter("c_nationkey > 3").select("c_custkey", "c_name"), row_key=["c_custkey"])
    view.refresh()
    t.update(F.col("c_custkey") == 7, {"c_name": F.lit("seven")})
    t.delete(F.col("c_custkey") == 11)
    view.refresh()
    return view.read()


@pair("j1_create_table", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(1.5000 AS DECIMAL(18,4)), DATE '2024-01-02'), (2, '', CAST(0 AS DECIMAL(18,4)), DATE '2024-01-03')) t(id, name, price, d)")
def _create_table(spark, sf_dir):
    from quillon.plans.engine import Engine

    e = Engine(spark, scratch(spark))
    e.execute("CREATE TABLE IF NOT EXISTS t (id INT, name VARCHAR(10), price DECIMAL, d DATE, PRIMARY KEY (id), KEY k (name)) ENGINE=x")
    e.execute("INSERT INTO t VALUES (1, 'a', 1.5, DATE '2024-01-02')")
    e.execute("INSERT INTO t (id, d) VALUES (2, DATE '2024-01-03')")
    return e.execute("SELECT * FROM t")


@pair("i10_updatable_view", "SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'seven' ELSE c_name END AS c_name, c_nationkey FROM customer WHERE NOT (c_nationkey = 7 AND c_custkey < 100)")
def _updatable_view(spark, sf_dir):
    from quillon.plans.engine import Engine

    e = Engine(spark, scratch(spark))
    e.register("customer", table(spark, sf_dir, "customer"))
    e.execute("CREATE TABLE c AS SELECT c_custkey, c_name, c_nationkey FROM customer")
    e.execute("CREATE VIEW seven AS SELECT c_custkey, c_name, c_nationkey FROM c WHERE c_nationkey = 7")
    e.execute("UPDATE seven SET c_name = 'seven'")
    e.execute("DELETE FROM seven WHERE c_custkey < 100")
    return e.execute("SELECT * FROM c")


@pair("j11_explain", None)
def _explain(spark, sf_dir):
    from quillon.plans.engine import Engine

    e = Engine(spark, scratch(spark))
    e.register("orders", table(spark, sf_dir, "orders"))
    return e.execute("EXPLAIN SELECT o_custkey, COUNT(*) FROM orders WHERE o_orderkey > 5 GROUP BY o_custkey")


# --- K. procedures ----------------------------------------------------------------------

SCRIPT = """
BEGIN
  DECLARE total BIGINT DEFAULT 0;
  DECLARE i BIGINT DEFAULT 0;
  steps: WHILE i < 100 DO
    SET i = i + 1;
    IF i % 2 = 0 THEN ITERATE steps; END IF;
    IF i > 20 THEN LEAVE steps; END IF;
    SET total = total + i;
  END WHILE;
  SELECT total AS total, i AS i;
END
"""


@pair("k2_k3_blocks_and_loops", "SELECT CAST(100 AS BIGINT) AS total, CAST(21 AS BIGINT) AS i")
def _script(spark, sf_dir):
    """Odd numbers up to 20, by a scripted loop."""
    return spark.sql(SCRIPT)


@pair("k1_procedure_call", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey < 300 GROUP BY 1")
def _procedure(spark, sf_dir):
    from quillon.plans.engine import Engine

    e = Engine(spark, scratch(spark))
    e.register("orders", table(spark, sf_dir, "orders"))
    e.procedure("by_status", lambda db, below: db.execute(f"SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey < {below} GROUP BY o_orderstatus"))
    e.execute("SET @below = 300")
    return e.execute("CALL by_status(@below)")


@pair("k1_procedure_text", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey < 300 GROUP BY 1")
def _procedure_text(spark, sf_dir):
    e = _engine(spark, sf_dir, "orders")
    e.execute("CREATE PROCEDURE by_status(IN below INT, OUT doubled INT) BEGIN SET doubled = below * 2; SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey < below GROUP BY o_orderstatus; END")
    e.execute("CALL by_status(150, @next)")
    return e.execute("CALL by_status(@next, @next)")


@pair("k4_cursor", "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS total, CAST(COUNT(*) AS BIGINT) AS n FROM nation")
def _cursor(spark, sf_dir):
    """A sum by a cursor and a handler for its end."""
    e = _engine(spark, sf_dir, "nation")
    e.execute("""CREATE PROCEDURE add_up(OUT total INT, OUT n INT)
    BEGIN
      DECLARE key_of, done INT DEFAULT 0;
      DECLARE c CURSOR FOR SELECT n_nationkey FROM nation ORDER BY n_nationkey;
      DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1;
      SET total = 0, n = 0;
      OPEN c;
      rows: LOOP
        FETCH c INTO key_of;
        IF done = 1 THEN LEAVE rows; END IF;
        SET total = total + key_of, n = n + 1;
      END LOOP rows;
      CLOSE c;
    END""")
    e.execute("CALL add_up(@total, @n)")
    return e.execute("SELECT CAST(@total AS BIGINT) AS total, CAST(@n AS BIGINT) AS n")


@pair("k5_handlers", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL VALUES (-1, '23000'), (-2, 'mine 45000')")
def _handlers(spark, sf_dir):
    """A repeated key is caught, as is a condition that is signalled."""
    e = _engine(spark, sf_dir, "nation")
    e.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    e.execute("""CREATE PROCEDURE fill()
    BEGIN
      DECLARE state, what TEXT DEFAULT '';
      DECLARE CONTINUE HANDLER FOR SQLEXCEPTION GET DIAGNOSTICS CONDITION 1 state = RETURNED_SQLSTATE, what = MESSAGE_TEXT;
      INSERT INTO t SELECT n_nationkey, n_name FROM nation;
      INSERT INTO t SELECT n_nationkey, n_name FROM nation;
      INSERT INTO t VALUES (-1, state);
      SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'mine';
      INSERT INTO t VALUES (-2, CONCAT(what, ' ', state));
    END""")
    e.execute("CALL fill()")
    return e.execute("SELECT id, name FROM t")


@pair("k6_dynamic_statement", "SELECT COUNT(*) AS n FROM part WHERE p_size < 9")
def _dynamic(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("EXECUTE IMMEDIATE 'SELECT COUNT(*) AS n FROM part WHERE p_size < ?' USING 9")


@pair("k8_triggers", "SELECT n_nationkey, upper(n_name) AS n_name FROM nation")
def _triggers(spark, sf_dir):
    from quillon.plans.engine import Engine

    e = Engine(spark, scratch(spark))
    e.register("nation", table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("int")))
    e.execute("CREATE TABLE t AS SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 0")
    e.trigger("BEFORE", "INSERT", "t", lambda rows: rows.withColumn("n_name", F.upper("n_name")))
    e.execute("INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    return e.execute("SELECT n_nationkey, n_name FROM t")


@pair("k8_trigger_text", "SELECT CAST(c_custkey AS BIGINT) AS id, upper(c_name) AS name, CAST(c_nationkey AS BIGINT) AS was, CAST(c_nationkey + 1 AS BIGINT) AS now FROM customer WHERE c_nationkey < 3")
def _trigger_text(spark, sf_dir):
    """A trigger changes the rows that come, another notes each change."""
    e = _engine(spark, sf_dir, "customer")
    e.execute("CREATE TABLE member (id INT PRIMARY KEY, name TEXT, land INT)")
    e.execute("CREATE TABLE moved (id INT PRIMARY KEY, name TEXT, was INT, now INT)")
    e.execute("CREATE TRIGGER loud BEFORE INSERT ON member FOR EACH ROW SET NEW.name = UPPER(NEW.name)")
    e.execute("CREATE TRIGGER note AFTER UPDATE ON member FOR EACH ROW INSERT INTO moved VALUES (NEW.id, NEW.name, OLD.land, NEW.land)")
    e.execute("INSERT INTO member SELECT c_custkey, c_name, c_nationkey FROM customer")
    e.execute("UPDATE member SET land = land + 1 WHERE land < 3")
    return e.execute("SELECT id, name, was, now FROM moved")


@pair("k8_before_update", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey > 9 THEN 'TRIG' ELSE n_name END AS name FROM nation")
def _before_update(spark, sf_dir):
    """What a BEFORE trigger sets is what is stored."""
    e = _engine(spark, sf_dir, "nation")
    e.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    e.execute("INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    e.execute("CREATE TRIGGER own BEFORE UPDATE ON t FOR EACH ROW SET NEW.name = 'TRIG'")
    e.execute("UPDATE t SET name = 'statement' WHERE id > 9")
    return e.execute("SELECT id, name FROM t")


# --- L. change streams ------------------------------------------------------------------


def _changed(spark, sf_dir) -> VersionedTable:
    t = _customers(spark, sf_dir)
    t.update(F.col("c_nationkey") == 4, {"c_name": F.lit("four")})
    t.delete(F.col("c_nationkey") == 5)
    return t


@pair("l2_change_events", "SELECT CAST(2 AS BIGINT) AS lsn, 'PUT' AS op, c_custkey FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 3, 'DELETE', c_custkey FROM customer WHERE c_nationkey = 5")
def _events(spark, sf_dir):
    """The feed after the first statement, drained by a stream."""
    from quillon.streaming.changefeed import drain, subscribe

    t, path = _changed(spark, sf_dir), scratch(spark)
    drain(subscribe(t, from_lsn=1, keys_only=True), lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/b={n}"), f"{path}-at")
    return spark.read.parquet(path).select("lsn", "op", "c_custkey")


@pair("l4_filtered_events", "SELECT CAST(3 AS BIGINT) AS lsn, c_custkey FROM customer WHERE c_nationkey = 5")
def _filtered_events(spark, sf_dir):
    return _changed(spark, sf_dir).changes().filter("op = 'DELETE'").select("lsn", "c_custkey")


@pair("l6_show_events", "SELECT CAST(1 AS BIGINT) AS lsn, c_custkey FROM customer WHERE c_custkey < 20")
def _show_events(spark, sf_dir):
    from quillon.streaming.changefeed import events

    return events(_changed(spark, sf_dir), limit=20).select("lsn", "c_custkey")


@pair("l7_latest_state", "SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN 'four' ELSE c_name END AS c_name, c_nationkey FROM customer WHERE c_nationkey <> 5")
def _latest(spark, sf_dir):
    from quillon.streaming.changefeed import Replica, drain, subscribe

    t, path = _changed(spark, sf_dir), scratch(spark)
    replica = Replica(spark, f"{path}/replica", ["c_custkey"], t.read())
    drain(subscribe(t), replica.apply, f"{path}/at")
    return replica.read()


@pair("l7_latest_state_batch", ORACLES["l7_latest_state"])
def _latest_batch(spark, sf_dir):
    t = _changed(spark, sf_dir)
    return replay(t.read().limit(0), t.changes(), ["c_custkey"])


# --- M. beside one statement ------------------------------------------------------------


@pair("m7_read_only_batch", "SELECT 'customer' AS name, COUNT(*) AS n FROM customer UNION ALL SELECT 'nation', COUNT(*) FROM nation UNION ALL SELECT 'orders', COUNT(*) FROM orders")
def _batch(spark, sf_dir):
    """Queries at the same time, their results in order."""
    e = _engine(spark, sf_dir, "customer", "nation", "orders")
    names = ["customer", "nation", "orders"]
    found = e.batch([f"SELECT COUNT(*) AS n FROM {name}" for name in names])
    return spark.createDataFrame([(name, rows[0]["n"]) for name, rows in zip(names, found, strict=True)], "name string, n long")


@pair("m8_query_cache", "SELECT CAST(c_nationkey AS BIGINT) AS land, COUNT(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1")
def _query_cache(spark, sf_dir):
    """A cached result goes once a statement changes its table."""
    e = _engine(spark, sf_dir, "customer")
    e.execute("CREATE TABLE member (id INT PRIMARY KEY, land INT)")
    e.execute("INSERT INTO member SELECT c_custkey, c_nationkey FROM customer")
    e.execute("SET query_cache = on")
    e.execute("SELECT land, COUNT(*) AS n FROM member GROUP BY land").count()
    e.execute("DELETE FROM member WHERE land = 3")
    return e.execute("SELECT land, COUNT(*) AS n FROM member GROUP BY land")
