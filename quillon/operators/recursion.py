"""Recursive queries with set semantics.

Recursive UNION ALL is Spark SQL's WITH RECURSIVE; UNION, which ends on cycles because no
row is taken twice, is a semi-naive loop here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.session import scratch

#: Rounds, and those after which what was found is written as one table again.
DEPTH, TOGETHER = 1000, 8


class TooDeep(RuntimeError):
    pass


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written under the checkpoint folder that the session names, and read again:
    ends the lineage and survives a lost executor."""
    path = scratch(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def recursive_union(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int = DEPTH) -> DataFrame:
    """All rows of ``anchor`` and of ``step`` of new rows, each once. Each round applies
    ``step`` only to the rows that the round before has added. More than ``depth`` rounds
    is an error, nothing is cut off."""
    spark = anchor.sparkSession
    fresh = written(spark, anchor.distinct())
    every = fresh
    for n in range(1, depth + 1):
        made = step(fresh).toDF(*anchor.columns).distinct()
        matches = [made[c].eqNullSafe(every[c]) for c in anchor.columns]
        condition = matches[0]
        for m in matches[1:]:
            condition = condition & m
        fresh = written(spark, made.join(every, condition, "left_anti"))
        if fresh.isEmpty():
            return every
        every = every.unionByName(fresh)
        if n % TOGETHER == 0:
            every = written(spark, every)
    raise TooDeep(f"recursion goes deeper than {depth} rounds")


def recursive_union_all(spark: SparkSession, text: str, depth: int = DEPTH, rows: int = 1_000_000) -> DataFrame:
    """Runs a query that starts WITH RECURSIVE under the engine's depth; the session's own
    limits are set back once the query is planned. More than ``rows`` rows are an error."""
    names = {"spark.sql.cteRecursionLevelLimit": str(depth), "spark.sql.cteRecursionRowLimit": str(rows)}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        found = spark.sql(text)
        return written(spark, found)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
