"""Windows with the engine's default frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def rows_window(partition: list[str | Column] | None, order: list[str | Column] | None, start: int | None = None, end: int = 0) -> WindowSpec:
    """ROWS frames: unbounded preceding to the current row unless given otherwise, with an
    order or without one."""
    spec = Window.partitionBy(*(partition or []))
    if order:
        spec = spec.orderBy(*order)
    return spec.rowsBetween(Window.unboundedPreceding if start is None else start, end)


def range_window(partition: list[str | Column] | None, key: str | Column, before: int, after: int) -> WindowSpec:
    """Rows whose key is within [key - before, key + after]; one numeric key, ascending."""
    return Window.partitionBy(*(partition or [])).orderBy(key).rangeBetween(-before, after)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each group: the optimiser keeps k rows a group before the
    shuffle (a window group limit), so a large group doesn't meet whole in one task."""
    spec = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).filter(F.col(rank) <= k)
