"""Exact fixed-point arithmetic.

Integers are 64-bit and overflow is an error (the session's ANSI mode). A decimal is
``decimal(18, s)``. Quotients have scale 4 and products the larger operand scale, both cut
toward zero; division by zero is an error. No step passes through a floating-point number.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4
WIDE = "decimal(38, {})"


def decimal(x: Column | str, scale: int = SCALE) -> Column:
    """Rounds half away from zero to ``scale``."""
    column = F.col(x) if isinstance(x, str) else x
    return F.round(column.cast(WIDE.format(18)), scale).cast(f"decimal(18, {scale})")


def truncate(x: Column, scale: int) -> Column:
    """Cuts a decimal toward zero at ``scale``."""
    unit = F.lit(Decimal(10) ** scale)
    whole = F.when(x < 0, F.ceil(x * unit)).otherwise(F.floor(x * unit))
    return (whole / unit).cast(f"decimal(18, {scale})")


def divide(a: Column, b: Column, scale: int = SCALE) -> Column:
    """a / b of integers, with ``scale`` digits, cut toward zero."""
    wide = (a.cast("decimal(19, 0)") * F.lit(10**scale)).cast("decimal(38, 0)")
    return (F.call_function("div", wide, b.cast("decimal(19, 0)")).cast("decimal(38, 0)") / F.lit(Decimal(10) ** scale)).cast(f"decimal(18, {scale})")


def multiply(a: Column, b: Column, scale: int) -> Column:
    """a * b of decimals at the larger operand scale, cut toward zero."""
    return truncate((a.cast("decimal(18, 6)") * b.cast("decimal(18, 6)")).cast("decimal(38, 12)"), scale)


def average(x: Column | str) -> Column:
    """Of integers: the sum over the count of those that aren't null, cut toward zero; null
    for none."""
    column = F.col(x) if isinstance(x, str) else x
    n = F.count(column)
    return F.when(n > 0, F.call_function("div", F.sum(column), n)).cast("bigint")


def decimal_average(x: Column | str, scale: int = SCALE) -> Column:
    """Of decimals, at their own scale, cut toward zero."""
    column = F.col(x) if isinstance(x, str) else x
    units = F.sum((column * F.lit(10**scale)).cast("decimal(28, 0)"))
    n = F.count(column)
    return F.when(n > 0, F.call_function("div", units, n.cast("decimal(20, 0)")).cast("decimal(38, 0)") / F.lit(Decimal(10) ** scale)).cast(f"decimal(18, {scale})")
