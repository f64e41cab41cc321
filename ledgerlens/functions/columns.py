"""Column expressions used throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The number, or null for NaN and infinities."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bounds a number; null stays null (greatest and least would skip it)."""
    x = col(c)
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def log_amount(c: Column | str) -> Column:
    """log1p of an amount clipped at 0; null passes through."""
    return F.log1p(clip(finite(c), low=0.0) + F.lit(1e-8))


def md5_int(*parts: Column, digits: int = 8) -> Column:
    """A non-negative integer from the leading hex digits of the md5 of the joined parts: equal in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, digits), 16, 10).cast("bigint")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def improvement(new: Column, old: Column, higher_is_better: bool = True) -> Column:
    """Percent change in the good direction; the base is floored at 1e-12."""
    base = F.greatest(F.abs(old), F.lit(1e-12))
    return (new - old if higher_is_better else old - new) / base * 100


def cut_label(c: Column | str, longest: int = 22) -> Column:
    """Long names end in an ellipsis, for reports."""
    x = col(c)
    return F.when(F.length(x) > longest, F.concat(F.substring(x, 1, longest - 1), F.lit("…"))).otherwise(x)
