"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int) -> Column:
    """Round half-even on the scaled binary value (array rounding, not HALF_UP)."""
    scale = float(10**digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a/b, NULL where b is 0 (also under ANSI mode)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def flag(cond: Column) -> Column:
    """0/1 flag; a comparison with a missing value counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(c: str | Column, lo: float, hi: float) -> Column:
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def log_ratio(a: str | Column, b: str | Column) -> Column:
    return F.log(ratio(a, b))

