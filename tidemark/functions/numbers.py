"""Number expressions whose rounding and gaps must be exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity: -2.5 gives -2."""
    return F.floor(x + F.lit(0.5))


def share(part: Column, whole: Column) -> Column:
    """``part`` in hundredths of ``whole``; null unless the whole is positive."""
    return F.when(whole > 0, part / whole * 100)


def upper_median(x: Column) -> Column:
    """Element floor(n/2) in ascending order, never an average; nulls don't count, no values give null."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {_sql(x)} DESC)").cast("double")


def _sql(x: Column) -> str:
    return x._jc.toString() if hasattr(x, "_jc") else str(x)


def log_or_null(x: Column) -> Column:
    """log10 for positive values, null otherwise."""
    return F.when(x > 0, F.log10(F.when(x > 0, x)))


def sum_or_null(*cols: Column) -> Column:
    """The sum of those that are known, null if none is."""
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0))
    return F.when(F.coalesce(*cols).isNotNull(), total)
