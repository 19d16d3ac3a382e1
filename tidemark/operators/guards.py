"""Checks on a batch before it is written; each gives the offending rows or figures as a DataFrame, or raises."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.calendar import spine


class GuardError(ValueError):
    """A batch that must not be written."""


def floor(df: DataFrame, least: int) -> None:
    n = df.limit(least).count()
    if n < least:
        raise GuardError(f"{n} rows; at least {least} are expected")


def no_shrink(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> None:
    had, has = (d.select(*keys).distinct().count() for d in (stored, incoming))
    if has < had:
        raise GuardError(f"{has} keys; {had} are stored")


def unexplained_missing(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored keys that are missing, unless an incoming key equals one in all columns but one (a renamed key)."""
    had, has = (d.select(*keys).distinct() for d in (stored, incoming))
    missing = had.join(has, list(keys), "left_anti")
    for left_out in keys:
        rest = [k for k in keys if k != left_out]
        missing = missing.join(has.select(*rest).distinct(), rest, "left_anti")
    return missing


def shrink_tolerance(stored_keys: int) -> int:
    """How many unexplained missing keys are accepted."""
    return min(20, max(1, stored_keys // 100))


def shrink(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> None:
    n, most = unexplained_missing(stored, incoming, keys).count(), shrink_tolerance(stored.select(*keys).distinct().count())
    if n > most:
        raise GuardError(f"{n} stored keys are missing; {most} are accepted")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def header_drift(df: DataFrame, required: Sequence[str]) -> None:
    if missing := sorted(set(required) - set(df.columns)):
        raise GuardError(f"columns are missing: {', '.join(missing)}")


def unmapped_keys(df: DataFrame, map_col: str, known: Sequence[str]) -> DataFrame:
    """Keys of a map column that no one has mapped."""
    return df.select(F.explode(F.map_keys(map_col)).alias("key")).distinct().where(~F.col("key").isin(*known))


def child_mismatch(parents: DataFrame, children: DataFrame, keys: Sequence[str], total: str, part: str, tolerance: float = 0.0) -> DataFrame:
    """Parents with children whose parts don't sum up to the total."""
    sums = children.groupBy(*keys).agg(F.sum(part).alias("children"))
    return parents.select(*keys, total).join(sums, list(keys)).where(F.abs(F.col(total) - F.col("children")) > tolerance)


def gap_days(df: DataFrame, day: str, start: dt.date, end: dt.date, audited: DataFrame | None = None) -> DataFrame:
    """Days of the range without rows that aren't audited as silent."""
    gaps = spine(df.sparkSession, start, end, day).join(df.select(day).distinct(), day, "left_anti")
    return gaps if audited is None else gaps.join(audited.select(day), day, "left_anti")


def _band(x: Column, least: float, part: float) -> Column:
    """The band of a number: bands grow with it as the tolerance does.

    Two numbers of one band are within the tolerance, and two within the tolerance are at most three bands apart: up to
    where ``part`` outgrows ``least`` a band is half of ``least`` wide, from there on half of the logarithm of the widest ratio.
    """
    turn = least / part
    grown = F.log(x / turn) / -math.log1p(-part)
    return F.floor(2 * F.when(x <= turn, x / least).otherwise(1 / part + grown)).cast("long")


def unmatched_within(values: DataFrame, totals: DataFrame, value: str, total: str, least: float = 10.0, part: float = 0.1) -> DataFrame:
    """Values that match no total within ``max(least, part of the greater)``, each row by itself; null, NaN and infinity match nothing.

    Both are sorted into bands, of which few exist, and of a band's totals only the least and the greatest can be the nearest to
    a value of another one.  Values are joined by their band with those of the seven bands around it, so neither many values
    nor many totals of one size meet as pairs.
    """
    t = F.col(total).cast("double")
    ends = totals.where(t.isNotNull() & ~F.isnan(t)).groupBy(_band(t, least, part).alias("_at")).agg(F.min(t).alias("_low"), F.max(t).alias("_high"))
    ends = ends.select(F.explode(F.sequence(F.col("_at") - 3, F.col("_at") + 3)).alias("_band"), "_low", "_high")
    x = F.col(value).cast("double")
    near = lambda y: F.abs(x - y) <= F.greatest(F.lit(least), part * F.greatest(x, y))
    return values.join(ends, (F.when(~F.isnan(x), _band(x, least, part)) == F.col("_band")) & (near(F.col("_low")) | near(F.col("_high"))), "left_anti")


def plausible(count: Column, most: int = 5000) -> Column:
    """The count, null where it can't be true."""
    return F.when(count <= most, count)


def consistent_total(total: Column, parts: Column, fallback: Column) -> Column:
    """The total, unless a part exceeds it: then the fallback if that is no less than the part, else null."""
    return F.when(total >= parts, total).otherwise(F.when(fallback >= parts, fallback))


def within(value: Column, low: float, high: float) -> Column:
    """The value, null outside of ``low`` to ``high``."""
    return F.when(value.between(low, high), value)


def sane_report(total: Column, parts: Column, fallback: Column, *, places: tuple[int, int] = (5, 20), counts: tuple[int, int] = (0, 500)) -> Column:
    """(total, plausible): the total as ``consistent_total`` has it against the greatest of ``parts``, an array with a count a place.

    Plausible are reports with 5 to 20 places whose counts and total lie between 0 and 500; null counts say nothing.
    """
    good = consistent_total(total, F.coalesce(F.array_max(parts), F.lit(0)), fallback)
    known = F.filter(parts, lambda p: p.isNotNull())
    fits = F.size(parts).between(*places) & F.forall(known, lambda p: p.between(*counts)) & F.coalesce(good.between(*counts), F.lit(True))
    return F.struct(good.alias("total"), fits.alias("plausible"))
