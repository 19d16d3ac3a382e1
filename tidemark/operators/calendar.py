"""Inclusive calendar windows, spines without gaps, and labels for days and months."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_date(text: str | None, default: dt.date) -> dt.date:
    """The day in ``YYYY-MM-DD``; the default where the text is no such day."""
    if text and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            return dt.date.fromisoformat(text)
        except ValueError:
            return default
    return default


def today_in(zone: str, now: dt.datetime | None = None) -> dt.date:
    """The day in a zone at a moment (aware; now if not given)."""
    from zoneinfo import ZoneInfo

    return (now or dt.datetime.now(dt.UTC)).astimezone(ZoneInfo(zone)).date()


def day_window(df: DataFrame, day: str, end: dt.date, days: int) -> DataFrame:
    """The ``days`` days up to ``end``, both ends included."""
    return df.where(F.col(day).between(F.lit(end - dt.timedelta(days=days - 1)), F.lit(end)))


def lookback(df: DataFrame, day: str, as_of: dt.date, days: int = 90) -> DataFrame:
    """From ``days`` days before ``as_of`` on, that day included."""
    return df.where(F.col(day) >= F.lit(as_of - dt.timedelta(days=days)))


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_window(df: DataFrame, month: str, end: dt.date, months: int | None) -> DataFrame:
    """Rows of the ``months`` months up to that of ``end``; all up to it with None."""
    df = df.where(F.col(month) <= F.lit(f"{end:%Y-%m}"))
    if months is None:
        return df
    first = end.year * 12 + end.month - months
    return df.where(F.col(month) >= F.lit(f"{first // 12:04d}-{first % 12 + 1:02d}"))


def weekdays(df: DataFrame, day: str, wanted: Sequence[int]) -> DataFrame:
    """Days of the week, Sunday being 0; none wanted means all."""
    return df.where((F.dayofweek(day) - 1).isin(*wanted)) if wanted else df


def spine(spark: SparkSession, start: dt.date, end: dt.date, name: str = "date") -> DataFrame:
    """One row a day from ``start`` to ``end``."""
    days = F.sequence(F.lit(start), F.lit(end)) if start <= end else F.array().cast("array<date>")
    return spark.range(1).select(F.explode(days).alias(name))


def fill_days(df: DataFrame, day: str, start: dt.date, end: dt.date, keep: Column | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """Every day of the range, with nulls where ``df`` has no row; ``keep`` (on the day) filters added days only.

    Of several rows for a day the last by ``order`` stays; without an order ``df`` has one row a day.
    """
    days = spine(df.sparkSession, start, end, day)
    if order:
        rank = F.row_number().over(Window.partitionBy(day).orderBy(*[c.desc() for c in order]))
        df = df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    known = df.withColumn("_real", F.lit(True))
    out = days.join(known, day, "left")
    if keep is not None:
        out = out.where(F.col("_real") | keep)
    return out.drop("_real")


def pad_months(df: DataFrame, month: str, end: dt.date) -> DataFrame:
    """Adds the months after the last one up to ``end``'s, with nulls; gaps before stay, an empty input stays empty."""
    first = F.to_date(F.concat(F.max(month), F.lit("-01")))
    last = F.lit(end.replace(day=1))
    after = df.agg(first.alias("first")).where(F.col("first") < last)
    missing = after.select(F.explode(F.sequence(F.add_months("first", 1), last, F.expr("interval 1 month"))).alias("d"))
    return df.unionByName(missing.select(month_of(F.col("d")).alias(month)), allowMissingColumns=True)


def first_gap(df: DataFrame, day: str, after: dt.date, end: dt.date) -> DataFrame:
    """Rows after ``after`` and before the first day that has none."""
    days = spine(df.sparkSession, after + dt.timedelta(days=1), end + dt.timedelta(days=1), day)
    gap = days.join(df.select(day).distinct(), day, "left_anti").agg(F.min(day).alias("_gap"))
    return df.where(F.col(day) > F.lit(after)).join(F.broadcast(gap), F.col(day) < F.col("_gap")).drop("_gap")


def thursday_week(day: Column) -> Column:
    """The Thursday that begins the day's week."""
    return F.date_sub(day, F.pmod(F.datediff(day, F.lit(dt.date(1970, 1, 1))), F.lit(7)))


def monday_week(day: Column) -> Column:
    return F.trunc(day, "week")


def whole_month(start: Column, end: Column) -> Column:
    """True for a period that is exactly one calendar month."""
    return (F.dayofmonth(start) == 1) & (F.last_day(start) == end)
