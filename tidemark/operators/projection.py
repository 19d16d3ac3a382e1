"""Projections of days and months that are not over, trends and scaled series."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numbers import round_half_up
from tidemark.operators import scan
from tidemark.operators.scan import places

MIN_SAMPLES, DONE = 5, 0.98


def end_of_day(readings: DataFrame, as_of: dt.date, *, day: str = "date", bucket: str = "bucket", metric: str = "metric", value: str = "value") -> DataFrame:
    """Per metric the final value expected for ``as_of``, from how far past days had come at the same bucket.

    ``readings`` are cumulative values, one a metric, day and bucket.  The completion at a bucket is the upper-middle
    median of past days' ratios to their last reading; it needs five days and must lie between 0 and 0.98.
    """
    by_day = [metric, day]
    final = readings.groupBy(*by_day).agg(F.max_by(value, bucket).alias("final"), F.max(bucket).alias("last_bucket"))
    past = readings.where(F.col(day) != F.lit(as_of)).join(final.where("final > 0").drop("last_bucket"), by_day)
    past = past.withColumn("_ratio", F.col(value) / F.col("final"))
    done = past.groupBy(metric, bucket).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _ratio DESC)").cast("double").alias("fraction"), F.count("*").alias("samples"))
    today = final.where(F.col(day) == F.lit(as_of)).select(metric, F.col("last_bucket").alias(bucket), F.col("final").alias("partial"))
    out = today.join(done, [metric, bucket]).where((F.col("samples") >= MIN_SAMPLES) & (F.col("fraction") > 0) & (F.col("fraction") < DONE))
    return out.withColumn("projected", round_half_up(F.col("partial") / F.col("fraction")))


def month_projection(total: Column, month: Column, as_of: dt.date) -> Column:
    """The month's total carried on to its end, for the month of ``as_of`` only; that day counts as complete."""
    days = calendar.monthrange(as_of.year, as_of.month)[1]
    return F.when(month == F.lit(f"{as_of:%Y-%m}"), round_half_up(total * days / as_of.day))


def trend(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``trend``: the regression line over row numbers (null rows count as places), rounded and not below 0.

    Fewer than two values give the values themselves.  With ``by`` a key's rows are one window; without it the table is
    one series of any length.
    """
    y, x = F.col(value), F.col("_i")
    if by:
        w = Window.partitionBy(*by)
        df = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1)
        known, slope, intercept = (f.over(w) for f in (F.count(value), F.regr_slope(y, x), F.regr_intercept(y, x)))
    else:
        df = places(df, [order], "_i").withColumn("_i", F.col("_i") - 1).drop("_i_all")
        line = df.agg(F.count(value).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
        known, slope, intercept = (line.select(c).scalar() for c in line.columns)
    fitted = F.greatest(F.lit(0), round_half_up(F.round(slope * x + intercept, 6)))
    return df.withColumn("trend", F.when(y.isNull(), None).when(known < 2, y).otherwise(fitted)).drop("_i")


def running_total(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``running``: nulls inside keep the total, leading ones give 0, trailing ones stay null; ``by`` as in ``trend``."""
    y = F.col(value)
    if by:
        w = Window.partitionBy(*by)
        last = F.max(F.when(y.isNotNull(), F.col(order))).over(w)
        total = F.sum(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("running", F.when(F.col(order) <= last, F.coalesce(total, F.lit(0))))
    out = scan.scan(df, [order], {"running": scan.total(y), "_known": scan.count(y)})
    more = y.isNotNull() | (F.coalesce("_known", F.lit(0)) < F.col("_known_all"))
    return out.select(*df.columns, F.when(more, F.coalesce("running", F.lit(0))).alias("running"))


def normalized(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``normalized``: parts of the series' greatest value; null where that is 0."""
    top = F.max(value).over(Window.partitionBy(*by)) if by else df.agg(F.max(value)).scalar()
    return df.withColumn("normalized", F.when(top != 0, F.col(value) / top))


def increments(df: DataFrame, order: str, value: str, by: Sequence[str]) -> DataFrame:
    """Adds ``increment``: the difference from the row before, null on a series' first row."""
    return df.withColumn("increment", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


def tail_flag(df: DataFrame, order: str, rows: int, by: Sequence[str] = (), name: str = "provisional") -> DataFrame:
    """Marks the last ``rows`` rows of each series; ``by`` as in ``trend``."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc())) <= rows)
    return places(df, [order], "_at").withColumn(name, F.col("_at_all") - F.col("_at") < rows).drop("_at", "_at_all")
