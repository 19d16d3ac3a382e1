"""Statistic bundles, coverage and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cell(x: Column) -> Column:
    """A whole number that grows with ``x``: its sign and size, in sixteenths of a doubling; NaN comes last, as in sorting."""
    far = 1 << 20
    size = lambda a: F.when(a == float("inf"), far).otherwise(F.floor(F.log2(a) * 16).cast("int") + (1 << 16))
    return F.when(F.isnan(x), far + 1).when(x > 0, size(x)).when(x < 0, -size(-x)).otherwise(0)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """A row for each key and value, with ``n`` and the ``cell`` of values of near size; null values are counted too."""
    return df.groupBy(*by, value).agg(F.count("*").alias("n")).withColumn("cell", F.when(F.col(value).isNotNull(), _cell(F.col(value))))


def upper_medians(counts: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Per key of ``value_counts`` the upper-middle median of the known values: the first, from the greatest down, that half of them reach.

    Selection by counting: the cell that holds the place is found from the cells' counts, of which a key has some thousand at
    most, then the place in that cell alone.  Values stay rows throughout, so that no buffer grows with their number.
    """
    known = counts.where(F.col(value).isNotNull())
    series = Window.partitionBy(*by)

    def at_middle(rows: DataFrame, order: str) -> DataFrame:
        """The row of each key at which the values up to it outnumber the others."""
        upto = F.sum("n").over(series.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
        return rows.withColumn("upto", upto).where((2 * (F.col("upto") - F.col("n")) <= F.col("whole")) & (F.col("whole") < 2 * F.col("upto")))

    cells = known.groupBy(*by, "cell").agg(F.sum("n").alias("n")).withColumns({"whole": F.sum("n").over(series), "below": F.lit(0)})
    middle = at_middle(cells, "cell").select(*[F.col(k).alias(f"_{k}") for k in by], F.col("cell").alias("_cell"), "whole", (F.col("upto") - F.col("n")).alias("below"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] + [F.col("cell") == F.col("_cell")]
    return at_middle(known.join(middle, same), value).select(*by, F.col(value).alias(name))


def stat_bundle(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), nulls: str = "skip") -> DataFrame:
    """Per metric (and key) the greatest value, the upper-middle median and the total, 0 where there is none.

    The metrics are unpivoted and their values counted first, so that one aggregation serves them all.  ``nulls='zero'``
    counts nulls as 0.
    """
    number = lambda m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) if nulls == "zero" else F.col(m).cast("double")
    keys = [*by, "metric"]
    counts = value_counts(df.select(*by, *[number(m).alias(m) for m in metrics]).unpivot(list(by), list(metrics), "metric", "value"), keys, "value")
    whole = counts.groupBy(*keys).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("max_value"), F.round(F.coalesce(F.sum(F.col("value") * F.col("n")), F.lit(0.0)), 4).alias("total_value"))
    medians = upper_medians(counts, keys, "value").select(*[F.col(k).alias(f"_{k}") for k in keys], "median")
    out = whole.join(medians, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return out.select(*keys, "max_value", F.coalesce("median", F.lit(0.0)).alias("median_value"), "total_value")


def data_window(df: DataFrame, day: str, newest: Column | None = None) -> DataFrame:
    """First and last day, and the newest reading of the last day."""
    aggs = [F.min(day).alias("first_date"), F.max(day).alias("last_date")]
    if newest is not None:
        aggs.append(F.max_by(newest, F.struct(F.col(day), newest)).alias("newest"))
    return df.agg(*aggs)


def peak_per_day(df: DataFrame, day: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(day, *by).agg(F.max(value).alias(value))


def pivot_all(df: DataFrame, keys: Sequence[str], category: str, names: Sequence[str], value: Column) -> DataFrame:
    """A column per category, 0 where it has no rows, and ``all``: the sum over every category, also those not named."""
    cells = [F.coalesce(F.sum(F.when(F.col(category) == n, value)), F.lit(0)).alias(n) for n in names]
    return df.groupBy(*keys).agg(*cells, F.coalesce(F.sum(value), F.lit(0)).alias("all"))


def grouped_columns(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Adds a column per group: the sum of its columns, nulls as 0."""
    return df.withColumns({g: sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0)) for g, cols in groups.items()})


def rolled_up(df: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates for ``by``, for each of its beginnings, and over all; ``level`` counts the columns that hold, the others are null."""
    level = sum((1 - F.grouping(c).cast("int") for c in by), F.lit(0))
    return df.rollup(*by).agg(*aggs, level.alias("level"))
