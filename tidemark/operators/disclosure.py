"""Sums over rows of which some withhold their value: unknown is not zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def disclosed_sums(df: DataFrame, keys: Sequence[str], withheld: Column, values: dict[str, Column]) -> DataFrame:
    """Per key the sums of disclosed values (null if none is) and ``hidden``, how many rows withhold theirs."""
    sums = [F.sum(F.when(~withheld, v)).alias(name) for name, v in values.items()]
    return df.groupBy(*keys).agg(*sums, F.sum(withheld.cast("long")).alias("hidden"))


def dense_daily(df: DataFrame, day: str, chosen: Column, withheld: Column, value: Column) -> DataFrame:
    """Every day of ``df`` with the chosen rows' total: 0 on days without such a row, null where it was withheld."""
    own = df.where(chosen).groupBy(day).agg(F.sum(F.when(~withheld, value)).alias("value"), F.sum(withheld.cast("long")).alias("hidden"))
    out = df.select(day).distinct().join(own, day, "left")
    return out.withColumn("value", F.when(F.col("hidden").isNull(), F.lit(0.0)).otherwise(F.col("value"))).withColumn("hidden", F.coalesce("hidden", F.lit(0)))
