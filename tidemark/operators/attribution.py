"""Preferred sources, and counts shared out among places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def priority(source: str, preferred: Sequence[str]) -> Column:
    """0 for the first preferred source, and so on; those not named come last."""
    out = None
    for i, s in enumerate(preferred):
        out = F.when(F.col(source) == s, i) if out is None else out.when(F.col(source) == s, i)
    return F.lit(0) if out is None else out.otherwise(len(preferred))


def pick_by_priority(df: DataFrame, keys: Sequence[str], source: str, preferred: Sequence[str], then: Sequence[Column]) -> DataFrame:
    """One row a key: of the most preferred source, then by ``then``."""
    w = Window.partitionBy(*keys).orderBy(priority(source, preferred), *then)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def drop_covered(df: DataFrame, keys: Sequence[str], source: str, preferred: str) -> DataFrame:
    """Rows of the preferred source, and of others where that source has no row for the key."""
    first = df.where(F.col(source) == preferred)
    rest = df.where(F.col(source) != preferred).join(first.select(*keys).distinct(), list(keys), "left_anti")
    return first.unionByName(rest)


def fair_share(children: DataFrame, keys: Sequence[str], place: str, count: Column, group_size: Column) -> DataFrame:
    """Per key and place the greatest of ``count / group_size``: duplicates of a report don't add up, groups share."""
    return children.groupBy(*keys, place).agg(F.max(count / group_size).alias("attributed"))


def coverage(totals: DataFrame, shares: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """Totals with what is attributed to places, and what is not (never below 0; 0 where the total is unknown)."""
    sums = shares.groupBy(*keys).agg(F.sum(F.when(F.col("attributed") > 0, F.col("attributed"))).alias("attributed"))
    out = totals.join(sums, list(keys), "left").withColumn("attributed", F.coalesce("attributed", F.lit(0.0)))
    gap = F.greatest(F.lit(0.0), F.col(total) - F.col("attributed"))
    return out.withColumn("unattributed", F.when(F.col(total).isNull(), F.lit(0.0)).otherwise(gap))


def last_snapshot(df: DataFrame, keys: Sequence[str], snapshot: str) -> DataFrame:
    """Rows of each key's last snapshot, ties kept; rows without one go."""
    w = Window.partitionBy(*keys).orderBy(F.col(snapshot).desc())
    return df.where(F.col(snapshot).isNotNull()).withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")
