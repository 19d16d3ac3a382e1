"""Append-only tables of versions: latest rows, history, and what an incoming batch changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class VersionedTable:
    """Rows with a natural key, of which the greatest version holds.

    ``pre_filter`` of ``latest`` goes below the version window; it must not depend on what changes between versions
    of a key, for Catalyst can push only predicates on the key below a window.
    """

    df: DataFrame
    keys: tuple[str, ...]
    version: str

    def latest(self, ties: str = "keep", order: Sequence[Column] = (), pre_filter: Column | None = None, null_versions: bool = False) -> DataFrame:
        """Rows of the greatest version.

        ``ties='keep'`` keeps all rows of it, ``'one'`` the first by ``order``.  Null versions are older than any
        other; with ``null_versions`` they are kept beside the latest, as an anti-join on newer rows would.
        """
        df = self.df if pre_filter is None else self.df.where(pre_filter)
        w = Window.partitionBy(*self.keys).orderBy(F.col(self.version).desc_nulls_last(), *(order if ties == "one" else ()))
        rank = (F.row_number() if ties == "one" else F.rank()).over(w)
        out = df.withColumn("_rank", rank)
        holds = F.col("_rank") == 1
        if null_versions:
            holds = holds | F.col(self.version).isNull()
        elif ties == "keep":
            holds = holds & F.col(self.version).isNotNull()
        return out.where(holds).drop("_rank")

    def as_of(self, version: object) -> VersionedTable:
        """The table as it was when ``version`` was the newest."""
        return VersionedTable(self.df.where(F.col(self.version) <= F.lit(version)), self.keys, self.version)

    def history(self) -> DataFrame:
        """Per key the number of versions, the first and the last."""
        v = F.col(self.version)
        return self.df.groupBy(*self.keys).agg(F.count_distinct(v).alias("versions"), F.min(v).alias("first_version"), F.max(v).alias("last_version"))

    def changes(self, compare: Sequence[str]) -> DataFrame:
        """Versions whose ``compare`` columns differ from the version before; a key's first version is a change."""
        w = Window.partitionBy(*self.keys).orderBy(self.version)
        same = _all([F.lag(c).over(w).eqNullSafe(F.col(c)) for c in compare])
        return self.df.withColumn("_same", same & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")


def diff(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """``incoming`` with ``status``: new, revised or unchanged against the latest ``stored`` rows (one a key); nulls are equal."""
    old = stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in compare], F.lit(True).alias("_known"))
    same = _all([F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in compare])
    status = F.when(F.col("_known").isNull(), "new").when(same, "unchanged").otherwise("revised")
    return incoming.join(old, list(keys), "left").withColumn("status", status).drop("_known", *[f"_old_{c}" for c in compare])


def merge_known(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows to write where null in ``incoming`` means no information: stored values stay under nulls.

    Only keys come back that are new or for which some incoming value is known and differs.
    """
    old = stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in values], F.lit(True).alias("_known"))
    changed = F.col("_known").isNull()
    for c in values:
        changed = changed | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_old_{c}")))
    merged = incoming.join(old, list(keys), "left").where(changed)
    return merged.select(*keys, *[F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in values])


def monotone_refresh(target: DataFrame, source: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``target`` with metrics raised to the source's where that is known and greater, or the target's is null."""
    src = source.select(*keys, *[F.col(c).alias(f"_src_{c}") for c in metrics])
    out = target.join(src, list(keys), "left")
    for c in metrics:
        new = F.col(f"_src_{c}")
        out = out.withColumn(c, F.when(new.isNotNull() & (F.col(c).isNull() | (new > F.col(c))), new).otherwise(F.col(c)))
    return out.drop(*[f"_src_{c}" for c in metrics])


def backfill(target: DataFrame, source: DataFrame, keys: Sequence[str], best: Sequence[Column]) -> DataFrame:
    """Source rows whose key the target lacks, the best one a key."""
    return best_per_key(source, keys, best).join(target.select(*keys).distinct(), list(keys), "left_anti")


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def with_parent_version(child: DataFrame, parent_latest: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Child rows of the parents' latest versions: they share key and version."""
    return child.join(parent_latest.select(*keys, version).distinct(), [*keys, version], "left_semi")


def signature(df: DataFrame, keys: Sequence[str], cells: Sequence[str], name: str = "signature") -> DataFrame:
    """Per key the sorted child cells, as one string whose equality is theirs.

    Separators inside values are escaped, and null is an escape that no value gives, so different cells never read alike.
    """
    value = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([\\|;])", r"\\$1"), F.lit("\\N"))
    cell = F.concat_ws("|", *[value(c) for c in cells])
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(cell)), ";").alias(name))
