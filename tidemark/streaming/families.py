"""Parents and their children as two streams that meet within a span of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.versioned import best_per_key
from tidemark.operators.writers import VersionStore


def families(parents: DataFrame, children: DataFrame, keys: Sequence[str], at: str, child_at: str, *, within: str = "1 hour", early: str = "0 seconds", late: str = "2 days") -> DataFrame:
    """Parents with each of their children, as (``keys``…, parent, child), both as structs.

    A child belongs to the parent with its ``keys`` if its time is at most ``early`` before and ``within`` after the parent's.
    Pairs come as soon as both are there.  A parent that no child has joined, and a child without a parent, come alone, the
    other null, once the watermark (``late`` behind both streams) rules out that one follows.  Of a parent that is
    repeated within the watermark the first row counts.  Rows later than the watermark are dropped; null keys join nothing.
    State holds what may still be joined: ``late`` and the span, no more.
    """
    once = parents.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
    side = lambda df, name, time: df.select(F.struct("*").alias(name), F.col(time).alias(f"_{name}_at"), *[F.col(k).alias(f"_{name}_{k}") for k in keys])
    p, c = side(once, "parent", at), side(children.withWatermark(child_at, late), "child", child_at)
    same = [F.col(f"_parent_{k}") == F.col(f"_child_{k}") for k in keys]
    span = F.col("_child_at").between(F.col("_parent_at") - F.expr(f"interval {early}"), F.col("_parent_at") + F.expr(f"interval {within}"))
    on = span
    for s in same:
        on = on & s
    joined = p.join(c, on, "full_outer")
    return joined.select(*[F.coalesce(f"_parent_{k}", f"_child_{k}").alias(k) for k in keys], "parent", "child")


def append_families(joined: DataFrame, store: VersionStore, child_store: VersionStore, checkpoint: str, *, version: Column, child_version: Column, orphans: str | None = None) -> StreamingQuery:
    """Stores what ``families`` gives: children under the change test of their store, then parents under theirs.

    A reader who finds a parent finds the children that came with it.  A batch that runs again after a failure finds its
    rows stored and unchanged.  Children without a parent go to the folder ``orphans``, a part a batch, else nowhere.
    ``version`` and ``child_version`` are columns of the parent and of the child.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            kids = batch.where("parent is not null and child is not null").select("child.*")
            child_store.append_changed(best_per_key(kids, child_store.keys, [child_version.desc(), F.xxhash64("*")]), child_version)
            whole = batch.where("parent is not null").select("parent.*")
            store.append_changed(best_per_key(whole, store.keys, [version.desc(), F.xxhash64("*")]), version)
            if orphans:
                batch.where("parent is null").select("child.*").write.mode("overwrite").parquet(f"{orphans}/batch={n}")
        finally:
            batch.unpersist()

    return joined.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
