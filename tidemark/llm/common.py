"""Helpers that several text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` computed once and written as a table in the shared folder, which cuts its lineage.

    A table rather than a checkpoint: its size is known, so that small ones are broadcast; a checkpoint goes on with
    the estimate of the plan it replaces, and in a loop these estimates multiply until planning takes all the time.
    Who gives the ``path`` may remove the table once nothing reads it.
    """
    path = path or scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders below the shared one, wherever that is, that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def there(spark: SparkSession, path: str) -> bool:
    """True if the file or folder exists."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the quick built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    An array that a lambda reads at many places must be bound like this: as a plain column, the optimizer may fold
    its expression into the lambda, which then builds the array anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) drawn from the columns' hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected ``edges(src, dst)`` as ``(node, component)``, the component being its least node.

    Every round each node points at the neighbour of least random rank and the graph is contracted along the
    pointers, so chains and stars alike shrink geometrically.  Only minima are gathered per node; a hub's edges
    are never brought together.  Nodes without a proper edge are absent from the result.  A round's tables are removed
    when the next one's are written.
    """
    spark, root = edges.sparkSession, scratch(edges.sparkSession, "components")
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    rest = cut(pairs.where("src <> dst").distinct(), f"{root}/rest")
    kind = rest.schema["src"].dataType
    placed, step, old = None, 0, [f"{root}/rest"]
    while not rest.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("r"), c.alias("id"))  # noqa: B023, E731
        both = rest.unionByName(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        best = both.groupBy("src").agg(F.min(rank(F.col("dst"))).alias("n"))
        jump = cut(best.select(F.col("src").alias("node"), F.least(F.col("n"), rank(F.col("src")))["id"].alias("to")), f"{root}/jump{step}")
        if placed is None:
            placed = jump.select("node", F.col("to").alias("label"))
        else:
            move = jump.select(F.col("node").alias("label"), "to")
            placed = placed.join(move, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        placed = cut(placed, f"{root}/placed{step}")
        a, b = (jump.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to")) for k in ("src", "dst"))
        moved = rest.join(a, "src").join(b, "dst").where("src_to <> dst_to")
        rest = cut(moved.select(F.least("src_to", "dst_to").alias("src"), F.greatest("src_to", "dst_to").alias("dst")).distinct(), f"{root}/rest{step}")
        remove(spark, f"{root}/jump{step}", *old)
        old = [f"{root}/placed{step}", f"{root}/rest{step}"]
        step += 1
    if placed is None:
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    least = placed.groupBy("label").agg(F.least(F.min("node"), F.col("label")).alias("component"))
    out = cut(placed.join(least, "label").select("node", "component"), f"{root}/found")
    remove(spark, *old)
    return out
