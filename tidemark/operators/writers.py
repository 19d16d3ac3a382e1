"""Writers that append versions only where something changed; a written path's files are never changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.versioned import VersionedTable, best_per_key, diff, merge_known


def _path(spark: SparkSession, path: str):
    """A path and the file system that it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; one a batch, hence few."""
    at, files = _path(spark, path)
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


@dataclass(frozen=True)
class WriteResult:
    """Keys of a batch by what became of them; a run without changes need not be published."""

    new: int
    revised: int
    unchanged: int

    @property
    def changed(self) -> bool:
        return bool(self.new or self.revised)


@dataclass(frozen=True)
class VersionStore:
    """A Parquet folder of versions: one folder a batch below it."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    version: str = "scraped_at"

    def read(self) -> DataFrame | None:
        """All versions, older batches' missing columns null; None before the first.  A store that can't be read is an error."""
        if not any(n.startswith("batch-") for n in _names(self.spark, self.path)):
            return None
        return self.spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(self.path)

    def latest(self) -> DataFrame | None:
        """Each key's newest version: from the newest snapshot and the batches since, else from all batches."""
        names = _names(self.spark, self.path)
        batches = {n for n in names if n.startswith("batch-")}
        for name in sorted((n for n in names if n.startswith("_latest-")), reverse=True):
            at = f"{self.path}/{name}"
            covered = {r[0] for r in self.spark.read.parquet(f"{at}/covers").collect()}  # one name a batch
            if covered <= batches:  # else one of them was taken back
                paths = [f"{at}/rows", *(f"{self.path}/{n}" for n in sorted(batches - covered))]
                return self._newest(self.spark.read.option("mergeSchema", "true").parquet(*paths))
        all_rows = self.read()
        return None if all_rows is None else self._newest(all_rows)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Ties go by a hash that neither the order of columns nor null ones change, so that snapshots agree with batches."""
        return VersionedTable(rows, self.keys, self.version).latest("one", [F.xxhash64(*sorted(c for c in rows.columns if c != self.version))])

    def snapshot(self, keep: int = 2) -> bool:
        """Writes what ``latest`` gives beside the batches, so that later runs read it and newer batches, not the history.

        False if no batch came since the last one.  The ``keep`` newest stay for readers that have begun with them.
        """
        names = _names(self.spark, self.path)
        batches, old = [n for n in names if n.startswith("batch-")], sorted(n for n in names if n.startswith("_latest-"))
        name = f"_latest-{len(batches):012d}"
        if not batches or name in old:
            return False
        staged = f"_staged-{uuid.uuid4().hex}"
        self.latest().write.parquet(f"{self.path}/{staged}/rows")
        self.spark.createDataFrame([(n,) for n in batches], "batch string").coalesce(1).write.parquet(f"{self.path}/{staged}/covers")
        self._show(staged, name)
        for gone in [*old, name][:-keep]:
            self._forget(gone)
        return True

    def _write(self, rows: DataFrame, version: Column, name: str | None = None) -> None:
        rows.withColumn(self.version, version).write.parquet(f"{self.path}/{name or f'batch-{uuid.uuid4().hex}'}")

    def _show(self, batch: str, to: str) -> None:
        """Renames a staged batch, which readers don't see, to one that they do."""
        at, files = _path(self.spark, f"{self.path}/{batch}")
        if not files.rename(at, _path(self.spark, f"{self.path}/{to}")[0]):
            raise OSError(f"{batch} can't be renamed")

    def _forget(self, batch: str) -> None:
        at, files = _path(self.spark, f"{self.path}/{batch}")
        files.delete(at, True)

    def append_changed(self, incoming: DataFrame, version: Column, compare: Sequence[str] | None = None, normalize: Callable[[Column], Column] | None = None, batch: str | None = None) -> WriteResult:
        """Appends keys that are new or differ in ``compare`` (all other columns by default); nulls are equal.

        ``normalize`` is applied to text before it is compared.  Columns new to the store are added.
        """
        compare = list(compare or [c for c in incoming.columns if c not in self.keys])
        old = self.latest()
        if old is None:
            marked = incoming.withColumn("status", F.lit("new"))
        else:
            old = old.select(*[c for c in old.columns if c != self.version])
            for c in compare:
                if c not in old.columns:
                    old = old.withColumn(c, F.lit(None).cast(incoming.schema[c].dataType))
            if normalize:
                side = {c: normalize(F.col(c)) for c in compare if incoming.schema[c].dataType.simpleString() == "string"}
                now = incoming.select(*self.keys, *[side.get(c, F.col(c)).alias(c) for c in compare])
                status = diff(old.withColumns(side), now, self.keys, compare).select(*self.keys, "status")
                marked = incoming.join(status, list(self.keys))
            else:
                marked = diff(old, incoming, self.keys, compare)
        marked = marked.persist()
        try:
            n = {r["status"]: r["count"] for r in marked.groupBy("status").count().collect()}  # three rows at most
            if n.get("new") or n.get("revised"):
                self._write(marked.where("status <> 'unchanged'").drop("status"), version, batch)
        finally:
            marked.unpersist()
        return WriteResult(n.get("new", 0), n.get("revised", 0), n.get("unchanged", 0))

    def append_known(self, incoming: DataFrame, version: Column, values: Sequence[str]) -> WriteResult:
        """As ``append_changed``, but null means no information: it changes nothing and stored values stay under it."""
        old = self.latest()
        if old is None:
            return self.append_changed(incoming, version, values)
        merged = merge_known(old.select(*self.keys, *values), incoming, self.keys, values)
        rest = incoming.count()
        done = self.append_changed(merged, version, values)
        return WriteResult(done.new, done.revised, rest - done.new - done.revised)

    def append_updated(self, incoming: DataFrame, version: Column, updated: str = "updated_at") -> WriteResult:
        """Appends unless the upstream's change time is known and equals the stored one; unknown always appends."""
        old = self.latest()
        if old is not None:
            same = old.where(F.col(updated).isNotNull()).select(*self.keys, updated)
            total = incoming.count()
            incoming = incoming.join(same, [*self.keys, updated], "left_anti").select(incoming.columns)
        kept = incoming.count()
        known = 0 if old is None else incoming.join(old.select(*self.keys), list(self.keys), "left_semi").count()
        if kept:
            self._write(incoming, version)
        return WriteResult(kept - known, known, (total - kept) if old is not None else 0)

    def append_with_children(self, parents: DataFrame, children: DataFrame, child_store: VersionStore, version: Column, compare: Sequence[str]) -> WriteResult:
        """Appends changed parents and, with the same version, their children, in batches of the same name.

        Both are staged out of readers' sight; the children's batch is shown first, then the parents'.  Batches that a
        run left behind when it failed in between are removed before: children's without the parents' of that name.
        Both stores are for this use only.
        """
        shown = {n for n in _names(self.spark, self.path) if n.startswith("batch-pair-")}
        for store, names in ((child_store, _names(self.spark, child_store.path)), (self, _names(self.spark, self.path))):
            for n in names:
                if n.startswith("_staged-") or n.startswith("batch-pair-") and n not in shown:
                    store._forget(n)
        old, name = self.latest(), uuid.uuid4().hex
        changed = parents if old is None else diff(old.drop(self.version), parents, self.keys, list(compare)).where("status <> 'unchanged'").drop("status")
        keys = changed.select(*self.keys).persist()
        try:
            keys.count()
            rows = children.join(keys, list(self.keys), "left_semi")
            with_children = not rows.isEmpty()
            if with_children:
                child_store._write(rows, version, f"_staged-{name}")
            done = self.append_changed(parents, version, compare, batch=f"_staged-{name}")
            if with_children:
                child_store._show(f"_staged-{name}", f"batch-pair-{name}")
            if done.changed:
                self._show(f"_staged-{name}", f"batch-pair-{name}")
            return done
        finally:
            keys.unpersist()

    def compact(self, to: str) -> VersionStore:
        """All batches rewritten as one under another path."""
        self.read().write.parquet(f"{to}/batch-{uuid.uuid4().hex}")
        return VersionStore(self.spark, to, self.keys, self.version)


def upsert(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], partition: str | None = None) -> None:
    """Rows replaced by key, the last write winning; only partitions that lose or get rows are rewritten.

    A key whose partition changes leaves its old one.  The staged copy goes when its rows are in place.
    """
    rows = incoming.withColumn("_new", F.lit(1))
    emptied: list = []
    if exists(spark, path):
        stored = spark.read.parquet(path)
        if partition:
            own = incoming.select(*keys).distinct()
            left = stored.join(own, list(keys), "left_semi").select(partition)
            touched = incoming.select(partition).unionByName(left).distinct().persist()
            before = {r[0] for r in left.distinct().collect()}  # one value a partition folder
            stored = stored.join(touched, partition, "left_semi")
            emptied = sorted(before, key=str)
        rows = rows.unionByName(stored.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    rows = best_per_key(rows, keys, [F.col("_new").desc(), F.xxhash64("*")]).drop("_new")
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"  # the input is among what is replaced
    rows.write.parquet(staged)
    written = spark.read.parquet(staged)
    if partition and emptied:
        full = {r[0] for r in written.select(partition).distinct().collect()}
        for value in emptied:
            if value not in full:  # all its rows moved away; overwriting wouldn't touch it
                at, files = _path(spark, f"{path.rstrip('/')}/{partition}={value}")
                files.delete(at, True)
    writer = written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    at, files = _path(spark, staged)
    files.delete(at, True)


def correction_hour(fetched_hour: Column) -> Column:
    """The hour under which a correction made on the next day is kept."""
    return fetched_hour + 24


def corrections(stored: DataFrame, fetched: DataFrame, day: str, hour: str, values: Sequence[str]) -> DataFrame:
    """Rows to append for days corrected later: those of ``fetched`` (hours of the clock, one row a day) that say something new.

    A day is compared with its last stored row from hour 24 on, nulls being equal; days without one are new.
    """
    last = stored.where(F.col(hour) >= 24).groupBy(day).agg(F.max_by(F.struct(*values), hour).alias("_last"))
    changed = F.col("_last").isNull() | ~F.struct(*values).eqNullSafe(F.col("_last"))
    return fetched.join(last, day, "left").where(changed).withColumn(hour, correction_hour(F.col(hour))).select(fetched.columns)


def replace_lookup(df: DataFrame, path: str) -> None:
    """A small table replaced as a whole: the new one is written beside it and takes its name, so that a failed write loses nothing.

    Between the two renames there is no table of that name for a moment; where readers must not see that, or several
    tables change together, ``editions`` swap them at once.
    """
    at, files = _path(df.sparkSession, path)
    new, old = (at.suffix(f"-{what}-{uuid.uuid4().hex}") for what in ("new", "old"))
    df.coalesce(1).write.parquet(new.toString())
    had = files.exists(at)
    if had and not files.rename(at, old) or not files.rename(new, at):
        if had and not files.exists(at):
            files.rename(old, at)
        raise OSError(f"{path} can't be replaced")
    files.delete(old, True)


def blank_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bulky columns emptied: '' where a column admits no nulls, null elsewhere."""
    return df.withColumns({c: F.lit(None if df.schema[c].nullable else "").cast(df.schema[c].dataType) for c in columns})


def add_columns(df: DataFrame, others: DataFrame) -> DataFrame:
    """Both sets of rows; columns that one side lacks are null there."""
    return df.unionByName(others, allowMissingColumns=True)


def mark_silent(days: DataFrame | None, day: str, note: str, data: DataFrame, spark: SparkSession, day_col: str = "report_date") -> DataFrame:
    """The table of audited silent days with ``day`` set; refused if the day has data."""
    if not data.where(F.col(day_col) == F.lit(day).cast("date")).isEmpty():
        raise ValueError(f"{day} has data")
    row = spark.createDataFrame([(day, note)], "d string, note string").select(F.to_date("d").alias(day_col), "note")
    return row if days is None else days.where(F.col(day_col) != F.lit(day).cast("date")).unionByName(row)


def reparsed(latest: DataFrame, text: str, accepted: Callable[[Column], Column], parsed: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Derived columns made anew from the stored text; rows whose text is no longer accepted go."""
    return latest.where(accepted(F.col(text))).withColumns({c: f(F.col(text)) for c, f in parsed.items()})
