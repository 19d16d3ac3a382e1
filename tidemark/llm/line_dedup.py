"""Removal of lines that many documents repeat.

Line hashes live in levelled sorted runs: tables of ``(h1, h2, n, owner)`` bucketed and sorted by the hash, so that
runs are merged bucket by bucket without moving or sorting them again.  Batches of documents come from the largest
ids down.  A batch is reduced to one sorted run and merge-anti-joined with the runs so far: keys that no run holds
get their owner, the batch's largest id; keys seen before only bring their counts.  Two runs of a level are merged
into one of the next.  A key's owner thus is whoever the first run to hold it names, and no other entry names one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut, let, remove, scratch

BLANK = " \t\n\x0b\x0c\r"
KEYS = ["h1", "h2"]
#: Documents that a batch holds for each bucket, about; small inputs have MIN_BATCHES batches.
BUCKET_DOCS, MIN_BATCHES = 50_000, 3
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """Levelled runs of line keys, in as many buckets as there are shuffle partitions; the newest run comes last."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, scratch(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []

    @contextmanager
    def sorted_scans(self) -> Iterator[None]:
        """Within, scans of runs are known to be sorted, as every bucket is one file."""
        before = self.spark.conf.get(SORTED_SCANS, None)
        self.spark.conf.set(SORTED_SCANS, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(SORTED_SCANS) if before is None else self.spark.conf.set(SORTED_SCANS, before)

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        with self.sorted_scans():
            rows.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", f"{self.root}/{name}").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        """Oldest first."""
        return [run for level in reversed(self.levels) for run in level]

    def unseen(self, own: DataFrame) -> DataFrame:
        """The keys of ``own`` that no run holds."""
        for run in self.runs():
            own = own.hint("merge").join(run.select(*KEYS), KEYS, "left_anti")
        return own

    def owned(self, own: DataFrame) -> DataFrame:
        """``own`` with owners for unseen keys only."""
        return own.drop("owner").hint("merge").join(self.unseen(own).select(*KEYS, "owner"), KEYS, "left")

    @staticmethod
    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        """Both runs as one; at most one of a key's entries names an owner."""
        a, b = (run.select(*KEYS, F.col("n").alias(f"n_{k}"), F.col("owner").alias(f"owner_{k}")) for k, run in (("a", old), ("b", new)))
        n = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
        return a.hint("merge").join(b, KEYS, "full_outer").select(*KEYS, n.cast("long").alias("n"), F.coalesce("owner_b", "owner_a").alias("owner"))

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of ``(h1, h2, n, owner)``, one row a key."""
        run, level = self._write(batch), 0
        if self.runs():
            run = self._write(self.owned(run))
        while level < len(self.levels) and self.levels[level]:
            run = self._write(self.merged(self.levels[level].pop(), run))
            level += 1
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)

    def totals(self) -> DataFrame:
        """One row a key over all batches, by merging all runs into one: documents that hold it, and its owner."""
        *older, out = self.runs()
        for run in reversed(older):
            out = self._write(self.merged(run, out))
        self.levels = [[out]]
        return out

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.root)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int | None = None) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, ``n_lines`` (before) and ``n_dropped``.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` distinct ids lose all their lines save those
    under the largest id that holds them.  Null and empty text: one empty line, text ''.  Rows without an id keep all
    lines and count for nothing.  Rows that share an id count as one document, but each loses its own lines only, by
    its own text.  Ids are whole numbers of any size.  Texts of any length: lines are exploded, positions of dropped
    ones come back as one array a row.  Other columns pass through, whatever their names; input columns called
    ``n_lines`` or ``n_dropped`` are replaced.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"), F.struct("*").alias("row"))
    runs = LineRuns(spark)
    n = docs.where(F.col(id_col).isNotNull()).count()
    batches = batches or max(MIN_BATCHES, -(-n // (runs.buckets * BUCKET_DOCS)))
    cuts = [k / batches for k in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), cuts, 10_000)).first()[0] if n and cuts else []
    batch = sum(((F.col("id") <= b).cast("int") for b in bounds), F.lit(0))  # 0: the largest ids
    cells = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")))
    long_ones = F.filter(cells, lambda c: F.length(c["key"]) >= min_chars)
    lines = rows.where("id is not null").select("id", "t", F.explode(long_ones).alias("c"))
    lines = lines.select("id", "t", "c.pos", F.xxhash64("c.key").alias("h1"), F.xxhash64(F.lit(1), "c.key").alias("h2"), batch.alias("batch"))
    path = scratch(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("id long, t long, pos int, h1 long, h2 long, batch int").parquet(path)
    try:
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).groupBy(*KEYS).agg(F.count_distinct("id").alias("n"), F.max("id").alias("owner")))
        # as a table, so that a join on frequent lines can be split; it grows with the input
        often = cut(runs.totals().where(F.col("n") >= min_docs).select(*KEYS, "owner"), f"{path}-often")
    finally:
        runs.close()
    hits = lines.select("id", "t", "pos", *KEYS).join(often.hint("merge"), KEYS).where("id <> owner")
    gone = cut(hits.groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    remove(spark, path, f"{path}-often")
    rows = rows.join(gone.hint("merge"), ["id", "t"], "left")
    parts, dropped = F.split("text", "\n", -1), F.size("gone")

    def pieces(lines: Column) -> Column:
        def between(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get("gone", k - 1) + 1)
            return F.slice(lines, start + 1, F.coalesce(F.get("gone", k), F.size(lines)) - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), dropped), between))

    kept = F.array_join(let(parts, pieces), "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    counts = {"n_lines": F.size(parts).cast("long"), "n_dropped": F.coalesce(dropped, F.lit(0)).cast("long")}
    own = [(kept if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in counts]
    return rows.select(*own, *[v.alias(c) for c, v in counts.items()])
