"""Ordered folds over series: cumulative readings and run-length codes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A reading is suspect if the last good one was above this and it falls below this part of it.
SUSPECT_FROM, SUSPECT_PART = 100.0, 0.5


class LastGood:
    """The fold over one series of cumulative readings: the last good one, and whether any has been."""

    def __init__(self, last: float | None = None, seen: bool = False):
        self.last, self.seen = last, seen

    def step(self, value: float | None) -> float | None:
        """The increment that ``value`` (None if unknown) brings."""
        last, first = self.last, not self.seen
        self.seen = True
        if value is None or value != value or last is not None and last > SUSPECT_FROM and value < last * SUSPECT_PART:
            return None
        self.last = value
        return value - last if last is not None else value if first else None


def hold_last_good(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Increments of cumulative readings: per key and ``order`` the difference from the last good reading.

    A null reading (or NaN) gives null; the first known one gives itself on the series' first row and null later; a suspect
    drop gives null and the last good reading stays.  Equal places of a key are taken by value, the unknown first.
    Keys are dealt and sorted by Spark, and a task folds the rows as they come: of a series of any length it holds a batch.
    """
    marks = [F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)]
    rows = df.select(*keys, order, F.col(value).cast("double").alias("_v"), *[m.alias(f"_m{i}") for i, m in enumerate(marks)])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, order, "_v")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold = None, LastGood()
        for b in batches:
            out = []
            for v, *key in zip(*(b.column(c).to_pylist() for c in ("_v", "_m0", "_m1")), strict=True):
                if key != at:
                    at, fold = key, LastGood()
                out.append(fold.step(v))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keys, order)), pa.array(out, pa.float64())], [*keys, order, "increment"])

    kinds = T.StructType([*(df.schema[c] for c in (*keys, order)), T.StructField("increment", T.DoubleType())])
    return rows.mapInArrow(folded, kinds)


def rle_decode(codes: Column) -> Column:
    """Run-length codes as values: a negative number stands for so many zeros."""
    return F.flatten(F.transform(codes, lambda x: F.when(x < 0, F.array_repeat(F.lit(0), (-x).cast("int"))).otherwise(F.array(x.cast("int")))))


def rle_encode(values: Column) -> Column:
    """Values without negative ones as run-length codes: each run of zeros is one negative number, its length."""
    value = lambda k: F.get(values, k)
    ends = F.filter(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda c: (c["x"] != 0) | F.coalesce(value(c["i"] + 1) != 0, F.lit(True)))
    # a run of zeros ends at its last one; it began after the end before
    return F.transform(ends, lambda c, k: F.when(c["x"] != 0, c["x"].cast("int")).otherwise(-(c["i"] - F.coalesce(F.get(ends, k - 1)["i"], F.lit(-1)))))


def checked_rle(codes: Column, days: Column) -> Column:
    """Decoded values; an error if there aren't ``days`` of them."""
    values = rle_decode(codes)
    return F.when(F.size(values) == days, values).otherwise(F.raise_error(F.lit("run-length codes don't cover the days")).cast("array<int>"))


def bucket_sums(df: DataFrame, day: str, start: Column, value: str, days: int = 7) -> DataFrame:
    """Sums over buckets of ``days`` days from ``start`` on, each named by its first day; the last may be partial."""
    n = F.floor(F.datediff(F.col(day), start) / days).cast("int")
    return df.groupBy(F.date_add(start, n * days).alias("week")).agg(F.sum(value).alias(value))
