"""MinHash near-duplicates by a multi-index Hamming join.

A text's shingle set is sketched by the low bits of many minima.  The first 80 symbols (8 bits each) are split into
chunks, so many that two sketches under the distance threshold differ, by pigeonhole, in at most one symbol of some
chunk; leaving out each symbol of each chunk in turn enumerates that one error, so that every pair under the
threshold meets in a bucket.  The thresholds, on these 80 and on all 455 symbols, lie four standard deviations above
the distance expected at the least similarity: for 0.85, 25 of 80 in 13 chunks, and 96 of 455.

Buckets are not expanded into pairs.  Each bucket's least member is compared with the others, and the links found
give first components.  Only members of different components are then joined within a bucket, under the distance
thresholds and at the first bucket that they share.  All links are confirmed on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, cut
from tidemark.llm.shingles import WordHashes, in_parts, mix, shingle_set

KEYED, MORE = 80, 375  # symbols of 8 and of 4 bits; the latter 15 to a long
_SYMBOLS = KEYED + MORE
_TAIL = MORE // 15


@dataclass(frozen=True)
class Scheme:
    """Thresholds on the keyed symbols and on all, and the keyed symbols of each chunk (a long each)."""

    near: int
    near_all: int
    chunks: tuple[int, ...]

    @classmethod
    def at(cls, percent: int) -> Scheme:
        """For pairs of at least ``percent`` hundredths; a pair at that similarity is missed once in ten thousand times."""
        p8, p4 = (1 - percent / 100) * 255 / 256, (1 - percent / 100) * 15 / 16
        mean, var = KEYED * p8, KEYED * p8 * (1 - p8)
        near = int(mean + 4.1 * var**0.5)
        n = near // 2 + 1
        whole = mean + MORE * p4, var + MORE * p4 * (1 - p4)
        return cls(near, int(whole[0] + 4.2 * whole[1] ** 0.5), tuple(KEYED // n + (k < KEYED % n) for k in range(n)))

    @property
    def longs(self) -> int:
        return len(self.chunks) + _TAIL


@cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, 2 * _SYMBOLS + 1, dtype=np.uint64)
    x = mix(n * np.uint64(0x9E3779B97F4A7C15))
    return x[:_SYMBOLS].astype(np.uint32) | np.uint32(1), x[_SYMBOLS:].astype(np.uint32)


def sketch(shingles: np.ndarray, scheme: Scheme) -> np.ndarray:
    """``scheme.longs`` numbers that hold the symbols of a non-empty set of shingle hashes."""
    mul, xor = _factors()
    least = np.full(_SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 128):
        x = short[k : k + 128, None] ^ xor
        x *= mul
        np.minimum(least, x.min(0), out=least)
    least = mix(least.astype(np.uint64))
    out, at = np.zeros(scheme.longs, np.uint64), 0
    for c, n in enumerate(scheme.chunks):
        for k in range(n):
            out[c] |= (least[at] & np.uint64(0xFF)) << np.uint64(8 * k)
            at += 1
    rest = (least[at:] & np.uint64(0xF)).reshape(-1, 15) << (np.uint64(4) * np.arange(15, dtype=np.uint64))
    out[-_TAIL:] = np.bitwise_or.reduce(rest, axis=1)
    return out.view(np.int64)


def _signed(size: int, scheme: Scheme):
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in in_parts(batches):
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                s = shingle_set(text, size, hashes)
                k = np.arange(1, len(s) + 1, dtype=np.uint64)
                name = np.array([mix(s ^ k).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + k), initial=np.uint64(len(s)))], np.uint64).view(np.int64)
                rows.append((doc, len(s), name[0], name[1], sketch(s, scheme) if len(s) else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return signed


def _sets(size: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in in_parts(batches):
            yield pd.DataFrame({"rep": b["rep"], "shingles": [shingle_set(t, size, hashes).view(np.int64) for t in b["text"]]})

    return sets


def buckets_of(sig: Column, scheme: Scheme) -> Column:
    """Keys of all chunks with each symbol left out."""
    keys = []
    for c, n in enumerate(scheme.chunks):
        for k in range(n):
            left = ((1 << 8 * n) - 1) & ~(0xFF << 8 * k)
            keys.append(F.xxhash64(F.lit(8 * c + k), F.get(sig, F.lit(c)).bitwiseAND(F.lit(left))))
    return F.array(*keys)


def _differing(x: Column, bits: int) -> Column:
    """How many of the symbols in a long of differences are not zero; its top bits are free."""
    low, top = (0x7F7F7F7F7F7F7F, 0x80808080808080) if bits == 8 else (0x777777777777777, 0x888888888888888)
    return F.bit_count((x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(top)))


def hamming(a: Column, b: Column, chunks: range) -> Column:
    """Differing symbols of some chunks."""
    return sum((_differing(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))), 8) for i in chunks), F.lit(0))


def hamming_tail(a: Column, b: Column, scheme: Scheme) -> Column:
    """Differing symbols of the longs after the chunks; a short expression, for what the chunks leave over.

    Written out, it would make the join's generated method too large for the JVM to compile.
    """
    counts = F.zip_with(F.slice(a, len(scheme.chunks) + 1, _TAIL), F.slice(b, len(scheme.chunks) + 1, _TAIL), lambda x, y: _differing(x.bitwiseXOR(y), 4))
    return F.aggregate(counts, F.lit(0), lambda s, x: s + x)


def _first_shared(a: Column, b: Column, scheme: Scheme, chunk: Column, left_out: Column) -> Column:
    """True at one only of the buckets that the two share: the first chunk that agrees, and there the first symbol left out."""
    first = None
    for c in range(len(scheme.chunks)):
        agrees = hamming(a, b, range(c, c + 1)) <= 1
        first = F.when(agrees, F.lit(c)) if first is None else first.when(agrees, F.lit(c))
    return (first == chunk) & ((left_out == 0) | (F.get(a, chunk) != F.get(b, chunk)))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole shingle sets are alike enough."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """Per distinct ``doc_id``: ``n_shingles``, ``component_id`` (the least id reachable over links) and ``kept``.

    Documents are linked whose sets of ``size``-word shingles have at least ``percent`` hundredths of their union in
    common.  Texts with fewer words are one shingle; null texts and those without words are linked with nothing.
    Rows that share an id count as the one with the greatest text; rows without an id are left out.  Texts of any
    length: a task holds the hashes of one text's words, and a row holds its whole set.  Other columns are ignored; an
    empty table gives no rows.
    """
    if not 60 <= percent <= 100:
        raise ValueError("buckets for similarities below 0.6 would hold unrelated texts")
    scheme = Scheme.at(percent)
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(base.mapInPandas(_signed(size, scheme), "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>"))
    if not signed.groupBy("doc_id").count().where("count > 1").isEmpty():
        base = cut(base.groupBy("doc_id").agg(F.max("text").alias("text")))
        signed = cut(base.mapInPandas(_signed(size, scheme), signed.schema))
    one = ["h1", "h2", "n_shingles"]
    worded = signed.where("n_shingles > 0")
    classes = cut(worded.groupBy(*one).agg(F.min("doc_id").alias("rep")))  # as a table, so that a join on large classes can be split
    reps = cut(worded.join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").cast("int").alias("n"), "sketch"))

    keys = reps.select("rep", F.posexplode(buckets_of(F.col("sketch"), scheme)).alias("slot", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("pivot")).where("members > 1").drop("members")
    members = cut(keys.join(shared, "key"))
    stars = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    parts = {k: reps.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab"}
    a, b = F.col("s_a"), F.col("s_b")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    keyed = hamming(a, b, range(len(scheme.chunks)))
    near = sizes & (keyed <= scheme.near) & (keyed + hamming_tail(a, b, scheme) <= scheme.near_all)
    stars = stars.join(parts["a"], "a").join(parts["b"], "b").where(near).select("a", "b")
    met = members.select("rep").distinct()  # grows with the input, hence never broadcast; texts move here only
    sets = cut(base.join(met.hint("merge"), base["doc_id"] == met["rep"]).select("rep", "text").mapInPandas(_sets(size), "rep long, shingles array<long>"))
    links = cut(_linked(stars, sets, percent))
    first = connected_components(links)

    placed = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    of_slot = [F.array(*[F.lit(v[i]) for v in ((c, k) for c, n in enumerate(scheme.chunks) for k in range(n))]) for i in (0, 1)]
    open_ = placed.join(mixed, "key").join(reps, "rep").withColumns({name: F.get(of_slot[i], F.col("slot")) for i, name in enumerate(("chunk", "left_out"))})
    side = {k: open_.select("key", F.col("rep").alias(k), F.col("component").alias(f"c_{k}"), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"), "chunk", "left_out") for k in "ab"}
    apart = (side["a"]["key"] == side["b"]["key"]) & (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b"))
    rest = side["a"].join(side["b"], apart & near & _first_shared(a, b, scheme, side["a"]["chunk"], side["a"]["left_out"]))
    more = cut(_linked(rest.select("a", "b"), sets, percent))
    if more.isEmpty():
        final = first
    else:
        kept = first.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
        final = connected_components(kept.unionByName(more))
    named = signed.join(classes.hint("merge"), one, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    out = named.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
