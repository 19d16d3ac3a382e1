"""Ranked lexical search over a two-level index.

The index holds the documents in blocks, each with its own inverted lists.  The first level has a byte for each
posting: the posting's share of a score, rounded up to steps.  Sums of bytes bound scores from above, and less a step
for each posting from below.  The second level has what exact shares need: occurrences, and the documents' lengths.

A search reads the first level of all blocks once to find for each query the k-th highest lower bound, and once more,
with the second level, to score in exact integers every document whose upper bound reaches it.  Tasks keep k
documents a query; nothing else leaves them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import floor, log
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, remove, scratch
from tidemark.llm.shingles import WordHashes

#: A share of a score before its weight is below WHOLE; a byte counts steps of STEP, so 250 at most.
WHOLE, STEP = 1_000_000, 4_000
#: A block ends at so many bytes of text or documents, and has one document at least; a document's number in it has 16 bits.
BLOCK_BYTES, BLOCK_DOCS = 2 << 20, 4_000
#: Queries that are answered in one pass over the index, about; they are what a task is sent.
QUERIES = 1_000
#: Cells of bounds that a task holds at once for a block: its documents by a slice of the queries.
CELLS = 1 << 21
POSTINGS = ["terms", "starts", "docs"]
INDEX = "n_docs int, ids binary, norms binary, terms binary, starts binary, docs binary, impacts binary, counts binary"
#: Bytes of ASCII that are letters or digits are terms, in lower case, as are all bytes beyond ASCII; the others part them.
SEEN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(SEEN).split()


def share(count: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """A posting's part of the score for a term of weight 1, from its occurrences and its document's ``m``."""
    return (1_000_000_000 * count) // (1_000 * count + 8 * norm)


@dataclass(frozen=True)
class Index:
    """The blocks, with the number of documents that have terms and the sum of their lengths."""

    blocks: DataFrame
    path: str
    documents: int
    length: int


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes every row that has an id and a term; its whole text."""
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [len(terms_of(t)) for t in b["text"]]
            yield pd.DataFrame({"n": [sum(map(bool, n))], "total": [sum(n)]})

    n, total = rows.select("text").mapInPandas(sizes, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block(n, total)
        for b in batches:
            for doc_id, text in b.itertuples(index=False):
                if (block.size and block.size + len(text or "") > BLOCK_BYTES) or len(block.ids) == BLOCK_DOCS:
                    yield block.row()
                    block = _Block(n, total, block.hashes)
                block.add(doc_id, text)
        if block.ids:
            yield block.row()

    path = scratch(spark, "index")
    return Index(cut(rows.mapInPandas(blocks, INDEX), path), path, n, total)


@dataclass
class _Block:
    n: int
    total: int
    hashes: WordHashes = field(default_factory=WordHashes)
    size: int = 0
    ids: list[int] = field(default_factory=list)
    norms: list[int] = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    def add(self, doc_id: int, text: str | None) -> None:
        words = terms_of(text)
        if not words:
            return
        found = Counter(words)
        self.terms.append(np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found)))
        self.counts.append(np.fromiter(found.values(), np.int64, len(found)))
        self.ids.append(doc_id)
        self.norms.append(25 + 75 * len(words) * self.n // self.total)
        self.size += len(text)

    def row(self) -> pd.DataFrame:
        terms, counts = np.concatenate(self.terms), np.concatenate(self.counts)
        docs, norms = np.repeat(np.arange(len(self.ids)), [len(t) for t in self.terms]), np.array(self.norms, np.int64)
        order = np.argsort(terms, kind="stable")
        terms, counts, docs = terms[order], counts[order], docs[order]
        terms, starts = np.unique(terms, return_index=True)
        impacts = -(-share(counts, norms[docs]) // STEP)
        data = [np.array(self.ids, np.int64), norms, terms, np.append(starts, len(docs)).astype(np.int32), docs.astype(np.uint16), impacts.astype(np.uint8), counts.astype(np.uint32)]
        return pd.DataFrame([[len(self.ids), *(x.tobytes() for x in data)]], columns=[c.split()[0] for c in INDEX.split(", ")])


@dataclass(frozen=True)
class _Queries:
    """Queries by number, inverted: for each term its weight, the queries that hold it and how often; and each query's own (term, how often)."""

    names: list[Any]
    terms: np.ndarray
    weights: np.ndarray
    holders: list[np.ndarray]
    repeats: list[np.ndarray]
    own: list[list[tuple[int, int]]]


def _invert(rows: list[tuple[Any, str | None]]) -> _Queries:
    hashes, held = WordHashes(), {}
    for k, (_, text) in enumerate(rows):
        for term, n in Counter(terms_of(text)).items():
            held.setdefault(hashes[term], []).append((k, n))
    order, own = sorted(held), [[] for _ in rows]
    for t, term in enumerate(order):
        for k, n in held[term]:
            own[k].append((t, n))
    holders, repeats = ([np.array([x[j] for x in held[t]], np.int64) for t in order] for j in (0, 1))
    return _Queries([name for name, _ in rows], np.array(order, np.uint64), np.zeros(len(order), np.int64), holders, repeats, own)


def _matched(queries: _Queries, block: Any) -> dict[int, slice]:
    """The places of the postings of the queries' weighty terms that a block holds."""
    _, mine, theirs = np.intersect1d(queries.terms, np.frombuffer(block.terms, np.uint64), assume_unique=True, return_indices=True)
    starts = np.frombuffer(block.starts, np.int32)
    return {t: slice(starts[k], starts[k + 1]) for t, k in zip(mine.tolist(), theirs.tolist(), strict=True) if queries.weights[t] > 0}


def _weighted(queries: _Queries, index: Index) -> _Queries:
    """With the terms' weights, from how many documents of the index hold them; sums come one row a term of the queries."""

    def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(len(queries.terms), np.int64)
        for b in batches:
            for block in b.itertuples(index=False):
                _, mine, theirs = np.intersect1d(queries.terms, np.frombuffer(block.terms, np.uint64), assume_unique=True, return_indices=True)
                df[mine] += np.diff(np.frombuffer(block.starts, np.int32))[theirs]
        yield pd.DataFrame({"term": np.flatnonzero(df), "df": df[df > 0]})

    weights = np.zeros(len(queries.terms), np.int64)
    for term, df in index.blocks.select("terms", "starts").mapInPandas(holding, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        weights[term] = floor(1000 * log((2 * index.documents + 2) / (2 * df + 1)))
    return replace(queries, weights=weights)


def _bounds(queries: _Queries, block: Any, matched: dict[int, slice]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Upper and lower bounds of the scores of slices of the queries (rows) for a block's documents (columns)."""
    docs, impacts = np.frombuffer(block.docs, np.uint16), np.frombuffer(block.impacts, np.uint8).astype(np.int64)
    step = max(1, CELLS // block.n_docs)
    for first in range(0, len(queries.names), step):
        some = slice(first, min(first + step, len(queries.names)))
        upper, spread = (np.zeros((some.stop - first, block.n_docs), np.int64) for _ in range(2))
        for t, at in matched.items():
            lo, hi = np.searchsorted(queries.holders[t], [some.start, some.stop])
            if lo < hi:
                who, weight = queries.holders[t][lo:hi, None] - first, (queries.weights[t] * queries.repeats[t][lo:hi])[:, None]
                upper[who, docs[at]] += weight * impacts[at]
                spread[who, docs[at]] += weight * (impacts[at] > 0)
        yield some, STEP * upper, STEP * upper - (STEP - 1) * spread


def _least_bounds(queries: _Queries, index: Index, k: int) -> np.ndarray:
    """For each query the k-th highest lower bound over all documents, or 1 if fewer have a score; a row a query comes back."""

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.zeros((len(queries.names), k), np.int64)
        for b in batches:
            for block in b.itertuples(index=False):
                for some, _, lower in _bounds(queries, block, _matched(queries, block)):
                    both = np.concatenate([best[some], lower], 1)
                    best[some] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
        query, place = np.nonzero(best)
        yield pd.DataFrame({"query": query, "bound": best[query, place]})

    found = index.blocks.select("n_docs", *POSTINGS, "impacts").mapInPandas(highest, "query int, bound long")
    found = _top(found.withColumn("place", F.monotonically_increasing_id()), k, F.desc("bound"), F.asc("place"))
    out = np.ones(len(queries.names), np.int64)
    for query, n, bound in found.groupBy("query").agg(F.count("*"), F.min("bound")).collect():
        out[query] = bound if n == k else 1
    return out


def _top(rows: DataFrame, k: int, *order: Any) -> DataFrame:
    """The first ``k`` rows of each query, with their ``rank``: within tasks first, so that a query's rows don't all meet."""
    rows = rows.withColumn("cell", F.pmod(F.spark_partition_id(), F.lit(64)))
    for keys in (["query", "cell"], ["query"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return rows.drop("cell")


def _scored(queries: _Queries, index: Index, least: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): each task's best ``k`` of the documents whose upper bound reaches ``least``, in exact integers."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for block in b.itertuples(index=False):
                matched = _matched(queries, block)
                ids, norms = (np.frombuffer(x, np.int64) for x in (block.ids, block.norms))
                for query, docs in _candidates(queries, block, matched, least):
                    scores = _exact(queries, block, matched, query, docs, norms[docs])
                    old = found.get(query, (np.zeros(0, np.int64),) * 2)
                    scores, names = np.concatenate([old[0], scores]), np.concatenate([old[1], ids[docs]])
                    first = np.lexsort((names, -scores))[:k]
                    found[query] = scores[first], names[first]
        for query, (scores, names) in found.items():
            yield pd.DataFrame({"query": query, "doc_id": names, "score": scores}).query("score > 0")

    return index.blocks.mapInPandas(best, "query int, doc_id long, score long")


def _candidates(queries: _Queries, block: Any, matched: dict[int, slice], least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(query, documents of the block whose upper bound reaches the query's least)."""
    for some, upper, _ in _bounds(queries, block, matched):
        reach = upper >= least[some, None]
        for query in np.flatnonzero(reach.any(1)):
            yield some.start + int(query), np.flatnonzero(reach[query])


def _exact(queries: _Queries, block: Any, matched: dict[int, slice], query: int, docs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Scores of some of a block's documents (in order) for one query."""
    holders, counts, out = np.frombuffer(block.docs, np.uint16), np.frombuffer(block.counts, np.uint32), np.zeros(len(docs), np.int64)
    for t, repeats in queries.own[query]:
        if t in matched:
            held = holders[matched[t]]
            place = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            hit = np.flatnonzero(held[place] == docs)
            out[hit] += queries.weights[t] * repeats * share(counts[matched[t]][place[hit]].astype(np.int64), norms[hit])
    return out


def search(index: Index, queries: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = 10, at_once: int = QUERIES) -> DataFrame:
    """For each query its ``k`` best documents with a score above 0: the query's id, ``rank``, ``doc_id``, ``score``.

    Scores are as the contract of ``op11`` has them; equal ones are ranked by ascending id.  Rows of the index that share
    an id are ranked each by itself; queries that share one count as the one with the greatest text, a null id being a value
    like any other.  Null and empty queries find nothing.  Terms are told apart by 64-bit hashes.  About ``at_once``
    queries are brought to the driver and sent to the tasks at a time, each with all its terms.
    """
    spark = queries.sparkSession
    kind = queries.schema[id_col].dataType.simpleString()
    asked = queries.groupBy(F.col(id_col).alias("id")).agg(F.max(text_col).alias("text"))
    parts = max(1, -(-asked.count() // at_once))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    out = spark.createDataFrame([], f"{id_col} {kind}, rank int, doc_id long, score long")
    for part in range(parts):
        some = _invert([tuple(r) for r in asked.where(F.col("part") == part).select("id", "text").collect()])
        if not len(some.terms):
            continue
        some = _weighted(some, index)
        best = _top(_scored(some, index, _least_bounds(some, index, k), k), k, F.desc("score"), F.asc("doc_id"))
        names = spark.createDataFrame(list(enumerate(some.names)), f"query int, {id_col} {kind}")  # as many rows as queries at once
        out = out.unionByName(best.join(F.broadcast(names), "query").select(id_col, "rank", "doc_id", "score"))
    return out


def ranked_search(docs: DataFrame, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """Indexes ``docs`` and searches it; the index goes when the ranks are written."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "ranks")
    index = build_index(docs)
    out = cut(search(index, queries, k=k), path)
    remove(spark, index.path)
    return out
