"""What quality filters do to each other: who removes what in every order, and each filter's share over all orders.

Documents are routed by a fingerprint of their text to find copies.  A task keeps one chain for each fingerprint: the
different texts that have it, whole, with the least id of each.  Whoever is not the least id of its text fails the
last filter.  Copies meet in the task that reads them first, so of a hot text each reading task sends on one.  Each
document becomes a mask of the filters that it fails; parts' vectors of counts by mask are merged by combineByKey, and
all orders follow from a part's vector alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from typing import Any

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: A: fewer words; B: fewer different words in a hundred; C: more capitals in a hundred characters; D: any of these.
WORDS, VARIETY, CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
UPPER = bytes(range(65, 91))
COPY = 1 << FILTERS.index("E")
#: Bytes of text that a reading task holds back at most to meet copies; a longer text is held alone.
HELD = 32 << 20
#: Bytes of text that a task which meets copies gets, about, before copies are left out.
ROUTED = 64 << 20
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def failures(text: bytes, chars: int) -> int:
    """The filters but the last that the text fails, as bits in the order of FILTERS."""
    words = text.split()  # bytes split at ASCII white space only
    fails = (
        len(words) < WORDS,
        100 * len(set(words)) < VARIETY * len(words),
        100 * (len(text) - len(text.translate(None, UPPER))) > CAPITALS * chars,
        len(text) > len(text.translate(None, MARKS)),
    )
    return sum(f << k for k, f in enumerate(fails))


class Chains:
    """Texts by fingerprint, each with its least id so far and what ``of`` counts under it; ``add`` returns who is no longer least."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.size = 0

    def add(self, key: int, text: bytes, doc_id: Any, mask: int, of: Counter) -> tuple[Any, int, Counter] | None:
        chain = self.by_print.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                _, least, _, counted = entry
                if doc_id == least:
                    counted.update(of)
                    return None
                if doc_id > least:
                    return doc_id, mask | COPY, of
                entry[1:] = [doc_id, mask, of]
                return least, mask | COPY, counted
        chain.append([text, doc_id, mask, of])
        self.size += len(text)
        return None

    def entries(self) -> Iterator[tuple[int, list]]:
        return ((key, entry) for key, chain in self.by_print.items() for entry in chain)


def _route(key: Any) -> int:
    return xxhash.xxh64_intdigest(repr(key).encode())


def _read(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(fingerprint, (text, id, mask, counts of parts)); text is None where the mask is final."""
    chains = Chains()
    for k, (doc_id, part, text) in enumerate(rows):
        text = text or ""
        data, of = text.encode("utf-8", "surrogatepass"), Counter({part or "": 1})
        mask = failures(data, len(text))
        if doc_id is None:
            yield _route(k), (None, None, mask, of)
            continue
        told = chains.add(xxhash.xxh3_64_intdigest(data), data, doc_id, mask, of)
        if told:
            yield _route(told[0]), (None, *told)
        if chains.size > HELD:
            for key, entry in chains.entries():
                yield key, tuple(entry)
            chains = Chains()
    for key, entry in chains.entries():
        yield key, tuple(entry)


def _meet(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, mask, counts of parts): rows come sorted by fingerprint, so only one chain is held."""
    at, chains = None, Chains()

    def least() -> Iterator[tuple]:
        return ((doc_id, mask, of) for _, (_, doc_id, mask, of) in chains.entries())

    for key, (text, doc_id, mask, of) in rows:
        if text is None:
            yield doc_id, mask, of
            continue
        if key != at:
            yield from least()
            at, chains = key, Chains()
        told = chains.add(key, text, doc_id, mask, of)
        if told:
            yield told
    yield from least()


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): ``n`` rows of that id and part fail the filters whose bits the mask holds.

    Null text is empty and a null part ''.  Copies are rows of equal texts: all but those of the least id fail E, in
    whatever part; rows that repeat the least id stay, and rows without an id are nobody's copy.  The bytes of all texts,
    summed up first, say how many tasks meet them: as many as the session shuffles to, or more.  Texts of any length;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(part_col).alias("part"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED))
    routed: RDD = rows.rdd.mapPartitions(_read).repartitionAndSortWithinPartitions(parts, lambda key: key)
    counted = routed.mapPartitions(_meet).flatMap(lambda r: [(r[0], part, r[1], n) for part, n in r[2].items()])
    kind = docs.schema[id_col].dataType.simpleString()
    return spark.createDataFrame(counted, f"doc_id {kind}, part string, mask int, n long", verifySchema=False)


def copies(docs: DataFrame, **columns: str) -> DataFrame:
    """The ids that are not the least of their text."""
    return masks(docs, **columns).where(F.col("mask").bitwiseAND(COPY) > 0).select("doc_id").distinct()


def _vector(row: tuple) -> np.ndarray:
    return _count(np.zeros((3, 1 << len(FILTERS)), np.int64), row)


def _count(vector: np.ndarray, row: tuple) -> np.ndarray:
    mask, n, good, toxic = row
    vector[0, mask] += n
    vector[1, mask] += n * good
    vector[2, mask] += n * toxic
    return vector


def orders(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """A part's rows for all orders and steps from its counts by mask: all, good and toxic documents."""
    mask = np.arange(vector.shape[1])
    rows, shares = [], Counter()
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, earlier = mask & bit > 0, mask & before > 0
            removed = vector[:, fails & ~earlier].sum(1)
            kept, redundant = vector[0, mask & (before | bit) == 0].sum(), vector[0, fails & earlier].sum()
            rows.append((order, step, name, int(kept), int(removed[0]), int(redundant), int(vector[0, bit]), int(removed[1]), int(removed[2])))
            shares[name] += int(removed[0])
            before |= bit
    return ((part, order, step, *counts, shares[name]) for order, step, name, *counts in rows)


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of the filters and step: COUNTS, as the columns say, with ``shapley`` summed over all orders.

    ``labels(doc_id, quality, toxic)``: documents without a label are neither good nor toxic; of label rows that repeat
    an id the greatest values count.  See ``masks`` for odd rows; an empty table has no part, hence no rows.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    told = masks(docs, id_col=id_col, text_col=text_col, part_col=part_col).hint("merge").join(known, "doc_id", "left")
    told = told.select("part", F.struct("mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")).alias("row"))
    vectors = told.rdd.map(tuple).combineByKey(_vector, _count, np.add)
    return spark.createDataFrame(vectors.flatMap(lambda kv: orders(*kv)), RESULT, verifySchema=False)
