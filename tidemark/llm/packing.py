"""Packing of documents into training sequences: bounded-space online best fit.

Every partition keeps a fixed number of open windows.  A document's full windows go out as they are; what remains is
placed into the open window that it fills best.  When none fits, the fullest goes out, its gap first filled by the
head of the piece at hand.  Windows left open at the end of the partitions are dealt to groups of bounded size and
merged there.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

TOKENS = 2048
WINDOWS = 64
#: Gaps below this many tokens are padded rather than filled by cutting a piece.
MIN_CUT = 16
END_ID = 1
#: Windows that a task of the final merge holds, about.
MERGE_WINDOWS = 1000
#: Scripts in which both libraries are held to agree on the pattern's classes of letters and spaces.
COMMON = re.compile("[^\t\n\r -~ -ÿĀ-ſΑ-Ρα-ωА-я‐-‧]")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def _encoders(ranks_path: str, json_path: str):
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(json_path)
    whole.encode_special_tokens = True
    return fast, whole


def token_ids(text: str | None, ranks_path: str, json_path: str) -> np.ndarray:
    """Ids of the text by the vocabulary in ``json_path``; ``ranks_path`` holds the same one for a faster library.

    The faster library does common scripts; other texts go to the library that the vocabulary is made for.
    """
    fast, whole = _encoders(ranks_path, json_path)
    text = text or ""
    if COMMON.search(text):
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode_ordinary(text), np.uint32)


@dataclass
class Piece:
    doc: int
    start: int
    ids: np.ndarray
    total: int

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    fill: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece.ids)


class OpenWindows:
    """A bounded number of windows being filled; ``place`` returns those that are done."""

    def __init__(self, tokens: int, windows: int):
        self.tokens, self.windows, self.open = tokens, windows, []

    def place(self, piece: Piece) -> list[Window]:
        done = []
        while len(piece.ids) >= self.tokens:
            head, piece = piece.split(self.tokens)
            done.append(Window([head], self.tokens))
        while len(piece.ids):
            fitting = [w for w in self.open if w.fill + len(piece.ids) <= self.tokens]
            if fitting:
                best = max(fitting, key=lambda w: w.fill)
                best.add(piece)
                if best.fill == self.tokens:
                    self.open.remove(best)
                    done.append(best)
                break
            if len(self.open) < self.windows:
                self.open.append(Window([piece], len(piece.ids)))
                break
            fullest = max(self.open, key=lambda w: w.fill)
            self.open.remove(fullest)
            if (gap := self.tokens - fullest.fill) >= MIN_CUT:
                head, piece = piece.split(gap)
                fullest.add(head)
            done.append(fullest)
        return done

    def merged(self) -> list[Window]:
        """The open windows, the emptiest poured into the fullest; at most one of the results has a large gap."""
        rest = sorted(self.open, key=lambda w: w.fill)
        done, self.open = [], []
        while rest:
            window = rest.pop()
            while rest and (gap := self.tokens - window.fill) >= MIN_CUT:
                piece = rest[0].pieces.pop()
                rest[0].fill -= len(piece.ids)
                if len(piece.ids) > gap:
                    piece, tail = piece.split(gap)
                    rest[0].add(tail)
                window.add(piece)
                if not rest[0].pieces:
                    rest.pop(0)
            done.append(window)
        return done


def _rows(windows: list[Window], first: int, with_ids: bool) -> pd.DataFrame:
    rows = []
    for k, w in enumerate(windows):
        at = 0
        for p in w.pieces:
            data = p.ids.astype("<u4").tobytes()
            rows.append((p.doc, p.start, len(p.ids), zlib.crc32(data), p.total, first + k, at, data if with_ids else None))
            at += len(p.ids)
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
    return out.astype({"doc_id": "Int64"})


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, windows: int = WINDOWS, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document is its text's ids and then id 1; null or empty text is id 1 alone.  Pieces of a document cover it once,
    pieces of a sequence cover it from 0 without gaps.  Rows that repeat an id, or have none, are documents like any
    other.  Texts of any length: a task holds the ids of one text.  Other columns are ignored; an empty table gives no rows.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, first = OpenWindows(tokens, windows), TaskContext.get().partitionId() << 28
        for b in batches:
            done = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(token_ids(text, ranks_path, json_path), np.uint32(END_ID))
                done += place.place(Piece(None if pd.isna(doc) else int(doc), 0, ids, len(ids)))
            yield _rows(done, first, False)
            first += len(done)
        yield _rows(place.open, first, True)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        place = OpenWindows(tokens, 1 << 30)
        for _, own in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            w = Window()
            for doc, start, ids, total in zip(own["doc_id"], own["start"], own["ids"], own["doc_tokens"], strict=True):
                w.add(Piece(None if pd.isna(doc) else int(doc), int(start), np.frombuffer(ids, "<u4"), int(total)))
            place.open.append(w)
        return _rows(place.merged(), (1 << 61) + (int(rows["part"].iloc[0]) << 28), False).drop(columns="ids")

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = cut(base.mapInPandas(fill, f"{PIECES}, ids binary"))
    left = placed.where("ids is not null")
    parts = max(1, left.where("offset = 0").count() // MERGE_WINDOWS)
    left = left.withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(parts)))
    merged = left.groupBy("part").applyInPandas(merge, PIECES)
    return placed.where("ids is null").drop("ids").unionByName(merged)
