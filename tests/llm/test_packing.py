from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import frame, words
from tokenizers import Tokenizer

from tidemark.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_both_libraries_agree():
    whole = Tokenizer.from_file(JSON)
    whole.encode_special_tokens = True
    rnd = random.Random(5)
    pool = "aZé ñ1 9.,!?'s\n\t  -日本ا😀\u0085 \x1c\x0b ǅ²½Ⅷя_"
    for _ in range(3000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30)))
        assert packing.token_ids(text, RANKS, JSON).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    common = "aZéñßЯя 19.,!?'s're\n\t\r -—“”…€ÿĀſαω£§ "
    for _ in range(6000):
        text = "".join(rnd.choice(common) for _ in range(rnd.randint(0, 30)))
        assert packing.token_ids(text, RANKS, JSON).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def held(rows, docs, tokens):
    """The pieces cover every document once and every sequence from 0; gives the sequences' lengths."""
    whole = Tokenizer.from_file(JSON)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in docs}
    for i, text in docs:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    lengths = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens
        lengths.append(at)
    return lengths


def test_pieces_cover_all(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join(words(rnd, rnd.choice([1, 5, 30, 200, 2000])))) for i in range(150)] + [(900, None), (901, "")]
    rows = packing.pack(frame(spark, docs).repartition(5), tokens=256, windows=4).collect()
    lengths = held(rows, docs, 256)
    assert sum(256 - n for n in lengths) < 0.03 * 256 * len(lengths)


def test_bounded_space_best_fit():
    place = packing.OpenWindows(100, 2)
    piece = lambda n, d=0: packing.Piece(d, 0, np.zeros(n, np.uint32), n)
    assert place.place(piece(60)) == [] and place.place(piece(70)) == []
    assert place.place(piece(25)) == [] and [w.fill for w in place.open] == [60, 95]  # the fuller of those that fit
    (done,) = place.place(piece(50))  # none fits; the gap of 5 is too small to cut for
    assert done.fill == 95 and sorted(w.fill for w in place.open) == [50, 60]
    (done,) = place.place(piece(70))
    assert done.fill == 100 and [w.fill for w in place.open] == [50 + 30]  # the head of 40 filled the gap
    assert [w.fill for w in place.place(piece(350))][:3] == [100, 100, 100]
    assert len(place.open) <= 2


def test_odd_tables(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    rows = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(rows) == 3 and len({r.sequence_id for r in rows}) == 1


def test_a_very_long_text_is_packed_whole(spark):
    docs = [(1, " ".join(words(random.Random(6), 300_000))), (2, "short")]
    rows = sorted(packing.pack(frame(spark, docs)).collect(), key=lambda r: (r.doc_id, r.start))
    mine = [r for r in rows if r.doc_id == 1]
    assert mine[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(mine, mine[1:], strict=False)) and mine[-1].start + mine[-1].length == mine[0].doc_tokens > 300_000
    assert max(r.offset + r.length for r in rows) <= 2048
