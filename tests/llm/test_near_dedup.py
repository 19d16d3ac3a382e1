from __future__ import annotations

import itertools
import random
import re

import pytest
from helpers import frame, union_find, words

from tidemark.llm.common import connected_components
from tidemark.llm.near_dedup import Scheme, near_duplicates


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, size, percent):
    s = {i: shingles(t, size) for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    top = union_find(s, links)
    return {i: (len(s[i]), top[i], top[i] == i) for i in s}


def corpus():
    rnd = random.Random(4)
    docs, i = [], 0
    for _ in range(12):
        base = words(rnd, rnd.choice([20, 60, 200]))
        for k in range(8):  # from exact copies to texts just below the threshold
            w = list(base)
            for _ in range(k * len(w) // 100 + (k > 4)):
                w[rnd.randrange(len(w))] = words(rnd, 1)[0]
            docs.append((i := i + 1, (" " if k % 2 else "\t").join(w)))
    passage = words(rnd, 40)
    docs += [(i := i + 1, " ".join(passage + words(rnd, 12))) for _ in range(40)]
    docs += [(i := i + 1, t) for t in (None, "", " \n", "one", "ONE", "one two", "É b c", "é b c", "one two three")]
    return docs


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_links_match_brute_force(spark, size, percent):
    docs = corpus()
    out = near_duplicates(frame(spark, docs), size=size, percent=percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == brute(docs, size, percent)


def test_tables_without_rows_and_repeated_ids(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    out = near_duplicates(frame(spark, [(1, "a b c d"), (1, "a b c e"), (None, "a b c d"), (2, "a b c e")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 1)]


def test_pigeonhole():
    for percent in (80, 85, 95):
        s = Scheme.at(percent)
        assert sum(s.chunks) == 80 and s.near < 2 * len(s.chunks)  # some chunk has at most one error


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(70)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    proper = [e for e in edges if e[0] != e[1]]
    assert got == union_find({n for e in proper for n in e}, proper)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_very_long_texts(spark):
    rnd = random.Random(9)
    long = words(rnd, 150_000)
    other = [w if k % 100 else "changed" for k, w in enumerate(long)]
    got = {r.doc_id: r for r in near_duplicates(frame(spark, [(1, " ".join(long)), (2, " ".join(other)), (3, "x" * 2_000_000), (4, " ".join(words(rnd, 150_000)))])).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[1].n_shingles == len(shingles(" ".join(long), 3)) and got[3].n_shingles == 1
