"""Ranked search, filter audit and WARC archives."""

from __future__ import annotations

import gzip
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from helpers import frame, words

from tidemark.llm import filter_audit, ranked_search, warc
from tidemark.llm.filter_audit import audit_filters, copies, masks
from tidemark.llm.ranked_search import build_index, search
from tidemark.llm.warc import Archive, page_records, packed, ranges, read_warc, record, row_of, write_warc


def ranked(docs, items, k=10):
    """A plain version of the ranks; ``items``: id -> text."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    tfs = [(i, Counter(split(t))) for i, t in docs if i is not None]
    n, total = sum(bool(c) for _, c in tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(term for _, c in tfs for term in c)
    out = {}
    for item, text in items.items():
        scores = []
        for i, c in tfs:
            if c:
                m = 25 + 75 * sum(c.values()) * n // total
                scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if c[t]), i))
        best = sorted((-s, i) for s, i in scores if s > 0)[:k]
        out |= {(item, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def found(df):
    rows = df.collect()
    out = {(r[0], r.rank): (r.doc_id, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


ITEMS = "item_id string, text string, score long"


@pytest.mark.parametrize("at_once", [1000, 3])
def test_ranks_against_a_plain_version(spark, monkeypatch, at_once):
    monkeypatch.setattr(ranked_search, "CELLS", 64)  # several slices of queries a block
    rnd = random.Random(31)
    vocabulary = [words(rnd, 1)[0] for _ in range(60)]
    text = lambda n: " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=n))
    docs = [(i, text(rnd.choice([1, 3, 20, 80]))) for i in range(400)] + [(400 + i, "The same copy, again & again: Ünïcode x1") for i in range(300)]
    docs += [(900, None), (901, ""), (902, "!!! ..."), (None, "copy again"), (903, text(30_000)), (904, "same copy"), (904, "again"), (904, "again")]
    items = {f"q{k}": text(rnd.randint(1, 12)) for k in range(12)} | {"copy": "the COPY again ünïcode", "dots": "...", "empty": "", "null": None, "new": "nowhere1 nowhere2", "twice": "same same same x1", None: "x1 again"}
    queries = spark.createDataFrame([(i, t, 1) for i, t in items.items()], ITEMS)
    index = build_index(frame(spark, docs).repartition(7))
    assert found(search(index, queries, at_once=at_once)) == ranked(docs, items)
    assert found(search(index, queries.unionByName(queries), k=1)) == ranked(docs, items, 1)


def test_ranks_of_nothing(spark):
    none, some = frame(spark, []), spark.createDataFrame([("a", "word", 1)], ITEMS)
    assert search(build_index(none), some).count() == 0
    assert search(build_index(frame(spark, [(1, "word")])), some.limit(0)).count() == 0
    assert found(search(build_index(frame(spark, [(1, "word other"), (2, "other")])), some))[("a", 1)][0] == 1
    assert search(build_index(frame(spark, [(1, "word"), (2, "word")])), some).count() == 2  # its weight is log(6 / 5)


def test_bounds_hold_and_few_documents_are_scored(spark):
    rnd = random.Random(32)
    docs = [(i, " ".join(words(rnd, rnd.choice([5, 50, 500])))) for i in range(300)]
    index = build_index(frame(spark, docs))
    some = ranked_search._weighted(ranked_search._invert([(k, " ".join(words(rnd, 40))) for k in range(6)]), index)
    least = ranked_search._least_bounds(some, index, 5)
    scored = 0
    for block in index.blocks.collect():
        matched = ranked_search._matched(some, block)
        ids, norms = (np.frombuffer(x, np.int64) for x in (block.ids, block.norms))
        for part, upper, lower in ranked_search._bounds(some, block, matched):
            for k in range(part.start, part.stop):
                exact = ranked_search._exact(some, block, matched, k, np.arange(len(ids)), norms)
                assert (lower[k - part.start] <= exact).all() and (exact <= upper[k - part.start]).all()
                scored += int((upper[k - part.start] >= least[k]).sum())
    assert 6 * 5 <= scored < 6 * 300 / 3


def audited(docs, labels):
    """A plain version of the audit; ``docs``: (id, text, part)."""
    least, good, bad = {}, defaultdict(int), defaultdict(int)
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in [label for label in labels if label[0] is not None]:
        good[i], bad[i] = max(good[i], int(q == 1)), max(bad[i], int(x == 1))
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        rows.append((part or "", {k for k, f in fails.items() if f}, good[i], bad[i]))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                out[part, "".join(order), step] = [
                    sum(not r[1] & {*before, f} for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    share = Counter()
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] += v[1]
    return {(p, o, s): (*v, share[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 3000)  # chains are sent on many times in a task
    rnd = random.Random(33)
    texts = [" ".join(rnd.choices([*words(rnd, 200), "ABC", "x#y", "Z|"], k=n)) for n in (3, 90, 110, 150, 400)] + ["one hot text of many", "", None, "    NO ascii blanks", "Ä" * 30 + "A" * 4]
    docs = [(rnd.randrange(900), rnd.choices(texts, [1] * 5 + [6] + [1] * 4)[0], rnd.choice(["en", "de", None, ""])) for _ in range(700)] + [(None, "one hot text of many", "en"), (None, None, None)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 900, 2)] + [(2, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame([(i, t, p, 3, "x") for i, t, p in docs], "doc_id long, text string, lang string, step int, part string").repartition(5)
    got = audit_filters(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audited(docs, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want and len(got) == len(want)
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    assert {r.doc_id for r in copies(table).collect()} == {i for i, t, _ in docs if i is not None and least[t or ""] < i}
    assert sum(r.n for r in masks(table).collect()) == len(docs)
    assert audit_filters(table.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_texts_of_one_fingerprint_form_a_chain(spark, monkeypatch):
    chains = filter_audit.Chains()
    one = Counter({"en": 1})
    assert chains.add(7, b"a", 5, 0, Counter(one)) is None and chains.add(7, b"b", 6, 1, Counter(one)) is None
    assert chains.add(7, b"a", 3, 0, Counter(one)) == (5, filter_audit.COPY, one)
    assert chains.add(7, b"b", 9, 1, Counter(one)) == (9, 1 | filter_audit.COPY, one)
    assert [e[:2] for _, e in chains.entries()] == [[b"a", 3], [b"b", 6]]
    rows = [(7, (b"a", 4, 0, Counter(one))), (7, (b"b", 2, 0, Counter(one))), (7, (b"a", 1, 0, Counter(one))), (9, (None, 8, 16, Counter(one)))]
    assert sorted((i, m) for i, m, _ in filter_audit._meet(iter(rows))) == [(1, 0), (2, 0), (4, filter_audit.COPY), (8, 16)]


PAGES = "page_id long, url string, html string, digest string, payload string"


def archive(spark, rows, path):
    write_warc(spark.createDataFrame([(i, u, h, "d", "p") for i, u, h in rows], PAGES), path)
    return path


def test_archives_of_odd_rows(spark, tmp_path):
    long = "".join(random.Random(34).choices("abcdef<>é", k=400_000))
    rows = [(5, "http://a.org/x y\r\nWARC-Type: z", "x" * 100), (3, None, "x" * 100), (9, "u", "x" * 100), (9, "u", "x" * 100), (3, "v", "x" * 100), (1, "u", "é" * 49 + "x"), (2, "u", "é" * 49 + "x"), (7, "", None), (8, "u", ""), (10, "u", long), (11, "u", long), (None, "u", "x" * 100), (12, "u", "a\r\n\r\nb\0c")]
    path = archive(spark, rows, str(tmp_path / "a"))
    for size in (warc.RANGE, 4096, 100):
        got = page_records(read_warc(spark, path, range_bytes=size)).collect()
        first = {"x" * 100: 3, long: 10}
        want = [(i, len((h or "").encode()), warc_sha(h), *(("revisit", first[h]) if h in first and i is not None and i > first[h] else ("response", None))) for i, _, h in rows]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    records = {r.record_id: r for r in read_warc(spark, path).collect()}
    assert records["<urn:x-page:5>"].target_uri == "http://a.org/x%20y%0D%0AWARC-Type:%20z" and records["<urn:x-page:9>"].payload == b"" and records["<urn:x-page:10>"].payload == long.encode()
    # any gzip reader takes the archives
    data = b"".join(gzip.open(f"{path}/{f}").read() for f in os.listdir(path) if f.startswith("part-"))
    assert data.count(b"WARC/1.1\r\n") == len(rows)
    assert read_warc(spark, archive(spark, [], str(tmp_path / "none"))).count() == 0


def warc_sha(html):
    import hashlib

    return hashlib.sha256((html or "").encode()).hexdigest()


def test_members_end_with_the_byte_that_the_writer_adds():
    for data in (b"", b"x" * 1000, b"y" * ((16 << 20) + 5)):
        assert b"".join(iter_members(row_of(data) + b"\0")) == data


def iter_members(data):
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data)
        assert z.eof
        data = z.unused_data


def test_each_record_has_one_owner_whatever_the_ranges(tmp_path, monkeypatch):
    """Records by ranges of any size; stored blocks hold magic bytes, whole members and whole records as content."""
    monkeypatch.setattr(warc, "CHUNK", 61)
    rnd = random.Random(35)
    inner = packed(record(99, "u", b"inner", "d", 5, None, "t"))
    payloads = [rnd.randbytes(rnd.randint(0, 300)) + rnd.choice([b"", warc.MAGIC, inner, packed(b"no record")]) + rnd.randbytes(20) for _ in range(60)]
    members = []
    for k, p in enumerate(payloads):
        z = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: what a payload holds stands in the archive as it is
        members.append(z.compress(record(k, "u", p, "d", len(p), None, "t")) + z.flush() + (packed(b"") if k % 7 == 0 else b""))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(members))
    n = path.stat().st_size
    for size in (1, 17, 200, 5000, n):
        found = [warc.parsed(r) for k in range(0, n, size) for r in Archive(str(path), n).records(k, min(n, k + size))]
        assert [r[-1] for r in found] == payloads
    path.write_bytes(b"".join(members[:5]) + b"damage" + b"".join(members[5:]))
    with pytest.raises(ValueError, match="no gzip member"):
        list(Archive(str(path), n + 6).records(0, n + 6))


def test_ranges_cover_files_and_each_is_a_task(spark, tmp_path):
    path = archive(spark, [(i, "u", "".join(random.Random(i).choices("abcdefgh", k=3000))) for i in range(40)], str(tmp_path / "r"))
    cut = ranges(spark, path, 5000)
    assert sum(e - s for _, s, e, _ in cut) == sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-")) and len(cut) > 8
    assert read_warc(spark, path, range_bytes=5000).rdd.getNumPartitions() == len(cut)
    assert sorted(r.page_id for r in page_records(read_warc(spark, path, range_bytes=5000)).collect()) == list(range(40))
