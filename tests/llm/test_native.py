"""Line dedup, URL rules, shards, decontamination and fingerprints."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from helpers import frame, union_find, words
from pyspark.sql import functions as F

from tidemark.llm import queries as q
from tidemark.llm import sharding
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.fingerprints import BLOCK, SAMPLES, fingerprint_documents, fingerprint_pairs, likeness, next_ids
from tidemark.llm.line_dedup import LineRuns, dedup_lines
from tidemark.llm.sharding import FILL, LOTS, SLACK, SMALL, propagate, shard_documents
from tidemark.llm.url_filter import RULES, filter_urls

PYTHON = re.compile("Python|Pandas|Arrow")


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_matches_sql(name, spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = q.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({q.ORACLE[name]}) q").fetchall())


@pytest.mark.parametrize("name", ["op6_line_dedup", "op8_sharding", "op9_decontamination", "op10_fingerprints"])
def test_no_python_in_native_plans(name, spark, data):
    assert not PYTHON.search(q.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString())


def test_lines(spark):
    twenty, short = "a line of twenty chars", "short line"
    docs = [(1, f"{twenty}\nx\n  {twenty.upper()}\t"), (2, f"{twenty}\n{short}"), (3, f"{short}\n{twenty}\n{twenty}"), (4, short), (5, None), (6, ""), (None, twenty), (7, f"one more line, only twice\n\n{twenty[:-1]}"), (8, "one more line, only twice")]
    out = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in dedup_lines(frame(spark, docs)).collect()}
    assert out[1] == ("x", 3, 2) and out[2] == (short, 2, 1) and out[3] == (docs[2][1], 3, 0) and out[5] == out[6] == ("", 1, 0)
    assert out[None] == (twenty, 1, 0) and out[7][2] == out[8][2] == 0
    assert dedup_lines(frame(spark, [])).count() == 0
    assert dedup_lines(frame(spark, [(None, "a\nb")])).first()["n_lines"] == 2


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_in_any_number_of_batches(spark, batches):
    rnd = random.Random(8)
    pool = [" ".join(words(rnd, 6)) + " " * 3 + "z" * 10 for _ in range(30)]
    docs = [(i * 37, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    holders = defaultdict(set)
    for i, t in docs:
        for line in t.split("\n"):
            holders[line.strip().lower()].add(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(holders[x.strip().lower()]) < 3 or max(holders[x.strip().lower()]) == i) for i, t in docs}
    assert {r.doc_id: r.text for r in dedup_lines(frame(spark, docs), batches=batches).collect()} == want


def test_lines_of_repeated_and_far_ids(spark):
    line = "a line that many hold, surely"
    docs = [(1, f"{line}\nkeep a"), (1, f"unique first line of all\nkeep b\n{line}"), (1, "\n".join("x" * 9) + f"\n{line}"), (-9 * 10**18, f"{line}\nlow"), (9 * 10**18, f"high\n{line}"), (5, f"{line}\n{line}")]
    wide = spark.createDataFrame([(i, t, 1, 2, "x", 4, 5) for i, t in docs], "doc_id long, text string, gone int, _line_doc int, row string, id int, t int")
    out = dedup_lines(wide)
    assert out.columns == [*wide.columns, "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_dropped, r.gone, r.row) for r in out.collect())) == sorted(
        [(1, "keep a", 1, 1, "x"), (1, "unique first line of all\nkeep b", 1, 1, "x"), (1, "\n".join("x" * 9), 1, 1, "x"), (-9 * 10**18, "low", 1, 1, "x"), (9 * 10**18, f"high\n{line}", 0, 1, "x"), (5, "", 2, 1, "x")]
    )
    twice = [(1, line), (1, line + " "), (2, line)]  # two ids only
    assert [r.n_dropped for r in dedup_lines(frame(spark, twice)).collect()] == [0, 0, 0]


@pytest.mark.parametrize("fragment", ["<link rel=canonical ", "<link rel=x ", "<base x ", "<meta http-equiv=", "<link rel=canonical href=http://a.org/es/>"])
def test_pages_of_open_tags_take_linear_time(spark, fragment):
    html = fragment * (1_000_000 // len(fragment))
    began = time.time()
    assert filter_urls(spark.createDataFrame([(1, "http://a.info/x", html)], "page_id long, url string, html string")).first().verdict in ("allow", "block")
    assert time.time() - began < 15  # before, 16 KB took 28 s


def test_a_very_long_text_of_lines(spark):
    docs = [(i, "\n".join(f"line number {k} of the long text" for k in range(60_000))) for i in range(3)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in dedup_lines(frame(spark, docs)).collect()}
    assert got == {0: (60_000, 60_000), 1: (60_000, 60_000), 2: (60_000, 0)}


def test_runs_move_and_sort_nothing_and_their_anti_join_decides(spark, monkeypatch):
    runs, n = LineRuns(spark), spark.conf.get("spark.sql.shuffle.partitions")
    keys = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("long").alias("n"), (100 - F.col("id")).alias("owner")).repartition(int(n), "h1", "h2")
    for k in range(3):
        runs.add(keys(10 * k, 10 * k + 20))
    assert [len(level) for level in runs.levels] == [1, 1]
    with runs.sorted_scans():
        own = runs._write(keys(5, 50))
        for df in (runs.owned(own), runs.merged(*runs.runs())):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and not re.search(r"\bSort \[", plan)
    assert {r.h2: r.n for r in runs.totals().collect()} == {i: 1 + (10 <= i < 30) for i in range(40)}
    runs.close()
    docs = [(i, "the very same line in all of them") for i in range(40)]
    right = lambda: [r.doc_id for r in dedup_lines(frame(spark, docs)).collect() if not r.n_dropped] == [39]
    assert right()
    monkeypatch.setattr(LineRuns, "unseen", lambda self, own: own)
    assert not right()


def verdicts(urls, links):
    """A plain version of the rules and of what aliases pass on."""

    def parts(u):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.split(r"[/?#]", rest)[0]
        return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.split(r"[?#]", rest[len(host) :])[0]

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    form = {u: None if not parts(u)[0] else parts(u)[0] + re.sub("/$", "", parts(u)[1]) for u in {*urls, *(b for _, b in links)}}
    top = union_find({f for f in form.values() if f}, [(form[a], form[b]) for a, b in links if form[a] and form[b]])
    said = defaultdict(set)
    for u in urls:
        if form[u] and rule(*parts(u))[1]:
            said[top[form[u]]].add(rule(*parts(u))[1])
    out = []
    for u in urls:
        name, v = rule(*parts(u))
        about = said.get(top.get(form[u]), set()) if form[u] else set()
        out.append((*parts(u), name, v or ("allow" if "allow" in about or not about else "block")))
    return out


def test_urls(spark):
    urls = ["http://A.Example.COM/en/1", "https://example.com/en/7x", "http://x.net/de/1", "http://m.example.net/de/8/q?x=1", "http://b.org/es/2#t", "http://b.org/fr/2", "http://c.org/p", "http://d.org/p/", "http://e.org/q", None, "no scheme", "http://"]
    links = [("http://c.org/p", "http://d.org/p/"), ("http://d.org/p/", "http://b.org/es/2"), ("http://e.org/q", "http://b.org/es/2"), ("http://e.org/q", "http://example.com/en/7x")]
    html = {a: "".join(f'<link href="{b}" rel="canonical">' for x, b in links if x == a) for a, _ in links}
    pages = spark.createDataFrame([(i, u, html.get(u), "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages).collect()}
    assert [got[i] for i in range(len(urls))] == verdicts(urls, links)
    assert got[0][3] == "block" and got[1][3] == "allow" and got[3][3] == "block" and got[6][3] == "allow"
    assert filter_urls(pages.limit(0)).count() == 0
    assert filter_urls(pages.unionByName(pages)).count() == 2 * len(urls)


def test_urls_take_the_decision_of_targets_outside_the_table(spark):
    link, refresh = '<link rel="canonical" href="{}">', "<meta http-equiv=refresh content=\"0; url='{}'\">"
    pages = [  # url, html, verdict
        ("http://c.org/p", link.format("http://b.org/es/2"), "block"),
        ("http://c.org/q", link.format("http://b.org/es/5") + link.format("http://example.com/en/7x"), "allow"),
        ("http://d.org/x/y", link.format("/es/2"), "block"),
        ("http://e.info/p", refresh.format("//b.org/es/3"), "block"),
        ("http://f.org/es2/x?y=/", refresh.format("../es/./3"), "block"),
        ("http://g.org", link.format("es/4"), "block"),
        ("http://h.org/es", link.format("?es"), "allow"),
        ("http://i.org/es", link.format("/es/"), "block"),
        ("http://j.org/x", '<base href="/es/">' + link.format("a"), "block"),
        ("http://k.org/x", '<link rel=stylesheet href="/es/canonical.css"><link rel="canonical" href="mailto:a@b.org"><meta http-equiv="refresh" content="5">', "allow"),
        ("http://l.org/x", link.format("/y"), "block"),
        ("http://l.org/z", link.format("http://l.org/y") + link.format("/a/../es/9"), "block"),
        ("http://m.org/x", link.format("/go/../en?to=http://b.org/es/2"), "allow"),
        ("no scheme", link.format("/es/2"), "allow"),
        (None, link.format("http://b.org/es/2"), "allow"),
        ("http://n.org/x", link.format("http://n.org/y?a=1&amp;b=2"), "block"),
        ("http://n.org/y?a=1&b=2", link.format("http://b.org/es/2"), "block"),
        ("http://o.org/x", "<p>" * 30_000 + refresh.format("http://b.org/es/8"), "block"),
    ]
    got = filter_urls(spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")).collect()
    assert [(u, v) for u, _, v in pages] == [(pages[r.page_id][0], r.verdict) for r in sorted(got, key=lambda r: r.page_id)]


def test_shards(spark):
    rnd = random.Random(9)
    docs = [(i, " ".join(words(rnd, rnd.choice([3, 30, 60])))) for i in range(3000)]
    docs += [(3000 + i, "the same text " * 5) for i in range(900)] + [(4000 + 2 * i + k, f"pair {i} " * 8) for i in range(100) for k in (0, 1)] + [(5000, None), (5001, "")]
    out = shard_documents(frame(spark, docs), shards=8).collect()
    size = {i: len((t or "").encode()) + 16 for i, t in docs}
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t in docs}
    loads, slots, shard = Counter(), defaultdict(list), {r.doc_id: r.shard for r in out}
    for r in out:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) < 0.03 * sum(loads.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    together = sum(shard[4000 + 2 * i] == shard[4001 + 2 * i] for i in range(100))
    assert together > 60  # by chance 12
    assert shard_documents(frame(spark, [])).count() == 0
    odd = shard_documents(frame(spark, [(None, "a"), (1, "a"), (1, "b")]), shards=3).collect()
    assert len(odd) == 3 and len({r.shard for r in odd if r.doc_id == 1}) == 1


def test_shards_by_given_links(spark):
    rnd = random.Random(10)
    docs = [(i, " ".join(words(rnd, 20))) for i in range(400)]
    links = spark.createDataFrame([(i, i // 4) for i in range(400)], "doc_id long, key long")
    shard = {r.doc_id: r.shard for r in shard_documents(frame(spark, docs), links, shards=4).collect()}
    cut = sum(shard[4 * g + a] != shard[4 * g + b] for g in range(100) for a in range(4) for b in range(a))
    assert cut < 0.5 * 600  # by chance three quarters


def hashed(*numbers):
    """Spark's hash of several longs."""
    seed = 42
    for x in numbers:
        seed = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_rounds(size, shard, keys, shards, quota, rounds):
    """The rounds of label propagation over dictionaries; ``keys``: key -> ids."""
    of = defaultdict(list)
    for k, ids in keys.items():
        for i in ids:
            of[i].append(k)
    log = []
    for step in range(rounds):
        load = Counter()
        for i, s in shard.items():
            load[s] += size[i]
        here, cut = {k: Counter() for k in keys}, 0
        ranked, need, small = {}, {}, {}
        for k, ids in keys.items():
            for i in ids:
                here[k][shard[i]] += size[i]
            whole = sum(here[k].values())
            ranked[k] = sorted(here[k], key=lambda s: (-here[k][s], hashed(k, s), s))  # noqa: B023
            need[k] = min(shards, -(-whole // (quota * FILL // 100 + 1)))
            small[k] = whole * SMALL <= quota
            cut += len(ranked[k]) - 1
        wish, asked, unbound = {}, Counter(), {}
        for i, own in of.items():
            said, ticket = Counter(), {}
            for k in own:
                place = ranked[k].index(shard[i])
                goals = ranked[k][: min(place, need[k])]
                to, gain = shard[i], here[k][shard[i]] - size[i]
                if place >= need[k] and goals:
                    to = goals[hashed(step, i) % len(goals)]
                    gain = here[k][to]
                said[to] += gain
                t = hashed(step, k if small[k] else i) % LOTS
                ticket[to] = min(ticket.get(to, t), t)
            to = max(said, key=lambda s: (said[s], s == shard[i], -s))  # noqa: B023
            if to == shard[i] and len(own) == 1 and small[own[0]] and len(ranked[own[0]]) == 1:
                unbound[i] = ticket[to]
            if to != shard[i]:
                wish[i] = (to, ticket[to])
                asked[shard[i], to] += size[i]
        load = [load[s] for s in range(shards)]
        spare = [sum(size[i] for i in unbound if shard[i] == s) for s in range(shards)]
        granted, ways = sharding.flows(load, quota + quota // SLACK, asked, spare)  # held by a test of its own
        moved = {i: to for i, (to, t) in wish.items() if t < granted[shard[i], to] * LOTS // asked[shard[i], to]}
        for i, t in unbound.items():
            first = 0
            for (a, b), n in sorted(ways.items()):
                first += n if a == shard[i] else 0
                if a == shard[i] and t < first * LOTS // spare[a]:
                    moved[i] = b
                    break
        shard = shard | moved
        log.append({"cut": cut, "moved": len(moved)})
        if not moved:
            break
    return shard, log


@pytest.mark.parametrize("hot", [0, 300])
def test_rounds_match_a_plain_version(spark, hot):
    rnd = random.Random(13 + hot)
    size = {i: rnd.randint(20, 90) for i in range(600)}
    keys = {hashed(g): rnd.sample(range(600), rnd.randint(2, 6)) for g in range(200)}  # many documents have two keys or more
    if hot:
        keys[hashed(999)] = rnd.sample(range(600), hot)
    start = {i: rnd.randrange(8) for i in {i for ids in keys.values() for i in ids}}
    quota = -(-sum(size.values()) // 8)
    state = spark.createDataFrame([(i, size[i], s) for i, s in start.items()], "rid long, size long, shard int")
    links = spark.createDataFrame([(i, k) for k, ids in keys.items() for i in ids], "rid long, key long")
    log = []
    got = {r.rid: r.shard for r in propagate(state, links, 8, quota, 4, log).collect()}
    want, told = plain_rounds(size, start, keys, 8, quota, 4)
    assert got == want and log == told and log[0]["moved"] > 100


def test_net_flows_fit_and_full_shards_swap():
    flows = lambda load, wished, spare=(0, 0, 0): sharding.flows(load, 1000, wished, spare)
    assert flows([1000] * 3, {(0, 1): 600, (1, 0): 400, (2, 0): 300}) == ({(0, 1): 400, (1, 0): 400, (2, 0): 0}, {})
    assert flows([1000] * 3, {(0, 1): 600, (1, 2): 400, (2, 0): 300})[0] == {(0, 1): 300, (1, 2): 300, (2, 0): 300}
    assert flows([1000, 900, 1000], {(0, 1): 600, (2, 0): 70})[0] == {(0, 1): 100, (2, 0): 70}
    assert flows([1000, 1000, 0], {(0, 1): 600, (2, 1): 50}, (9, 200, 9)) == ({(0, 1): 200, (2, 1): 0}, {(1, 0): 200})
    assert flows([1200, 1000, 0], {(0, 1): 50})[0] == {(0, 1): 0}
    rnd = random.Random(16)
    for _ in range(200):
        wished = {(a, b): rnd.randint(1, 500) for a in range(8) for b in range(8) if a != b and rnd.random() < 0.4}
        load, spare = [rnd.randint(500, 1200) for _ in range(8)], [rnd.randint(0, 200) for _ in range(8)]
        got, ways = flows(load, wished, spare)
        assert all(0 <= got[p] <= w for p, w in wished.items()) and all(sum(n for (a, _), n in ways.items() if a == s) <= spare[s] for s in range(8))
        after = [load[s] + sum(n * ((b == s) - (a == s)) for m in (got, ways) for (a, b), n in m.items()) for s in range(8)]
        assert all(after[s] <= max(1000, load[s]) for s in range(8))
        # nobody is kept from a shard that has room or spare bytes left
        assert all(got[a, b] == w or after[b] >= 1000 and sum(n for (x, _), n in ways.items() if x == b) == spare[b] for (a, b), w in wished.items())


def cut_of(shard, keys):
    return sum(len({shard[i] for i in ids}) - 1 for ids in keys.values())


def test_propagation_is_what_keeps_links_together(spark, monkeypatch):
    rnd = random.Random(14)
    docs = [(i, " ".join(words(rnd, rnd.choice([5, 10, 20])))) for i in range(2000)]
    keys = {g: [*range(5 * g, 5 * g + 5), (5 * g + 7) % 1000] for g in range(200)}  # chains of groups: every group holds one of the next
    links = spark.createDataFrame([(i, g) for g, ids in keys.items() for i in ids], "doc_id long, key long")
    size = {i: len(t) + 16 for i, t in docs}

    def run():
        shard = {r.doc_id: r.shard for r in shard_documents(frame(spark, docs), links, shards=8).collect()}
        loads = Counter()
        for i, s in shard.items():
            loads[s] += size[i]
        assert max(loads.values()) - min(loads.values()) < 0.01 * sum(size.values()) / 8 + max(size.values())
        return cut_of(shard, keys)

    with_rounds = run()
    monkeypatch.setattr(sharding, "propagate", lambda state, *_: state)
    assert run() > 2 * with_rounds


def test_crowded_shards_are_left_by_whole_groups(spark):
    """All documents are linked in pairs, and one text is a third of all: sizes stay even, few pairs part (by chance 900)."""
    rnd = random.Random(15)
    docs = [(2 * i + k, f"pair {i} " + "x" * (i % 50)) for i in range(1000) for k in (0, 1)] + [(5000 + i, "the hot text " * 3) for i in range(1000)]
    got = shard_documents(frame(spark, docs), shards=10).collect()
    shard, loads = {r.doc_id: r.shard for r in got}, Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values()) / 10
    assert sum(shard[2 * i] != shard[2 * i + 1] for i in range(1000)) < 250 and len({shard[5000 + i] for i in range(1000)}) <= 7


def contamination(docs, items, window=13):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
    spans = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            spans[tuple(w[k : k + n])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(s) for s in spans}:
            for k in range(len(w) - n + 1):
                if (s := tuple(w[k : k + n])) in spans:
                    hit |= set(range(k, k + n))
                    found |= spans[s]
        out[d] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark):
    rnd = random.Random(11)
    items = [(i, " ".join(words(rnd, rnd.choice([14, 20, 40])))) for i in range(20)] + [(50, "short item here"), (51, None), (52, "..."), (53, "Ünï code item")]
    whole = {i: t.split() for i, t in items if t}
    docs = [(i, " ".join(words(rnd, 60))) for i in range(20)]
    for i in range(20, 60):
        w, src = words(rnd, rnd.choice([10, 100, 600])), whole[i % 20]
        n = rnd.randint(10, len(src))
        at, k = rnd.randint(0, len(src) - n), rnd.randrange(len(w))
        docs.append((i, " ".join(w[:k] + src[at : at + n] + w[k:]).replace(" ", rnd.choice([" ", "--", "\n"])).upper()))
    docs += [(100, None), (101, ""), (102, "A SHORT item, HERE"), (103, "ünï CODE item"), (104, " ".join(whole[1] * 3))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words long")
    out = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate(frame(spark, docs), bench).collect()}
    assert out == contamination(docs, items)
    assert decontaminate(frame(spark, []), bench).count() == 0
    assert not any(r.n_hit for r in decontaminate(frame(spark, docs), bench.limit(0)).collect())


def test_short_items_of_all_lengths(spark):
    rnd = random.Random(21)
    pool = words(rnd, 12)  # few words, so that items begin alike and hits overlap
    items = [(k, " ".join(rnd.choice(pool) for _ in range(1 + k % 14))) for k in range(14, 40)]
    docs = [(i, " ".join(rnd.choice(pool) if rnd.random() < 0.6 else words(rnd, 1)[0] for _ in range(rnd.choice([0, 1, 2, 12, 40])))) for i in range(80)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate(frame(spark, docs), bench).collect()}
    assert out == contamination(docs, items)


def test_decontamination_of_repeated_ids_and_long_texts(spark):
    rnd = random.Random(22)
    item = " ".join(words(rnd, 30))
    long = " ".join([*words(rnd, 30_000), item, *words(rnd, 10), item])
    docs = [(1, "zz " + item), (1, "aa nothing"), (2, "zz nothing"), (2, item), (3, long), (None, item)]
    out = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: (31, 30), 2: (2, 0), 3: (30_070, 60)}  # of an id's rows the greatest text counts


def plain_print(text, samples, words_=5):
    """Consistent weighted sampling, term by term, with no bound on who runs."""
    w = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ").split(" ")
    one = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(one(x.encode())) for x in w]
    grams = Counter(hashed(*h[k : k + words_]) & -2 for k in range(max(1, len(h) - words_ + 1)))
    bits = lambda x, at, n: (((x & (1 << 64) - 1) >> at & (1 << n) - 1) + 1) * (1 / ((1 << n) + 1))
    out = []
    for k in range(samples):
        best = None
        for term, n in grams.items():
            draw = signed(one(term.to_bytes(8, "little", signed=True), one((k // BLOCK).to_bytes(4, "little"))))
            a, b = (one(draw.to_bytes(8, "little", signed=True), one((2 * (k % BLOCK) + j).to_bytes(4, "little"))) for j in (0, 1))
            r, c = -math.log(bits(a, 0, 32) * bits(a, 32, 32)), -math.log(bits(b, 0, 21) * bits(b, 21, 21))
            t = math.floor(math.log(n) / r + bits(b, 42, 22))
            race = math.floor((math.log(c) - r * (t - bits(b, 42, 22) + 1)) * (1 << 20))
            name = hashed(term, t) & 0xFFFF
            best = min(best or (race, name), (race, name))
        out.append(best[1])
    return out


def test_prints_match_a_plain_version(spark):
    rnd = random.Random(23)
    pool = words(rnd, 5)
    texts = ["one", "one two three", " ".join(rnd.choice(pool) for _ in range(400)), " ".join(words(rnd, 150)), "a b c d e f " * 40]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True))]
    for r in fingerprint_pairs(spark.createDataFrame(rows, "id long, a string, b string"), ["id"], "a", "b", 16).collect():
        assert (r.print_a, r.print_b) == (plain_print(rows[r.id][1], 16), plain_print(rows[r.id][2], 16))


def test_terms_that_run_in_no_sample_are_not_grouped(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h", "a b c d e f g")], "id long, a string, b string")
    lines = fingerprint_pairs(df, ["id"], "a", "b")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    inner = lines[max(i for i, x in enumerate(lines) if "Aggregate" in x) :]
    (kept,) = [x for x in inner[: next(i for i, x in enumerate(inner) if "Generate" in x)] if re.search(r"\bFilter\b", x)]
    assert "runs0" in kept and "xxhash64" not in kept  # the hashes are made once, below


def test_next_ids_of_clustered_ids(spark):
    ids = [*range(100, 400), -9 * 10**18, 9 * 10**18, 7 * 10**17]
    got = {r.id: r.next for r in next_ids(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}


def test_the_plan_of_next_ids_does_not_grow(spark):
    size = lambda n: len(next_ids(spark.range(n).repartition(4))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(200) - size(200_000)) < 100


def test_long_texts_have_fingerprints(spark):
    rnd = random.Random(24)
    long = " ".join(words(rnd, 30_000))
    out = {r.doc_id: r for r in fingerprint_documents(frame(spark, [(1, long), (2, long), (3, "x" * 200_000)])).collect()}
    assert out[1].print == out[2].print and len(out[1].print) == SAMPLES and out[3].n_chars == 200_000


def test_fingerprints(spark):
    rnd = random.Random(12)
    docs = [(3 * i, " ".join(words(rnd, 80))) for i in range(60)] + [(500, None), (501, ""), (502, "one two"), (503, "one two"), (504, "é" * 7)]
    out = {r.doc_id: r for r in fingerprint_documents(frame(spark, docs)).withColumn("near", likeness(*map(__import__("pyspark").sql.functions.col, ("print", "edited_print")))).collect()}
    order = sorted((i for i, _ in docs), reverse=True)
    text = {i: t or "" for i, t in docs}
    for k, i in enumerate(order):
        following, n = text[order[(k + 1) % len(order)]], len(text[i]) // 3
        assert (out[i].n_chars, out[i].edited) == (len(text[i]), text[i][: len(text[i]) - n] + following[:n])
    assert out[502].print == out[503].print and out[500].print is None and out[500].near == 1.0
    near = [out[i].near for i, t in docs if t and len(t) > 99]
    assert 0.35 < sum(near) / len(near) < 0.6  # two thirds of the words stay
    assert fingerprint_documents(frame(spark, [])).count() == 0
    (one,) = fingerprint_documents(frame(spark, [(1, "abc def"), (1, None)])).collect()
    assert one.edited == "abc d" + "ab"


def collision_rate(spark, a, b, tries):
    rows = [(i, *(" ".join(f"{w}{i}" for w in t.split()) for t in (a, b))) for i in range(tries)]
    got = fingerprint_pairs(spark.createDataFrame(rows, "id long, a string, b string"), ["id"], "a", "b").collect()
    return sum(x == y for r in got for x, y in zip(r.print_a, r.print_b, strict=True)) / tries / SAMPLES


def test_collisions_follow_generalised_jaccard(spark):
    a, b = "p q r s t u v w " * 2, "p q r s t u v w " * 5 + "x y z"
    grams = lambda t: Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4))
    want = sum((grams(a) & grams(b)).values()) / sum((grams(a) | grams(b)).values())
    assert abs(collision_rate(spark, a, b, 400) - want) < 0.02


def test_digest_columns(spark, data):
    r = q.op6_line_dedup(spark, data).first()
    assert re.fullmatch("[0-9a-f]{64}", r.kept_sha256) and hashlib.sha256(b"").hexdigest() != r.kept_sha256
