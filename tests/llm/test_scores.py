from __future__ import annotations

import math
import random
import re
import time

import numpy as np
from helpers import frame, words

from tidemark.llm import quality, toxicity
from tidemark.llm import queries as q


def test_folding_keeps_places():
    for text in ("ID1OT", "Ïdіоt", "l0ser $cum", "İx", "ＦＯＯ", "£5 - 10%"):
        assert len(toxicity.fold(text)) == len(text)
    assert toxicity.fold("1d10t l0s3r SCUM") == "idiot loser scum" and toxicity.fold("room 101") == "room 101"


def test_lexicon():
    lex = toxicity.Lexicon({"trash$": 2.0, "veju": 3.0})
    hits = lambda s: [(s[a:b], w) for a, b, w in lex.hits(toxicity.fold(s))]
    assert hits("you tr4sh, vejument trashy") == [("tr4sh", 2.0), ("veju", 3.0)]
    assert hits("a trash can, convejuo") == [] and hits("Trash*** TRASH!!") == [("Trash", 2.0), ("TRASH", 2.0)]
    assert lex.features("") == lex.features(None) == (0.0, 0.0)
    few, many = lex.features("trash " + "x " * 10), lex.features("trash " + "x " * 1000)
    assert few[0] > 5 * many[0] and few[1] == many[1] == 0.5
    assert lex.features("trash " * 3)[1] == 1.5 and lex.features(("trash " + "x " * 400) * 3)[1] == 0.5 and lex.features("trash " * 99)[1] == 5.0


def test_lexicon_sees_stand_ins_at_edges_of_words():
    lex = toxicity.Lexicon({"idiot$": 2.0, "worthless$": 2.0, "scum$": 2.0, "trash$": 2.0, "veju": 3.0, "massi": 3.0})
    hits = lambda s: [s[a:b] for a, b, _ in lex.hits(toxicity.fold(s))]
    assert hits("idi07") == ["idi07"] and hits("w0rthle55 worthle$$, (worthle$$)") == ["w0rthle55", "worthle$$", "worthle$$"]
    assert hits('"1diot" and (5cum), "5cum"!') == ["1diot", "5cum", "5cum"] and hits("IDI07!! you 1d107!") == ["IDI07", "1d107"]
    assert hits("(v3ju) ve74 (7rash bin) trash!! $$$ scum$$$ '!!idiot!!'") == ["v3ju", "trash", "scum", "idiot"]
    assert hits('("7rash can") room 101, mass!! $$$ 5c 2017 ' + "x" * 9999 + "!" * 9999) == []
    wild = "(5cum" + "!" * 50_000 + "0" * 50_000
    assert len(lex.unmasked(wild)) == len(wild) and hits(wild) == ["5cum"]


def test_unseen_characters_marks_and_other_shapes():
    lex = toxicity.Lexicon({"idiot$": 2.0, "stupid$": 2.0, "r\u00e9ta$": 3.0, "trash$": 2.0})
    spans = lambda s: [s[a:b] for a, b, _ in lex.spans(s)]
    text = "an i\u200bdi\u00adot, \U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d or \uff29\uff24\uff29\uff2f\uff34; st\u00fap\u00efd s\u0301tupid tr4\u0336sh can"
    assert spans(text) == ["i\u200bdi\u00adot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "\uff29\uff24\uff29\uff2f\uff34", "st\u00fap\u00efd", "s\u0301tupid"]
    assert spans("re\u0301ta r\u00e9ta reta \u24d8\u24d3\u24d8\u24de\u24e3") == ["re\u0301ta", "r\u00e9ta", "\u24d8\u24d3\u24d8\u24de\u24e3"]
    assert toxicity.squeezed("plain") == ("plain", None) and spans("\u0301" * 50) == []


def test_time_grows_with_the_text_only():
    lex = toxicity.Lexicon({"trash$": 2.0, "idiot$": 2.0})
    times = []
    for n in (20_000, 80_000):
        text = "trash can " * n + "1d10t " * n
        began = time.process_time()
        assert len(lex.hits(toxicity.fold(text))) == n
        times.append(time.process_time() - began)
    assert times[1] < 8 * times[0] + 0.5


def test_nested_entries():
    held = {"abcd": (50, 1.0), "abcde": (49, 1.5), "abcdef": (20, 2.0), "wxyz": (30, 1.0), "wxyz$": (29, 1.2), "other$": (9, 3.0)}
    assert toxicity.chosen(held) == {"abcde": 1.5, "wxyz$": 1.2, "other$": 3.0}
    many = {f"{k:06d}"[:n]: (5, 1.0) for k in range(30_000) for n in (4, 5, 6)}
    began = time.process_time()
    toxicity.chosen(many)
    assert time.process_time() - began < 5


def test_toxicity_query_against_a_plain_lexicon(spark, data):
    """Scores of the whole table again, with a scan over words in place of the automaton."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    entries, beta = toxicity.fit_toxicity(docs.select("doc_id", "text"), learn)
    lex = toxicity.Lexicon(entries)

    def plain(text):
        folded = lex.unmasked(lex.plain(toxicity.fold(toxicity.squeezed(text or "")[0])))
        out = []
        for at in range(len(folded)):
            if at and re.match(r"[^\W\d_]", folded[at - 1]):
                continue
            fits = [(e.removesuffix("$"), w) for e, w in entries.items() if folded.startswith(e.removesuffix("$"), at) and not (e.endswith("$") and re.match(r"[^\W\d_]", folded[at + len(e) - 1 :]))]
            if fits:
                word, weight = max(fits, key=lambda f: len(f[0]))
                if not any(re.search(rf"(?<![^\W\d_]){re.escape(x)}(?![^\W\d_])", folded[max(0, at - 40) : at + 60]) for x in toxicity.EXCEPTIONS):
                    out.append((at, weight))
        total, most = sum(w for _, w in out), max((sum(w for b, w in out if a - toxicity.STRETCH <= b <= a) for a, _ in out), default=0.0)
        x = (math.log1p(100 * total / (20 + folded.count(" ") + folded.count("\n"))), min(most, toxicity.PEAK) / 4)
        return 1 / (1 + math.exp(-(beta[0] + beta[1] * x[0] + beta[2] * x[1])))

    got = {r.doc_id: r.score for r in q.op2_toxicity(spark, data).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and all(abs(got[r.doc_id] - plain(r.text)) < 1e-9 for r in rows)


def test_quality_query_against_the_formula(spark):
    """Scores of the whole table from the class densities, written out."""
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs.select("doc_id", "text"), labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    got = {r.doc_id: (r.score, r.predicted) for r in q.op1_quality(spark, data).collect()}
    rows = docs.select("doc_id", "text").collect()
    x = np.array([quality.statistics(r.text) for r in rows])
    z = (x - model.centre) / model.scale
    logs = []
    for mean, factor in zip(model.means, model.factors, strict=True):
        d = (z - mean) @ factor.T
        logs.append(-0.5 * (d**2).sum(1) + np.log(np.abs(np.diag(factor))).sum())
    assert np.allclose(model.difference(x), logs[1] - logs[0])
    assert len(got) == len(rows) and all(abs(got[r.doc_id][0] - s) < 1e-9 and got[r.doc_id][1] == int(s >= 0.5) for r, s in zip(rows, model.score(x), strict=True))


def test_toxicity_learns_entries(spark):
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        w = words(rnd, 40)
        bad = i % 4 == 0
        if bad:
            w[5] = rnd.choice(["grumblefoo", "grumblebar", "grumblez"]) if i % 8 else "zorkish"
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += [(1000, None), (1001, ""), (1002, "a stupid 1d10t"), (1003, "Grumblexyz and GRUMBLEFOO"), (1003, "calm words"), (None, "zorkish")]
    table = frame(spark, docs)
    model = toxicity.fit_toxicity(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("grumblefoo".startswith(e) for e in model[0]) and "zorkish$" in model[0] or any("zorkish".startswith(e) for e in model[0])
    out = toxicity.score_toxicity(table, model).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.predicted for r in out if r.doc_id is not None and r.doc_id < 1003}
    assert all(got[i] == y for i, y in labels) and got[1000] == got[1001] == 0 and got[1002] == 1
    assert sorted(r.predicted for r in out if r.doc_id == 1003) == [0, 1]
    nothing = toxicity.fit_toxicity(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(table.where("doc_id = 1002"), nothing).first()["predicted"] == 1
    assert toxicity.score_toxicity(table.limit(0), nothing).count() == 0


def test_discriminant_separates_by_spread():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 3, (400, 4)), rng.normal(0, 0.5, (400, 4))])  # equal means: a linear rule would fail
    y = np.repeat([0, 1], 400)
    model = quality.fit_discriminant(x[::2], y[::2])
    assert ((model.score(x[1::2]) >= 0.5) == y[1::2]).mean() > 0.9
    low = np.linalg.inv(model.factors[0])
    z = (x[1] - model.centre) / model.scale
    d = z - model.means[0]
    direct = -0.5 * (d @ np.linalg.inv(low @ low.T) @ d + np.log(np.linalg.det(low @ low.T)))
    other = np.linalg.inv(model.factors[1])
    e = z - model.means[1]
    assert abs(model.difference(x[1:2])[0] - (-0.5 * (e @ np.linalg.inv(other @ other.T) @ e + np.log(np.linalg.det(other @ other.T))) - direct)) < 1e-6


def test_statistics_of_odd_texts():
    for text in (None, "", "\n", "x", "x" * 200_000, "\ud800", "é" * 10, "! " * 1000):
        values = quality.statistics(text)
        assert len(values) == len(quality.STATS) and np.isfinite(values).all()


def test_quality_without_labels(spark):
    table = frame(spark, [(1, "a"), (1, None), (None, "")])
    model = quality.fit_quality(table, spark.createDataFrame([], "doc_id long, quality int"))
    assert model is None and {r.score for r in quality.score_quality(table, model).collect()} == {0.5}


def test_queries_on_held_out_labels(spark, data):
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for query, column, least in ((q.op1_quality, "quality", 0.95), (q.op2_toxicity, "toxic", 0.9)):
        out = [r for r in query(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
        assert np.mean([r.predicted == labels[r.doc_id][column] for r in out]) >= least


def test_quality_of_odd_tables(spark):
    """Repeated labels count once, extra columns are ignored, an empty table has no scores."""
    rnd = random.Random(7)
    docs = [(i, (" ".join(words(rnd, 60)) + ".") if i % 2 else "!!! " * rnd.randint(1, 30)) for i in range(120)]
    labels = [(i, i % 2) for i in range(120)]
    table = frame(spark, docs)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    once = quality.fit_quality(table, marks)
    twice = quality.fit_quality(table, marks.unionByName(marks.where("doc_id < 40")))
    x = np.array([quality.statistics(t) for _, t in docs])
    assert np.allclose(once.score(x), twice.score(x)) and ((once.score(x) >= 0.5) == [y for _, y in labels]).mean() > 0.95
    assert quality.score_quality(table.limit(0), once).count() == 0 and quality.fit_quality(table.limit(0), marks) is None
    assert quality.score_quality(table, once).columns == ["doc_id", "score", "predicted"]
