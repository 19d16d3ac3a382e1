"""Paths of nested answers, names from long lists, parents and children as streams."""

from __future__ import annotations

import datetime as dt
import json
import random
import time

from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import classify, shapes
from tidemark.operators.writers import VersionStore
from tidemark.streaming import streams
from tidemark.streaming.families import append_families, families


def plain_paths(text):
    """(path, kind) of each node, by Python's own reader."""
    kind = {dict: "object", list: "array", str: "text", int: "whole", float: "number", bool: "truth", type(None): "null"}

    def walk(path, v):
        yield path, kind[type(v)]
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(path + (f".{k}" if k.isidentifier() or k.isdigit() else f"[{json.dumps(k)}]"), x)
        elif isinstance(v, list):
            for x in v:
                yield from walk(path + "[]", x)

    try:
        return list(walk("$", json.loads(text)))
    except ValueError:
        return [("$", "invalid")]


def nested(rnd, level=0):
    what = rnd.randrange(8 if level < 5 else 5)
    if what < 5:
        return [None, True, rnd.randrange(99), rnd.randrange(99) + 0.5, 'a "{[\\ b'][what]
    if what < 7:
        return {k: nested(rnd, level + 1) for k in rnd.sample(["a", "b", "c d", 'q"', "7"], 3)}
    return [nested(rnd, level + 1) for _ in range(rnd.randrange(4))]


def found_paths(df):
    return {r["path"]: (r["kinds"], r["n"]) for r in df.collect()}


def test_paths_equal_a_plain_walk(spark):
    rnd = random.Random(4)
    texts = [json.dumps({"top": nested(rnd)}) for _ in range(200)] + ["not json", "", "[]", "{}", '"x"', "null"]
    want = {}
    for t in texts:
        for path, kind in plain_paths(t):
            kinds, n = want.setdefault(path, (set(), 0))
            want[path] = (kinds | {kind}, n + 1)
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "j string")
    assert found_paths(shapes.json_paths(df, "j")) == {p: (sorted(k), n) for p, (k, n) in want.items()}


def test_paths_of_data_keys_and_of_empty_tables(spark):
    df = spark.createDataFrame([("a", '{"by_id": {"1": {"hit": 2}, "2": {"hit": 3}}}'), ("b", '{"by_id": {}}')], "g string, j string")
    got = {(r["g"], r["path"]): r["n"] for r in shapes.json_paths(df, "j", ["g"], keyed=["$.by_id"]).collect()}
    assert got == {("a", "$"): 1, ("a", "$.by_id"): 1, ("a", "$.by_id{}"): 2, ("a", "$.by_id{}.hit"): 2, ("b", "$"): 1, ("b", "$.by_id"): 1}
    assert shapes.json_paths(df.where("false"), "j").count() == 0


def test_what_lies_too_deep_is_named(spark):
    df = spark.createDataFrame([("[" * 40 + "]" * 40,), ('{"a": 1}',)], "j string")
    got = found_paths(shapes.json_paths(df, "j", deepest=3))
    assert got == {"$": (["array", "object"], 2), "$.a": (["whole"], 1), "$[]": (["array"], 1), "$[][]": (["array"], 1), "$[][][]": (["deeper"], 1)}


def test_drift_names_new_gone_and_retyped_paths(spark):
    def paths(*texts):
        return shapes.json_paths(spark.createDataFrame([(t,) for t in texts], "j string"), "j")

    old = paths('{"a": 1, "b": {"c": "x"}, "n": null, "w": 1, "gone": true}')
    new = paths('{"a": "1", "b": {"c": null}, "n": 3, "w": 1.5, "more": []}', '{"a": "2", "b": {"c": "y"}, "w": 2}')
    got = [(r["path"], r["change"], r["before"], r["after"]) for r in shapes.drift(old, new).orderBy("path").collect()]
    assert got == [("$.a", "retyped", ["whole"], ["text"]), ("$.gone", "gone", ["truth"], None), ("$.more", "new", None, ["array"])]
    assert shapes.drift(old, old).count() == 0


def test_longest_of_many_names(spark):
    rnd = random.Random(3)
    letters = "abcdefghij"
    names = {" ".join(rnd.choices(letters, k=rnd.randrange(1, 6))) for _ in range(20000)}
    names = sorted(n for n in names if len(n) > 3)[:10000]
    texts = [" ".join(rnd.choices(letters.upper() + letters, k=30)) for _ in range(200)] + ["", None, "!!", "a"]
    table = spark.createDataFrame([(n, n) for n in names], "name string, v string")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    out = classify.longest_name(df, ["k"], "x", table, "name", "v")
    want = []
    for text in texts:
        padded = f" {(text or '').lower()} "
        want.append(min((n for n in names if f" {n} " in padded), key=lambda n: (-len(n.split()), -len(n), n), default=None))
    assert [r["v"] for r in out.orderBy("k").collect()] == want and sum(w is not None for w in want) >= 200
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and len(plan) < 20_000


def test_a_very_long_text_is_split_once(spark):
    table = spark.createDataFrame([(" ".join(["wort"] * n + ["ende"]), n) for n in (1, 2, 5, 9)], "name string, v int")
    df = spark.range(1).select("id", F.concat(F.repeat(F.lit("wort, "), 200_000), F.lit("ende")).alias("x"))
    began = time.monotonic()
    assert classify.longest_name(df, ["id"], "x", table, "name", "v").first()["v"] == 9
    assert time.monotonic() - began < 30


def test_names_fold_whole_and_keep_accents(spark):
    names = spark.createDataFrame([("Große Straße", "g"), ("GROSSE STRASSE", "h"), ("resume", "r"), ("", "never"), ("--", "never"), ("Straße", "s")], "name string, v string")
    df = spark.createDataFrame([(1, "die grosse-STRASSE!"), (2, "Résumé"), (3, "RESUME, bitte"), (4, "Hauptstraße"), (None, "resume"), (5, "x"), (5, "resume")], "k int, x string")
    got = sorted(((r["k"], r["x"], r["v"]) for r in classify.longest_name(df, ["k"], "x", names, "name", "v").collect()), key=repr)
    assert got == sorted([(1, "die grosse-STRASSE!", "g"), (2, "Résumé", None), (3, "RESUME, bitte", "r"), (4, "Hauptstraße", None), (None, "resume", None), (5, "x", "r"), (5, "resume", "r")], key=repr)
    assert classify.longest_name(df, ["k"], "x", names.where("false"), "name", "v").where("v is not null").count() == 0


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


class Posts:
    """Two folders of files that come one by one; the query is started anew each time."""

    P, C = "k int, at timestamp, text string", "k int, part int, child_at timestamp, place string"

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self.store, self.kids = VersionStore(spark, f"{path}/parents", ("k",)), VersionStore(spark, f"{path}/kids", ("k", "part"))
        for name, schema in (("p", self.P), ("c", self.C)):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")

    def go(self, parents=(), children=()):
        for name, schema, new in (("p", self.P, parents), ("c", self.C, children)):
            if new:
                self.spark.createDataFrame(list(new), schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
        p, c = (streams.source(self.spark, f"{self.path}/{n}", s) for n, s in (("p", self.P), ("c", self.C)))
        both = families(p, c, ["k"], "at", "child_at", within="2 hours", early="10 minutes", late="6 hours")
        append_families(both, self.store, self.kids, f"{self.path}/kept", version=F.col("at"), child_version=F.col("child_at"), orphans=f"{self.path}/orphans").awaitTermination()
        return self

    def stored(self):
        p, c = self.store.latest(), self.kids.latest()
        return sorted(r["k"] for r in p.collect()) if p else [], sorted((r["k"], r["part"]) for r in c.collect()) if c else []


def test_parents_meet_their_children(spark, tmp_path):
    posts = Posts(spark, str(tmp_path))
    posts.go([(1, at(0), "a"), (2, at(0), "b"), (4, at(0), "d")], [(1, 1, at(1), "x"), (1, 2, at(-0.1), "y"), (4, 1, at(5), "too far"), (3, 1, at(0), "no parent")])
    assert posts.stored() == ([1], [(1, 1), (1, 2)])
    # started anew: a late child of 1, and 1 once more with other words
    posts.go([(1, at(0.5), "again")], [(1, 3, at(1.5), "late")])
    assert posts.stored() == ([1], [(1, 1), (1, 2), (1, 3)])
    # both watermarks pass: 2 and 4 come without children, children without a parent apart
    posts.go([(9, at(40), "end")], [(9, 1, at(40), "end")]).go([(9, at(41), "end")], [(9, 2, at(41), "end")])
    assert posts.stored() == ([1, 2, 4, 9], [(1, 1), (1, 2), (1, 3), (9, 1), (9, 2)])
    assert {r["text"] for r in posts.store.latest().where("k = 1").collect()} == {"a"} and posts.store.read().where("k = 1").count() == 1
    alone = spark.read.schema(Posts.C + ", batch int").parquet(f"{tmp_path}/orphans")
    assert rows(alone.select("k", "part")) == [(3, 1), (4, 1)]
