"""Rule tables, recovery, and items that no rule claims."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.rules import Rule, chain, counters, facts, match_rows, recovered, unclaimed

#: Made-up wordings of a harbour's report.
RULES = [
    Rule("boats", "rose", r"(?iU)boats in all rose to ([\w ]+?) by"),
    Rule("boats", "counted", r"(?iU)([\w]+) boats came in"),
    Rule("boats", "loose", r"(?iU)boats\D{0,30}?(\d+)"),
    Rule("crates", "counted", r"(?iU)(\d+) crates"),
    Rule("crews", "counted", r"(?iU)(\w+) crews"),
]
BOUNDS = [("at_least", "more than|at least"), ("approx", "about|nearly")]
TEXTS = {
    1: "Boats in all rose to 120 by night. At the north pier 7 boats came in. 30 crates",
    2: "At the north pier seven boats came in; boats 250 in sum; more than 40 crates, about five crews",
    3: "0 boats came in, boats left: 9",
    4: "crates 12",
    5: "many boats came in",
    6: None,
}


def cells(spark, column):
    df = spark.createDataFrame(list(TEXTS.items()), "id int, text string")
    return {r.id: r.c for r in df.select("id", column.alias("c")).collect()}


def test_chains_tell_their_branch(spark):
    boats = [r for r in RULES if r.field == "boats"]
    got = cells(spark, chain(F.col("text"), boats))
    assert {i: c and tuple(c) for i, c in got.items()} == {1: ("rose", 120), 2: ("counted", 7), 3: ("loose", 9), 4: None, 5: None, 6: None}
    got = cells(spark, chain(F.col("text"), boats, off={"rose", "counted"}))
    assert tuple(got[2]) == ("loose", 250) and tuple(got[1]) == ("loose", 120) and got[5] is None
    got = cells(spark, facts(F.col("text"), RULES))
    assert (got[1].boats.branch, got[1].crates.value, got[1].crews) == ("rose", 30, None)


def test_recovery_leaves_branches_out(spark):
    """A total can't be below a part: the branch that read a part is passed over."""
    boats = [r for r in RULES if r.field == "boats"]
    got = cells(spark, recovered(F.col("text"), boats, lambda v: v >= 100))
    assert [(got[i].branch, got[i].value, got[i].passed) for i in TEXTS] == [("rose", 120, []), ("loose", 250, ["counted"]), (None, None, ["loose"]), (None, None, []), (None, None, []), (None, None, [])] or got[6].passed is None
    got = cells(spark, recovered(F.col("text"), boats, lambda v: v.between(5, 9)))
    assert (got[1].branch, got[1].value, got[1].passed) == ("counted", 7, ["rose"])


def test_counters_with_bounds(spark):
    got = cells(spark, counters(F.col("text"), RULES, BOUNDS))
    assert [tuple(c) for c in got[2]] == [("boats", "counted", 7, "exact"), ("crates", "counted", 40, "at_least"), ("crews", "counted", 5, "approx")]
    assert [tuple(c) for c in got[1]] == [("boats", "rose", 120, "exact"), ("crates", "counted", 30, "exact")] and got[4] == []


def test_places_of_matches(spark):
    rnd = random.Random(9)
    texts = [(i, "".join(rnd.choices("a1é 😀+2\n", k=rnd.randint(0, 40)))) for i in range(200)] + [(900, None), (901, "")]
    patterns = {"number": r"[0-9]+", "pair": r"a1|1a"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "id int, text string, start int")
    got = sorted((r.id, r.name, r.start, r.end, r.item) for r in match_rows(df, "id", "text", patterns).collect())
    assert got == sorted((i, n, m.start(), m.end(), m.group()) for i, t in texts for n, p in patterns.items() for m in re.finditer(p, t or ""))


@pytest.mark.parametrize("seed", range(3))
def test_what_no_claim_touches(spark, seed):
    """Overlapping, nested, equal and touching spans against a plain test of each pair."""
    rnd = random.Random(seed)
    spans = lambda n: [(rnd.randrange(12), a := rnd.randrange(60), a + rnd.randint(1, rnd.choice([3, 3, 25]))) for _ in range(n)]
    claimed, found = spans(40), spans(120)
    rows = [(k, s, e, f"{s}-{e}") for k, s, e in found]
    want = []
    for k, s, e, x in rows:
        mine = [(a, b) for key, a, b in claimed if key == k]
        if mine and min(a for a, _ in mine) <= s and e <= max(b for _, b in mine) and not any(a < e and s < b for a, b in mine):
            want.append((k, s, e, x))
    got = unclaimed(spark.createDataFrame(rows, "k int, start int, end int, item string"), spark.createDataFrame(claimed, "k int, start int, end int"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert got.columns == ["k", "start", "end", "item"]
