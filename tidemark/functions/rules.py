"""Wordings as tables of rules: chains of alternatives whose branch is told, recovery without a branch, and items that no rule claims.

A table is data of the caller's, a rule a row of it: what it is for, the name of its branch, its pattern and the group with the
number.  Each table becomes one expression.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.reports import spelt_number
from tidemark.functions.text import let, number_word

#: How a number is bound, by the words before it.
Bounds = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class Rule:
    field: str
    branch: str
    pattern: str
    group: int = 1


def number_in(words: Column) -> Column:
    """A number in digits or words; null if there is none, or 0, which counts as none in a chain."""
    return F.nullif(F.coalesce(words.try_cast("long"), spelt_number(F.nullif(words, F.lit(""))), number_word(words)), F.lit(0).cast("long"))


def candidates(text: Column, rules: Sequence[Rule]) -> Column:
    """(branch, value) of each rule that gives a number, in the table's order."""
    found = [F.struct(F.lit(r.branch).alias("branch"), number_in(F.regexp_extract(text, r.pattern, r.group)).alias("value")) for r in rules]
    return F.filter(F.array(*found), lambda c: c["value"].isNotNull())


def chain(text: Column, rules: Sequence[Rule], off: Collection[str] = ()) -> Column:
    """(branch, value) of the first rule that gives a number, as if the branches in ``off`` were not there; null without one."""
    return F.get(candidates(text, [r for r in rules if r.branch not in off]), F.lit(0))


def recovered(text: Column, rules: Sequence[Rule], plausible: Callable[[Column], Column]) -> Column:
    """(branch, value, passed): the chain run again without each branch whose value can't be, until one can.

    ``passed`` names the branches left out, in order.  If no branch gives a plausible value, branch and value are null.
    """

    def pick(found: Column) -> Column:
        good = F.filter(found, lambda c: F.coalesce(plausible(c["value"]), F.lit(False)))
        first = F.get(good, F.lit(0))
        place = F.coalesce(F.array_position(found, first), F.lit(0))
        passed = F.slice(found, 1, F.when(place > 0, place - 1).otherwise(F.size(found)).cast("int"))
        return F.struct(first["branch"].alias("branch"), first["value"].alias("value"), F.transform(passed, lambda c: c["branch"]).alias("passed"))

    return let(candidates(text, rules), pick)


def facts(text: Column, rules: Sequence[Rule]) -> Column:
    """A struct with (branch, value) for each field of the table, in the order in which it names them first."""
    return F.struct(*[chain(text, [r for r in rules if r.field == f]).alias(f) for f in dict.fromkeys(r.field for r in rules)])


def counters(text: Column, rules: Sequence[Rule], bounds: Bounds = (), reach: int = 40) -> Column:
    """(category, branch, value, bound) for each field that has a number, from the first of its rules that gives one.

    ``bounds``: (name, pattern of the words right before what the rule matches), looked for within ``reach`` characters; the
    first that fits names the bound, else it is ``exact``.
    """

    def bound(rule: Rule) -> Column:
        at = F.regexp_instr(text, F.lit(rule.pattern))
        before = F.substr(text, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach)))
        return F.coalesce(*[F.when(before.rlike(rf"(?iU)(?:{words})\s*$"), F.lit(name)) for name, words in bounds], F.lit("exact"))

    def counter(field: str) -> Column:
        mine = [r for r in rules if r.field == field]
        found = [F.struct(F.lit(field).alias("category"), F.lit(r.branch).alias("branch"), number_in(F.regexp_extract(text, r.pattern, r.group)).alias("value"), bound(r).alias("bound")) for r in mine]
        return F.get(F.filter(F.array(*found), lambda c: c["value"].isNotNull()), F.lit(0))

    return F.filter(F.array(*[counter(f) for f in dict.fromkeys(r.field for r in rules)]), lambda c: c.isNotNull())


def match_rows(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, name, start, end, item): every match of every pattern with its place in code points, the end exclusive.

    The pieces between matches and the matches take turns, so a match starts where the lengths before it end.  Keys are
    unique; patterns match something, and have no groups.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def turns(name: str, pattern: str) -> Column:
        pieces, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.transform(F.arrays_zip(F.transform(pieces, lambda p: F.length(p)).alias("gap"), found.alias("item")), lambda z: F.struct(F.lit(name).alias("name"), z["gap"].alias("gap"), z["item"].alias("item")))

    rows = df.select(key, F.explode(F.array(*[turns(n, p) for n, p in patterns.items()])).alias("turns")).select(key, F.posexplode("turns").alias("at", "m"))
    rows = rows.select(key, "m.name", "at", "m.gap", "m.item").where("item is not null")
    upto = F.sum(F.col("gap") + F.length("item")).over(Window.partitionBy(key, "name").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, "name", (upto - F.length("item")).alias("start"), upto.alias("end"), "item")


def unclaimed(found: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """Rows of ``found`` that no row of ``claimed`` touches, between the first start and the last end claimed for their key.

    Both have (key, start, end).  One pass in order of start: a span is touched by an earlier one that reaches beyond its start, or
    by a later one that starts before its end.  Spans may overlap and nest; those without a claim for their key are left out.
    """
    claims = claimed.select(key, "start", "end").withColumn("_claim", F.lit(True))
    both = claims.unionByName(found.withColumn("_claim", F.lit(False)), allowMissingColumns=True)
    of = Window.partitionBy(key)
    order = of.orderBy("start", F.col("_claim").desc())
    when = lambda c: F.when(F.col("_claim"), F.col(c))
    both = both.withColumns({
        "_reach": F.max(when("end")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.min(when("start")).over(order.rowsBetween(1, Window.unboundedFollowing)),
        "_low": F.min(when("start")).over(of), "_high": F.max(when("end")).over(of),
    })
    inside = (F.col("start") >= F.col("_low")) & (F.col("end") <= F.col("_high"))
    free = (F.coalesce("_reach", F.col("start")) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    return both.where(~F.col("_claim") & inside & free).select(*found.columns)
