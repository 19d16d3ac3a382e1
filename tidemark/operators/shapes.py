"""Shapes of nested JSON answers without a fixed schema: which paths there are, what they hold, and what has changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "text", "BIGINT": "whole", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "truth", "VOID": "null"}


def _kind(v: Column) -> Column:
    """What a variant holds; SQL null, from text that is no JSON, is ``invalid``."""
    named = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    # the array of one name binds it, so that a variant's schema is told once
    kind = F.transform(F.array(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)), lambda name: F.coalesce(named[name], F.lower(name)))[0]
    return F.when(v.isNull(), "invalid").otherwise(kind)


def depth(text: Column) -> Column:
    """How many brackets of a JSON text stand in each other, by brackets outside of strings."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]+", "")
    step = lambda s, c: F.when(c.isin("[", "{"), F.struct((s["now"] + 1).alias("now"), F.greatest(s["most"], s["now"] + 1).alias("most"))).otherwise(F.struct((s["now"] - 1).alias("now"), s["most"].alias("most")))
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def _below(path: Column, v: Column, kind: Column, keyed: Sequence[str]) -> Column:
    """The members of an object or array with their paths."""
    plain = lambda k: F.when(k.rlike(r"^\w+$"), F.concat(F.lit("."), k)).otherwise(F.concat(F.lit("["), F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit("]")))
    name = lambda k: F.when(path.isin(*keyed), F.lit("{}")).otherwise(plain(k)) if keyed else plain(k)
    node = lambda p, x: F.struct(p.alias("path"), x.alias("v"), F.lit(True).alias("open"))
    members = F.transform(F.map_entries(v.try_cast("map<string,variant>")), lambda e: node(F.concat(path, name(e["key"])), e["value"]))
    items = F.transform(v.try_cast("array<variant>"), lambda x: node(F.concat(path, F.lit("[]")), x))
    return F.when(kind == "object", members).when(kind == "array", items)


def json_paths(df: DataFrame, text: str, by: Sequence[str] = (), keyed: Sequence[str] = (), deepest: int = 24) -> DataFrame:
    """The paths of a column of JSON texts: (``by``…, path, kinds, n), ``n`` how often a path stands in them, ``kinds`` sorted.

    Items of an array share the path ``…[]``; so do the members ``…{}`` of objects whose keys are data, whose paths ``keyed`` lists.
    Text that isn't JSON is the path ``$`` of kind ``invalid``; null texts have no path.  Texts are read as variants and
    opened a level at a time within one task; only paths with their counts are shuffled.  Levels are as many as the texts
    have (one number, from a first pass), at most ``deepest``: what lies below that is of kind ``deeper``.
    """
    texts = df.where(F.col(text).isNotNull())
    valid = F.try_parse_json(text).isNotNull()
    levels = texts.agg(F.max(F.when(valid, depth(F.col(text)))).alias("n")).first()["n"] or 0
    none = F.lit(None).cast("variant")
    nodes = texts.select(*by, F.lit("$").alias("path"), F.try_parse_json(text).alias("v"), F.lit(True).alias("open")).withColumn("kind", _kind(F.col("v")))
    for _ in range(min(levels, deepest)):
        here = F.struct("path", none.alias("v"), F.lit(False).alias("open"))
        below = F.when(F.col("open"), _below(F.col("path"), F.col("v"), F.col("kind"), keyed))
        # a node stands before its members, with its kind and closed
        opened = nodes.select(*by, "kind", F.explode(F.concat(F.array(here), F.coalesce(below, F.slice(F.array(here), 1, 0)))).alias("x"))
        nodes = opened.select(*by, "x.path", "x.v", "x.open", F.when(F.col("x.open"), _kind(F.col("x.v"))).otherwise(F.col("kind")).alias("kind"))
    if levels > deepest:
        # containers that no step has opened
        nodes = nodes.withColumn("kind", F.when(F.col("open") & F.col("kind").isin("object", "array"), "deeper").otherwise(F.col("kind")))
    counted = nodes.groupBy(*by, "path", "kind").agg(F.count("*").alias("n"))
    return counted.groupBy(*by, "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("n").alias("n"))


def _meaning(kinds: Column) -> Column:
    """Kinds without those that say nothing new: null beside others, whole numbers beside numbers."""
    told = F.when(F.size(kinds) > 1, F.array_remove(kinds, "null")).otherwise(kinds)
    return F.when(F.array_contains(told, "number"), F.array_remove(told, "whole")).otherwise(told)


def drift(known: DataFrame, incoming: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Paths that are new, gone or retyped: (``by``…, path, change, before, after), both inputs as ``json_paths`` gives them.

    A path that held nothing but null on one side, or whole numbers before and after among other numbers, isn't retyped.
    """
    keys = [*by, "path"]
    nothing = F.lit(None).cast("array<string>")
    old = known.select(*keys, _meaning(F.col("kinds")).alias("before"), nothing.alias("after"))
    new = incoming.select(*keys, nothing.alias("before"), _meaning(F.col("kinds")).alias("after"))
    both = old.unionByName(new).groupBy(*keys).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    void, numbers = F.array(F.lit("null")), F.array(F.lit("number"), F.lit("whole"))
    wide = lambda k: F.array_distinct(F.transform(k, lambda x: F.when(F.array_contains(numbers, x), "number").otherwise(x)))
    retyped = (F.array_sort(wide(F.col("before"))) != F.array_sort(wide(F.col("after")))) & (F.col("before") != void) & (F.col("after") != void)
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(retyped, "retyped")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", "before", "after")
