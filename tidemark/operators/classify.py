"""Classes from names: token sets, canonical spellings and longest matches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(name: Column, sep: str = " and ") -> Column:
    """The parts of a name in lower case."""
    return F.transform(F.split(name, sep), lambda t: F.lower(F.trim(t)))


def classify(name: Column, classes: Sequence[tuple[str, Sequence[str], str]], default: str, sep: str = " and ") -> Column:
    """The first class that applies: (class, tokens, 'any' or 'all' of the name's tokens among them)."""
    parts, out = tokens(name, sep), None
    for label, known, how in classes:
        test = F.exists(parts, lambda t: t.isin(*known)) if how == "any" else F.forall(parts, lambda t: t.isin(*known))  # noqa: B023
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.lit(default) if out is None else out.otherwise(default)


def canonical_spelling(df: DataFrame, name: str, known: DataFrame, spelling: str) -> DataFrame:
    """``name`` as ``known`` spells it, whatever its case; ``known`` is a short list."""
    table = known.select(F.lower(spelling).alias("_fold"), F.col(spelling).alias("_spelt")).groupBy("_fold").agg(F.min("_spelt").alias("_spelt"))
    out = df.join(table, F.lower(F.trim(F.col(name))) == F.col("_fold"), "left")
    return out.withColumn(name, F.coalesce("_spelt", name)).drop("_fold", "_spelt")


def longest_match(text: Column, names: dict[str, str]) -> Column:
    """The value of the longest key that the text contains, case aside; null without any."""
    out = None
    for key in sorted(names, key=lambda k: (-len(k), k)):
        test = F.contains(F.lower(text), F.lit(key.lower()))
        out = F.when(test, names[key]) if out is None else out.when(test, names[key])
    return F.lit(None).cast("string") if out is None else out


def words(text: Column) -> Column:
    """The runs of letters, marks and digits of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def fold(text: Column) -> Column:
    """Text in capitals, which are alike where only case differs; whole foldings such as ß to SS included.

    The collation UNICODE_CI tells the same, but Spark neither hashes nor broadcasts keys under it: each run of words would be
    shuffled and sorted.
    """
    return F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS"))


def lower(text: Column) -> Column:
    """Text in small letters, each character by itself: no Σ depends on its place, İ is one i; ß and SS are told apart."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def longest_name(df: DataFrame, keys: Sequence[str], text: str, names: DataFrame, name: str, value: str, same: Callable[[Column], Column] = fold) -> DataFrame:
    """``df`` with ``value`` of the longest of many names that stands in its text as whole words; null without any.

    ``names`` is a table of any length.  Words are compared after ``same``, accents told apart; what stands between words says
    nothing.  More words win, then more letters, then the first name, all as ``same`` spells them, then the least value.  Each run of as many words as some
    name has is looked up in one equi-join, which Spark broadcasts if its estimate of the names is small, and then only hits are
    shuffled.  Names without words match nothing; rows with equal ``keys`` share what is found in any of their texts, rows
    with a null key find nothing.
    """
    parts = words(same(F.col(name)))
    known = names.select(F.array_join(parts, " ").alias("_name"), F.size(parts).alias("_words"), F.col(value).alias("_value")).where("_words > 0")
    sizes = sorted(r["_words"] for r in known.select("_words").distinct().collect())  # numbers of words that names have: few
    if not sizes:
        return df.withColumn(value, F.lit(None).cast(names.schema[value].dataType))
    known = known.groupBy("_name", "_words").agg(F.min("_value").alias("_value"))
    run = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    # the array of one array binds the words, so that a text is split once and not for each run
    runs = F.flatten(F.transform(F.array(words(same(F.col(text)))), lambda w: F.concat(*[run(w, n) for n in sizes])))
    grams = df.where(F.col(text).isNotNull()).select(*keys, F.explode(runs).alias("_name"))
    rank = F.struct((-F.col("_words")).alias("a"), (-F.length("_name")).alias("b"), F.col("_name").alias("c"), F.col("_value").alias("d"))
    best = grams.join(known, "_name").groupBy(*keys).agg(F.min(rank)["d"].alias(value))
    return df.join(best, list(keys), "left")


def bounded(value: Column, value_max: Column, bound: Column) -> tuple[Column, Column, Column]:
    """Low, high and middle of a measurement with a bound; a suspended one is 0."""
    low = F.when(bound == "suspended", 0.0).when(bound == "up_to", 0.0).otherwise(value)
    high = F.when(bound == "suspended", 0.0).when(bound == "at_least", value).otherwise(F.coalesce(value_max, value))
    return low, high, (low + high) / 2
