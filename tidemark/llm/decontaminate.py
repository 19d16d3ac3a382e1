"""Benchmark decontamination by winnowing.

Both sides keep the least k-gram hash of every sliding window, and where it stands, so that any span of ``window``
words that a document shares with an item leaves the same fingerprint on both.  Joined fingerprints name the documents
and places to look at; each hit is extended to the windows around it, which are compared in full.  Items shorter than
a window are one window of their own length: documents are looked at where their first two words stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_lower, cut, let

#: Between words: all ASCII but digits and letters (upper case is gone by then).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 4


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def pair_hash(span: Column) -> list[Column]:
    """Two independent 64-bit hashes of an array of words."""
    return [F.xxhash64(span).alias("w1"), F.xxhash64(F.lit(29), span).alias("w2")]


def _grams(words: Column, body) -> Column:
    """``body`` of the array of hashes of the K = 4 words from each place on; its last K - 1 entries are not full ones."""

    def rolled(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(rolled(h), body))


#: A fingerprint's low bits are the place of its k-gram, as far as they go; longer texts are tried at all places that fit.
PLACE = 24


def fingerprints(words: Column, window: int) -> Column:
    """The winnowed hashes of an array of words with the places of their k-grams; fewer words than a window have none.

    Of equal hashes in a window the first counts, on either side.
    """
    wide = window - K + 1

    def least(m: Column, have: int) -> Column:  # the least of ``have`` neighbours becomes that of up to twice as many
        if have == wide:
            return F.array_distinct(F.slice(m, 1, F.greatest(F.size(m) - window + 1, F.lit(0))))
        step = min(have, wide - have)
        return let(F.transform(m, lambda x, i: F.least(x, F.get(m, i + step))), lambda x: least(x, have + step))

    low = F.lit((1 << PLACE) - 1)
    placed = lambda g: F.transform(g, lambda x, i: x.bitwiseAND(F.lit(-(1 << PLACE))).bitwiseOR(i.cast("long").bitwiseAND(low)))
    return _grams(words, lambda g: let(placed(g), lambda m: least(m, 1)))


def hash_of(fingerprint: Column) -> Column:
    return F.shiftright(fingerprint, PLACE)


def place_of(fingerprint: Column) -> Column:
    return fingerprint.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")


def _starts(places: Column, n: Column, window: int) -> Column:
    """Places at which a window of an ``n``-word text may start that holds the k-gram at one of ``places``."""
    every = F.flatten(F.transform(places, lambda p: F.when(p < n, F.sequence(p, n - 1, F.lit(1 << PLACE))).otherwise(F.array().cast("array<int>"))))
    around = F.transform(F.filter(every, lambda p: p <= n - K), lambda p: F.sequence(F.greatest(p - (window - K), F.lit(0)), F.least(p, n - window)))
    return F.array_distinct(F.flatten(around))


def _openings(words: Column) -> Column:
    """Hashes of each word and of each pair of words, as short items begin with."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.concat(h, F.filter(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))), lambda x, i: i < F.size(h) - 1)))


def _short_spans(base: DataFrame, short: DataFrame, words: Column) -> DataFrame:
    """(doc_id, pos, len, w1, w2) of the spans of documents that begin as a short item does and are as long as one.

    ``short(len, opening)``: lengths and hashes of the items' first two words.  Only documents that hold an opening are
    looked at, and of these only the places at which it stands.
    """
    held = base.select("doc_id", F.explode(F.array_distinct(_openings(words))).alias("opening"))
    held = cut(held.join(short.hint("merge"), "opening").groupBy("doc_id").agg(F.collect_set(F.struct("opening", "len")).alias("held")))

    def spans(w: Column) -> Column:
        def at(x: Column) -> Column:
            n = x["len"]
            begins = lambda p: F.when(n == 1, F.xxhash64(F.get(w, p))).otherwise(F.xxhash64(F.xxhash64(F.get(w, p)), F.xxhash64(F.get(w, p + 1))))
            places = F.filter(F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>")), lambda p: begins(p) == x["opening"])
            return F.transform(places, lambda p: F.struct(p.alias("pos"), n.alias("len"), *pair_hash(F.slice(w, p + 1, n))))

        return F.flatten(F.transform("held", at))

    found = base.join(held.hint("merge"), "doc_id").select("doc_id", let(words, spans).alias("c"))
    return found.select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.pos", "c.len", "c.w1", "c.w2")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: float = 0.05) -> DataFrame:
    """Per distinct ``doc_id``: ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as sorted strings) and ``contaminated``.

    A document word is hit if it lies inside an occurrence of a window; contaminated documents have hits on at least
    ``share`` of their words.  Null or wordless texts have no words and no hits; items without words match nothing.
    Of rows that share a document id the one with the greatest text counts; items may share an id; rows without an id
    are left out.  Texts of any length: work and memory grow with a text's words and with its hits.  Other columns are
    ignored; empty tables give no rows or no hits.
    """
    parts = round(1 / share)
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not base.groupBy("doc_id").count().where("count > 1").isEmpty():
        base = cut(base.groupBy("doc_id").agg(F.max("text").alias("text")))
    words = words_of(F.col("text"))
    bench = cut(items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0))
    spans = bench.select("item", F.least(F.size("words"), F.lit(window)).alias("len"), "words")
    spans = spans.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1), lambda i: F.slice("words", i, F.col("len")))).alias("span"))
    spans = cut(spans.select("item", "len", *pair_hash(F.col("span"))).distinct())

    seen = cut(base.select("doc_id", let(words, lambda w: F.struct(F.size(w).alias("n"), fingerprints(w, window).alias("prints"))).alias("d")).select("doc_id", "d.n", "d.prints"))
    test = bench.select(F.explode(fingerprints(F.col("words"), window)).alias("print")).select(hash_of(F.col("print")).alias("hash")).distinct()
    mine = seen.select("doc_id", F.explode("prints").alias("print")).select("doc_id", hash_of(F.col("print")).alias("hash"), place_of(F.col("print")).alias("place"))
    found = cut(mine.join(test, "hash").groupBy("doc_id").agg(F.collect_set("place").alias("places")))
    near = base.join(found.hint("merge"), "doc_id").select("doc_id", let(words, lambda w: let(_starts(F.col("places"), F.size(w), window), lambda s: F.transform(s, lambda p: F.struct(p.alias("pos"), *pair_hash(F.slice(w, p + 1, window)))))).alias("c"))
    keyed = near.select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.pos", F.lit(window).alias("len"), "c.w1", "c.w2")
    few = bench.where(F.size("words") < window)
    if not few.isEmpty():
        opening = F.when(F.size("words") == 1, F.xxhash64(F.get("words", F.lit(0)))).otherwise(F.xxhash64(F.xxhash64(F.get("words", F.lit(0))), F.xxhash64(F.get("words", F.lit(1)))))
        keyed = keyed.unionByName(_short_spans(base, cut(few.select(F.size("words").alias("len"), opening.alias("opening")).distinct()), words))
    hits = cut(keyed.join(spans, ["len", "w1", "w2"]).select("doc_id", "pos", "len", "item"))
    in_order = Window.partitionBy("doc_id").orderBy("pos", "len")
    ends = hits.groupBy("doc_id", "pos").agg(F.max("len").alias("len"))
    ends = ends.withColumn("from", F.greatest("pos", F.coalesce(F.max(F.col("pos") + F.col("len")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.col("pos"))))
    words_hit = ends.groupBy("doc_id").agg(F.sum(F.greatest(F.col("pos") + F.col("len") - F.col("from"), F.lit(0))).alias("n_hit"))
    named = hits.select("doc_id", "item").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    size = seen.select("doc_id", F.col("n").cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = size.join(words_hit.join(named, "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((hit > 0) & (hit * parts >= F.col("n_words"))).alias("contaminated")).withColumn("n_items", F.size("items").cast("long"))
