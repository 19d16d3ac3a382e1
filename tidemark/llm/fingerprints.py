"""Document fingerprints by consistent weighted sampling.

A text's terms are its shingles of words, weighted by how often they occur.  For each sample k a term draws, from
hashes of (k, term), r and c from Gamma(2, 1) and b uniformly; with t = floor(ln(weight) / r + b) its race value is
ln c - r (t - b + 1), and the term of least value wins.  Two texts agree on a winner (term and t) with
probability equal to the generalised Jaccard similarity of their weights.

A text and its edited form share most terms, which draw once for both.  The race's least value is exponential with the
text's total weight as its rate, so a term whose value is surely above MARGIN over that weight need not run: for
terms of weight 1 a bound without logarithms tells.  That no term is left happens once in e**MARGIN samples; the
sample then is named 0.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, let

SAMPLES = 48
WORDS = 5
MARGIN = 25.0
#: Race values are kept in steps of 2 ** -20, in front of 16 bits that name the winner.
STEP, NAME = float(1 << 20), 16
#: Samples whose races are run together: as many as the JVM compiles in one piece.
BLOCK = 4
#: A form that is written in this many hexadecimal digits a sample.
DIGITS = NAME // 4


def _runs(g: Column) -> Column:
    """Distinct numbers of a sorted array, with how often each occurs."""
    ends = F.filter(F.transform(g, lambda x, i: F.when(x.eqNullSafe(F.get(g, i + 1)), F.lit(-1)).otherwise(i)), lambda e: e >= 0)
    return let(ends, lambda e: F.transform(e, lambda x, j: F.struct(F.get(g, x).alias("x"), (x - F.coalesce(F.get(e, j - 1), F.lit(-1))).alias("n"))))


def shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of the text's shingles; words are what white space leaves, fewer than ``words``, but some, are one shingle."""
    split = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")

    def rolled(h: Column) -> Column:
        every = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, words)]))
        return F.slice(every, 1, F.greatest(F.size(h) - words + 1, F.least(F.size(h), F.lit(1))))

    return let(F.transform(split, lambda w: F.xxhash64(w)), rolled)


def both_terms(a: Column, b: Column) -> Column:
    """(term, weight in a, weight in b) for the terms of either: the lowest bit of a hash tells whose it is, until they are sorted."""
    marked = F.sort_array(F.concat(F.transform(a, lambda x: x.bitwiseAND(F.lit(-2))), F.transform(b, lambda x: x.bitwiseOR(F.lit(1)))))

    def paired(r: Column) -> Column:
        def row(e: Column, i: Column) -> Column:
            other = F.get(r, i + 1)
            twin = F.coalesce(other["x"] == e["x"].bitwiseOR(F.lit(1)), F.lit(False)) & (e["x"] != other["x"])
            mine = e["x"].bitwiseAND(F.lit(1)) == 0
            second = F.when(~mine, e["n"]).when(twin, other["n"]).otherwise(0)
            # the second of twins was told with the first
            told = ~mine & (i > 0) & F.coalesce(F.get(r, i - 1)["x"] == e["x"].bitwiseAND(F.lit(-2)), F.lit(False))
            return F.when(~told, F.struct(e["x"].bitwiseAND(F.lit(-2)).alias("term"), F.when(mine, e["n"]).otherwise(0).alias("wa"), second.alias("wb")))

        return F.filter(F.transform(r, row), lambda x: x.isNotNull())

    return let(marked, lambda g: let(_runs(g), paired))


def _unit(h: Column, shift: int, bits: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND((1 << bits) - 1) + 1) * (1.0 / ((1 << bits) + 1))


def _hashes(k: int) -> tuple[Column, Column]:
    """The two hashes of sample ``k`` of this row's block."""
    return tuple(F.xxhash64(F.lit(2 * k + j), F.col("draw")) for j in range(2))


def _draws(one: Column, two: Column) -> tuple[Column, Column, Column, Column]:
    """u v, p, q and b of two hashes."""
    return _unit(one, 0, 32) * _unit(one, 32, 32), _unit(two, 0, 21), _unit(two, 21, 21), _unit(two, 42, 22)


def _runs_for(k: int) -> Column:
    """Whether this row's term need run for sample ``k``."""
    uv, p, q, b = _draws(F.col(f"one{k}"), F.col(f"two{k}"))
    least = 2.0 - p - q
    # c >= 2 - p - q.  For weight 1 exp of the race value is c (u v) ** (1 - b), hence at least c u v; and nearer, as
    # -ln x <= 8 (x ** -1/8 - 1) bounds r from above, at least c (1 - s) ** 8; roots are taken for the few that pass the first bound
    eighth = lambda x: F.sqrt(F.sqrt(F.sqrt(x)))
    near = F.when(least * uv < F.col("bound"), (1.0 / eighth(uv) - 1.0) * (1.0 - b) > 1.0 - eighth(F.col("bound") / least)).otherwise(False)
    return (F.col("wa") > 1) | (F.col("wb") > 1) | near


def _sample(k: int) -> tuple[Column, Column]:
    """For sample ``k`` of this row's block the race values of its term in both texts, with the winner's name, each as one long."""
    uv, p, q, b = _draws(*_hashes(k))  # made again for those that run: carried along, they cost more
    r, c = -F.log(uv), -F.log(p * q)

    def race(weight: str) -> Column:
        t = F.floor(F.log(F.col(weight).cast("double")) / r + b)
        name = F.xxhash64(F.col("term"), t).bitwiseAND((1 << NAME) - 1)
        return F.when(F.col(f"runs{k}") & (F.col(weight) > 0), F.shiftleft(F.floor((F.log(c) - r * (t - b + 1)) * STEP), NAME).bitwiseOR(name))

    return race("wa"), race("wb")


def fingerprint_pairs(df: DataFrame, keys: list[str], a: str, b: str, samples: int = SAMPLES) -> DataFrame:
    """Per row of ``df``, whose ``keys`` are unique: ``print_a`` and ``print_b`` of the texts ``a`` and ``b``, arrays of winners' names.

    Texts without words have null.  A document's terms are reduced to its winners where they are made, so long texts
    and frequent terms meet in no task; if ``df`` is dealt by ``keys``, nothing moves.  Of the terms that run in no
    sample of a block only a text's first is grouped, so that no block is missing.
    ``samples`` is a multiple of BLOCK.
    """
    cells = let(F.struct(shingles(F.col(a)).alias("a"), shingles(F.col(b)).alias("b")), lambda g: F.struct(F.size(g["a"]).alias("na"), F.size(g["b"]).alias("nb"), both_terms(g["a"], g["b"]).alias("terms")))
    na, nb = (F.when(F.col(f"c.n{s}") > 0, F.col(f"c.n{s}")) for s in "ab")
    sides = F.when(na.isNotNull(), 1).otherwise(0) + F.when(nb.isNotNull(), 2).otherwise(0)
    rows = df.select(*keys, cells.alias("c")).select(*keys, sides.alias("sides"), (MARGIN / F.least(na, nb)).alias("bound"), F.posexplode_outer("c.terms").alias("at", "t"))
    rows = rows.select(*keys, "sides", "bound", "at", "t.term", "t.wa", "t.wb", F.explode(F.sequence(F.lit(0), F.lit(samples // BLOCK - 1))).alias("block"))
    rows = rows.withColumn("draw", F.xxhash64("block", "term"))
    rows = rows.select("*", *[h.alias(f"{name}{k}") for k in range(BLOCK) for name, h in zip(("one", "two"), _hashes(k), strict=True)])
    # a column that is not deterministic holds the filter here: below, it would compute the hashes at each of their places
    rows = rows.select("*", F.spark_partition_id().alias("held"), *[_runs_for(k).alias(f"runs{k}") for k in range(BLOCK)])
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    rows = rows.where((F.col("held") >= 0) & reduce(or_, [F.col(f"runs{k}") for k in range(BLOCK)], first))
    races = {f"{side}{k}": F.min(race) for k in range(BLOCK) for side, race in zip("ab", _sample(k), strict=True)}
    best = rows.groupBy(*keys, "sides", "block").agg(*[v.alias(c) for c, v in races.items()])
    names = {s: F.array(*[F.coalesce(F.col(f"{s}{k}").bitwiseAND((1 << NAME) - 1), F.lit(0)).cast("int") for k in range(BLOCK)]) for s in "ab"}
    whole = best.groupBy(*keys, "sides").agg(F.array_sort(F.collect_list(F.struct("block", names["a"].alias("a"), names["b"].alias("b")))).alias("blocks"))
    return whole.select(*keys, *[F.when(F.col("sides").bitwiseAND(bit) > 0, F.flatten(F.transform("blocks", lambda x: x[s]))).alias(f"print_{s}") for s, bit in (("a", 1), ("b", 2))])  # noqa: B023


def as_text(prints: Column) -> Column:
    """Four hex digits a sample; '' for a text without words."""
    return F.coalesce(F.array_join(F.transform(prints, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples; 1 for two texts without words, 0 if only one has any."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).otherwise(F.coalesce(same / samples, F.lit(0.0)))


def next_ids(ids: DataFrame) -> DataFrame:
    """``(id, next)`` for unique ids: the next lower id, or for the lowest the highest.

    Ids are ordered within the partitions of one sort by range, whose bounds Spark samples and the plan does not hold.
    They are written once with the number of their partition, so that no later attempt of a task draws other bounds.
    """
    cells = cut(ids.repartitionByRange("id").withColumn("cell", F.spark_partition_id()))
    if cells.isEmpty():
        return ids.select("id", F.col("id").alias("next"))
    tops = cells.groupBy("cell").agg(F.max("id").alias("top"), F.max(F.lit(1)).alias("one"))
    highest = ids.agg(F.max("id")).first()[0]
    tops = tops.select("cell", F.coalesce(F.lag("top").over(Window.partitionBy("one").orderBy("cell")), F.lit(highest)).alias("below"))  # one row a cell
    near = cells.withColumn("next", F.lag("id").over(Window.partitionBy("cell").orderBy("id")))
    return near.join(tops, "cell").select("id", F.coalesce("next", "below").alias("next"))


def edited_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_chars, text, edited) of each document, dealt by its id; and (doc_id, next), the document whose beginning it takes.

    The edited form replaces the last third (code points, rounded down) by as many first ones of the next document in
    descending id order.  Null texts count as empty; rows without an id are left out; of rows that share an id the
    one with the greatest text counts.  A single document is its own next.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"))
    ids = cut(base.groupBy("id").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows")))
    if not ids.where("rows > 1").isEmpty():
        base = base.groupBy("id").agg(F.max("text").alias("text"))
        ids = cut(base.select("id", F.length("text").alias("n")))
    order = cut(next_ids(ids.select("id")))
    need = order.join(ids.select("id", "n"), "id").select(F.col("next").alias("id"), F.col("id").alias("of"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    head = base.join(need, "id").select(F.col("of").alias("id"), F.expr("substring(text, 1, k)").alias("head"), "k")
    edited = F.concat(F.expr("substring(text, 1, length(text) - k)"), "head")
    return base.join(head, "id").select(F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited")), order.withColumnRenamed("id", "doc_id")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, keep: dict[str, Column] | None = None) -> DataFrame:
    """Per document: doc_id, what ``keep`` makes of it, and ``print``, ``edited_print`` and ``next_print`` (arrays, null without words).

    ``keep`` names short columns over doc_id, n_chars, text and edited (see ``edited_documents``), such as digests;
    they are carried through the sampling, so that texts move once.  Without it n_chars and the edited text come back,
    joined to the prints.  Texts of any length: a text's terms are one array, and sampled row by row.  Other columns
    are ignored; an empty table gives no rows.
    """
    edited, order = edited_documents(docs, id_col=id_col, text_col=text_col)
    keys = ["doc_id", *(keep or ())]
    rows = edited.select("doc_id", *[v.alias(c) for c, v in (keep or {}).items()], F.col("text").alias("_a"), F.col("edited").alias("_b"))
    prints = cut(fingerprint_pairs(rows, keys, "_a", "_b", samples))
    following = order.join(prints.select(F.col("doc_id").alias("next"), F.col("print_a").alias("next_print")), "next", "left").drop("next")
    out = prints.join(following, "doc_id")
    if keep is None:
        out, keys = out.join(edited.select("doc_id", "n_chars", "edited"), "doc_id"), ["doc_id", "n_chars", "edited"]
    return out.select(*keys, F.col("print_a").alias("print"), F.col("print_b").alias("edited_print"), "next_print")
