"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps homoglyphs (mathematical and full-width letters included) and digit substitutions to letters, drops
invisible characters and joins combining marks with their letters; places lead back to the text.  Entries match from a
word's start, and to its end where they are whole words; matches inside an exception phrase don't count.  Stand-ins at
a word's end or after punctuation may be mere decoration ("trash!!"), and accents may be part of a word: they are read
as letters, or left out, only where that makes a word of the lexicon.

Entries and weights come from labelled rows: words and word beginnings that toxic documents hold significantly often,
weighted by how much oftener they occur among the words of toxic documents.  The score is normalised by length: it
stands on the weight matched per word of the text and on that of its densest stretch, calibrated on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, remove, scratch, unit_hash
from tidemark.llm.shingles import WordHashes, shingle_set

#: Look-alikes of Latin letters, and characters that stand in for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "ν": "v", "τ": "t", "υ": "u", "κ": "k", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}
_FOLD = {ord(k): ord(v) for k, v in LOOKALIKES.items()}
#: Letters of other shapes, by the standard's own compatibility forms: mathematical, full-width and circled ones.
_FOLD |= {c: ord(unicodedata.normalize("NFKC", chr(c)).lower()) for block in (range(0x1D400, 0x1D800), range(0xFF21, 0xFF5B), range(0x24B6, 0x24EA)) for c in block if len(unicodedata.normalize("NFKC", chr(c)).lower()) == 1}
_BEYOND_ASCII = {k: v for k, v in _FOLD.items() if k > 127}
_ALIKE = frozenset(x for c in _BEYOND_ASCII for x in (chr(c), chr(c).upper()))
#: Combining marks, and characters that are not seen.
_UNSEEN = re.compile("[\u0300-\u036f\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufeff]")
_ACCENTED = re.compile(r"[^\W\d_]*[\u00c0-\u024f][^\W\d_]*")
_LETTER = re.compile(r"[^\W\d_]")
#: With inner stand-ins ("1d10t"), which must touch a letter on both sides or begin a word.
_WORD = re.compile(r"[^\W\d_]+")
_SWAPPED = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|(?<![^\s])[0134578@$]+(?=[^\W\d_])")
_STANDINS = "0134578@$!"
_RUN = re.compile(r"[0134578@$!]+")
#: Stand-ins at an edge of a word that are tried as letters, and letters between them, at most.
EDGE, CORE = 8, 40

#: Entries that hold without labels, and phrases in which they say nothing bad.
SEEDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SEED_WEIGHT = 2.0
EXCEPTIONS = ("class clown", "clown fish", "clown shoes", "pond scum", "loser bracket", "trash bag", "trash bin", "trash can", "white trash bag")
#: An entry's evidence, twice the log-likelihood ratio of the documents that hold it, and how much oftener it occurs in toxic ones.
EVIDENCE, LIFT = 30.0, 8.0
SHORTEST, LONGEST = 4, 8
END = "$"
#: Characters of a stretch, about fifty words, and the weight from which on more says no more.
STRETCH, PEAK = 300, 20.0


@lru_cache(1 << 16)
def _bare(word: str) -> str:
    """A word's letters without accents, one for one."""
    return "".join(unicodedata.normalize("NFD", c)[0] for c in word)


def squeezed(text: str) -> tuple[str, list[int] | None]:
    """``text`` with marks joined to their letters and without unseen characters, and each character's place (None: as they are)."""
    if text.isascii() or not _UNSEEN.search(text):
        return text, None
    out, places = [], []
    for at, c in enumerate(text):
        if not _UNSEEN.match(c):
            out.append(c)
            places.append(at)
        elif out and unicodedata.combining(c) and len(joined := unicodedata.normalize("NFC", out[-1] + c)) == 1:
            out[-1] = joined
    return "".join(out), [*places, len(text)]


def fold(text: str) -> str:
    """``text`` in lower case with look-alikes as Latin letters, code point for code point."""
    alike = not text.isascii() and not _ALIKE.isdisjoint(text)
    if alike:
        text = text.translate(_BEYOND_ASCII)
    low = text.lower()
    if len(low) != len(text):  # some capitals have two small letters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if alike:
        low = low.translate(_BEYOND_ASCII)
    return _SWAPPED.sub(lambda m: m.group().translate(_FOLD), low)


def entries_in(text: str, longest: int = LONGEST) -> Counter:
    """How often candidate entries of a folded text occur: whole words (marked at the end) and beginnings of words."""
    found = Counter()
    for w, n in Counter(_WORD.findall(text)).items():
        if len(w) >= SHORTEST:
            found[w + END] += n
            for k in range(SHORTEST, min(len(w), longest) + 1):
                found[w[:k]] += n
    return found


def chosen(held: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of significant entries (toxic documents, weight) that begin each other, the longest that loses few documents."""
    longer: dict[str, list[str]] = {}
    for entry in held:
        longer.setdefault(entry[:-1], []).append(entry)
    out: dict[str, float] = {}
    for entry in sorted(held, key=lambda e: (len(e), e)):
        if any(entry[:k] in held for k in range(SHORTEST, len(entry))):
            continue
        while on := [e for e in longer.get(entry, ()) if held[e][0] >= 0.9 * held[entry][0]]:
            entry = max(on, key=lambda e: (held[e][0], e))
        out[entry] = held[entry][1]
    return out


class Lexicon:
    """Weighted entries and exception phrases in one automaton."""

    def __init__(self, entries: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        self.words = {e.removesuffix(END) for e in entries if e.endswith(END)} | set(SEEDS) | {w for p in exceptions for w in p.split()}
        self.stems = {e for e in entries if not e.endswith(END)}
        self.sizes = sorted({len(e) for e in self.stems})
        for e, w in entries.items():
            word = e.removesuffix(END)
            old = self.automaton.get(word, None)
            if old is None or old[2]:
                self.automaton.add_word(word, (w, len(word), e.endswith(END), False))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (0.0, len(phrase), True, True))
        self.automaton.make_automaton()

    def unmasked(self, folded: str) -> str:
        """``folded`` with the stand-ins at edges of words as letters where that makes a word of the lexicon.

        As many are letters as give a word, and the others stay: "idi07!!" is "idiot!!".  A beginning of a word
        must not owe a letter to ! or $ after it, nor to ! before it, for these are common there.
        """

        def known(word: str, plain: bool) -> bool:
            return word in self.words or plain and any(word[:k] in self.stems for k in self.sizes)

        out, done = None, 0
        for m in _RUN.finditer(folded):
            a, b = m.span()
            if a and folded[a - 1].isalpha():
                start, end, tail = a, a, folded[a : min(b, a + EDGE)]
                while start and end - start <= CORE and folded[start - 1].isalpha():
                    start -= 1
            elif b < len(folded) and folded[b].isalpha():
                start, end, tail = b, b, ""
                while end < len(folded) and end - start <= CORE and folded[end].isalpha():
                    end += 1
                if end < len(folded) and folded[end] in _STANDINS:
                    continue  # the run at its end sees to it
            else:
                continue
            if end - start > CORE:
                continue
            first = start
            while first and start - first < EDGE and folded[first - 1] in _STANDINS:
                first -= 1
            lead, core = folded[first:start], folded[start:end]
            if known(core, True):
                continue
            for i, j in sorted(((i, j) for i in range(len(lead) + 1) for j in range(len(tail) + 1) if i + j), key=lambda n: (-sum(n), -n[1])):
                before, after = lead[len(lead) - i :], tail[:j]
                word = before.translate(_FOLD) + core + after.translate(_FOLD)
                if known(word, not {"!", "$"} & set(after) and "!" not in before):
                    out = out or []
                    out += [folded[done : start - i], word]
                    done = end + j
                    break
        return "".join([*out, folded[done:]]) if out else folded

    def plain(self, folded: str) -> str:
        """``folded`` with words whose letters without accents make a word of the lexicon in that form."""
        if folded.isascii():
            return folded
        return _ACCENTED.sub(lambda m: bare if (bare := _bare(m.group())) in self.words else m.group(), folded)

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches that count, the longest at each start, in order."""
        folded = self.unmasked(self.plain(folded))
        found: dict[int, tuple[int, int, float]] = {}
        excused = []
        for last, (weight, n, whole, phrase) in self.automaton.iter(folded):
            start, end = last - n + 1, last + 1
            if start and _LETTER.match(folded[start - 1]) or whole and end < len(folded) and _LETTER.match(folded[end]):
                continue
            if phrase:
                excused.append((start, end))
            elif start not in found or found[start][1] < end:
                found[start] = (start, end, weight)
        out, k, reach = [], 0, 0
        excused.sort()
        for hit in sorted(found.values()):  # one pass over both: phrases that begin no later, and the furthest end of them
            while k < len(excused) and excused[k][0] <= hit[0]:
                reach, k = max(reach, excused[k][1]), k + 1
            if reach < hit[1]:
                out.append(hit)
        return out

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """The hits in a text as it is."""
        text, places = squeezed(text)
        found = self.hits(fold(text))
        return found if places is None else [(places[a], places[b], w) for a, b, w in found]

    def features(self, text: str | None) -> tuple[float, float]:
        """The weight matched per word, on a log scale, and that of the densest stretch, up to PEAK."""
        if not text:
            return 0.0, 0.0
        folded = fold(squeezed(text)[0])
        total = here = most = 0.0
        first, found = 0, self.hits(folded)
        for start, _, weight in found:
            total, here = total + weight, here + weight
            while found[first][0] < start - STRETCH:
                here, first = here - found[first][2], first + 1
            most = max(most, here)
        words = folded.count(" ") + folded.count("\n")
        return (math.log1p(100 * total / (20 + words)), min(most, PEAK) / 4) if found else (0.0, 0.0)


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(x.shape[1]), x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 12_000, longest: int = LONGEST) -> tuple[dict[str, float], list[float]]:
    """Entries with weights, and coefficients of the score, from about ``sample`` labelled rows at most (a quarter toxic).

    Beginnings of words have up to ``longest`` letters.  All entries with enough evidence are taken: as each must be
    held by a dozen toxic documents of the sample or more, the sample bounds them.  A label row that is repeated
    counts once; documents that repeat an id, or a text, count once.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    n = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    part = F.when(F.col("y") == 1, min(1.0, sample / 4 / max(1, n.get(1, 0)))).otherwise(min(1.0, sample * 3 / 4 / max(1, n.get(0, 0))))
    marked = marked.where(unit_hash(F.lit("toxicity"), F.col("id")) < part)
    train = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(marked), "id")  # ``sample`` bounds it
    seeds = {s + END: SEED_WEIGHT for s in SEEDS}
    if not n.get(1) or not n.get(0):
        return seeds, [-4.0, 2.0, 1.0]

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            least = [int(s.view(np.int64).min()) if len(s := shingle_set(t, 5, hashes)) else 0 for t in b["text"]]
            yield b.assign(least=least)

    # copies of a text are no independent evidence: mostly they share their least shingle, and one of them counts
    alike = train.mapInPandas(named, "id long, text string, y int, least long").groupBy("y", "least")
    kept = scratch(docs.sparkSession, "toxicity-sample")
    train = cut(alike.agg(F.min(F.struct("id", "text"))["text"].alias("text")).select("y", "text"), kept)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, times = (Counter(), Counter()), (Counter(), Counter())
        for b in batches:
            for y, text in zip(b["y"], b["text"], strict=True):
                text = fold(squeezed(text)[0])
                own = entries_in(text, longest)
                held[y].update(own.keys())
                times[y].update(own)
                held[y][""] += 1
                times[y][""] += len(text.split())
        every = held[1].keys() | held[0].keys()
        yield pd.DataFrame([(e, *(c[y][e] for c in (held, times) for y in (1, 0))) for e in every], columns=["entry", "toxic", "clean", "toxic_times", "clean_times"])

    counts = ["toxic", "clean", "toxic_times", "clean_times"]
    sums = train.mapInPandas(counted, "entry string, toxic long, clean long, toxic_times long, clean_times long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in counts])
    sums = cut(sums.where("entry = '' or toxic >= 5"), f"{kept}-entries")  # with fewer, the evidence below can't be reached
    all_ = sums.groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("entry") == "", F.col(c))), F.lit(0)).alias(c) for c in counts]).first()
    if not all_["toxic"] or not all_["clean"]:  # labels of other documents only, or of one kind
        return seeds, [-4.0, 2.0, 1.0]
    toxic, clean = all_["toxic"], all_["clean"]
    a, b = F.col("toxic"), F.col("clean")
    expected = (a + b) * toxic / (toxic + clean)
    evidence = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / ((a + b) * clean / (toxic + clean)))).otherwise(0.0))
    lift = (F.col("toxic_times") + 0.5) / (all_["toxic_times"] + 1) / ((F.col("clean_times") + 0.5) / (all_["clean_times"] + 1))
    often = sums.where((F.col("entry") != "") & (a > expected) & (evidence >= EVIDENCE) & (lift >= LIFT))
    entries = chosen({r["entry"]: (r["toxic"], r["weight"]) for r in often.select("entry", "toxic", F.log(lift).alias("weight")).collect()})
    for s, w in seeds.items():
        if not any(e == s or s.startswith(e) for e in entries):
            entries[s] = w

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(entries)
        for b in batches:
            yield pd.DataFrame([(y, *lexicon.features(t)) for y, t in zip(b["y"], b["text"], strict=True)], columns=["y", "density", "peak"])

    seen = train.mapInPandas(measured, "y int, density double, peak double").toPandas()  # about ``sample`` rows
    remove(docs.sparkSession, kept, f"{kept}-entries")
    return entries, calibrated(seen[["density", "peak"]].to_numpy(), seen["y"].to_numpy()).tolist()


def toxicity(text: Column, model: tuple[dict[str, float], list[float]]) -> Column:
    """The score (0 to 1) of a text column, in Arrow batches; null and empty texts get that of a text without hits."""
    entries, beta = model

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(entries)
        for texts in batches:
            x = np.array([(1.0, *lexicon.features(t)) for t in texts]).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(beta), -30, 30))))

    return scored(text)


def score_toxicity(docs: DataFrame, model: tuple[dict[str, float], list[float]], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: ``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts have no hits and the score of a clean text; time grows with a text's length, whatever its
    hits.  Repeated ids and null ids are kept as they are; other columns are ignored; an empty table gives no rows.
    """
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), toxicity(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
