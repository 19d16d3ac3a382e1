"""Quality by regularised quadratic discriminant analysis over transformed statistics of a text.

Each class has a mean and a covariance, shrunk towards the pooled one and its diagonal.  A text's score comes from
the difference of the two log-densities, whose Mahalanobis distances use the classes' Cholesky factors, computed
once.  Neither statistics nor the difference are cut off: its arcsinh, which grows like a logarithm on both sides and
keeps the order of all texts, is calibrated on rows left out of the fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import unit_hash
from tidemark.llm.toxicity import calibrated

STATS = ["chars", "words", "word_length", "upper", "digit", "mark", "odd_mark", "space", "variety", "top_word", "echo", "line_words", "line_echo", "sentence", "shouting", "cells", "long_word", "word_spread"]
#: Classes of bytes: other, space, lower case, upper case, digit, everyday mark, odd mark, beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 2, 3, 4
_KIND[[ord(c) for c in ".,;:!?'\"-()"]] = 5
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_KIND[128:] = 7


def _logit(part: float) -> float:
    part = min(max(part, 0.0), 1.0) * 0.998 + 0.001
    return float(np.log(part / (1 - part)))


def statistics(text: str | None) -> list[float]:
    """The statistics named in STATS, each on a scale on which it is near to normal."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(_KIND[data], minlength=8)
    size = max(1, len(data))
    letters = max(1, n[2] + n[3] + n[7])
    words = text.split()
    count = max(1, len(words))
    tally = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = text.split("\n")
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(np.log1p(lengths.mean())),
        _logit(n[3] / letters), _logit(n[4] / size), _logit(n[5] / size), _logit(n[6] / size), _logit(n[1] / size),
        float(np.log((len(tally) + 1) / (count + 1)) / np.log(count + 2)), _logit(max(tally.values(), default=0) / count), _logit(echo / count),
        float(np.log1p(count / len(lines))), _logit(1 - len(set(lines)) / len(lines)),
        float(np.log1p(count / max(1, text.count(".")))), _logit(text.count("!") / count), _logit(text.count("|") / count),
        float(np.log1p(lengths.max())), float(np.log1p(lengths.std())),
    ]


@dataclass
class Discriminant:
    """Both classes' means, inverse Cholesky factors and log-determinants, and the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    beta: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        d = [-0.5 * ((((z - m) @ f.T) ** 2).sum(1) + ld) for m, f, ld in zip(self.means, self.factors, self.logdets, strict=True)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        d = np.arcsinh(self.difference(x))
        return 1 / (1 + np.exp(-(self.beta[0] + self.beta[1] * d)))


def _fit(x: np.ndarray, y: np.ndarray, to_pooled: float, to_diagonal: float) -> Discriminant:
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    own = [z[y == c] for c in (0, 1)]
    means = [g.mean(0) for g in own]
    covs = [np.cov(g.T, bias=True) for g in own]
    pooled = sum(len(g) * c for g, c in zip(own, covs, strict=True)) / len(z)
    factors, logdets = [], []
    for c in covs:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(centre, scale, means, factors, logdets, np.array([0.0, 1.0]))


def fit_discriminant(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """The shrinkage with the least loss over left-out fifths; rows in a fixed order give the same result."""
    best = None
    fold = np.arange(len(x)) % 5
    for to_pooled in (0.0, 0.1, 0.3, 0.6):
        for to_diagonal in (0.02, 0.1, 0.3):
            d = np.zeros(len(x))
            for k in range(5):
                d[fold == k] = _fit(x[fold != k], y[fold != k], to_pooled, to_diagonal).difference(x[fold == k])
            d = np.arcsinh(d)
            beta = calibrated(d[:, None], y, 1e-3)
            p = np.clip(1 / (1 + np.exp(-(beta[0] + beta[1] * d))), 1e-6, 1 - 1e-6)
            loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
            if best is None or loss < best[0]:
                best = (loss, to_pooled, to_diagonal, beta)
    model = _fit(x, y, best[1], best[2])
    model.beta = best[3]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> Discriminant | None:
    """A model from about ``sample`` labelled rows at most; None without at least 20 rows of each class.

    Label rows that repeat an id count once, as good if one says so.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marked = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    part = min(1.0, sample / max(1, marked.count()))
    marked = marked.where(unit_hash(F.lit("quality"), F.col("id")) < part)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": [statistics(t) for t in b["text"]]})

    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")  # ``sample`` bounds it
    rows = train.mapInPandas(measured, "id long, y int, x array<double>").toPandas().sort_values("id")  # about ``sample`` rows of statistics
    y = rows["y"].to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < 20:
        return None
    return fit_discriminant(np.array(rows["x"].tolist()), y)


def score_quality(docs: DataFrame, model: Discriminant | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: ``doc_id``, ``score`` (0 to 1, higher for better texts) and ``predicted``.

    Null and empty texts have the statistics of an empty text.  Without a model every score is 0.5.  Repeated and
    null ids are kept as they are; other columns are ignored; an empty table gives no rows.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([statistics(t) for t in b["text"]]).reshape(-1, len(STATS))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(x) if model else np.full(len(x), 0.5)})

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInPandas(scored, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
