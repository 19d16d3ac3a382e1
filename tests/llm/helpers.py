from __future__ import annotations

import random

LONG = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines long, spans string"


def frame(spark, docs):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 9.0, 7, "x") for i, t in docs], LONG)


def words(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
