"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions for other spellings.

The network is trained here in numpy, from windows whose spans are labelled as they are made.  A text is read in
overlapping windows at fixed places; scores of a character are averaged over its windows, with less weight towards a
window's ends, and Viterbi passes settle the spans of all windows together.  Only parts around triggers (digits, @,
"(at)", "dot") are read, with REACH characters before and after: every span that passes its kind's test holds one, so
windows without any can add nothing.  Spans found so that touch no exact match are added to the exact ones.
"""

from __future__ import annotations

import io
import random
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, there

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),  # what follows the @; before it, [A-Za-z0-9._%+-]+
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),  # as no later digit of a run does better, only its first is tried
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_MAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]|(?<=[\s\[(])dot(?=[\s\])])")
_AT = re.compile(r"@|[\[(]at[\])]")
_SPOKEN_AT = re.compile(r"\sat\s")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _passes(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in found.split("."))
    digits = _digits(found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def exact_spans(text: str) -> list[Span]:
    """Per kind the leftmost non-overlapping matches that pass the kind's test, kinds as listed, by start."""
    out: list[Span] = []
    if "@" in text:
        for run in _MAIL_RUN.finditer(text):  # no match reaches over its ends
            free = run.start()
            at = text.find("@", free, run.end())
            while at >= 0:
                if at > free and (m := PATTERNS["email"].match(text, at + 1)):
                    out.append(("email", free, m.end()))
                    free = m.end()
                free, at = max(free, at + 1), text.find("@", at + 1, run.end())
    if _DIGIT.search(text):
        for kind in KINDS[1:]:
            out += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _passes(kind, m.group())]
    return out


#: Characters: 0 beyond the text, 1 others, 2 beyond ASCII, 3 digits, then a letter or mark each.
_MARKS = "abcdefghijklmnopqrstuvwxyz \n.-+()@_%[]/:=\"',#"
_CODE = np.ones(129, np.int64)
_CODE[128] = 2
_CODE[48:58] = 3
for _i, _c in enumerate(_MARKS):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = 4 + _i
SIZE = 4 + len(_MARKS)
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
WINDOW, STRIDE, REACH = 64, 32, 48
#: Longer parts are decoded in pieces that overlap by this many characters on each side.
PIECE, OVERLAP = 4096, 128


def codes(text: str) -> np.ndarray:
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, an LSTM each way, a linear layer and CRF transitions; ``fit`` trains it with Adam."""

    def __init__(self, hidden: int = 20, width: int = 12, seed: int = 5, dtype: type = np.float32):
        rng = np.random.default_rng(seed)
        self.hidden, k = hidden, len(TAGS)
        self.p = {"emb": rng.normal(0, 0.3, (SIZE, width)), "out": rng.normal(0, 0.2, (2 * hidden, k)), "bias": np.zeros(k), "trans": np.zeros((k, k)), "first": np.zeros(k)}
        for way in ("there", "back"):
            self.p[f"{way}_x"] = rng.normal(0, 0.25, (width, 4 * hidden))
            self.p[f"{way}_h"] = rng.normal(0, 0.25, (hidden, 4 * hidden))
            self.p[f"{way}_b"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
        self.allowed = np.zeros((k, k))
        for a, x in enumerate(TAGS):
            for b, y in enumerate(TAGS):
                if y[0] == "I" and x not in (f"B-{y[2:]}", y):
                    self.allowed[a, b] = -1e4
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}

    def _run(self, e: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        n, steps, h = e.shape[0], e.shape[1], self.hidden
        x, wh = e @ self.p[f"{way}_x"] + self.p[f"{way}_b"], self.p[f"{way}_h"]
        state, cell, out = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype), np.empty((n, steps, h), x.dtype)
        for t in range(steps) if way == "there" else range(steps - 1, -1, -1):
            z = x[:, t] + state @ wh
            gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before, held = cell, state
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            squashed = np.tanh(cell)
            state = gates[:, 2 * h :] * squashed
            out[:, t] = state
            if keep is not None:
                keep.append((t, gates, new, before, held, squashed))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Emission scores of windows of codes."""
        e = self.p["emb"][x]
        both = np.concatenate([self._run(e, "there", None), self._run(e, "back", None)], 2)
        return both @ self.p["out"] + self.p["bias"]

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h, (n, steps) = self.p, self.hidden, x.shape
        kept: dict[str, list] = {"there": [], "back": []}
        e = p["emb"][x]
        both = np.concatenate([self._run(e, way, kept[way]) for way in kept], 2)
        s = both @ p["out"] + p["bias"]
        # forward and backward sums of the CRF give the tags' and transitions' expected counts
        ahead, behind = np.empty_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0] + p["first"]
        for t in range(1, steps):
            ahead[:, t] = _logsum(ahead[:, t - 1, :, None] + p["trans"], 1) + s[:, t]
        for t in range(steps - 2, -1, -1):
            behind[:, t] = _logsum(p["trans"] + (s[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = _logsum(ahead[:, -1], 1)
        ds = np.exp(ahead + behind - total[:, None, None])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        for t in range(1, steps):
            g["trans"] += np.exp(ahead[:, t - 1, :, None] + p["trans"] + (s[:, t] + behind[:, t] - total[:, None])[:, None, :]).sum(0)
        np.subtract.at(g["trans"], (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        ds[np.arange(n)[:, None], np.arange(steps), y] -= 1
        g["first"] = ds[:, 0].sum(0)
        g["out"], g["bias"] = np.tensordot(both, ds, ((0, 1), (0, 1))), ds.sum((0, 1))
        back = ds @ p["out"].T
        de = np.zeros_like(e)
        for way, part in (("there", back[:, :, :h]), ("back", back[:, :, h:])):
            dstate, dcell = np.zeros((n, h), e.dtype), np.zeros((n, h), e.dtype)
            dx = np.empty((n, steps, 4 * h), e.dtype)
            for t, gates, new, before, held, squashed in reversed(kept[way]):
                dstate = dstate + part[:, t]
                i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dcell = dcell + dstate * o * (1 - squashed**2)
                dz = np.concatenate([dcell * new * i * (1 - i), dcell * before * f * (1 - f), dstate * squashed * o * (1 - o), dcell * i * (1 - new**2)], 1)
                dx[:, t] = dz
                g[f"{way}_h"] += held.T @ dz
                dstate, dcell = dz @ p[f"{way}_h"].T, dcell * f
            g[f"{way}_x"] += np.tensordot(e, dx, ((0, 1), (0, 1)))
            g[f"{way}_b"] += dx.sum((0, 1))
            de += dx @ p[f"{way}_x"].T
        np.add.at(g["emb"], x.ravel(), de.reshape(-1, de.shape[2]))
        return {k: v / n for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 50, rate: float = 0.015, seed: int = 6) -> Tagger:
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), len(x) // batch):
                g, step = self._gradients(x[part], y[part]), step + 1
                norm = np.sqrt(sum((v**2).sum() for v in g.values()))
                for k, v in g.items():
                    v = v * min(1.0, 5 / norm)
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v**2 - second[k])
                    self.p[k] -= rate * (1 - epoch / (epochs + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def best_tags(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best allowed sequence of tags (Viterbi) for each of several runs of scores, with no span across its ends."""
        k, longest = len(TAGS), max(map(len, scores))
        trans = (self.p["trans"] + self.allowed).astype(float)
        s = np.full((len(scores), longest, k), -1e9)
        s[:, :, 0] = 0.0  # beyond a run's end there is nothing
        for row, x in zip(s, scores, strict=True):
            row[: len(x)] = x
        back = np.empty(s.shape, np.int8)
        best = s[:, 0] + trans[0]
        for t in range(1, longest):
            ways = best[:, :, None] + trans
            back[:, t] = ways.argmax(1)
            best = ways.max(1) + s[:, t]
        tags = np.empty(s.shape[:2], np.int8)
        tags[:, -1] = (best + trans[:, 0]).argmax(1)
        for t in range(longest - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(len(s)), t, tags[:, t]]
        return [row[: len(x)] for row, x in zip(tags, scores, strict=True)]

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Tagger:
        out = cls()
        out.p = dict(np.load(io.BytesIO(data)))
        out.hidden = out.p["there_h"].shape[0]
        return out


def labelled_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up text as codes, and the tags of the spans put into them."""
    rnd = random.Random(seed)
    letters, hexa = "abcdefghijklmnopqrstuvwxyzéüñó", "0123456789abcdef"
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda lo=1, hi=9: "".join(rnd.choice(letters[:26] if rnd.random() < 0.9 else letters) for _ in range(rnd.randint(lo, hi)))
    plain = lambda lo, hi: "".join(rnd.choice(letters[:26]) for _ in range(rnd.randint(lo, hi)))

    def card() -> str:
        body = d(rnd.choice([15, 15, 15, 18]))
        body += next(c for c in "0123456789" if luhn(body + c))
        return rnd.choice(["", "", " ", "-", ".", "/"]).join(body[k : k + 4] for k in range(0, len(body), 4))

    def email() -> str:
        user, host, end = plain(2, 9) + rnd.choice(["", f".{d(2)}", f"_{plain(1, 5)}", d(1)]), plain(3, 9) + rnd.choice(["", d(1)]), rnd.choice(["com", "org", "net", "example.com", "co.uk", "de"])
        return rnd.choice(["{}@{}.{}", "{}@{}.{}", "{} [at] {}.{}", "{}(at){}.{}", "{} @ {}.{}", "{} [at] {} [dot] {}", "{} at {} dot {}", "{} at {} dot {}", "{}(at){}(dot){}"]).format(user, host, end)

    spans = {
        "email": email,
        "ip": lambda: rnd.choice([".", ".", ".", " . ", "[.]"]).join(str(rnd.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rnd.choice(["+{} ({}) {}-{}", "+{} ({}) {}-{}", "+{} {} {} {}", "({1}) {2}-{3}", "{1}-{2}-{3}", "({1}) {2} {3}"]).format(d(1), d(3), d(3), d(4)),
    }
    others = [
        lambda: "".join(rnd.choice(hexa) for _ in range(rnd.randint(12, 40))), lambda: f"password={''.join(rnd.choice(hexa) for _ in range(18))}", lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
        lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: d(rnd.randint(1, 9)), lambda: f"version {d(1)}.{d(1)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(3)}.{d(2)}", lambda: f"[{d(1)}]", lambda: d(rnd.randint(20, 26)),
        lambda: f"{plain(2, 6)}{d(2)}", lambda: f"@{plain(3, 9)}", lambda: f"{d(2)}%", lambda: f"{d(1)} - {d(1)}", lambda: f"/{plain(2, 5)}/{d(3)}/", lambda: "",
        lambda: f"look at {plain(2, 8)}", lambda: f"the dot {plain(2, 8)}", lambda: f"a dot at {plain(3, 8)}",
    ]
    xs, ys = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        text, tags = "", []
        while len(text) < 2 * WINDOW:
            kind = rnd.choice([*KINDS, None, None])
            item = spans[kind]() if kind else rnd.choice(others)()
            around = " ".join(word() for _ in range(rnd.randint(1, 6))) + rnd.choice([" ", " ", " ", ", ", ".\n", ": ", " | "])
            text += around + item
            tags += [0] * len(around) + ([0] * len(item) if kind is None else [TAGS.index(f"B-{kind}")] + [TAGS.index(f"I-{kind}")] * (len(item) - 1))
            tail = rnd.choice([" ", " ", ". ", ", ", "\n"])
            text, tags = text + tail, tags + [0] * len(tail)
        cut = rnd.randint(0, len(text) - WINDOW // 2)  # some windows end beyond the text
        part = codes(text[cut : cut + WINDOW])
        own = tags[cut : cut + WINDOW]
        for k, t in enumerate(own):  # a span cut off at the left goes on
            if t and t % 2 == 0 and (k == 0 or own[k - 1] not in (t, t - 1)):
                own[k] = t - 1
        xs[row, : len(part)], ys[row, : len(part)] = part, own
    return xs, ys


@cache
def trained(windows: int = 4500, seed: int = 11) -> Tagger:
    """The network; the same in every process, and trained once in each that asks for it."""
    return Tagger().fit(*labelled_windows(windows, seed))


#: Of a network in the shared folder: one trained by other code or data has another name.
STORED = "pii-tagger-2"


def stored(spark: SparkSession) -> Tagger:
    """The network from the shared folder; trained and put there if it isn't yet.

    It is written aside and then renamed, so that who finds it finds all of it.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{STORED}"
    if not there(spark, path):
        aside = f"{path}-{uuid.uuid4().hex}"
        spark.createDataFrame([(trained().saved(),)], "weights binary").coalesce(1).write.parquet(aside)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if there(spark, path) or not files.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), at):
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
    return Tagger.loaded(bytes(spark.read.parquet(path).first()["weights"]))


def _plausible(kind: str, found: str) -> bool:
    digits = _digits(found)
    if kind == "email":
        parts = _AT.split(found)
        if len(parts) == 1 and re.search(r"\sdot\s|[\[(]dot[\])]", found):
            parts = _SPOKEN_AT.split(found)
        return len(parts) == 2 and bool(re.search(r"[A-Za-z0-9]\s*$", parts[0])) and bool(re.search(r"\w\s*(\.|[\[(]dot[\])]|(?<=\s)dot(?=\s))\s*\w", parts[1]))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", found)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within reach of a trigger, overlapping ones joined."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def pieces(parts: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, and of these the part whose spans count) of pieces of bounded length."""
    for a, b in parts:
        if b - a <= PIECE:
            yield a, b, a, b
            continue
        for at in range(a, b, PIECE - 2 * OVERLAP):
            end = min(b, at + PIECE - 2 * OVERLAP)
            yield max(a, at - OVERLAP), min(b, end + OVERLAP), at, end


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


def emissions(text: str, a: int, b: int, score) -> np.ndarray:
    """Scores of ``text[a:b]``, averaged over the windows at multiples of STRIDE (half a window) that hold a character."""
    first = max(0, a // STRIDE - 1)
    n = -(-b // STRIDE) - first  # windows; the last may reach beyond the text
    own = codes(text[first * STRIDE : (first + n + 1) * STRIDE])
    own = np.pad(own, (0, (n + 1) * STRIDE - len(own))).reshape(n + 1, STRIDE)
    s = score(np.concatenate([own[:-1], own[1:]], 1)) * _WEIGHT
    total, weight = np.zeros((n + 1, STRIDE, s.shape[2]), np.float32), np.zeros((n + 1, STRIDE, 1), np.float32)
    total[:-1], weight[:-1] = s[:, :STRIDE], _WEIGHT[:STRIDE]
    total[1:] += s[:, STRIDE:]
    weight[1:] += _WEIGHT[STRIDE:]
    return (total / weight).reshape(-1, s.shape[2])[a - first * STRIDE : b - first * STRIDE]


def model_spans(texts: list[str], tagger: Tagger, at_once: int = 65_536, gated: bool = True) -> list[list[Span]]:
    """For each text the spans that the network finds and that pass, by kind and start; ``at_once`` characters bound the memory.

    Without the gate all windows are read; the spans are the same, but for those cut by a run of tags longer than REACH.
    """
    found: list[list[Span]] = [[] for _ in texts]

    def settle(group: list[tuple[int, int, int, int, int]]) -> None:
        todo = [(x, texts[x[0]]) for x in sorted(group, key=lambda x: x[2] - x[1])]
        for at in range(0, len(todo), 64):  # pieces of about the same length
            part = todo[at : at + 64]
            for (k, a, _, low, high), tags in zip((x for x, _ in part), tagger.best_tags([emissions(t, x[1], x[2], tagger.scores) for x, t in part]), strict=True):
                for i in np.flatnonzero(tags % 2 == 1):  # tags that begin a span
                    kind, end = KINDS[tags[i] // 2], i + 1
                    while end < len(tags) and tags[end] == tags[i] + 1:
                        end += 1
                    if low <= a + i < high and (span := text_span(texts[k], kind, a + int(i), a + int(end))):
                        found[k].append(span)

    group, size = [], 0
    for k, text in enumerate(texts):
        for piece in pieces(stretches(text) if gated else [(0, len(text))] if text else []):
            group.append((k, *piece))
            size += piece[1] - piece[0] + WINDOW
            if size >= at_once:
                settle(group)
                group, size = [], 0
    if group:
        settle(group)
    return [sorted(set(s), key=lambda x: (KINDS.index(x[0]), x[1])) for s in found]


def text_span(text: str, kind: str, start: int, end: int) -> Span | None:
    """The span without blanks and closing marks at its ends, if it passes."""
    while start < end and text[start] in " \n,.;:|":
        start += 1
    while start < end and text[end - 1] in " \n,.;:|":
        end -= 1
    outside = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return (kind, start, end) if start < end <= start + PIECE and outside and _plausible(kind, text[start:end]) else None


def apart(base: list[Span], more: list[Span]) -> list[Span]:
    """Those of ``more`` that touch none of ``base``."""
    merged: list[list[int]] = []
    for a, b in sorted(s[1:] for s in base):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    ends = [b for _, b in merged]

    def free(s: Span) -> bool:
        k = bisect_left(ends, s[1] + 1)  # the first that ends behind the span's start
        return k == len(merged) or merged[k][0] >= s[2]

    return [s for s in more if free(s)]


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``exact`` and ``spans``, both as kind:start:end joined by commas.

    Kinds come as listed in KINDS, then by start; places count code points, ends are exclusive.  ``spans`` has the
    exact ones and the network's.  Null and empty texts have none.  Texts of any length are read in pieces of bounded
    size.  Repeated and null ids are kept as they are; other columns are ignored; an empty table gives no rows.
    """
    tagger = tagger or stored(docs.sparkSession)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            exact = [exact_spans(t) for t in texts]
            spans = [sorted([*base, *apart(base, more)], key=lambda x: (KINDS.index(x[0]), x[1])) for base, more in zip(exact, model_spans(texts, tagger), strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "exact": map(as_text, exact), "spans": map(as_text, spans)})

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInPandas(found, "doc_id long, exact string, spans string")
