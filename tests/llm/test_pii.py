from __future__ import annotations

import random
import re
import time

from helpers import frame

from tidemark.llm import pii

REFERENCE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in REFERENCE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_exact_spans_match_the_patterns():
    rnd = random.Random(2)
    for alphabet, n in (("a1@.-+ 0(2%5é", 8000), ("0 -1", 4000), ("+1() 9-", 3000)):
        for _ in range(n):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            assert pii.exact_spans(text) == brute(text)


def test_long_texts_take_little_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+" + "(" * 200_000, "a@" * 100_000):
        began = time.process_time()
        assert pii.exact_spans(text) is not None
        assert time.process_time() - began < 5


def test_long_parts_of_addresses():
    """More digits than the interpreter turns into a number."""
    long = "0" * 5000 + "1.2.3.4"
    assert pii.exact_spans(long) == [("ip", 0, 5007)] and pii.exact_spans("9" * 5000 + ".2.3.4") == []
    assert not pii._plausible("ip", "9" * 5000 + " . 2 . 3 . 4")


def test_spans_that_touch_none():
    rnd = random.Random(7)
    for _ in range(300):
        base, more = ([("ip", a, a + rnd.randint(1, 9)) for a in (rnd.randrange(60) for _ in range(rnd.randint(0, 6)))] for _ in range(2))
        assert pii.apart(base, more) == [s for s in more if not any(a < s[2] and s[1] < e for _, a, e in base)]
    many = [("ip", 3 * k, 3 * k + 2) for k in range(200_000)]
    began = time.process_time()
    assert pii.apart(many, many) == []
    assert time.process_time() - began < 5


def spans_of(tags):
    out, k = set(), 0
    while k < len(tags):
        end = k + 1
        if pii.TAGS[tags[k]][0] == "B":
            while end < len(tags) and tags[end] == tags[k] + 1:
                end += 1
            out.add((tags[k], k, end))
        k = end
    return out


def test_network_on_windows_it_has_not_seen():
    net = pii.trained()
    x, y = pii.labelled_windows(300, 77)
    hit = found = there = 0
    for tags, want in zip(net.best_tags(list(net.scores(x))), y, strict=True):
        got, wanted = spans_of(tags), spans_of(want)
        hit, found, there = hit + len(got & wanted), found + len(got), there + len(wanted)
    assert hit / found > 0.85 and hit / there > 0.85


def test_spans_over_windows_and_whole_texts(spark):
    filler = "lorem ipsum dolor " * 400
    text = f"{filler}write to jane.doe [at] example.com or (555) 123-4567, card 4111 1111 1111 1111 {filler}a@b.org"
    docs = [(1, text), (2, None), (3, ""), (3, "no data here, token = deadbeef00112233"), (None, "1.2.3.4 é +1 (555) 010-9999")]
    out = sorted(pii.find_personal_data(frame(spark, docs)).collect(), key=lambda r: (str(r.doc_id), r.spans))
    by = {(r.doc_id, r.exact): r.spans for r in out}
    (exact,) = [e for i, e in by if i == 1]
    assert exact.startswith("email:") and "card:" in exact and set(exact.split(",")) < set(by[1, exact].split(","))
    added = {s.split(":")[0] for s in set(by[1, exact].split(",")) - set(exact.split(","))}
    assert added == {"email", "phone"}
    assert by[2, ""] == "" and by[3, ""] == "" and by[None, "ip:0:7,phone:10:27"] == "ip:0:7,phone:10:27"
    assert len(out) == 5


def made_up(rnd):
    """Addresses that no exact pattern finds, and their kinds."""
    w = lambda a, b: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(a, b)))
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    return rnd.choice(
        [("email", f"{w(3, 8)} [at] {w(3, 8)}.com"), ("email", f"{w(3, 8)}(at){w(3, 8)}.org"), ("email", f"{w(3, 8)} [at] {w(3, 8)} [dot] net"), ("email", f"{w(3, 8)} @ {w(3, 8)}.net")]
        + [("phone", f"({d(3)}) {d(3)}-{d(4)}"), ("phone", f"{d(3)}-{d(3)}-{d(4)}"), ("ip", " . ".join(str(rnd.randint(0, 255)) for _ in range(4))), ("ip", "[.]".join(str(rnd.randint(0, 255)) for _ in range(4)))]
    )


def test_gain_in_whole_documents_and_the_same_spans_without_the_gate(spark, data):
    """Respelt addresses put into the table's own texts: most are found, little else, and reading all windows finds the same."""
    rnd, net = random.Random(3), pii.trained()
    texts, wanted = [], []
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        kind, made = made_up(rnd)
        words = (r.text or "").split(" ")
        k = rnd.randrange(len(words) + 1)
        head = " ".join(words[:k]) + " " if k else ""
        texts.append(" ".join([head + made, *words[k:]]))
        wanted.append((kind, len(head), len(head) + len(made)))
    found = pii.model_spans(texts, net)
    added = [pii.apart(pii.exact_spans(t), f) for t, f in zip(texts, found, strict=True)]
    assert sum(w in a for w, a in zip(wanted, added, strict=True)) > 0.85 * len(texts)
    assert sum(len(a) for a in added) < 1.1 * len(texts)
    assert found[:120] == pii.model_spans(texts[:120], net, gated=False)


def test_one_text_of_digits_is_read_in_pieces():
    net = pii.trained()
    card = "4111 1111 1111 1111"
    text = "x 7" * 3000 + f" mail me: jo [at] example.com, {card} " + "12" * 20_000
    assert max(b - a for a, b, _, _ in pii.pieces(pii.stretches(text))) <= pii.PIECE
    at = text.index("jo [at]")
    assert ("email", at, at + len("jo [at] example.com")) in pii.model_spans([text], net)[0]
    assert sum(b - a for _, _, a, b in pii.pieces([(0, 50_000)])) == 50_000


def test_network_is_stored_once(spark, monkeypatch):
    first = pii.stored(spark)
    monkeypatch.setattr(pii, "trained", None)
    again = pii.stored(spark)
    assert all((first.p[k] == again.p[k]).all() for k in first.p) and first.hidden == again.hidden
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_gradients():
    import numpy as np

    net = pii.Tagger(hidden=3, width=2, seed=1, dtype=np.float64)
    x, y = pii.labelled_windows(4, 3)
    x, y = x[:, :9], np.minimum(y[:, :9], 1)

    def loss():
        s = net.scores(x)
        total = s[:, 0] + net.p["first"]
        score = total[np.arange(4), y[:, 0]]
        for t in range(1, 9):
            score = score + net.p["trans"][y[:, t - 1], y[:, t]] + s[np.arange(4), t, y[:, t]]
            total = pii._logsum(total[:, :, None] + net.p["trans"], 1) + s[:, t]
        return float((pii._logsum(total, 1) - score).mean())

    grads = net._gradients(x, y)
    for name in ("emb", "there_x", "back_h", "there_b", "out", "trans", "first"):
        flat, at = net.p[name].reshape(-1), int(np.abs(grads[name]).argmax())
        old = flat[at]
        flat[at] = old + 1e-5
        up = loss()
        flat[at] = old - 1e-5
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-5 - grads[name].reshape(-1)[at]) < 1e-5
