"""Runs of words against plain enumeration."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from vellumflow.llm import periodic_runs as P
from vellumflow.llm import queries
from vellumflow.llm.shared import table

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def least_period(words) -> int:
    border, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    return len(words) - (border[-1] if words else 0)


def runs_by_hand(words) -> list[tuple[int, int, int]]:
    """Each maximal stretch that keeps a period, if that is its least one."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and least_period(words[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)


def random_words(r: random.Random) -> list[int]:
    out = []
    for _ in range(r.randrange(8)):
        unit = [r.randrange(r.choice((1, 2, 3, 50))) for _ in range(r.choice((1, 2, 3, 7, 30)))]
        unit = unit * r.choice((1, 2)) if r.random() < 0.3 else unit
        out += (unit * r.choice((1, 3, 4, 5, 9)))[: r.randrange(1, 400)]
    return out


@pytest.mark.parametrize("places", (P.PLACES, 7))
def test_random_texts(places, monkeypatch):
    monkeypatch.setattr(P, "PLACES", places)
    r = random.Random(5)
    texts = [random_words(r) for _ in range(400 if places > 7 else 60)]
    texts += [[], [1], [1] * 5, [1] * 6, [1] * 500, [1, 2] * 4, [1, 2] * 3 + [1], [1, 1, 2] * 50 + [1, 1], [0, 1] * 30 + [0, 0, 1, 0, 1] * 9]
    got = P.runs_of([numbers(t) for t in texts])
    for t, found in zip(texts, got, strict=True):
        assert [tuple(x) for x in found.tolist()] == runs_by_hand(t)


def test_common_extensions():
    r = random.Random(6)
    for size in (1, 2, 20, 21, 22, 300, 2000):
        words = np.array([r.randrange(2) for _ in range(size)] if size < 2000 else [0, 0, 1] * 600 + [1] * 200)
        pairs = [(r.randrange(len(words)), r.randrange(len(words))) for _ in range(300)]
        pairs = [p for p in pairs if p[0] != p[1]] or [(0, 1)][: len(words) - 1]
        if not pairs:
            continue
        got = P.CommonExtensions(words).lengths(*(np.array(x) for x in zip(*pairs)))
        for (a, b), n in zip(pairs, got.tolist()):
            k = 0
            while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
                k += 1
            assert n == k


def test_cover():
    assert {(a - b) % P.COVER for a in P.SAMPLED for b in P.SAMPLED} == set(range(P.COVER))


def test_long_text():
    words = ["x"] * 10 + [f"w{k % 1999}" for k in range(60_000)] + ["y z"] * 3
    assert [tuple(x) for x in P.runs_of([numbers(words)])[0].tolist()] == [(0, 10, 1), (10, 60_000, 1999)]


def answer(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def test_op13(spark, sf):
    rows = queries.QUERIES["op13_periodic_runs"](spark, sf).collect()
    want = [answer(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, rows)) == sorted(want) and sum(w[1] for w in want) > 10


def test_odd_rows(odd, nothing):
    """Nulls, blanks, long texts, repeats and clashing names: every row stays."""
    docs = odd.withColumnRenamed("size", "runs").withColumnRenamed("place", "Collapsed")
    out = P.find_runs(docs)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "keep_id", "runs", "collapsed"]
    want = [(r.doc_id or -1, runs_by_hand(words := (r.text or "").encode().split()), words) for r in odd.where("length(text) < 3000 OR text IS NULL").collect()]
    got = {(r.doc_id or -1): [tuple(x) for x in r.runs] for r in out.collect()}
    assert all(got[d] == runs for d, runs, _ in want) and out.count() == odd.count()
    assert {r.doc_id: r.collapsed for r in out.collect()}[17] == "The" and P.find_runs(nothing).count() == 0
    assert {r.collapsed for r in out.where("doc_id IN (5, 6, 7)").collect()} == {""}


def test_best_run(spark):
    rows = [([(5, 8, 2), (9, 12, 3), (0, 30, 8)],), ([],), ([(3, 8, 2), (3, 4, 1)],)]
    got = spark.createDataFrame(rows, "runs array<struct<start:long,length:long,period:long>>").select(P.best_run(P.F.col("runs")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in got] == [(5, 8, 2), None, (3, 4, 1)]
