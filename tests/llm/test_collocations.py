"""Collocations against SQL and plain counting."""

import random
import re
from collections import Counter

import oracle
import pytest

from vellumflow.llm import collocations as C
from vellumflow.llm import queries
from vellumflow.llm.shared import table

SCHEMA = "doc_id long, text string, lang string"


def by_hand(rows, least, longest, keep=10**9):
    counts, totals = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) >= 2 and a >= least}
        inside = {}
        for g, a in candidates.items():
            for i in range(len(g)):
                for j in range(i + 1, len(g) + 1):
                    if j - i < len(g):
                        inside[g[i:j]] = max(inside.get(g[i:j], 0), a)
        rated = []
        for g, a in candidates.items():
            if 100 * inside.get(g, 0) < 100 * a:
                cuts = [(1000 * a * totals[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                rated.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, totals[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rated)[:keep], 1)]
    return sorted(out)


def random_rows(seed, n):
    r = random.Random(seed)
    words = ["The", "the", "of", "ab", "a\x01", "A", "é", "É", "\x85x", "日本", "zz", "\x1c"] + [f"w{k}" for k in range(20)]
    fixed = ["new york city hall", "the of the of the", "w1 w2 w3 w4 w5 w6"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice([r.choice(words), r.choice(words), r.choice(fixed)]) + r.choice(["  ", " ", "\t", ". ", ",", "\n", " ", " "]) for _ in range(r.randrange(60)))
        rows.append((text, r.choice(["en", "en", "en", "fr", None, "e n", ""])))
    return rows


@pytest.mark.parametrize("least,longest", [(3, 5), (1, 3), (20, 2), (5, 7)])
def test_plain_counting(spark, least, longest, monkeypatch):
    rows = random_rows(least, 60 if least == 1 else 250)
    monkeypatch.setattr(C, "WORDS", 500)  # several blocks
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(map(tuple, C.collocations(df, least, longest).collect()))
    want = by_hand(rows, least, longest, C.KEEP)
    assert got == want and len(want) > 10


def test_keep_and_ranks(spark):
    rows = random_rows(8, 200)
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], SCHEMA)
    got = sorted(map(tuple, C.collocations(df, 4, keep=7).collect()))
    assert got == by_hand(rows, 4, 5, 7) and max(g[1] for g in got) == 7


def test_gate_never_refuses(spark):
    phrases = [("en", f"w{k}") for k in range(3000)] + [("fr", "w1")]
    bits = C.np.frombuffer(C.gate(spark.createDataFrame(phrases, "lang string, phrase string").repartition(4)).value, C.np.uint8)
    assert C._passes(bits, C.word_hashes([p.encode() for lang, p in phrases if lang == "en"], "en")).all()
    assert C._passes(bits, C.word_hashes([f"v{k}".encode() for k in range(5000)], "en")).mean() < 0.01
    pairs = [("en", f"w{k} x{k}") for k in range(500)]
    bits = C.np.frombuffer(C.gate(spark.createDataFrame(pairs, "lang string, phrase string")).value, C.np.uint8)
    first, second = (C.word_hashes([f"{c}{k}".encode() for k in range(500)], "en") for c in "wx")
    assert C._passes(bits, C.pair_hashes(first, second)).all() and not C._passes(bits, C.pair_hashes(second, first)).any()


def test_walk():
    stream = [(0, "x a ", "x", "a", 9), (0, "x a b ", "x", "a b", 5), (0, "x a b c ", "x", "a b c", 5), (0, "x a d ", "x", "a d", 7), (1, "x a ", "x", "a", 9), (1, "x a e ", "x", "a e", 8)]
    got = sorted(C.walk(iter(stream)))
    assert got == sorted([("x", "a b c", 5, [9, 5], 0), ("x", "a b", 5, [9], 5), ("x", "a d", 7, [9], 0), ("x", "a", 9, [], 7), ("x", "a e", 8, [9], 0), ("x", "a", 9, [], 8)])


def test_large_products(spark):
    """Products beyond 64 bits stay exact."""
    big = 10**12 + 7
    phrases = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big), ("en", "a b", big)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 10**13 + 9)], "lang string, n long")
    (row,) = C.scored(phrases, totals).collect()
    assert row.score == 1000 * big * (10**13 + 9) // (6 * big * big) and (row.l, row.r) == (3 * big, 2 * big)


def test_odd_rows(odd, nothing):
    got = sorted(map(tuple, C.collocations(odd, 2).collect()))
    assert got == by_hand([(r.text, r.lang) for r in odd.collect()], 2, 5, C.KEEP)
    assert C.collocations(nothing).count() == 0
    with pytest.raises(ValueError, match="two words"):
        C.collocations(odd, longest=1)


def test_op12(spark, sf):
    df = queries.QUERIES["op12_collocations"](spark, sf)
    assert oracle.compare(df, queries.ORACLES["op12_collocations"], sf) is None
    assert sorted(map(tuple, df.collect())) == by_hand([(r.text, r.lang) for r in table(spark, sf, "documents").collect()], 100, 5, 2000)
