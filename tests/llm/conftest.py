"""Small fixtures that stress the operators: nulls, empty and long texts, ties, repeated rows, odd columns."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(2, 30)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "fr", None), (4, base.replace(" ", "\t\n "), "en", "a"),
        (5, None, None, None), (6, "", "en", "a"), (7, " \t\n", "de", "b"), (8, "one two", "en", "a"), (9, "one  two", "en", "a"),
        (10, prose(3, 40) + " " + passage + " " + prose(4, 40), "en", "b"), (11, prose(5, 10) + " " + passage, "en", "c"), (12, passage + prose(6, 20), "es", "c"),
        (13, "ab" * 5000, "en", "long"), (14, prose(7, 8000), "en", "long"), (15, "日本語 \x00 é😀 ▁ ½", "ja", "a"), (15, "日本語 \x00 é😀 ▁ ½", "ja", "a"),
        (16, prose(8, 300), "en", "a"), (17, "The " * 200, "en", "b"), (18, passage, "en", "c"), (None, prose(9, 30), "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and extra columns whose names the operators use inside."""
    rows = [(*r, len(r[1] or ""), 1, "x", 2.0) for r in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, keep_id string, place double").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
