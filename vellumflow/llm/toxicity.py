"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and the beginnings of words (letters only, A-Z lower-cased). The labels say toxic or not; grades come
from them: 0 is not toxic, and toxic rows fall into 1 and 2 by the share of their sentences that show a toxic feature, split
at the median: the regression sees how often features occur, but neither sentences nor the length of a text. One weight per
feature serves all thresholds, and the sum of the probabilities of passing each threshold is the expected severity. Above
which probability a text is toxic is chosen on labelled rows that take no part in the fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm import linear, sampling
from vellumflow.llm.shared import map_slices
from vellumflow.llm.wordhash import LETTER_BYTES, LOWER, byte_sums, chunks, joined, span_hashes, word_spans

LABELLED = 8000  # labelled rows that the model is fitted on, at most
FEATURES = 2048  # features that the model keeps, at most
BEGINNINGS = (4, 5, 6, 7)  # bytes
LEAST_SHARE, LEAST_ROWS = 0.01, 3  # of the toxic rows must have a feature
LEVELS = 3
HELD_OUT = 5  # every so many-th labelled row only helps to choose the threshold
PRECISION = 4  # times that a false alarm weighs against a toxic text that is missed: the square of 1 / beta of an F score


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    cuts: np.ndarray
    threshold: float = 0.5  # of P(toxic)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all features of some texts, the number of the text of each, and the words of each text."""
    data, starts = joined(texts)
    data = LOWER[data]
    begin, end = word_spans(data, LETTER_BYTES)
    of = np.searchsorted(starts, begin, side="right") - 1
    sums = byte_sums(data)
    hashes, owners = [span_hashes(sums, begin, end)], [of]
    for k in BEGINNINGS:
        longer = end - begin > k
        hashes.append(span_hashes(sums, begin[longer], begin[longer] + k) + np.uint64(k))
        owners.append(of[longer])
    return np.concatenate(hashes), np.concatenate(owners), np.bincount(of, minlength=len(texts))


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace") if t else b"" for t in texts]


def _hits(texts: list[bytes], wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of texts: where the range begins; text, feature number and count of what is found; words per text."""
    small = np.zeros(1 << 16, bool)  # turns most features away before the search
    small[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    for first, last in chunks(texts):
        hashes, of, words = features(texts[first:last])
        maybe = small[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        hashes, of = hashes[maybe], of[maybe]
        at = np.minimum(np.searchsorted(wanted, hashes), max(len(wanted) - 1, 0))
        found = wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), bool)
        pairs, counts = np.unique(of[found] * max(len(wanted), 1) + at[found], return_counts=True)
        yield first, pairs // max(len(wanted), 1), pairs % max(len(wanted), 1), counts, words


def select_features(sample: DataFrame, bound: int = FEATURES) -> np.ndarray:
    """The features that speak most for toxic rows by chi-squared, sorted. Counted by Spark over the sample."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, label = _encoded(batch["text"]), batch["_label"].to_numpy()
            for first, last in chunks(texts):
                hashes, of, _ = features(texts[first:last])
                order = np.lexsort((of, hashes))
                hashes, of = hashes[order], of[order]
                once = np.ones(len(hashes), bool)
                once[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
                hashes, toxic = hashes[once], label[first:last][of[once]] > 0
                distinct, where = np.unique(hashes, return_inverse=True)
                yield pd.DataFrame({"feature": distinct.view(np.int64), "toxic": np.bincount(where, toxic, len(distinct)).astype(np.int64), "clean": np.bincount(where, ~toxic, len(distinct)).astype(np.int64)})

    sums = sample.groupBy().agg(F.sum((F.col("_label") > 0).cast("long")).alias("toxic"), F.count(F.lit(1)).alias("rows")).first()
    toxic, clean = sums.toxic or 0, (sums.rows or 0) - (sums.toxic or 0)
    counted = map_slices(sample.select("text", "_label"), count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p, q = F.col("toxic") / max(toxic, 1), F.col("clean") / max(clean, 1)
    share = (F.col("toxic") + F.col("clean")) / max(toxic + clean, 1)
    speaks = (F.col("toxic") >= max(LEAST_ROWS, int(LEAST_SHARE * toxic))) & (p > 4 * q)
    best = counted.where(speaks).orderBy(F.desc((p - q) * (p - q) / (share * (1 - share) + 1e-12)), "feature").limit(bound)
    return np.sort(np.array([r.feature for r in best.select("feature").collect()], np.int64).view(np.uint64))


def _shares(texts: list[bytes], wanted: np.ndarray) -> list[float]:
    """Of each text, the share of sentences that show a feature."""
    sentences = [[p for p in re.split(rb"[.!?\n]+", t) if p.strip()] or [b""] for t in texts]
    flat = [p for parts in sentences for p in parts]
    shown = np.zeros(len(flat), bool)
    for first, of, _, _, _ in _hits(flat, wanted):
        shown[first + of] = True
    edges = np.concatenate([[0], np.cumsum([len(parts) for parts in sentences])])
    return [float(shown[a:b].mean()) for a, b in zip(edges, edges[1:])]


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, label: str = "toxic") -> Model:
    """Fit on at most bound labelled documents. Without toxic rows, nothing is toxic."""
    sample = sampling.labelled(docs.select("doc_id", "text"), labels, label, bound).withColumn("_held", F.pmod(F.xxhash64("doc_id", F.lit("threshold")), F.lit(HELD_OUT)) == 0)
    wanted = select_features(sample.where("NOT _held"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _encoded(batch["text"])
            for first, of, feature, counts, words in _hits(texts, wanted):
                last, cuts = first + len(words), np.searchsorted(of, np.arange(len(words) + 1))
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].to_numpy()[first:last],
                        "label": batch["_label"].to_numpy()[first:last],
                        "held": batch["_held"].to_numpy()[first:last],
                        "columns": [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])],
                        "counts": [counts[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])],
                        "share": _shares(texts[first:last], wanted),
                    }
                )

    # at most bound rows, each with the model's features only
    seen = map_slices(sample, look, "doc_id long, label long, held boolean, columns binary, counts binary, share double").toPandas().sort_values("doc_id", kind="stable")
    toxic, held = seen["label"].to_numpy(np.int64) > 0, seen["held"].to_numpy(bool)
    if len(wanted) == 0 or not (toxic & ~held).any():
        return Model(wanted, np.zeros(len(wanted)), np.array([5.0, 6.0]))
    share = seen["share"].to_numpy()
    grades = np.where(toxic, 1 + (share > np.median(share[toxic & ~held])), 0).astype(np.int64)
    columns = [np.frombuffer(c, np.int32) for c in seen["columns"]]
    counts = [1 + np.log(np.frombuffer(c, np.int32)) for c in seen["counts"]]
    pick = lambda at: linear.Rows([columns[k] for k in np.flatnonzero(at)], [counts[k] for k in np.flatnonzero(at)])
    weights, cuts = linear.ordinal(pick(~held), grades[~held], len(wanted), LEVELS)
    judge = held if (toxic & held).any() else ~held
    return Model(wanted, weights, cuts, _best_threshold(linear.sigmoid(pick(judge).dot(weights) - cuts[0]), toxic[judge]))


def _best_threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """Half way between the neighbouring probabilities where hits outweigh false alarms and misses best."""
    order = np.argsort(-p, kind="stable")
    ranked, hits = p[order], np.cumsum(toxic[order])
    false, missed = np.arange(1, len(p) + 1) - hits, toxic.sum() - hits
    score = (1 + PRECISION) * hits / ((1 + PRECISION) * hits + PRECISION * false + missed)
    score[:-1][ranked[:-1] == ranked[1:]] = 0
    k = int(score.argmax())
    return float((ranked[k] + ranked[min(k + 1, len(p) - 1)]) / 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 2), p_toxic, p_severe, grade (most likely), toxic: one row per input row.

    Null and empty texts have no features and get the lowest severity. Repeated ids are scored each. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            z = np.zeros(len(batch))
            for first, of, feature, counts, words in _hits(_encoded(batch["text"]), m.features):
                z[first : first + len(words)] = np.bincount(of, m.weights[feature] * (1 + np.log(counts)), len(words)) if len(of) else 0.0
            above = linear.sigmoid(z[:, None] - m.cuts[None, :])
            chances = -np.diff(np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1), axis=1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "severity": above.sum(axis=1), "p_toxic": above[:, 0], "p_severe": above[:, 1], "grade": chances.argmax(axis=1).astype(np.int32), "toxic": above[:, 0] >= m.threshold})

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, severity double, p_toxic double, p_severe double, grade int, toxic boolean")
