"""Quality classifier by co-training.

Two views of a document: the text's content (hashed words, word endings, repeats) and the page's metadata (language,
source, length and layout figures). Each view has its own classifier, and both start from the same labelled rows. In every
round each view labels all other documents of the corpus, and those that it is confident of teach the other view: Spark
sums their features by pseudo-label, and the mean of each class joins the other view's training rows with a weight of its
own, so what is learnt grows with the corpus while the driver holds no more than a row for each class. Both views are then
calibrated on labelled rows that neither was fitted on, and a document's score is a logistic combination of the calibrated
log odds, fitted on the same held-out rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.llm import linear, sampling
from vellumflow.llm.shared import SLICE, map_slices
from vellumflow.llm.wordhash import LOWER, WORD_BYTES, byte_sums, chunks, joined, span_hashes, word_spans

LABELLED = 5000  # labelled rows, at most
ROUNDS = 3
CONFIDENT = 0.9  # least probability of a pseudo-label
PSEUDO = 0.25  # weight of all pseudo-labels together, against the labelled rows
HELD_OUT = 5  # every so many-th labelled row calibrates
THRESHOLD = 0.5

WORD_DIM, END_DIM = 1 << 15, 1 << 12
CONTENT_DIM = WORD_DIM + 2 * END_DIM + 2
LANGS, SOURCES = 16, 64
FIGURES = 12
META_DIM = LANGS + SOURCES + FIGURES
SCALE = 20.0


@dataclass
class Model:
    content: np.ndarray  # weights and bias
    meta: np.ndarray
    content_line: tuple[float, float]  # calibration
    meta_line: tuple[float, float]
    both: np.ndarray  # weights of the calibrated log odds, and the bias


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column number of every content token, the text of each, and the words of each text."""
    data, starts = joined(texts)
    begin, end = word_spans(data, WORD_BYTES)
    of = np.searchsorted(starts, begin, side="right") - 1
    sums = byte_sums(data)
    word = span_hashes(byte_sums(LOWER[data]), begin, end)
    columns = [(word % np.uint64(WORD_DIM)).astype(np.int64)]
    for k, shift in ((2, WORD_DIM), (3, WORD_DIM + END_DIM)):
        columns.append((span_hashes(sums, np.maximum(begin, end - k), end) % np.uint64(END_DIM)).astype(np.int64) + shift)
    owners = [of] * 3
    for k, place in ((1, CONTENT_DIM - 2), (2, CONTENT_DIM - 1)):
        again = np.flatnonzero((word[k:] == word[:-k]) & (of[k:] == of[:-k])) + k
        columns.append(np.full(len(again), place, np.int64))
        owners.append(of[again])
    return np.concatenate(columns), np.concatenate(owners), np.bincount(of, minlength=len(texts))


_KIND = np.zeros(256, np.int64)  # 0 other letters, 1 upper case, 2 digit, 3 symbol, 4 space, 5 line end, 6 not ASCII
_KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 6
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 3
_KIND[[0x20, 0x09]], _KIND[0x0A] = 4, 5


def _figures(texts: list[bytes]) -> np.ndarray:
    """Layout figures of texts: shares of kinds of bytes, lengths, line statistics."""
    out = np.zeros((len(texts), FIGURES))
    for k, text in enumerate(texts):
        n = max(len(text), 1)
        share = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7)[:7] / n
        lines = text.split(b"\n")
        out[k] = [*(share * 5), np.log1p(len(text)) / 5, np.log1p(len(lines)), 2 * len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 3, float(len(text) < 100)]
    return out


def _slot(value: object, size: int) -> int:
    data = b"" if value is None or value != value else str(value).encode()
    return int(pd.util.hash_array(np.array([data.decode()], object))[0] % size)


def _meta(batch: pd.DataFrame, texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(batch), META_DIM))
    for name, size, shift in (("lang", LANGS, 0), ("source", SOURCES, LANGS)):
        codes, values = pd.factorize(batch[name], use_na_sentinel=False)
        slots = np.array([_slot(v, size) for v in values], np.int64)
        if len(batch):
            out[np.arange(len(batch)), shift + slots[codes]] = 1
    out[:, LANGS + SOURCES :] = _figures(texts)
    return out


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace") if t else b"" for t in texts]


def _featured(rows: DataFrame) -> pd.DataFrame:
    """Features of a bounded sample, on the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _encoded(batch["text"])
            meta = _meta(batch, texts).astype(np.float32)
            for first, last in chunks(texts):
                columns, of, words = _tokens(texts[first:last])
                pairs, counts = np.unique(of * CONTENT_DIM + columns, return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(len(words) + 1) * CONTENT_DIM)
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].to_numpy()[first:last],
                        "label": batch["_label"].to_numpy()[first:last],
                        "columns": [(pairs[a:b] % CONTENT_DIM).astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])],
                        "values": [(counts[a:b] * SCALE / max(w, 1)).astype(np.float32).tobytes() for a, b, w in zip(cuts, cuts[1:], words)],
                        "meta": [m.tobytes() for m in meta[first:last]],
                    }
                )

    slim = rows.select(F.col("doc_id").cast("long"), "text", "lang", "source", "_label")
    return map_slices(slim, run, "doc_id long, label long, columns binary, values binary, meta binary").toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)


class _View:
    """One classifier in co-training: its labelled rows, and the means of documents that the other view labelled."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], width: int, l2: float, train: np.ndarray, y: np.ndarray):
        self.width, self.l2, self.train, self.y = width, l2, train, y
        self.columns, self.values, self.weights = columns, values, None
        self.rows = linear.Rows(columns, values)

    def fit(self, means: dict[int, np.ndarray]) -> None:
        """means: of each pseudo-label's documents; their weights are in the proportion of the labels."""
        rows, y, weight = self.rows, self.y, self.train.astype(float)
        if means:
            every = np.arange(self.width, dtype=np.int32)
            rows = linear.Rows([*self.columns, *([every] * len(means))], [*self.values, *means.values()])
            share = {k: (weight * (y == k)).sum() for k in means}
            y, weight = np.concatenate([y, list(means)]), np.concatenate([weight, [PSEUDO * share[k] for k in means]])
        steps = 100 if self.weights is None else 40  # later rounds go on from the round before
        self.weights = linear.logistic(rows, y, self.width, weight, l2=self.l2, steps=steps, start=self.weights)

    def scores(self, at: np.ndarray) -> np.ndarray:
        return self.rows.dot(self.weights[:-1])[at] + self.weights[-1]


def _pseudo_means(rows: DataFrame, content: np.ndarray, meta: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """For the content view and the metadata view: means of the features of all documents that the other one is confident of, by pseudo-label.

    Each task sums its documents; Spark adds the sums by place. The result has a row for each feature and label at most.
    """
    shared = rows.sparkSession.sparkContext.broadcast((content, meta))  # bounded by the feature dimensions
    width = {"content": CONTENT_DIM, "meta": META_DIM}

    def sure(z: np.ndarray) -> np.ndarray:
        p = linear.sigmoid(z)
        return np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = (shared.value[0][:-1], shared.value[1][:-1]), (shared.value[0][-1], shared.value[1][-1])
        sums = {v: np.zeros((2, w + 1)) for v, w in width.items()}  # the last place counts documents
        for batch in batches:
            texts = _encoded(batch["text"])
            figures = _meta(batch, texts)
            said = sure(figures @ weights[1] + bias[1])
            for first, last in chunks(texts):
                columns, of, words = _tokens(texts[first:last])
                scale = SCALE / np.maximum(words, 1)
                by_content = sure(np.bincount(of, weights[0][columns], len(words)) * scale + bias[0])
                by_meta = said[first:last]
                for k in (0, 1):
                    taught = by_meta == k
                    at = taught[of]
                    sums["content"][k, :-1] += np.bincount(columns[at], scale[of[at]], CONTENT_DIM)
                    sums["content"][k, -1] += taught.sum()
                    taught = by_content == k
                    sums["meta"][k, :-1] += figures[first:last][taught].sum(axis=0)
                    sums["meta"][k, -1] += taught.sum()
        for view, table in sums.items():
            k, place = np.nonzero(table)
            yield pd.DataFrame({"view": view, "label": k, "place": place, "total": table[k, place]})

    added = map_slices(rows.select("text", "lang", "source"), run, "view string, label int, place int, total double").groupBy("view", "label", "place").agg(F.sum("total").alias("total")).toPandas()
    out = []
    for view, w in width.items():
        means = {}
        for k in (0, 1):
            one = added[(added["view"] == view) & (added["label"] == k)]
            total = np.zeros(w + 1)
            total[one["place"].to_numpy(np.int64)] = one["total"]
            if total[-1]:
                means[k] = (total[:-1] / total[-1]).astype(np.float32)
        out.append(means)
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, label: str = "quality") -> Model:
    """Co-train both views: on at most so many labelled rows, and on all other documents by their pseudo-labels.

    Labels of one kind only give a model that keeps that kind; without labels everything is kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    data = _featured(sampling.labelled(rows, labels, label, labelled))
    if data.empty:
        keep = (np.zeros(CONTENT_DIM + 1), np.zeros(META_DIM + 1))
        return Model(*keep, (1.0, 1.0), (1.0, 1.0), np.array([0.5, 0.5, 0.0]))
    y = (data["label"].to_numpy(np.int64) > 0).astype(float)
    held = np.arange(len(y)) % HELD_OUT == 0
    train = ~held if len(y) > HELD_OUT else np.ones(len(y), bool)
    columns, values, figures = ([np.frombuffer(v, t) for v in data[c]] for c, t in (("columns", np.int32), ("values", np.float32), ("meta", np.float32)))
    content = _View(columns, values, CONTENT_DIM, 1e-4, train, y)
    meta = _View([np.arange(META_DIM, dtype=np.int32)] * len(y), figures, META_DIM, 1e-3, train, y)
    used = docs.sparkSession.createDataFrame(data[["doc_id"]].rename(columns={"doc_id": "_used"}))  # at most `labelled` ids
    others = rows.join(F.broadcast(used), F.col("doc_id") == F.col("_used"), "left_anti")
    content.fit({})
    meta.fit({})
    for _ in range(rounds):
        of_content, of_meta = _pseudo_means(others, content.weights, meta.weights)
        content.fit(of_content)
        meta.fit(of_meta)
    views, truth = (content, meta), y[held]
    lines = [linear.platt(view.scores(held), truth) for view in views]
    odds = np.stack([slope * view.scores(held) + shift for view, (slope, shift) in zip(views, lines, strict=True)], axis=1)
    two = np.arange(2, dtype=np.int32)
    both = linear.logistic(linear.Rows([two] * len(odds), list(odds)), truth, 2, l2=1e-2, steps=300) if 0 < truth.sum() < len(truth) else np.array([0.5, 0.5, 0.0])
    return Model(content.weights, meta.weights, *lines, both)


def _scores(m: Model, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of good quality: of both views together, of the content, of the metadata."""
    texts = _encoded(batch["text"])
    z = np.full(len(batch), m.content[-1])
    for first, last in chunks(texts):
        columns, of, words = _tokens(texts[first:last])
        z[first:last] += np.bincount(of, m.content[columns], len(words)) * SCALE / np.maximum(words, 1)
    a = m.content_line[0] * z + m.content_line[1]
    b = m.meta_line[0] * (_meta(batch, texts) @ m.meta[:-1] + m.meta[-1]) + m.meta_line[1]
    return linear.sigmoid(m.both[0] * a + m.both[1] * b + m.both[2]), linear.sigmoid(a), linear.sigmoid(b)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, quality (probability), p_content, p_meta, keep: one row per input row, of the whole text.

    Null texts, languages and sources count as empty. Repeated ids are scored each. No rows give no rows. Other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the feature dimensions

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p, content, meta = _scores(shared.value, batch)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": p, "p_content": content, "p_meta": meta, "keep": p >= threshold})

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("quality", "p_content", "p_meta")), T.StructField("keep", T.BooleanType())])
    return map_slices(docs.select(F.col("doc_id").cast("long"), "text", "lang", "source"), run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns as they came. Rows are dropped where they are read: no exchange.

    Nulls in text, language and source count as empty; rows with a null or repeated id are judged each by its own text. No rows
    give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                seen = pd.DataFrame({c: part.column(c).to_pandas() for c in ("text", "lang", "source")})
                yield part.filter(pa.array(_scores(shared.value, seen)[0] >= threshold))

    return docs.mapInArrow(good, docs.schema)
