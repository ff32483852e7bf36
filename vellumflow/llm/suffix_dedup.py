"""Removal of repeated passages by suffix arrays.

A byte goes when a string of LENGTH bytes that covers it also starts in a document with a smaller id.

1. Each string has an anchor: of the k-byte windows inside it, the one with the smallest hash, leftmost first. Equal strings
   have equal anchors, and neighbouring strings mostly share theirs, so a text has few. Anchors are grouped by hash; those
   that occur in one document only are dropped, and with them all strings that they stand for.
2. What is left are slices of texts, the strings of one anchor in a row. Slices are dealt to shards by their anchor, so
   equal strings meet in one shard. A slice that occurs often is kept once, with its documents.
3. A shard is one text. Its suffix array is made by induced sorting, and permuted common prefixes of LENGTH bytes bind equal
   strings into groups; each group has its smallest document, and every later occurrence is marked.
4. Marked ranges are joined to their documents, merged and cut out.

Shards have a bounded number of bytes before equal slices are put together, unless one anchor alone has more: then the
shard holds that anchor's different contexts, each once for every batch of documents that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.shared import cut, drop_cut, map_slices
from vellumflow.llm.suffix_array import permuted_common_prefixes, suffix_array
from vellumflow.llm.wordhash import byte_sums, chunks, span_hashes

LENGTH = 50
WINDOW = 20  # bytes of an anchor
SHARD_BYTES = 4 << 20
BUCKET_BYTES = 64 << 20  # bytes of text whose anchors make a bucket, about
CHUNK = 1 << 20  # bytes of text whose anchors are found at once
FLUSH = 8  # chunks whose anchors or slices are packed together
SEPARATOR = b"\xff"  # no byte of UTF-8


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace") if t else b"" for t in texts]


class Anchors:
    """Anchors of a range of texts: owner (number of the text), place (in the text), hash, and the strings each stands for."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, window: int = WINDOW):
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=begins[1:])
        self.data, self.sums = data, byte_sums(data)
        strings = np.maximum(sizes - length + 1, 0)
        total = int(strings.sum())
        if not total:
            self.owner = self.place = self.run = self.first = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.begins = begins
            return
        n = len(data) - window + 1
        hashes = span_hashes(self.sums, np.arange(n), np.arange(n) + window)
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        wide, span = length - window + 1, 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        owner = np.repeat(np.arange(len(texts)), strings)
        start = np.arange(total) - np.repeat(np.cumsum(strings) - strings, strings) + begins[owner]
        at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(total, bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        self.begins = begins
        self.owner = owner[heads]
        self.first = start[heads]  # of the strings, in the data
        self.run = np.diff(np.append(heads, total))
        self.place = at[heads] - begins[self.owner]
        self.hash = hashes[at[heads]]


def _different(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different ones among slices of some bytes, compared in full, and which of them each slice is."""
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(data[a : a + n], len(seen)) for a, n in zip(starts.tolist(), sizes.tolist())], np.int64)
    return list(seen), number


def _numbers(blobs, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _aside(docs: np.ndarray, groups: int) -> int:
    """A number below 0 for the group of rows that need no comparison, from the documents they come from."""
    mixed = int(docs.sum(dtype=np.int64)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return -1 - (mixed >> 33) % groups


def shared_anchors(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, places: where each document has anchors that another document has as well (or, rarely, one with the same 32-bit hash).

    Anchors travel packed, by bucket of their hash. What a batch already knows to be shared needs no comparison and goes to groups of its
    own, dealt by batch; only one sign of it is compared, so a frequent anchor costs its bucket one entry per batch.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def packed_rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        hashes, docs_of, places = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((docs_of, hashes))
        hashes, docs_of, places = hashes[order], docs_of[order], places[order]
        heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(hashes)))
        known = np.repeat(docs_of[heads] != docs_of[heads + counts - 1], counts)
        sign = np.zeros(len(hashes), bool)
        sign[heads] = known[heads]
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        short = (hashes >> np.uint64(32)).astype("<u4")
        rows = []
        for kind, mask in ((0, ~known), (2, sign)):
            at = np.flatnonzero(mask)
            at = at[np.argsort(bucket[at], kind="stable")]
            cuts = np.searchsorted(bucket[at], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                own = at[cuts[b] : cuts[b + 1]]
                rows.append((int(b), kind, short[own].tobytes(), docs_of[own].astype("<i8").tobytes() if kind == 0 else b"", places[own].astype("<u4").tobytes() if kind == 0 else b""))
        if known.any():
            docs_of, places = docs_of[known], places[known]
            order = np.lexsort((places, docs_of))
            rows.append((_aside(docs_of, buckets), 1, b"", docs_of[order].astype("<i8").tobytes(), places[order].astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "kind", "hashes", "docs", "places"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for batch in batches:
            texts, ids = _encoded(batch["text"]), batch["doc_id"].to_numpy(np.int64)
            for first, last in chunks(texts, CHUNK):
                a = Anchors(texts[first:last], length, window)
                parts.append((a.hash, ids[first:last][a.owner], a.place))
                if len(parts) == FLUSH:
                    yield packed_rows(parts)
                    parts = []
        if parts:
            yield packed_rows(parts)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        mine, passed, signs = (group[group["kind"] == k] for k in range(3))
        hashes, ids, places = _numbers(mine["hashes"], "<u4"), _numbers(mine["docs"], "<i8"), _numbers(mine["places"], "<u4")
        order = np.lexsort((ids, hashes))
        hashes, ids, places = hashes[order], ids[order], places[order]
        heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(hashes)))
        several = np.repeat(ids[heads] != ids[heads + counts - 1], counts) if len(heads) else np.zeros(0, bool)
        several |= np.isin(hashes, np.unique(_numbers(signs["hashes"], "<u4")))
        return pd.DataFrame({"doc_id": np.concatenate([ids[several], _numbers(passed["docs"], "<i8")]), "place": np.concatenate([places[several], _numbers(passed["places"], "<u4")]).astype(np.int32)})

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    packed = map_slices(rows, pack, "bucket int, kind int, hashes binary, docs binary, places binary")
    found = packed.groupBy("bucket").applyInPandas(compare, "doc_id long, place int")
    return found.groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def _lost(docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shards: int) -> tuple:
    """The row of what is known to go: ranges of each document, joined where they overlap or touch."""
    order = np.lexsort((starts, docs))
    docs, starts, stops = docs[order], starts[order], (starts + sizes)[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (starts[1:] > stops[:-1])
    first = np.flatnonzero(new)
    docs, starts, stops = docs[first], starts[first], np.maximum.reduceat(stops, first)
    return _aside(docs, shards), b"", (stops - starts).astype("<u4").tobytes(), b"", docs.astype("<i8").tobytes(), starts.astype("<u4").tobytes()


def _slices(docs: DataFrame, shards: int, length: int, window: int) -> DataFrame:
    """Rows of (shard, text: different slices one after the other, their sizes, and what occurs where).

    Of a batch's occurrences of a slice only those in the smallest document have to be compared. The others lose all of it whatever
    other batches hold, and go to groups of their own, with a shard below 0, no text, and the sizes of what they lose.
    """

    def found(a: Anchors, ids: np.ndarray, marked: list, bases: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk: the different slices; and of each occurrence the number of its slice, shard, document and start."""
        wanted = (np.repeat(np.arange(len(ids)), [len(m) for m in marked]) << 32) | (np.concatenate(marked).astype(np.int64) & 0xFFFFFFFF)
        at = np.flatnonzero(np.isin((a.owner << 32) | a.place, wanted))
        texts, number = _different(a.data.tobytes(), a.first[at], a.run[at] + length - 1)
        return texts, number, (a.hash[at] % np.uint64(shards)).astype(np.int64), ids[a.owner[at]], a.first[at] - a.begins[a.owner[at]] + bases[a.owner[at]]

    def packed_rows(parts: list[tuple]) -> pd.DataFrame:
        seen: dict[bytes, int] = {}
        names = [np.array([seen.setdefault(t, len(seen)) for t in p[0]], np.int64) for p in parts]
        texts = list(seen)
        number = np.concatenate([name[p[1]] for name, p in zip(names, parts)])
        shard, own, starts = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, number, own)
        later = own > least[number]
        rows = [_lost(own[later], starts[later], np.array([len(t) for t in texts], np.int64)[number[later]], shards)] if later.any() else []
        shard, number, own, starts = shard[~later], number[~later], own[~later], starts[~later]
        order = np.lexsort((number, shard))  # equal slices have equal anchors, and so the same shard
        shard, number, own, starts = shard[order], number[order], own[order], starts[order]
        new = np.ones(len(order), bool)
        new[1:] = number[1:] != number[:-1]
        heads, place = np.flatnonzero(new), np.cumsum(new) - 1
        edge = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            s0, s1 = place[lo], place[hi - 1] + 1
            here = [texts[k] for k in number[heads[s0:s1]]]
            rows.append((int(shard[lo]), b"".join(here), np.array([len(t) for t in here], "<u4").tobytes(), (place[lo:hi] - s0).astype("<u4").tobytes(), own[lo:hi].astype("<i8").tobytes(), starts[lo:hi].astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["shard", "text", "sizes", "of", "docs", "starts"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for batch in batches:
            texts, ids = _encoded(batch["text"]), batch["doc_id"].to_numpy(np.int64)
            marked, bases = batch["places"].tolist(), batch["base"].to_numpy(np.int64)
            for first, last in chunks(texts, CHUNK):
                slices = found(Anchors(texts[first:last], length, window), ids[first:last], marked[first:last], bases[first:last])
                if slices[0]:
                    parts.append(slices)
                if len(parts) == FLUSH:
                    yield packed_rows(parts)
                    parts = []
        if parts:
            yield packed_rows(parts)

    return map_slices(docs, pack, "shard int, text binary, sizes binary, of binary, docs binary, starts binary")


def mark_shard(group: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """doc_id, start, stop: ranges of bytes to remove, from one shard's slices."""
    sizes = _numbers(group["sizes"], "<u4").astype(np.int64)
    if group["shard"].iloc[0] < 0:
        docs, starts = _numbers(group["docs"], "<i8"), _numbers(group["starts"], "<u4").astype(np.int64)
        return pd.DataFrame({"doc_id": docs, "start": starts.astype(np.int32), "stop": (starts + sizes).astype(np.int32)})
    in_row = np.array([len(s) // 4 for s in group["sizes"]], np.int64)
    occurs = np.array([len(o) // 4 for o in group["of"]], np.int64)
    of = _numbers(group["of"], "<u4").astype(np.int64) + np.repeat(np.cumsum(in_row) - in_row, occurs)
    docs, starts = _numbers(group["docs"], "<i8"), _numbers(group["starts"], "<u4").astype(np.int64)

    # each different slice once, behind it a separator
    slices, number = _different(b"".join(group["text"]), np.cumsum(sizes) - sizes, sizes)
    of, sizes = number[of], np.array([len(t) for t in slices], np.int64)
    least = np.full(len(slices), np.iinfo(np.int64).max)
    np.minimum.at(least, of, docs)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(SEPARATOR.join([*slices, b""]), np.uint8)
    del slices

    # strings start where a slice has room for them; others leave the array
    strings = sizes - length + 1
    numbers = np.repeat(np.arange(len(sizes)), strings)
    spots = np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings) + offsets[numbers]
    string_at = np.full(len(text), -1, np.int32)
    string_at[spots] = np.arange(len(spots), dtype=np.int32)
    order = suffix_array(text, length)
    order = order[string_at[order] >= 0]
    heads = np.flatnonzero(permuted_common_prefixes(text, order, length) < length)
    in_order = string_at[order]
    best = np.empty(len(spots), np.int64)
    best[in_order] = np.repeat(np.minimum.reduceat(least[numbers[in_order]], heads), np.diff(np.append(heads, len(order))))

    # an occurrence loses the strings that a smaller document has: all, none or some of its slice
    edges = np.cumsum(strings) - strings
    low, high = np.minimum.reduceat(best, edges), np.maximum.reduceat(best, edges)
    whole = high[of] < docs
    some = np.flatnonzero(~whole & (low[of] < docs))
    out = [(docs[whole], starts[whole], starts[whole] + sizes[of[whole]])]
    if len(some):
        n = strings[of[some]]
        own = np.repeat(np.arange(len(some)), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        goes = best[inside + edges[of[some]][own]] < docs[some][own]
        own, inside = own[goes], inside[goes]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(own)) - 1
        out.append((docs[some][own[first]], starts[some][own[first]] + inside[first], starts[some][own[first]] + inside[last] + length))
    return pd.DataFrame({"doc_id": np.concatenate([o[0] for o in out]), "start": np.concatenate([o[1] for o in out]).astype(np.int32), "stop": np.concatenate([o[2] for o in out]).astype(np.int32)})


def _based(docs: DataFrame) -> DataFrame:
    """doc_id, text, base: the bytes that other rows of the same id have before a row's, so that a place in any of them has a number of its own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.withColumn("base", F.lit(0))
    before = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.octet_length("text"), F.lit(0)))
    numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    bases = numbered.where("doc_id IS NOT NULL").select("row", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int").alias("base"))
    return cut(numbered.join(bases, "row", "left").select("doc_id", "text", F.coalesce("base", F.lit(0)).alias("base")), "based-rows")


def removed_ranges(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, ranges: array of (start, stop) in bytes behind the base of their row, which may touch and overlap. Documents that keep all have no row.

    docs: as _based() gives them.
    """
    marked = cut(shared_anchors(docs, length, window), "anchors")
    slices = marked.agg(F.sum(F.size("places"))).first()[0] or 0
    shards = max(1, -(-slices * (length + (length - window) // 2) // SHARD_BYTES))
    rows = docs.join(marked, "doc_id")
    ranges = _slices(rows, shards, length, window).groupBy("shard").applyInPandas(lambda g: mark_shard(g, length), "doc_id long, start int, stop int")
    out = cut(ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "ranges")
    drop_cut(marked)
    return out


def _merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _own(ranges: list[tuple[int, int]], base: int, size: int) -> list[tuple[int, int]]:
    """Of ranges, what falls into the row with this base and size."""
    clipped = [(max(a - base, 0), min(b - base, size)) for a, b in ranges]
    return [(a, b) for a, b in clipped if a < b]


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, kept (the bytes that remain), spans (array of removed (start, stop), maximal and in order), n_bytes: one row per input row.

    Texts are taken as UTF-8; null and empty texts have no bytes. Texts shorter than length lose nothing. A null id neither
    loses nor takes anything away. Rows that repeat an id, 2 GiB together at most, take nothing away from each other, and each loses
    its own bytes. Other columns are ignored; an empty table gives no rows. What remains may not be valid UTF-8, so it is binary.
    """
    based = _based(docs)
    ranges = removed_ranges(based, length, window).withColumnRenamed("doc_id", "of")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _encoded(batch["text"])
            spans = [_own(_merged(r), base, len(t)) if r is not None else [] for r, base, t in zip(batch["ranges"], batch["base"], texts)]
            kept = []
            for text, gone in zip(texts, spans):
                edges = [0, *(e for s in gone for e in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if gone else text)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "kept": kept, "spans": [[{"start": a, "stop": b} for a, b in s] for s in spans], "n_bytes": [len(t) for t in texts]})

    rows = based.join(ranges, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "base", "ranges")
    return map_slices(rows, strip, "doc_id long, kept binary, spans array<struct<start:int,stop:int>>, n_bytes long")
