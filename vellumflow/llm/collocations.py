"""Collocations: phrases that occur more often than their parts would have them stand together.

Counting goes by length: a phrase can only be frequent if its parts are, so each pass over the texts counts what the frequent
phrases before leave possible. What is possible is read off a gate, a set of bits of fixed size that never refuses a frequent
phrase and lets a few others pass; those fall to their exact count. Tasks sum up blocks of texts before anything is shuffled.

The frequent phrases of all lengths are then kept as streams in two orders. In prefix order a phrase stands directly before
those that begin with it, in suffix order (words backwards) before those that end with it. So one walk through a sorted stream
with the phrases that the present one extends at hand gives the counts of all its first parts, or of all its last parts, and
tells each phrase its most frequent extension. No table is looked up. Streams are cut into ranges by sampled splitters, and a
phrase is repeated in each range that has extensions of it, so ranges are walked independently. Both walks are merged by phrase.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.sampling import smallest_hashes
from vellumflow.llm.shared import cut, drop_cut
from vellumflow.llm.wordhash import byte_sums, mixed, span_hashes

LEAST, LONGEST, KEEP = 100, 5, 2000
UNKNOWN = "und"
BYTES = 8 << 20  # of text whose words are Python objects at once; one text may be longer
WORDS = 4 << 20  # words that are counted together; one block may have more
PACK = 1 << 16  # phrases that are spelt out at once
GATE_BITS = 26  # of a gate's address: 8 MB at any size of the data
SLOTS = 1024  # parts in which a gate is put together
SALTS = 64
SAMPLE = 50  # keys a splitter is chosen from

_BREAK = b"\xff"  # stands between pieces; no byte of UTF-8
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all pieces of some texts, A-Z lower-cased, with a break between pieces."""
    return b"\n".join(texts).translate(_TABLE).replace(b"\n", b" " + _BREAK + b" ").split()


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]) if words else np.zeros(0, np.int64)
    return mixed(span_hashes(byte_sums(data), np.append(0, ends[:-1]).astype(np.int64) if len(ends) else ends, ends) + np.uint64(zlib.crc32(lang.encode())))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(3) + second)


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a gate for each hash."""
    mask = np.uint64((1 << GATE_BITS) - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(64 - GATE_BITS)).astype(np.int64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = _places(hashes)
    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def gate(phrases: DataFrame):
    """Broadcast bits of frequent words or pairs (lang, phrase); their size is fixed, so they may be collected."""
    part = (1 << GATE_BITS) // 8 // SLOTS

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros((1 << GATE_BITS) // 8, np.uint8)
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                words = [p.encode().split(b" ") for p in rows["phrase"]]
                hashes = word_hashes([w for ws in words for w in ws], lang)
                if len(words) and len(words[0]) == 2:
                    hashes = pair_hashes(hashes[::2], hashes[1::2])
                for at in _places(hashes):
                    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = bits.reshape(SLOTS, part)
        used = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"slot": used.astype(np.int32), "bits": [parts[k].tobytes() for k in used]})

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in group["bits"]])
        return pd.DataFrame({"slot": group["slot"][:1], "bits": [bits.tobytes()]})

    marked = phrases.select("lang", "phrase").mapInPandas(mark, "slot int, bits binary")
    out = np.zeros((SLOTS, part), np.uint8)
    for row in marked.groupBy("slot").applyInPandas(unite, "slot int, bits binary").collect():
        out[row.slot] = np.frombuffer(row.bits, np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(out.tobytes())


def _phrases(words: list[bytes], ids: np.ndarray, links: np.ndarray, low: int, high: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Different phrases of low to high words with their counts. links[i]: words i and i + 1 may stand in a frequent phrase."""
    at, shorter = np.flatnonzero(links), words
    name = ids[at]
    for k in range(2, high + 1):
        if k > 2:
            going = links[at + k - 2]
            at, name = at[going], name[going]
        keys, name, counts = np.unique(name.astype(np.int64) << 32 | ids[at + k - 1], return_inverse=True, return_counts=True)
        def spelt(first: int, last: int) -> list[bytes]:
            return [shorter[a] + b" " + words[b] for a, b in zip((keys[first:last] >> 32).tolist(), (keys[first:last] & 0xFFFFFFFF).tolist())]

        if k >= low:
            for first in range(0, len(keys), PACK):
                yield spelt(first, first + PACK), counts[first : first + PACK]
        if k < high:
            shorter = spelt(0, len(keys))


def _counted(rows: DataFrame, low: int, high: int, least: int, bits=None) -> DataFrame:
    """lang, phrase, f of the phrases of low to high words that occur often enough; for single words also the number of all, with a null phrase."""

    def summed(lang: str, number: dict[bytes, int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, ids = list(number), np.concatenate([*parts, np.zeros(high, np.int32)])
        if high == 1:
            counts = np.bincount(ids, minlength=len(words))[1:]
            found = [*((words[k : k + PACK], counts[k - 1 : k - 1 + PACK]) for k in range(1, len(words), PACK)), ([None], np.array([counts.sum()]))]
        else:
            allowed, hashes = np.frombuffer(bits.value, np.uint8), word_hashes(words, lang)
            if low == 2:
                good = _passes(allowed, hashes)
                good[0] = False
                links = good[ids[:-1]] & good[ids[1:]]
            else:
                links = (ids[:-1] > 0) & (ids[1:] > 0)
                at = np.flatnonzero(links)
                links[at] = _passes(allowed, pair_hashes(hashes[ids[at]], hashes[ids[at + 1]]))
            found = _phrases(words, ids, np.append(links, np.zeros(high, bool)), low, high)
        for phrases, counts in found:
            some = pa.array(phrases, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), some, pa.array(counts.astype(np.int64))], names=["lang", "phrase", "f"])

    def count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, dict[bytes, int]] = {}
        parts: dict[str, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            texts, langs = batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist()
            first = 0
            while first < len(langs):
                by_lang, size = defaultdict(list), 0
                while first < len(langs) and size < BYTES:
                    text = texts[first].as_py() or b""
                    by_lang[langs[first]].append(text)
                    size += len(text)
                    first += 1
                for lang, some in by_lang.items():
                    if lang not in numbers:
                        numbers[lang], parts[lang] = defaultdict(count().__next__, {}), []
                        numbers[lang][_BREAK]  # is number 0
                    found = tokens(some)
                    parts[lang].append(np.fromiter(map(numbers[lang].__getitem__, found), np.int32, len(found)))
                    parts[lang].append(np.zeros(1, np.int32))
                    held += len(found)
                if held >= WORDS:
                    for lang in numbers:
                        yield from summed(lang, numbers[lang], parts[lang])
                    numbers, parts, held = {}, {}, 0
        for lang in numbers:
            yield from summed(lang, numbers[lang], parts[lang])

    counted = rows.mapInArrow(count_blocks, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= least) | F.col("phrase").isNull())


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, f) of one to longest words, and (lang, n), the number of all words. Both are written to the shared folder."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    words = cut(_counted(rows, 1, 1, least), "words")
    totals = words.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    out = words.where("phrase IS NOT NULL")
    pairs = cut(_counted(rows, 2, 2, least, gate(out)), "pairs")
    out = out.unionByName(pairs)
    if longest > 2:
        out = out.unionByName(cut(_counted(rows, 3, longest, least, gate(pairs)), "longer"))
    return out, totals


def _splitters(keys: DataFrame, ranges: int) -> list[str]:
    """Keys that cut a stream into about equal ranges, from a bounded sample. Only the layout depends on them."""
    found = sorted((r.key for r in smallest_hashes(keys, "key", SAMPLE * ranges).collect()), key=lambda k: k.encode())
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}, key=lambda k: k.encode()) if found else []


def walk(rows: Iterator[tuple[int, str, str, str, int]]) -> Iterator[tuple[str, str, int, list[int], int]]:
    """From a sorted stream of (range, key, lang, phrase, f): lang, phrase, f, counts of the phrases that it extends, shortest first, and the greatest count of its extensions by one word."""
    path: list[list] = []  # each extends the one before: key, lang, phrase, f, counts, greatest
    now = None
    for number, key, lang, phrase, f in rows:
        while path and (number != now or not key.startswith(path[-1][0])):
            yield tuple(path.pop()[1:])
        now = number
        if path:
            path[-1][5] = max(path[-1][5], f)
        path.append([key, lang, phrase, f, [p[3] for p in path], 0])
    while path:
        yield tuple(path.pop()[1:])


def _stream(phrases: DataFrame, backwards: bool, counts: str) -> DataFrame:
    """lang, phrase, f, counts of the parts and the greatest extension, from a walk in prefix or suffix order."""
    words = F.split("phrase", " ", -1)
    # a language is a first word without spaces, and each word ends with a space, so that extensions follow what they extend
    key = F.concat(F.hex(F.encode("lang", "UTF-8")), F.lit(" "), F.array_join(F.reverse(words) if backwards else words, " "), F.lit(" "))
    keyed = phrases.select("lang", "phrase", "f", key.alias("key"))
    ranges = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(keyed, ranges)
    if splitters:
        all_of = F.array(*(F.lit(s) for s in splitters))
        own = F.size(F.filter(all_of, lambda s: s <= F.col("key")))
        # extensions come before the key with its last space raised to the next byte
        last = F.size(F.filter(all_of, lambda s: s < F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("!"))))
        keyed = keyed.withColumn("range", F.explode(F.sequence(own, F.greatest(own, last))))
    else:
        keyed = keyed.withColumn("range", F.lit(0))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("range", "key", "lang", "phrase", "f")))

        def packed(some: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=["lang", "phrase", "f", counts, "extended"])

        some: list[tuple] = []
        for row in walk(rows()):
            if row[3]:
                some.append(row)
            if len(some) == 1 << 14:
                yield packed(some)
                some = []
        if some:
            yield packed(some)

    ordered = keyed.repartitionByRange(ranges, "range").sortWithinPartitions("range", "key")
    return ordered.mapInArrow(walked, f"lang string, phrase string, f long, {counts} array<long>, extended long")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no longer one explains; see collocations().

    An inner phrase of a longer one with the same count also has an extension by one word with that count, so it is enough to
    look at those.
    """
    first, last = _stream(phrases, False, "first"), _stream(phrases, True, "last")
    both = first.withColumn("last", F.lit(None).cast("array<long>")).unionByName(last.withColumn("first", F.lit(None).cast("array<long>")))
    merged = both.groupBy("lang", "phrase").agg(F.max("f").alias("a"), F.max("first").alias("first"), F.max("last").alias("last"), F.max("extended").alias("extended"))
    exact = "decimal(38,0)"
    best = F.expr(f"""
        array_min(transform(sequence(1, size(first)), k -> struct(
            (cast(1000 as {exact}) * cast(a as {exact}) * cast(n as {exact})) div (cast(first[k - 1] as {exact}) * cast(last[size(last) - k] as {exact})) as score,
            k, first[k - 1] as l, last[size(last) - k] as r)))
    """)
    alone = merged.where("extended < a").join(totals, "lang").withColumn("best", best)
    return alone.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, keep: int = KEEP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Texts are lower-cased (A-Z), cut at [.,;:!?] and the bytes 10 to 13, and what is between spaces and tabs is a word. A phrase
    of 2 to longest words counts with a occurrences from least on. Of the cuts into a first part with l and a rest with r
    occurrences the one with the lowest floor(1000 * a * n / (l * r)) gives the score, the earliest of equals; n counts all words of
    the language. Phrases that stand inside a longer one with as many occurrences are left out. Ranks go by score, then a, both
    descending, then by the phrase's bytes.

    Null texts count as empty, a null language as "und"; repeated rows count each; texts are taken whole. Other columns are
    ignored. No rows, or no frequent phrase, give no rows. Counts may have up to 38 digits in products, more are an error.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    phrases, totals = frequent_phrases(docs, least, longest, text, lang)
    rows = cut(scored(phrases, totals), "scored")
    for path in (phrases, totals):
        drop_cut(path)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that a large one is not sorted by one task
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= keep)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
