"""Runs: stretches of words that repeat with a period, found with common extensions over a difference cover.

Periods are tried on a grid: a run of period q and at least POWERS * q words holds POWERS words that are equal, q apart, on
places that are multiples of q. All periods of a text have n/1 + n/2 + ... such places. Where the words are equal, the run is
as long as the common extensions of two neighbouring places reach, forwards and backwards.

A common extension compares words until both places are in the sample; a difference cover makes sure that this happens within
COVER words. From there it is the least common prefix between two sampled suffixes, which are the only ones that are sorted.

A text is worked on inside one task, with about 70 bytes a word beside its words, and only texts with equal words on the grid
are indexed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A difference cover: each number modulo 21 is the difference of two of these.
COVER, SAMPLED = 21, (0, 1, 4, 14, 16)
POWERS = 4  # a run has at least so many periods
SHORTEST = 6  # and so many words
WORDS = 1 << 18  # words of texts that are looked at together; one text may have more
PLACES = 1 << 20  # places of the grid that are looked at together

_sampled = np.zeros(COVER, bool)
_sampled[list(SAMPLED)] = True
_slot = np.cumsum(_sampled) - 1  # number of a sampled place within its COVER words
_ahead = np.array([[next(d for d in range(COVER) if _sampled[(i + d) % COVER] and _sampled[(j + d) % COVER]) for j in range(COVER)] for i in range(COVER)])


class CommonExtensions:
    """Lengths of the longest common prefixes of suffixes of a sequence of numbers, none of them negative; see the module."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        rest = -n % COVER + 2 * COVER
        self.words = np.concatenate([words, -1 - np.arange(rest)])  # different from all others, so nothing extends beyond the end
        places = np.arange(n + rest - COVER)
        self.places = places = places[_sampled[places % COVER]]
        names = [self._first_names(places)]
        step, m = len(SAMPLED), len(places)
        while names[-1].max() < m - 1 and step < m:
            now = names[-1].astype(np.int64)
            later = np.full(m, -1, np.int64)
            later[:-step] = now[step:]
            names.append(np.unique(now * (m + 1) + later + 1, return_inverse=True)[1].astype(np.int32))
            step *= 2
        self.rank = names[-1]
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common, spread = np.zeros(m - 1, np.int64), COVER << (len(names) - 1)
        for known in reversed(names):
            inside = (a < m) & (b < m)
            same = inside.copy()
            same[inside] = known[a[inside]] == known[b[inside]]
            common += same * spread
            a, b = a + same * (spread // COVER * len(SAMPLED)), b + same * (spread // COVER * len(SAMPLED))
            spread //= 2
        common += self._compared(self.places[order[:-1]] + common, self.places[order[1:]] + common, np.full(m - 1, COVER))
        self.table = [common.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= m - 1:
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _first_names(self, places: np.ndarray) -> np.ndarray:
        """Ranks of the sampled suffixes by their first COVER words: those still tied are compared by one word more each time."""
        rank = np.zeros(len(places), np.int64)
        tied = np.arange(len(places))
        low = int(self.words.min())
        wide = int(self.words.max()) - low + 1
        for depth in range(COVER):
            keys = rank[tied] * wide + (self.words[places[tied] + depth] - low)
            order = np.argsort(keys, kind="stable")
            tied, keys = tied[order], keys[order]
            new = np.diff(keys, prepend=-1) != 0
            group = np.diff(rank[tied], prepend=-1) != 0
            # ranks within a group start at the group's own: the number of smaller suffixes
            place = np.arange(len(tied))
            start = place[new][np.cumsum(new) - 1] - place[group][np.cumsum(group) - 1]
            rank[tied] += start
            several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
            tied = tied[several]
            if not len(tied):
                break
        return np.unique(rank, return_inverse=True)[1].astype(np.int32)

    def _compared(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words are equal from two places on, up to a limit."""
        out = np.zeros(len(a), np.int64)
        going = np.flatnonzero(limit > 0)
        while len(going):
            at = out[going]
            going = going[self.words[a[going] + at] == self.words[b[going] + at]]
            out[going] += 1
            going = going[out[going] < limit[going]]
        return out

    def lengths(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of different places, the length of what both have in common from there on."""
        ahead = _ahead[a % COVER, b % COVER]
        out = self._compared(a, b, ahead)
        far = np.flatnonzero(out == ahead)
        x, y = ((p[far] + ahead[far]) // COVER * len(SAMPLED) + _slot[(p[far] + ahead[far]) % COVER] for p in (a, b))
        x, y = self.rank[x], self.rank[y]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[far[at]] += np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out


def _grid(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the grid: (text start + k * q, q), as far as POWERS places follow each other in the text."""
    most = sizes // POWERS  # longest period of each text
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (sizes[text] - 1) // period - POWERS + 2
    text, period, places = text[places > 0], period[places > 0], places[places > 0]
    ends = np.cumsum(places)
    first = 0
    while first < len(text):
        done = ends[first] - places[first]
        last = max(first + 1, int(np.searchsorted(ends, done + PLACES)))
        n = places[first:last]
        own = np.repeat(np.arange(first, last), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q = period[own]
        yield starts[text[own]] + k * q, q
        first = last


def _repeated(words: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grid from where on POWERS equal words follow, a period apart."""
    found = []
    for at, q in _grid(sizes, starts):
        for k in range(POWERS - 1):
            same = words[at + k * q] == words[at + (k + 1) * q]
            at, q = at[same], q[same]
        if len(at):
            found.append((at, q))
    return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, as an array of word numbers, its runs: rows of start, length and least period, in this order."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    if not sizes.sum():
        return out
    at, q = _repeated(np.concatenate(texts), sizes, starts)
    if not len(at):
        return out
    text = np.searchsorted(starts, at, side="right") - 1
    indexed = np.unique(text)
    # the texts with a chance, each between words of their own, so that nothing extends from one into another
    above = 1 + max(int(t.max()) for t in (texts[k] for k in indexed))
    parts, new_start, total = [np.array([above], np.int64)], np.zeros(len(texts), np.int64), 1
    for number, k in enumerate(indexed.tolist()):
        new_start[k] = total
        parts += [texts[k].astype(np.int64), np.array([above + 1 + number], np.int64)]
        total += len(texts[k]) + 1
    line = np.concatenate(parts)
    del parts
    at = at - starts[text] + new_start[text]
    forwards = CommonExtensions(line).lengths(at, at + q)
    backwards = CommonExtensions(line[::-1]).lengths(total - at, total - at - q)
    start, end = at - backwards, at + q + forwards
    long = end - start >= np.maximum(POWERS * q, SHORTEST)
    text, start, end, q = text[long], start[long], end[long], q[long]
    # the same stretch also has the multiples of its least period
    order = np.lexsort((q, end, start))
    text, start, end, q = text[order], start[order], end[order], q[order]
    least = np.ones(len(order), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    text, start, end, q = text[least], start[least], end[least], q[least]
    rows = np.stack([start - new_start[text], end - start, q], axis=1)
    rows, text = rows[np.lexsort((q, start, text))], np.sort(text)
    for k in np.unique(text):
        out[k] = rows[np.searchsorted(text, k) : np.searchsorted(text, k, side="right")]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, without those that a run has after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def _blocks(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    block, held = [], 0
    for text in texts:
        block.append(text.split())
        held += len(block[-1])
        if held >= WORDS:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """Replace the text column by the runs of its words and by the text without their repetitions.

    Words are what stands between spaces and the bytes 9 to 13; they are compared byte by byte. Runs are in the order of
    start and period and may overlap. Null counts as empty; it and blank texts have no runs and an empty collapsed text.
    Texts are taken whole, however long. Every row stays, repeated ones too; other columns stay as they are, but those that are
    named like the outputs are replaced. No rows give no rows.
    """
    new = [T.StructField(runs_col, RUNS), T.StructField(collapsed_col, T.StringType())]
    names = {f.name.lower() for f in new}
    rows = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in names or c == text_col))
    staying = [f for f in rows.schema if f.name.lower() not in names and f.name != text_col]
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            texts = batch.column(text_col).cast(pa.binary())
            for block in _blocks([t.as_py() or b"" for t in texts]):
                number: dict[bytes, int] = defaultdict(count().__next__)
                found = runs_of([np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for words in block])
                del number
                part = batch.slice(first, len(block))
                first += len(block)
                ends = np.append(0, np.cumsum([len(r) for r in found])).astype(np.int32)
                flat = np.concatenate(found)
                values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                made = [pa.ListArray.from_arrays(pa.array(ends), values).cast(kind), pa.array([collapsed(w, r) for w, r in zip(block, found)], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in staying] + made, names=[f.name for f in [*staying, *new]])

    return rows.mapInArrow(run, T.StructType([*staying, *new]))


def best_run(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equals the one that starts first, then the least period. Null without runs."""
    return F.reduce(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, run: F.when(
            (run["length"] * best["period"] > best["length"] * run["period"])
            | ((run["length"] * best["period"] == best["length"] * run["period"]) & ((run["start"] < best["start"]) | ((run["start"] == best["start"]) & (run["period"] < best["period"])))),
            run,
        ).otherwise(best),
    )
