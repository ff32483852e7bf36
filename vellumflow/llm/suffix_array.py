"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy (inside tasks).

Suffixes are S (smaller than the next) or L. The leftmost S of every run, LMS, carry all order: their substrings are sorted
by inducing from their first bytes, get names, and the string of names is sorted in its turn (where only a certain depth
matters: they are sorted by words of eight bytes, ties recursively by the next); the order of the LMS suffixes then induces that of all L suffixes, bucket by bucket upwards, and of all S suffixes, downwards. Within a bucket
the scan is vectorised: what a bucket induces into itself comes in waves, as long as a run of one byte.
"""

from __future__ import annotations

import numpy as np

from vellumflow.llm.wordhash import byte_sums, span_hashes


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The end of the text counts as smaller than all bytes, so the last suffix is L."""
    n = len(text)
    differs = np.full(n, n, np.int64)
    if n > 1:
        at = np.flatnonzero(text[:-1] != text[1:])
        differs[at] = at
    follows = np.minimum.accumulate(differs[::-1])[::-1]
    rises = np.zeros(n + 1, bool)
    if n > 1:
        rises[: n - 1] = text[:-1] < text[1:]
    return rises[follows]


def _deal(items: np.ndarray, keys: np.ndarray, to: list[list[np.ndarray]]) -> None:
    """Append items to the lists of their keys, keeping their order."""
    if not len(items):
        return
    order = np.argsort(keys, kind="stable")
    items, keys = items[order], keys[order]
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    first = 0
    for last in [*cuts.tolist(), len(items)]:
        to[keys[first]].append(items[first:last])
        first = last


def _gather(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _waves(start: np.ndarray, text: np.ndarray, c: int) -> np.ndarray:
    """The suffixes given, and then whatever they induce into their own bucket, in the order of the scan."""
    waves, wave = [start], start
    while len(wave):
        wave = wave[wave > 0] - 1
        wave = wave[text[wave] == c]
        if len(wave):
            waves.append(wave)
    return _gather(waves)


def induce(text: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in an order: sorted wherever that is."""
    n = len(text)
    starts: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(lms, text[lms], starts)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[text[n - 1]].append(np.array([n - 1], np.int32))
    sides: list[np.ndarray] = []
    for c in range(256):
        bucket = _waves(_gather(larger[c]), text, c)
        sides.append(bucket)
        seen = _gather([bucket, *starts[c]])
        before = seen[seen > 0] - 1
        keys = text[before]
        up = keys > c
        _deal(before[up], keys[up], larger)
        larger[c] = []
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(255, -1, -1):
        bucket = _waves(_gather(smaller[c]), text, c)
        out += [bucket[::-1], sides[c]]
        seen = np.concatenate([bucket, sides[c][::-1]])
        before = seen[seen > 0] - 1
        keys = text[before]
        down = keys < c
        _deal(before[down], keys[down], smaller)
        smaller[c] = []
    return np.concatenate(out[::-1])


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling; only what is not yet apart is sorted again."""
    m = len(names)
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        heads = np.ones(m, bool)
        heads[1:] = sorted_rank[1:] != sorted_rank[:-1]
        rank[order] = np.flatnonzero(heads)[np.cumsum(heads) - 1]
        tied = ~heads
        tied[:-1] |= ~heads[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            return order
        at = order[tied]
        beyond = at + step
        second = np.where(beyond < m, rank[np.minimum(beyond, m - 1)] + 1, 0)
        again = np.lexsort((second, rank[at]))
        order[tied] = at[again]
        # new ranks: by both halves
        first, second = rank[at[again]], second[again]
        change = np.ones(len(tied), bool)
        change[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        fresh = tied[np.flatnonzero(change)[np.cumsum(change) - 1]]
        rank[order[tied]] = fresh
        step *= 2


def unaligned_words(text: np.ndarray, beyond: int) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers without a copy; zeros follow the text for so many bytes."""
    padded = np.zeros((len(text) + beyond + 23) // 8 * 8, np.uint8)
    padded[: len(text)] = text
    return np.lib.stride_tricks.as_strided(padded.view("<u8"), shape=(len(padded) - 8,), strides=(1,))


def _sort_to_depth(text: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """LMS suffixes by their first bytes, depth of them at least: sorted by a word, and groups that tie on it, recursively, by the next."""
    words = unaligned_words(text, depth + 8)
    key = words[lms].byteswap()
    order = np.argsort(key)
    out, key = lms[order], key[order]
    same = np.zeros(len(out), bool)
    same[1:] = key[1:] == key[:-1]
    for shift in range(8, depth, 8):
        inside = same.copy()
        inside[:-1] |= same[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        group = np.cumsum(~same[at])
        key = words[out[at] + shift].byteswap()
        order = np.argsort(key)
        order = order[np.argsort(group[order], kind="stable")]
        out[at] = out[at[order]]
        key = key[order]
        tie = np.zeros(len(at), bool)
        tie[1:] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        same[at] = tie
    return out


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes of a byte array (shorter than 2^31), in order; with a depth, in the order of that many bytes at least."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = suffix_types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) < 2:
        return induce(text, lms)
    if depth is not None:
        return induce(text, _sort_to_depth(text, lms, depth))
    rough = induce(text, lms)
    place = np.zeros(n, bool)
    place[lms] = True
    rough = rough[place[rough]]
    # names: equal LMS substrings (up to the next LMS start, included) stand side by side
    number = np.zeros(n, np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    ends = np.append(lms[1:].astype(np.int64) + 1, n)
    hashes = span_hashes(byte_sums(text), lms.astype(np.int64), ends)
    hashes[-1] ^= np.uint64(1)  # the last one ends with the text, like no other
    ranked = hashes[number[rough]]
    names = np.empty(len(lms), np.int64)
    names[number[rough]] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    if names[number[rough[-1]]] + 1 == len(lms):
        return induce(text, rough)
    return induce(text, lms[_sort_names(names)])


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For the suffixes in order: common bytes with the suffix before (0 for the first), up to most.

    Compared in the order of the text, where one side of each comparison is read in sequence, eight bytes at a time.
    """
    m = len(order)
    out = np.zeros(m, np.int32)
    if m < 2:
        return out
    words = unaligned_words(text, most + 8)
    by_text = np.argsort(order[1:], kind="stable")
    here, there = order[1:][by_text].astype(np.int64), order[:-1][by_text].astype(np.int64)
    common = np.zeros(m - 1, np.int32)
    active = np.arange(m - 1)
    for shift in range(0, most, 8):
        unlike = words[here[active] + shift] ^ words[there[active] + shift]
        same = unlike == 0
        stopped = active[~same]
        low = unlike[~same]
        low &= ~low + np.uint64(1)  # the lowest set bit tells the first byte that differs
        common[stopped] = shift + (np.log2(low.astype(np.float64)).astype(np.int32) >> 3)
        active = active[same]
        common[active] = shift + 8
    common = np.minimum(common, np.minimum(most, len(text) - np.maximum(here, there)).astype(np.int32))
    out[1:][by_text] = common
    return out
