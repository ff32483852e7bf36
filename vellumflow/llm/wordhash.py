"""Vectorised hashes of words and shingles over batches of texts (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20  # bytes of text handled at once
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser, so that all bits of a hash depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hashes() takes the hash of any span of the bytes."""
    up, _ = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, the same for equal bytes wherever they stand."""
    _, down = _tables(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text) + 1
        if held >= size:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the table marks."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[data]
    edges = np.diff(flags)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space after each, and where each begins (one more: the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


#: Bytes of words: all but space and the bytes 9 to 13.
WORD_BYTES = np.ones(256, np.int8)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = 0
#: Bytes of letters: ASCII letters and whatever is not ASCII.
LETTER_BYTES = np.zeros(256, np.int8)
LETTER_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_hashes(texts: list[bytes], inside: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, A-Z lower-cased, and the offsets of each text's words among them."""
    data, starts = joined(texts)
    data = LOWER[data]
    begin, end = word_spans(data, inside)
    return span_hashes(byte_sums(data), begin, end), np.searchsorted(begin, starts)


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; of fewer words, the whole sequence; of none, nothing."""
    up, _ = _tables(k + 2)
    for first, last in chunks(texts):
        words, offsets = word_hashes(texts[first:last])
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            rolled += words[j : len(words) - k + 1 + j] * up[j + 1]
        rolled = mixed(rolled)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    short = mixed(short + words[j : j + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)
