"""BPE with word ends: encoding by an index of pair occurrences, and decoding.

The new words of a block of texts are laid out as one chain of symbols. Each pair that has a merge is indexed under its rank
with all its positions. Active ranks are applied in ascending order, each at all its positions from left to right, and the
lists of the pairs that a merge makes are extended. That is the order in which a single word would be merged, because a pair
never merges earlier than the pairs that build its halves; a model for which this does not hold is refused.

Texts are cut at white space, which no token crosses, and the ids of a cut are remembered, so only new ones are merged.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEPT = 200_000  # remembered cuts and words of a Python worker, about 40 MB each; as many of the time before are still at hand
LONGEST_KEPT = 48
BYTES = 16 << 20  # of texts whose new words are merged together; one text may be longer
ROWS = 512  # texts whose ids are Python objects at once
SYMBOLS = 4 << 20  # of the words that are merged at once; one word may be longer

OVERLAY = "\u0334"  # a mark of the lowest class: normalisation puts it before all others

#: The settings of a model file that this codec reproduces.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


@dataclass
class Vocabulary:
    """What the codec needs of a model: plain data, bounded by the vocabulary, so it can be broadcast."""

    tokens: list[str | None]  # by id
    first: list[int]  # id of each byte inside a word
    last: list[int]  # and at its end
    merges: dict[int, tuple[int, int]]  # left id << 32 | right id: rank, id of both
    specials: dict[str, int]
    letters: str  # character classes as the library has them, as ranges
    numbers: str
    spaces: str
    lower: dict[int, str]  # code points that the library lower-cases otherwise than Python
    fixed: str  # marks that the library's normalisation does not move


def faults_of(model: dict) -> list[str]:
    """Why this codec cannot reproduce a model; empty if it can."""
    bpe, pre, norm = model.get("model") or {}, model.get("pre_tokenizer") or {}, model.get("normalizer") or {}
    checks = {
        "it is no BPE": bpe.get("type") != "BPE",
        "words have no end mark": not bpe.get("end_of_word_suffix"),
        "pieces inside words are marked": bool(bpe.get("continuing_subword_prefix")),
        "merges are dropped at random": bool(bpe.get("dropout")),
        "it has a token for the unknown": bpe.get("unk_token") is not None or bool(bpe.get("byte_fallback")),
        "whole words skip the merges": bool(bpe.get("ignore_merges")),
        "texts are normalised otherwise": norm.get("normalizers") != NORMALIZERS,
        "words are cut otherwise": pre.get("pretokenizers") != PRETOKENIZERS,
        "it has a decoder": model.get("decoder") is not None,
        "added tokens have conditions": any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in model.get("added_tokens", [])),
    }
    return [k for k, v in checks.items() if v]


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next free one from U+0100 on."""
    free, out = 256, []
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD
        out.append(chr(b if shown else free))
        free += not shown
    return out


def _ranges(members: list[str]) -> str:
    """A character class of sorted single characters, without its brackets."""
    codes = np.array([ord(c) for c in members])
    edges = np.flatnonzero(np.diff(codes) != 1)
    firsts, lasts = codes[np.append(0, edges + 1)], codes[np.append(edges, len(codes) - 1)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts.tolist(), lasts.tolist()))


def load_vocabulary(model_file: str) -> Vocabulary:
    """Read a model on the driver; classes of characters are asked of the library, whose Unicode version may be another than Python's.

    Raises ValueError for a model that this codec would encode differently.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    with open(model_file, encoding="utf-8") as file:
        model = json.load(file)
    if faults := faults_of(model):
        raise ValueError("this codec cannot reproduce the model: " + "; ".join(faults))
    bpe, ids = model["model"], model["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
    made = {a + b: r for r, (a, b) in enumerate(pairs)}
    if len(made) < len(pairs) or any(made.get(half, -1) > r for r, pair in enumerate(pairs) for half in pair):
        raise ValueError("this codec cannot reproduce the model: a pair merges before its halves are built")
    merges = {ids[a] << 32 | ids[b]: (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}
    specials = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    tokens: list[str | None] = [None] * (1 + max([*ids.values(), *specials.values()]))
    for token, i in chain(ids.items(), specials.items()):
        tokens[i] = token
    marks, end = byte_characters(), bpe["end_of_word_suffix"]
    all_of = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    members = {kind: _ranges([c for c, _ in pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(all_of)]) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    lowered, composed = normalizers.Lowercase(), normalizers.NFC()
    odd = [c for c in all_of if unicodedata.category(c) in ("Cn", "Lu", "Lt")]
    lower = {ord(c): low for c in odd if (low := lowered.normalize_str(c)) != c.lower()} | {ord("Σ"): "σ"}  # Python has a rule for a last sigma
    fixed = "".join(c for c in all_of if unicodedata.combining(c) > 1 and composed.normalize_str(f"1{c}{OVERLAY}") != unicodedata.normalize("NFC", f"1{c}{OVERLAY}"))
    return Vocabulary(tokens, [ids[m] for m in marks], [ids[m + end] for m in marks], merges, specials, members[r"\p{L}"], members[r"\p{N}"], members[r"\s"], lower, fixed)


class Merges:
    """The pairs that merge, for lookups of many at once."""

    def __init__(self, v: Vocabulary):
        self.keys = np.array(sorted(v.merges), np.int64)
        self.ranks, self.whole = (np.array([v.merges[k][n] for k in self.keys.tolist()], np.int32) for n in (0, 1))
        by_rank = np.argsort(self.ranks)
        self.left_of, self.right_of = ((self.keys[by_rank] >> 32).tolist(), (self.keys[by_rank] & 0xFFFFFFFF).tolist())
        self.whole_of = self.whole[by_rank].tolist()
        self.first, self.last = np.array(v.first, np.int32), np.array(v.last, np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; -1 where nothing merges."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], -1)


def merge_all(words: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of some words, as little-endian 32-bit integers, merged together through one index of pair occurrences."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(words), np.uint8)
    n = len(text)
    symbol = merges.first[text]
    symbol[ends - 1] = merges.last[text[ends - 1]]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1], before[ends - sizes] = -1, -1
    starts = np.flatnonzero(after >= 0)
    ranks = merges.ranks_of(symbol[starts], symbol[starts + 1])
    starts, ranks = starts[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    starts, ranks = starts[order], ranks[order]
    heads = np.flatnonzero(np.diff(ranks, prepend=-1))
    tails = np.append(heads[1:], len(ranks)).tolist()
    spans = dict(zip(ranks[heads].tolist(), zip(heads.tolist(), tails)))
    active = list(spans)  # ascending, so it is a heap
    added: dict[int, list[int]] = {}  # positions of pairs that merges have made
    while active:
        rank = heapq.heappop(active)
        left, right, whole = merges.left_of[rank], merges.right_of[rank], merges.whole_of[rank]
        low, high = spans.get(rank, (0, 0))
        at = starts[low:high]
        if rank in added:
            at = np.unique(np.append(at, added.pop(rank)))
        second = after[at]
        alive = (symbol[at] == left) & (second >= 0) & (symbol[second] == right)  # the others have merged with a neighbour
        at, second = at[alive], second[alive]
        if left == right and len(at) > 1:
            taken, free = [], -1
            for a, b in zip(at.tolist(), second.tolist()):
                if a != free:
                    taken.append(a)
                    free = b
            at = np.array(taken)
            second = after[at]
        if not len(at):
            continue
        third = after[second]
        symbol[at], symbol[second], after[at] = whole, -1, third
        inner = third >= 0
        before[third[inner]] = at[inner]
        first = before[at]
        outer = first >= 0
        pairs = np.append(at[inner], first[outer])
        found = merges.ranks_of(symbol[pairs], symbol[after[pairs]])
        for r, a in zip(found.tolist(), pairs.tolist()):
            if r >= 0:
                if r in added:
                    added[r].append(a)
                else:
                    added[r] = [a]
                    if r not in spans:
                        heapq.heappush(active, r)
    kept = symbol >= 0
    ids, edges = symbol[kept].tobytes(), np.append(0, np.cumsum(kept)[ends - 1] * 4).tolist()
    return [ids[a:b] for a, b in zip(edges, edges[1:])]


class Memory:
    """Ids of texts that were seen lately: two generations, of which the older one goes when the newer is full."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> set[str]:
        """What is in neither generation; what is in the older one comes into the newer."""
        if len(self.new) > KEPT:
            self.new, self.old = {}, self.new
        wanted = wanted.difference(self.new)
        self.new.update((w, self.old[w]) for w in wanted if w in self.old)
        return wanted.difference(self.new)


class Codec:
    """Encoder and decoder over a vocabulary; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.merges = Merges(v)
        self.words = re.compile(WORDS.replace(r"[\p{L}]", rf"[{v.letters}]").replace(r"[\p{N}]", rf"[{v.numbers}]").replace(r"[^\s\p{L}\p{N}]", rf"[^{v.spaces}{v.letters}{v.numbers}]"))
        self.gaps = re.compile(f"[{v.spaces}]+")
        self.no_gaps = [chr(c) for c in range(0x10000) if chr(c).isspace() and not self.gaps.match(chr(c))]
        self.special = re.compile("|".join(map(re.escape, sorted(v.specials, key=len, reverse=True)))) if v.specials else None
        self.fixed = re.compile(f"([{''.join(map(re.escape, v.fixed))}])") if v.fixed else None
        self.cuts, self.known = Memory(), Memory()

    def _cut(self, text: str) -> list[str]:
        """Text without white space, in order; special tokens stand alone."""
        if any(s in text for s in self.v.specials):
            out, at = [], 0
            for found in self.special.finditer(text):
                out += [*self._plain(text[at : found.start()]), found.group()]
                at = found.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if any(c in text for c in self.no_gaps):
            return [c for c in self.gaps.split(text) if c]
        return text.split()

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        parts = self.fixed.split(text) if self.fixed else [text]
        return "".join([unicodedata.normalize("NFC", p) for p in parts]).translate(self.v.lower).lower()

    def _words(self, cut: str) -> list[str]:
        """The words of a text without white space."""
        return [cut.lower()] if cut.isascii() and cut.isalpha() else self.words.findall(self._normal(cut))

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of cuts; words that have not been seen are merged together."""
        specials = self.v.specials
        parts = {cut: self._words(cut) for cut in new if cut not in specials}
        ids_of = {}
        here = set(chain.from_iterable(parts.values()))
        unseen = self.known.missing(here)
        block, held = [], 0
        for k, word in enumerate(unseen):
            block.append(word)
            held += len(word)
            if held >= SYMBOLS or k + 1 == len(unseen):
                ids_of.update(zip(block, merge_all([w.encode() for w in block], self.merges)))
                block, held = [], 0
        self.known.new.update((w, ids) for w, ids in ids_of.items() if len(w) <= LONGEST_KEPT)
        ids_of.update((w, self.known.new[w]) for w in here if w not in ids_of)
        out = {cut: ids_of[words[0]] if len(words) == 1 else b"".join([ids_of[w] for w in words]) for cut, words in parts.items()}
        return out | {cut: array("i", [specials[cut]]).tobytes() for cut in new if cut in specials}

    def encode(self, blocks: Iterable[list[str]]) -> Iterator[list[bytes]]:
        """Ids of each text of some blocks, as little-endian 32-bit integers. What is new in all blocks is merged together."""
        wanted: set[str] = set()
        blocks = list(blocks)
        for texts in blocks:
            for text in texts:
                wanted.update(self._cut(text))
        learnt = self._learn(self.cuts.missing(wanted))
        self.cuts.new.update(learnt)
        get = self.cuts.new.__getitem__
        for texts in blocks:
            yield [b"".join(map(get, self._cut(t))) for t in texts]
        for c in learnt:
            if len(c) > LONGEST_KEPT:
                del self.cuts.new[c]

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by a space; ids beyond the vocabulary give nothing."""
        try:
            if min(ids, default=0) >= 0:
                return " ".join(map(self.v.tokens.__getitem__, ids))
        except (IndexError, TypeError):
            pass
        n = len(self.v.tokens)
        return " ".join(t for i in ids if i is not None and 0 <= i < n and (t := self.v.tokens[i]) is not None)


_codecs: dict[str, object] = {}


def _codec(shared) -> Codec:
    """The worker's codec for a broadcast vocabulary; it and its memory live as long as the Python worker."""
    if shared.value is not _codecs.get("of"):
        _codecs.clear()
        _codecs["of"] = shared.value
        _codecs["codec"] = Codec(shared.value)
    return _codecs["codec"]


def share_vocabulary(spark: SparkSession, model_file: str):
    """Broadcast of a model's vocabulary: bounded by the model, read on the driver, so executors need no file."""
    return spark.sparkContext.broadcast(load_vocabulary(model_file))


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about BYTES of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(lengths, dtype=np.int64) // BYTES
    edges = np.flatnonzero(np.diff(place, prepend=-1))
    for first, last in zip(edges, np.append(edges[1:], batch.num_rows)):
        yield batch.slice(first, last - first)


def _id_lists(encoded: list[bytes]) -> pa.ListArray:
    ends = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def _mapped(rows: DataFrame, model_file: str, old: str, gone: list[str], new: list[T.StructField], convert: Callable[[Codec, pa.RecordBatch], Iterator[list[pa.Array]]]) -> DataFrame:
    """Rows with new columns made of an old one, a few hundred rows at a time; gone columns leave, columns named like new ones are replaced."""
    shared = share_vocabulary(rows.sparkSession, model_file)
    names = {f.name.lower() for f in new}
    rows = rows.select(*(f"`{c}`" for c in rows.columns if c.lower() not in names or c == old))
    staying = [f for f in rows.schema if f.name.lower() not in names and f.name not in gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            first = 0
            for made in convert(codec, batch):
                part = batch.slice(first, len(made[0]))
                first += len(made[0])
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in staying] + made, names=[f.name for f in [*staying, *new]])

    return rows.mapInArrow(run, T.StructType([*staying, *new]))


def _encoded(codec: Codec, batch: pa.RecordBatch, column: str) -> Iterator[list[bytes]]:
    for block in _blocks(batch, column):
        slices = [block.column(column).slice(k, ROWS) for k in range(0, block.num_rows, ROWS)]
        yield from codec.encode([[t or "" for t in s.to_pylist()] for s in slices])


def encode_texts(docs: DataFrame, model_file: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Replace the text column by its ids, an array of integers.

    Null counts as empty and has no ids; so has a text of white space. Texts are encoded whole, however long. Every row stays,
    repeated ones too; other columns stay as they are, but one that is named like the output is replaced. No rows give no rows.
    """
    new = [T.StructField(out_col, T.ArrayType(T.IntegerType()))]
    return _mapped(docs, model_file, text_col, [text_col], new, lambda codec, batch: ([_id_lists(e)] for e in _encoded(codec, batch, text_col)))


def decode_ids(encoded: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of the ids: tokens joined by a space. Null ids give null, no ids an empty text; null ids inside and ids beyond the vocabulary give nothing.

    Other columns stay as they are, but one that is named like the output is replaced. No rows give no rows.
    """

    def decoded(codec: Codec, batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for first in range(0, batch.num_rows, ROWS):
            yield [pa.array([None if i is None else codec.decode(i) for i in batch.column(ids_col).slice(first, ROWS).to_pylist()], pa.string())]

    return _mapped(encoded, model_file, ids_col, [], [T.StructField(out_col, T.StringType())], decoded)


def encode_and_decode(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encode_texts() and decode_ids() of the result, in one pass and one Python worker."""

    def both(codec: Codec, batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for encoded in _encoded(codec, batch, text_col):
            yield [_id_lists(encoded), pa.array([codec.decode(memoryview(e).cast("i").tolist()) for e in encoded], pa.string())]

    return _mapped(docs, model_file, text_col, [text_col], [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(out_col, T.StringType())], both)
