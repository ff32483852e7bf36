"""SentencePiece BPE: encoding by a table of last tokens, and decoding.

For each prefix of a word exactly one token can be the last one of its encoding. An automaton lists the pieces that end at
a position; the right one is the piece that may stand beside the last token of the prefix before it. Whether two tokens
may stand side by side is read off their merge trees. The ids are then recovered from the end backwards, so the time is
linear in the text and no merge queue is needed.

No piece has a space mark after another character, so texts are cut before runs of space marks, and the encoding of a
word is remembered. Runs of space marks merge last and from the left, which a greedy count gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MARK = "▁"
NEVER = float("inf")
WORDS_KEPT = 120_000  # remembered words of a Python worker, about 30 MB; as many of the time before are still at hand
PAIRS_KEPT = 150_000  # token pairs, about 20 MB
LONGEST_KEPT = 48
ROWS = 256  # texts that are turned into Python objects at once


@dataclass
class Vocabulary:
    """What the codec needs of a model: plain data, bounded by the vocabulary, so it can be broadcast."""

    pieces: dict[str, int]  # normal pieces
    ranks: dict[str, int]  # merge order of a piece: 0 merges first; equal scores share a rank
    bytes_at: list[int]  # id of each byte's piece
    controls: frozenset[int]
    unknown: int
    bos: int
    eos: int
    dummy_prefix: bool = True
    spines: dict[int, tuple[list, list]] = field(default_factory=dict)  # id: left spine, right spine as (piece, born)


#: Numbers of the fields of the model file's messages, and of the kinds that it uses.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_KIND, USER_DEFINED = 3, 4
MODEL_TYPE, BPE, SUFFIX_SPACE, BYTE_FALLBACK = 3, 2, 24, 35
CHARSMAP, DUMMY_PREFIX, FEWER_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    at = 0
    while at < len(data):
        key = number()
        kind, size = key & 7, 0
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


def check_settings(proto: bytes) -> bool:
    """Whether a model puts a space before texts; ValueError if it is none that the codec reproduces.

    That is BPE with byte pieces for unknown characters, no pieces defined by the user, no normalisation of characters or
    spaces, and spaces marked in front of words.
    """
    top = list(_fields(proto))
    trainer, normalizer = (dict(_fields(next((v for f, v in top if f == part), b""))) for part in (TRAINER, NORMALIZER))
    faults = {
        "the model is not of the BPE kind": trainer.get(MODEL_TYPE, 1) != BPE,
        "it has no byte fallback": not trainer.get(BYTE_FALLBACK, 0),
        "it marks spaces behind words": bool(trainer.get(SUFFIX_SPACE, 0)),
        "it normalises characters": bool(normalizer.get(CHARSMAP, b"")),
        "it removes spaces": bool(normalizer.get(FEWER_SPACES, 1)),
        "it does not mark spaces": not normalizer.get(ESCAPE_SPACES, 1),
        "it has pieces defined by the user": any(dict(_fields(v)).get(PIECE_KIND) == USER_DEFINED for f, v in top if f == PIECES),
    }
    if any(faults.values()):
        raise ValueError("this codec cannot reproduce the model: " + "; ".join(k for k, v in faults.items() if v))
    return bool(normalizer.get(DUMMY_PREFIX, 1))


def load_vocabulary(model_file: str) -> Vocabulary:
    """Read a model's pieces and scores through the library, and build the merge trees. Runs once, on the driver.

    Raises ValueError for models that this codec would encode differently: see check_settings().
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    dummy_prefix = check_settings(model.serialized_model_proto())
    ids = range(model.get_piece_size())
    kinds = {i: "byte" if model.is_byte(i) else "control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "piece" for i in ids}
    pieces = {model.id_to_piece(i): i for i in ids if kinds[i] == "piece"}
    order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in ids if kinds[i] == "piece"}, reverse=True))}
    ranks = {p: order[model.get_score(i)] for p, i in pieces.items()}
    bytes_at = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    vocabulary = Vocabulary(pieces, ranks, bytes_at, frozenset(i for i in ids if kinds[i] == "control"), model.unk_id(), model.bos_id(), model.eos_id(), dummy_prefix)
    trees: dict[str, tuple[str, str]] = {}
    for piece in pieces:
        merge(piece, ranks, trees)
    for piece, i in pieces.items():
        if len(piece) == 1 or piece in trees:
            vocabulary.spines[i] = (_spine(piece, trees, ranks, 0), _spine(piece, trees, ranks, 1))
    return vocabulary


def merge(text: str, ranks: dict[str, int], trees: dict[str, tuple[str, str]] | None = None) -> list[str]:
    """Plain merging of a short text, best pair first and leftmost of equals; notes how the whole text was put together."""
    parts = list(text)
    while len(parts) > 1:
        best = min(((ranks.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == NEVER:
            break
        k = best[1]
        if trees is not None and len(parts) == 2:
            trees[text] = (parts[0], parts[1])
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def _spine(piece: str, trees: dict[str, tuple[str, str]], ranks: dict[str, int], side: int) -> list[tuple[str, float, float]]:
    """A token's outermost pieces on one side, from the whole down to a character, each with the ranks at which it is born and is merged on."""
    out, dies = [], NEVER
    while True:
        born = ranks[piece] if len(piece) > 1 else -1
        out.append((piece, born, dies))
        if len(piece) == 1:
            return out
        dies, piece = born, trees[piece][side]


class Codec:
    """Encoder and decoder over a vocabulary; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, i in vocabulary.pieces.items():
            if i in vocabulary.spines and not (len(piece) > 1 and piece.strip(MARK) == ""):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.known = {p for p in vocabulary.pieces if len(p) == 1}
        self.lengths = {i: len(p) for p, i in vocabulary.pieces.items()}
        self.marks = [vocabulary.pieces.get(MARK * k) for k in range(0, 1 + max((len(p) for p in vocabulary.pieces if p.strip(MARK) == ""), default=1))]
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        self.text_of = {i: p.replace(MARK, " ").encode() for p, i in vocabulary.pieces.items()} | {i: b"" for i in vocabulary.controls} | {vocabulary.unknown: " ⁇ ".encode()}
        self.byte_of = {i: bytes([b]) for b, i in enumerate(vocabulary.bytes_at)}
        self.plain = self.text_of | self.byte_of

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b gives a and b: no merge across their border ever comes before the merges that build them."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self._apart(self.v.spines[a][1], self.v.spines[b][0])
        return found

    def _apart(self, right: list, left: list) -> bool:
        i = j = 0
        while True:
            (x, x_born, x_dies), (y, y_born, y_dies) = right[i], left[j]
            across = self.v.ranks.get(x + y, NEVER)
            # of equal ranks the leftmost merge goes first: inside a, then across, then inside b
            if across < x_dies and across <= y_dies and across != NEVER:
                return False
            if x_born < 0 and y_born < 0:
                return True
            if y_born >= x_born:  # the last merge, undone
                j += 1
            else:
                i += 1

    def _known(self, word: str) -> list[int]:
        """Ids of a text whose characters are all pieces, without a space mark after the first character."""
        last, known = [-1] * (len(word) + 1), self.pairs.get
        for end, (token, length) in self.automaton.iter(word):
            if last[end + 1] < 0:
                start = end + 1 - length
                if start:
                    before = last[start]
                    fits = known(before << 32 | token)
                    if not (self.compatible(before, token) if fits is None else fits):
                        continue
                last[end + 1] = token
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= self.lengths[last[end]]
        out.reverse()
        return out

    def _word(self, word: str) -> bytes:
        bare = word.lstrip(MARK)
        marks = len(word) - len(bare)
        ids: list[int] = []
        if bare and marks and bare[0] in self.known:
            bare, marks = MARK + bare, marks - 1
        if self.known.issuperset(bare):
            ids = self._known(bare) if bare else []
        else:
            run = ""
            for c in [*bare, ""]:
                if c and c in self.known:
                    run += c
                    continue
                ids += self._known(run) if run else []
                ids += [self.v.bytes_at[b] for b in c.encode("utf-8", "replace")]
                run = ""
        if marks and ids and bare and bare[0] == MARK and ids[0] == self.marks[1]:
            marks, ids = marks + 1, ids[1:]
        front = []
        while marks:
            k = min(marks, len(self.marks) - 1)
            while self.marks[k] is None:
                k -= 1
            front.append(self.marks[k])
            marks -= k
        return b"".join(i.to_bytes(4, "little") for i in front + ids)

    _cut = re.compile(f"{MARK}+[^{MARK}\\n]*|\\n+|[^{MARK}\\n]+")

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words, get = self.words, self.words.get
        out = [self.v.bos.to_bytes(4, "little")] if bos else []
        if text:
            marked = (MARK if self.v.dummy_prefix else "") + text.replace(" ", MARK)
            for word in self._cut.findall(marked):
                ids = get(word)
                if ids is None:
                    ids = self.words_before.get(word) or self._word(word)
                    if len(word) <= LONGEST_KEPT:
                        if len(words) >= WORDS_KEPT:
                            self.words_before = words
                            self.words = words = {}
                            get = words.get
                        words[word] = ids
                out.append(ids)
        if eos:
            out.append(self.v.eos.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: controls vanish, the space of the first piece is the dummy prefix, bytes that are no UTF-8 become U+FFFD, ids beyond the vocabulary give nothing."""
        try:
            if not self.v.controls.isdisjoint(ids[1:-1]):
                raise UnicodeError("a control ends a run of bytes")
            text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8")
        except (UnicodeError, KeyError):
            text, run = "", b""
            for i in [*ids, -1]:
                if i in self.byte_of:
                    run += self.byte_of[i]
                else:
                    text += _lenient(run) + self.text_of.get(i, b"").decode()
                    run = b""
        first = next((i for i in ids if i not in self.v.controls), None)
        return text[1:] if self.v.dummy_prefix and first is not None and self.text_of.get(first, b"")[:1] == b" " and first != self.v.unknown else text


def _lenient(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    out = ""
    while data:
        for n in range(1, min(4, len(data)) + 1):
            try:
                out += data[:n].decode("utf-8")
            except UnicodeDecodeError:
                continue
            data = data[n:]
            break
        else:
            out, data = out + "�", data[1:]
    return out


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


def _mapped(rows: DataFrame, model_file: str, old: str, gone: list[str], new: list[T.StructField], convert: Callable[[Codec, object], tuple]) -> DataFrame:
    """Rows with new columns made of the values of an old one, a few hundred rows at a time; gone columns leave."""
    shared = share_vocabulary(rows.sparkSession, model_file)
    names = {f.name for f in new}
    rows = rows.select(*(c for c in rows.columns if c not in names or c == old))  # columns named like the new ones are replaced
    staying = [f for f in rows.schema if f.name not in names and f.name not in gone]
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                made = zip(*(convert(codec, v) for v in part.column(old).to_pylist()))
                columns = [part.column(f.name) for f in staying] + [pa.array(c, k) for c, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in [*staying, *new]])

    return rows.mapInArrow(run, T.StructType([*staying, *new]))


def _decoded(codec: Codec, ids: bytes | None) -> str | None:
    return None if ids is None else codec.decode(memoryview(ids)[: len(ids) // 4 * 4].cast("I").tolist())


def encode_texts(docs: DataFrame, model_file: str, text_col: str = "text", out_col: str = "ids", bos: bool = True, eos: bool = True) -> DataFrame:
    """Replace the text column by its ids, as binary little-endian unsigned 32-bit integers.

    Null counts as empty. Texts are encoded whole, however long. Every row stays, repeated ones too; other columns stay as
    they are, but one that is named like the output is replaced. No rows give no rows.
    """
    return _mapped(docs, model_file, text_col, [text_col], [T.StructField(out_col, T.BinaryType())], lambda codec, t: (codec.encode(t or "", bos, eos),))


def decode_ids(encoded: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Add the text of the ids. Null ids give null, no ids an empty text; bytes behind the last whole id and ids beyond the vocabulary give nothing.

    Other columns stay as they are, but one that is named like the output is replaced. No rows give no rows.
    """
    return _mapped(encoded, model_file, ids_col, [], [T.StructField(out_col, T.StringType())], lambda codec, ids: (_decoded(codec, ids),))


def encode_and_decode(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encode_texts() with begin and end ids and decode_ids() of the result, in one pass and one Python worker."""

    def both(codec: Codec, text: str | None) -> tuple:
        ids = codec.encode(text or "")
        return ids, _decoded(codec, ids)

    return _mapped(docs, model_file, text_col, [text_col], [T.StructField(ids_col, T.BinaryType()), T.StructField(out_col, T.StringType())], both)
