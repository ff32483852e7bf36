"""Shingle join, suffix arrays, SentencePiece, TIFF and the classifiers against brute force, round trips and labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumflow.llm import ngram_join, quality, sp_codec, suffix_dedup, tiff_media, toxicity
from vellumflow.llm.components import components
from vellumflow.llm.queries import piece_model
from vellumflow.llm.suffix_array import permuted_common_prefixes, suffix_array

# -- n-gram Jaccard join -------------------------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components_by_hand(texts: dict) -> dict:
    sets, of = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(d):
        while of[d] != d:
            d = of[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                of[hi] = lo
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_join_on_odd_rows(odd, nothing):
    want = components_by_hand({r.doc_id: r.text for r in odd.collect() if r.doc_id is not None})
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    assert all((r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (26, None)) for r in got)
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_join_finds_chains_and_borders(spark):
    """Copies drift away word by word, so that links chain; many share a passage without being alike; sizes straddle the threshold."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts, common = {}, [f"c{k}" for k in range(30)]
    for family in range(12):
        text = [r.choice(words) for _ in range(r.randint(20, 90))]
        for _ in range(14):
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = r.choice(words)
            texts[len(texts)] = " ".join(text if r.random() < 0.8 else text[: r.randint(10, len(text))])
    for _ in range(120):
        texts[len(texts)] = " ".join([r.choice(words) for _ in range(r.randint(0, 25))] + common)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = components_by_hand(texts)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(docs).collect()}
    assert got == want
    assert sorted(x.doc_id for x in ngram_join.keep_one(docs).collect()) == sorted(d for d in want if want[d][1] == d)


@pytest.mark.parametrize("bounds", [{"DENSE": 99.0, "SHRINK": 2.0}, {"DENSE": 0.0}, {"BROADCAST_IDS": 0, "PACKED": 300, "BUCKET": 100}])
def test_large_cells_divide_and_join_exactly(spark, monkeypatch, bounds):
    """Families that are alike but only partly linked, in cells beyond the bound: divided again and again, or joined in blocks."""
    for name, value in ({"LEAF": 6, "PIVOTS": 3} | bounds).items():
        monkeypatch.setattr(ngram_join, name, value)
    r, texts = random.Random(11), {}
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(120)]
        for member in range(40):
            text = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
                text[r.randrange(len(text))] = f"x{r.randrange(6)}"
            texts[len(texts)] = " ".join(text)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(docs).collect()} == components_by_hand(texts)


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    of = {n: n for pair in links for n in pair}
    for _ in range(400):
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == c for n, c in of.items())


# -- suffix arrays ----------------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text("ab", max_size=120).map(str.encode), st.binary(max_size=30).map(lambda b: b * 3)))
def test_suffix_array(data):
    text = np.frombuffer(data, np.uint8)
    order = suffix_array(text)
    assert order.tolist() == sorted(range(len(data)), key=lambda k: data[k:])
    common = permuted_common_prefixes(text, order, 20)
    for k in range(1, len(data)):
        a, b = data[order[k] :], data[order[k - 1] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == min(n, 20)
    short = [data[k : k + 16] for k in suffix_array(text, 16)]
    assert short == sorted(short)


def removed_by_hand(rows):
    first, out = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], doc)
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        if doc is not None:
            for k in range(len(data) - 49):
                if first[data[k : k + 50]] < doc:
                    gone[k : k + 50] = True
        out[doc] = (bytes(b for b, g in zip(data, gone) if not g), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()))
    return out


def check_removed(docs):
    want = removed_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (bytes(r.kept), r.n_bytes - len(r.kept), len(r.spans)) == want[r.doc_id]


def test_repeats_on_odd_rows(odd, nothing):
    check_removed(odd)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeats_at_every_border(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)  # many shards
    r = random.Random(9)
    pool = ["".join(r.choice("abcdé \n") for _ in range(200)) for _ in range(6)]
    rows = []
    for k in range(120):
        parts = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            p, a = r.choice(pool), r.randint(0, 150)
            parts += [p[a : a + r.randint(45, 80)], "".join(r.choice("xyz") for _ in range(r.randint(0, 20)))]
        rows.append((k * 7 % 113, "".join(parts) if k % 9 else "ab" * r.randint(10, 90)))
    check_removed(spark.createDataFrame(list(dict(rows).items()), "doc_id long, text string").repartition(5))


def test_rows_that_repeat_an_id_keep_their_own_bytes(spark):
    one, two, three = ("".join(random.Random(seed).choices("abcdefgh ", k=90)) for seed in (1, 2, 3))
    rows = spark.createDataFrame([(1, one), (2, two), (2, one), (2, two + three), (2, None), (3, three + two), (None, one)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, bytes(r.kept).decode(), len(r.spans)) for r in suffix_dedup.remove_repeats(rows).collect())
    assert got == sorted([(1, one, 0), (2, two, 0), (2, "", 1), (2, two + three, 0), (2, "", 0), (3, "", 1), (0, one, 0)])


def test_a_frequent_passage_is_compared_once_a_batch(spark):
    """A footer of 600 documents: the comparing groups see it once for each batch of texts, the rest goes past them."""
    r = random.Random(4)
    footer = "".join(r.choices("abcdefgh ", k=200))
    docs = spark.createDataFrame([(k, "".join(r.choices("ijklmnop ", k=150)) + footer) for k in range(600)], "doc_id long, text string").repartition(3)
    check_removed(docs)
    based = suffix_dedup._based(docs)
    marked = suffix_dedup.shared_anchors(based)
    rows = suffix_dedup._slices(based.join(marked, "doc_id"), 8, 50, 20).toPandas()
    compared, past = rows[rows["shard"] >= 0], rows[rows["shard"] < 0]
    slices = int((compared["sizes"].map(len) // 4).sum())
    # every slice once in each batch: those inside the footer, and those over its border, which differ from text to text
    assert int((compared["of"].map(len) // 4).sum()) == slices < 600 * 1.5
    assert 590 <= int((past["docs"].map(len) // 8).sum()) <= 600  # one range of each later document


# -- SentencePiece ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return sp_codec.Codec(sp_codec.load_vocabulary(piece_model())), sentencepiece.SentencePieceProcessor(model_file=piece_model())


def same(both, text):
    codec, library = both
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert memoryview(codec.encode(text)).cast("I").tolist() == ids
    assert codec.decode(ids) == library.decode(ids)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60), st.integers(0, 40))
def test_codec_equals_the_library(both, text, spaces):
    same(both, text)
    same(both, " " * spaces + text + " " * spaces + "▁\n" + text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=12), st.lists(st.integers(3, 258), max_size=6))
def test_decode_of_any_ids(both, ids, more):
    codec, library = both
    assert codec.decode(ids + more + ids) == library.decode(ids + more + ids)


def test_models_with_other_settings_are_refused():
    field = lambda number, value: bytes([number << 3 & 255 | 2, len(value)]) + value if isinstance(value, bytes) else _varint(number << 3) + _varint(value)
    trainer = field(3, 2) + field(35, 1)
    normalizer = field(3, 1) + field(4, 0)
    assert sp_codec.check_settings(field(2, trainer) + field(3, normalizer)) is True
    assert sp_codec.check_settings(field(2, trainer) + field(3, field(3, 0) + field(4, 0))) is False
    other = [(field(35, 1), normalizer), (field(3, 2), normalizer), (trainer + field(24, 1), normalizer), (trainer, field(2, b"x") + normalizer), (trainer, b""), (trainer, normalizer + field(5, 0))]
    for train, norm in other:
        with pytest.raises(ValueError):
            sp_codec.check_settings(field(2, train) + field(3, norm))
    with pytest.raises(ValueError):
        sp_codec.check_settings(field(1, field(3, 4)) + field(2, trainer) + field(3, normalizer))


def _varint(value: int) -> bytes:
    out = b""
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


def test_codec_memory_is_bounded(both, monkeypatch):
    """Words and pairs are forgotten in turn, and the ids stay those of the library."""
    monkeypatch.setattr(sp_codec, "WORDS_KEPT", 5)
    monkeypatch.setattr(sp_codec, "PAIRS_KEPT", 7)
    codec = sp_codec.Codec(both[0].v)
    text = " ".join(f"word{k % 9} thing{k % 4}s {k}" for k in range(60))
    assert memoryview(codec.encode(text)).cast("I").tolist() == both[1].encode(text, add_bos=True, add_eos=True)
    assert len(codec.words) <= 5 and len(codec.pairs) <= 7


def test_codec_on_odd_ids_and_columns(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, b"", "y"), (3, b"\x01\x00\x00\x00\xff\xff\xff\x7f\x05", "z")], "doc_id long, ids binary, text string")
    assert {r.doc_id: r.text for r in sp_codec.decode_ids(rows, piece_model()).collect()} == {1: None, 2: "", 3: ""}
    encoded = sp_codec.encode_texts(rows, piece_model())
    assert encoded.columns == ["doc_id", "ids"] and encoded.count() == 3
    both_ways = sp_codec.encode_and_decode(rows, piece_model()).collect()
    assert {r.doc_id: r.decoded for r in both_ways} == {1: "x", 2: "y", 3: "z"}


def test_codec_on_given_texts(both, spark, sf, odd, nothing):
    rows = sp_codec.decode_ids(sp_codec.encode_texts(odd, piece_model()), piece_model(), out_col="decoded").collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        ids = both[1].encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert memoryview(bytes(r.ids)).cast("I").tolist() == ids and r.decoded == both[1].decode(ids)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        same(both, r.text)
    assert sp_codec.encode_texts(nothing, piece_model()).count() == 0


# -- TIFF ------------------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([1, 5, 8, 32773]), st.sampled_from([1, 2]), st.sampled_from([None, (16, 16), (64, 48)]), st.sampled_from("<>"), st.integers(1, 3))
def test_tiff_round_trip(data, compression, predictor, tile, order, n):
    page = np.frombuffer(tiff_media.payload(data), np.uint8).reshape(-1, 64)
    file = tiff_media.encode([page] * n, compression, predictor, tile, rows=7, order=order)
    read = list(tiff_media.decode(file))
    assert [p["page"] for p in read] == list(range(n)) and all(p["pixels"] == page.tobytes() and p["error"] is None for p in read)


def test_long_lzw_fills_its_table():
    data = bytes(random.Random(1).randrange(256) for _ in range(40000)) + b"abc" * 20000
    assert tiff_media.unlzw(tiff_media.lzw(data), len(data)) == data


def test_broken_files_give_a_reason(spark):
    good = tiff_media.encode([np.zeros((4, 64), np.uint8)])
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    files = [(1, None), (2, b""), (3, b"GIF89a"), (4, good[:40]), (5, bytes(loop)), (6, good)]
    rows = tiff_media.pages(spark.createDataFrame(files, "id long, media binary")).collect()
    assert {r.id for r in rows if r.error} == {1, 2, 3, 4, 5}
    assert [r.width for r in rows if r.id == 6] == [64]


def test_bytes_written_by_hand():
    """Examples that do not come from our own encoder: PackBits, LZW codes, and a big-endian file of short values."""
    packed = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa")
    assert tiff_media.unpackbits(packed, 24) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22") + b"\xaa" * 10
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff_media.unlzw(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    entries = [(256, 3, 1, "0003 0000"), (257, 3, 1, "0002 0000"), (258, 3, 1, "0008 0000"), (259, 3, 1, "0001 0000"), (262, 3, 1, "0001 0000"), (273, 4, 1, "0000 0008"), (277, 3, 1, "0001 0000"), (278, 3, 1, "0002 0000"), (279, 4, 1, "0000 0006")]
    file = bytes.fromhex("4d4d 002a 0000 000e 0102 0304 0506".replace(" ", "")) + len(entries).to_bytes(2, "big")
    file += b"".join(t.to_bytes(2, "big") + k.to_bytes(2, "big") + n.to_bytes(4, "big") + bytes.fromhex(v) for t, k, n, v in entries) + bytes(4)
    (page,) = tiff_media.decode(file)
    assert (page["error"], page["width"], page["height"], page["pixels"]) == (None, 3, 2, bytes([1, 2, 3, 4, 5, 6]))


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_no_file_raises(data):
    """Any four bytes of a good file replaced: huge sizes, wild offsets and counts give a reason or a page, never an error."""
    pixels = np.arange(640, dtype=np.uint8).reshape(10, 64)
    file = bytearray(tiff_media.encode([pixels], data.draw(st.sampled_from([1, 5, 8, 32773])), tile=data.draw(st.sampled_from([None, (16, 16)]))))
    at = data.draw(st.integers(0, len(file) - 4))
    file[at : at + 4] = data.draw(st.one_of(st.binary(min_size=4, max_size=4), st.sampled_from([b"\xff\xff\xff\x7f", b"\0\0\0\x40"])))
    assert all(p["error"] is not None or p["pixels"] is not None for p in tiff_media.decode(bytes(file)))


def test_pages_of_odd_rows(odd, nothing):
    from pyspark.sql import functions as F

    stored = tiff_media.store(odd.select("doc_id", F.encode("text", "UTF-8").alias("data"), F.lit("clash").alias("page")), "data")
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    rows = tiff_media.pages(stored).collect()
    assert len(rows) == odd.count() and all(bytes(r.pixels) == tiff_media.payload(texts[r.doc_id]) for r in rows)
    assert tiff_media.pages(tiff_media.store(nothing.select("doc_id", F.encode("text", "UTF-8").alias("data")), "data")).count() == 0
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


# -- classifiers -----------------------------------------------------------------------------------------------------------------


def split(spark, label):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = labels.where("pmod(xxhash64(doc_id, 'held'), 4) = 0")
    return docs, labels.join(held.select("doc_id"), "doc_id", "left_anti"), {r.doc_id: r[label] for r in held.collect()}


def test_quality_on_held_out_rows(spark, odd, nothing):
    docs, train, held = split(spark, "quality")
    model = quality.fit(docs, train)
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    good = [rows[d].keep for d, y in held.items() if y == 1]
    bad = [rows[d].keep for d, y in held.items() if y == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    odd_rows = quality.score(odd, model).collect()
    assert len(odd_rows) == odd.count() and all(0 <= r.quality <= 1 for r in odd_rows)
    assert quality.score(nothing, model).count() == 0
    assert quality.keep_good(odd, train).columns == odd.columns


def test_toxicity_on_held_out_rows(spark, odd, nothing):
    docs, train, held = split(spark, "toxic")
    model = toxicity.fit(docs, train)
    assert (np.diff(model.cuts) > 0).all()
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    bad = [rows[d].toxic for d, y in held.items() if y == 1]
    good = [rows[d].toxic for d, y in held.items() if y == 0]
    assert sum(bad) >= 0.85 * len(bad) and sum(good) <= 0.01 * len(good)
    assert all(abs(r.severity - r.p_toxic - r.p_severe) < 1e-9 for r in rows.values())
    assert len(toxicity.score(odd, model).collect()) == odd.count() and toxicity.score(nothing, model).count() == 0


def test_models_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(not r.toxic for r in toxicity.score(odd, toxicity.fit(odd, none)).collect())
    assert quality.score(odd, quality.fit(odd, none)).count() == odd.count()
