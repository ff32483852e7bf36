"""The codec with word ends against the library it reproduces."""

import hashlib
import json
import random

import pytest
from tokenizers import Tokenizer

from vellumflow.llm import bpe_codec, queries
from vellumflow.llm.shared import table

sha = lambda data: hashlib.sha256(data).hexdigest()
EVERY = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.word_model())


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(bpe_codec.load_vocabulary(queries.word_model()))


def check(codec, library, texts):
    (got,) = codec.encode([texts])
    for data, want, text in zip(got, library.encode_batch(texts, add_special_tokens=False), texts, strict=True):
        ids = memoryview(data).cast("i").tolist()
        assert ids == want.ids, text[:80]
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_every_character(codec, library):
    check(codec, library, [EVERY[k : k + 4000] for k in range(0, len(EVERY), 4000)])
    check(codec, library, [" a".join(EVERY[k : k + 4000]) for k in range(0, 0x30000, 4000)])


def test_literal_cases(codec, library):
    cases = ["", "   ", "It's 42nd, isn't it? 'LL", "<|endoftext|> a<|startoftext|>b<|endoftext|><|endoftext|>", "<|endoftext|", "ΑΣ ΑΣΑ İ ſ K", "a\x1cb \x1f c\x85d　e", "é x ẹ́ ạ࢘́", "日本語、テキスト。"]
    check(codec, library, cases)


def test_random_texts(codec, library, monkeypatch):
    r = random.Random(11)
    texts = ["".join(r.choice(EVERY if r.random() < 0.05 else "ab c'sStTlLÉé́ \n.,1日") for _ in range(r.randrange(300))) for _ in range(800)]
    check(codec, library, texts)
    monkeypatch.setattr(bpe_codec, "KEPT", 40)  # generations change all the time
    monkeypatch.setattr(bpe_codec, "SYMBOLS", 50)
    fresh = bpe_codec.Codec(codec.v)
    for k in range(0, len(texts), 50):
        check(fresh, library, texts[k : k + 50])


def test_long_words(codec, library):
    check(codec, library, ["a" * 30_001, "ab" * 20_000, "aab" * 10_000 + "!" * 999, "the " * 30_000 + "x" * 5])


def test_unknown_ids(codec, library):
    ids = [3306, 10**6, 267, 49407]
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) and codec.decode([-1, 267]) == ",</w>" and codec.decode([]) == ""


def test_other_models_are_refused(tmp_path):
    with open(queries.word_model(), encoding="utf-8") as file:
        model = json.load(file)
    for part, key, value in (("model", "end_of_word_suffix", None), ("model", "dropout", 0.1), ("normalizer", "normalizers", []), ("pre_tokenizer", "pretokenizers", [])):
        other = json.loads(json.dumps(model))
        other[part][key] = value
        (tmp_path / "model.json").write_text(json.dumps(other))
        with pytest.raises(ValueError, match="cannot reproduce"):
            bpe_codec.load_vocabulary(str(tmp_path / "model.json"))
    model["model"]["merges"] = model["model"]["merges"][::-1]
    (tmp_path / "model.json").write_text(json.dumps(model))
    with pytest.raises(ValueError, match="before its halves"):
        bpe_codec.load_vocabulary(str(tmp_path / "model.json"))


def test_op11(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = queries.QUERIES["op11_bpe"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(decoded.encode()))


def test_odd_rows(odd, nothing, library):
    """Nulls, blanks, long texts, repeats and clashing names: every row stays, with the library's ids."""
    model = queries.word_model()
    docs = odd.withColumnRenamed("size", "ids").withColumnRenamed("place", "Decoded")
    out = bpe_codec.encode_and_decode(docs, model)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "keep_id", "ids", "decoded"]
    want = sorted((r.doc_id or -1, library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect())
    assert sorted((r.doc_id or -1, r.ids) for r in out.collect()) == want
    back = bpe_codec.decode_ids(bpe_codec.encode_texts(docs, model), model, out_col="again")
    assert sorted(r.again for r in back.collect()) == sorted(r.decoded for r in out.collect())
    assert bpe_codec.encode_and_decode(nothing, model).count() == 0 and bpe_codec.encode_texts(nothing, model).columns[-1] == "ids"
    nulls = bpe_codec.decode_ids(odd.sparkSession.createDataFrame([(None,), ([],), ([267, None, 10**6],)], "ids array<int>"), model)
    assert [r.decoded for r in nulls.collect()] == [None, "", ",</w>"]
