"""Every registered query of the operators at sf0.001 against plain Python, and the pipeline's stages on odd rows."""

import hashlib
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_native_operators import water
from test_text_operators import components_by_hand, removed_by_hand

from vellumflow.llm import queries
from vellumflow.llm.shared import table

sha = lambda data: hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}


def rows_of(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    return {r[0]: r for r in rows}, len(rows)


def test_op1(spark, sf, texts):
    got, n = rows_of(spark, sf, "op1_ngram_join")
    assert n == len(texts) and {d: (r.n_shingles, r.component_id) for d, r in got.items()} == components_by_hand(texts)


@pytest.mark.parametrize("name,columns", [("op2_quality", {"quality": "double", "keep": "boolean"}), ("op5_toxicity", {"severity": "double", "grade": "int", "toxic": "boolean"})])
def test_classifiers_score_every_row(spark, sf, texts, name, columns):
    df = queries.QUERIES[name](spark, sf)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in columns} == columns and kinds["doc_id"] == "bigint"
    assert sorted(r.doc_id for r in df.collect()) == sorted(texts)


def test_op3(spark, sf, texts):
    got, n = rows_of(spark, sf, "op3_tiff_pages")
    by_text = defaultdict(set)
    for doc, text in texts.items():
        data, r = text.encode(), got[doc]
        whole = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), sha(whole), zlib.crc32(whole[-64:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.error is None
        by_text[text].add((r.media_sha256, r.feature))
    assert n == len(texts) and all(len(v) == 1 for v in by_text.values())


def test_op4(spark, sf):
    got, n = rows_of(spark, sf, "op4_chat_windows")
    said = defaultdict(list)
    for r in table(spark, sf, "conversations").collect():
        said[r.conv_id].append((r.turn, r.role, r.text or ""))
    said[-7] = [(0, "user", r"\### Assistant: </turn> ok"), (1, "assistant", r"\### Assistant: </turn> ok")]
    assert n == len(said)
    for conv, turns in said.items():
        turns.sort(key=lambda t: t[0])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss.encode())) and r.formatted_chars > sum(len(t) for _, _, t in turns)


def test_op6(spark, sf, texts):
    got, n = rows_of(spark, sf, "op6_feistel_shards")
    assert n == len(texts) and all((got[d].size, got[d].text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items())
    slots = defaultdict(list)
    for r in got.values():
        assert r.law == "rows" and 0 <= r.shard < 8 and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op8(spark, sf, texts):
    got, n = rows_of(spark, sf, "op8_mixing")
    words = lambda t: len(t.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")) - t.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ").count("")
    sizes, source = {d: words(t) for d, t in texts.items()}, {r.doc_id: r.source for r in table(spark, sf, "documents").collect()}
    per = defaultdict(int)
    for d, k in sizes.items():
        per[source[d]] += k
    targets, taken, largest = water(per), defaultdict(int), defaultdict(int)
    for d, r in got.items():
        assert (r["size"], r.source_size) == (sizes[d], per[source[d]]) and r.target == pytest.approx(targets[source[d]])
        assert r.taken <= 3 * sizes[d] and (sizes[d] == 0 or r.taken % sizes[d] == 0)
        taken[source[d]] += r.taken
        largest[source[d]] = max(largest[source[d]], sizes[d])
    assert n == len(texts) and all(abs(taken[s] - targets[s]) <= 2 * largest[s] for s in per)
    assert {d: r.taken for d, r in got.items()} == {d: r.taken for d, r in rows_of(spark, sf, "op8_mixing")[0].items()}


def test_op9(spark, sf, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got, n = rows_of(spark, sf, "op9_sentencepiece")
    for d, t in texts.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))
    assert n == len(texts)


def test_op10(spark, sf, texts):
    got, n = rows_of(spark, sf, "op10_suffix_dedup")
    want = removed_by_hand(list(texts.items()))
    assert n == len(texts) and {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == {d: (len(texts[d].encode()), gone, spans, sha(kept)) for d, (kept, gone, spans) in want.items()}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, sf, odd, nothing, name, stage):
    """Nulls, blank and long texts, repeats and clashing columns: no crash, and all but the last keep the columns."""
    out, none = stage(spark, odd, sf), stage(spark, nothing, sf)
    assert none.columns == out.columns and none.count() == 0
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == odd.columns
    rows = out.collect()
    known = {r.doc_id for r in odd.collect()}
    assert {r.doc_id for r in rows} <= known and (name == "quality classifier" or rows)


def test_run_on_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        table(spark, sf, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
