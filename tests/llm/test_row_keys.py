"""The near-duplicate stage on null and repeated ids."""

from vellumflow.llm import ngram_join


def test_rows_of_one_id_link_each_by_its_own_text(spark):
    words = lambda p: [f"{p}{k}" for k in range(60)]
    near = lambda p: " ".join([*words(p)[:-1], "changed"])
    a, b, c, d = (" ".join(words(p)) for p in "abcd")
    rows = [
        (5, a, 1), (7, near("a"), 2), (7, b, 3),  # one of two texts of an id is a near copy
        (8, near("b"), 4),  # of the other text
        (9, c, 5), (9, near("c"), 6), (9, c, 7),  # near copies under one id
        (None, a, 8), (None, a, 9), (None, d, 10), (11, None, 11), (11, "", 12),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    kept = {r.row for r in ngram_join.keep_one(docs).collect()}
    assert kept - {5, 6, 7} == {1, 3, 8, 9, 10, 11, 12} and len(kept & {5, 6, 7}) == 1
    assert ngram_join.keep_one(docs).columns == docs.columns
    of = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert of == {(5, 5), (7, 5), (8, 5), (9, 9), (None, None), (11, 11)}


def test_rows_without_id_stay(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text == text) for r in ngram_join.keep_one(docs).collect()) == [(0, False), (0, True), (1, True)]
