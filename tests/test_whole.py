"""Queries that do their whole job however large the table is."""

import pytest
from pyspark.sql import functions as F

from vellumflow.operators import assemble as A
from vellumflow.operators import search as S
from vellumflow.plans import catalog
from vellumflow.sources import derived as D


def test_exports_have_no_row_limit_of_their_own(spark, sf, monkeypatch):
    """The registered exports give every row; the refusal stays the default of export_table()."""
    monkeypatch.setattr(A.export_table, "__defaults__", (5,))
    rows = S.scope(D.documents(spark, sf)).where("document_type_id = 1").count()
    assert rows > 5
    for name in ("p6_export_table", "k3_export_csv"):
        assert catalog.QUERIES[name](spark, sf).count() == rows
    with pytest.raises(S.QueryError) as e:
        A.export_table(S.scope(D.documents(spark, sf)), D.extracted_fields(spark, sf), D.field_definitions(spark), 1)
    assert e.value.code == "TooManyRows"


def test_all_documents_are_dealt_into_batches(spark):
    """More than three pages, ids with holes and far apart, and an empty table."""
    ids = [k * k * 7 - 9000 for k in range(1234)]
    docs = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    got = {r.id: r.batch for r in S.batches(docs, 100).collect()}
    assert got == {i: k // 100 for k, i in enumerate(ids)}
    assert S.batches(docs.where("false"), 100).count() == 0


def test_reprocessing_goes_behind_the_third_batch():
    """The registered query at sf0.01, where there are more than three batches."""
    import oracle
    from vellumflow.session import get_session

    assert oracle.compare(catalog.QUERIES["g13_reprocess_batches"](get_session(4), "/root/testdata/sf0.01"), catalog.ORACLES["g13_reprocess_batches"], "/root/testdata/sf0.01") is None


def test_texts_in_arrays_are_tagged(spark):
    values = {"a": '["x<b>","1, \\"2\\"",null,7,true]', "b": '"<"', "c": "[]", "d": "[null]", "e": "null", "f": "-1.5"}
    row = spark.createDataFrame([(values,), ({"c": "[]"},)], "m map<string,string>").select(A.project_fields(F.col("m")).alias("m")).collect()
    assert row[0].m == {"a": '["<field>x&lt;b></field>","<field>1, \\"2\\"</field>",7,true]', "b": '"<field>&lt;</field>"', "f": "-1.5"}
    assert row[1].m is None
