"""Scans, predicates, orders and pages as registered queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from vellumflow.functions import values as V
from vellumflow.operators import search as S
from vellumflow.plans.registry import query
from vellumflow.sources import derived as D
from vellumflow.sources.derived import oracle

LIVE = "tenant_id IS NULL AND NOT is_deleted"
TEXTUAL = "id, creation_time, lifecycle_status"


def _docs(spark, sf):
    return D.documents(spark, sf)


def _searched(spark, sf, filters, code="order.general", **metadata):
    rows = S.search(_docs(spark, sf), D.extracted_fields(spark, sf, D.numbers_of(f.name for f in filters)), D.field_definitions(spark), D.document_types(spark), code, filters, **metadata)
    return rows.select("id", "creation_time", "lifecycle_status")


def _exists(definition, condition):
    return f"EXISTS (SELECT 1 FROM d_extracted_fields f WHERE f.document_id = d.id AND f.field_definition_id = {definition} AND {condition})"


def _field_oracle(*conditions, more=""):
    return oracle(f"SELECT {TEXTUAL} FROM d_documents d WHERE {LIVE} AND document_type_id = 1 {more} AND " + " AND ".join(conditions))


@query("s1_scoped_scan", oracle(f"SELECT id, title, file_size FROM d_documents WHERE {LIVE}"))
def s1(spark, sf):
    return S.scope(_docs(spark, sf)).select("id", "title", "file_size")


@query("s1_tenant_scan", oracle("SELECT id, title, file_size FROM d_documents WHERE tenant_id = 2 AND NOT is_deleted"))
def s1_tenant(spark, sf):
    return S.scope(_docs(spark, sf), 2).select("id", "title", "file_size")


@query("s2_recycle_bin", oracle("SELECT id, tenant_id FROM d_documents WHERE tenant_id IS NULL AND is_deleted"))
def s2(spark, sf):
    return S.recycle_bin(_docs(spark, sf)).select("id", "tenant_id")


@query("s3_with_children", oracle(f"SELECT d.id, CAST(count(f.document_id) AS BIGINT) AS n_fields, CAST(coalesce(sum(f.order_no), 0) AS BIGINT) AS orders FROM d_documents d LEFT JOIN d_extracted_fields f ON f.document_id = d.id WHERE {LIVE} GROUP BY d.id"))
def s3(spark, sf):
    rows = S.with_children(S.scope(_docs(spark, sf)), D.extracted_fields(spark, sf))
    n = F.coalesce(F.size("fields"), F.lit(0))
    return rows.select("id", F.greatest(n, F.lit(0)).cast("long").alias("n_fields"), F.coalesce(F.aggregate("fields", F.lit(0).cast("long"), lambda a, f: a + f["order_no"]), F.lit(0)).alias("orders"))


@query("s4_by_blob_name", oracle("SELECT min(id) AS id, content_hash FROM d_documents WHERE origin_document_id IS NULL GROUP BY content_hash"))
def s4(spark, sf):
    return _docs(spark, sf).where("origin_document_id IS NULL").groupBy("content_hash").agg(F.min("id").alias("id"))


@query("s5_stored_content", oracle("SELECT custkey, content_hash FROM (SELECT c_custkey AS custkey, sha256('blob#' || (c_custkey * 7)) AS content_hash FROM customer) WHERE content_hash IN (SELECT content_hash FROM d_documents)"))
def s5(spark, sf):
    incoming = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.sha2(F.concat(F.lit("blob#"), F.col("c_custkey") * 7), 256).alias("content_hash"))
    return S.by_content_hash(incoming, _docs(spark, sf)).select("custkey", "content_hash")


@query("s6_natural_key", oracle("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = lower((SELECT min(n_name) FROM nation))"))
def s6(spark, sf):
    nation = D.table(spark, sf, "nation")
    return S.by_natural_key(nation, "n_name", (nation.agg(F.min("n_name")).first()[0] or "").swapcase(), ignore_case=True).select("n_nationkey", "n_name")


@query("f1_metadata", oracle(f"SELECT {TEXTUAL} FROM d_documents WHERE {LIVE} AND lifecycle_status = 30 AND document_type_id = 2 AND cabinet_id = 3 AND review_disposition = 0"))
def f1(spark, sf):
    return S.filter_metadata(S.scope(_docs(spark, sf)), lifecycle=30, type_id=2, cabinet=3, disposition=0).select("id", "creation_time", "lifecycle_status")


@query("f1_origin", oracle(f"SELECT {TEXTUAL} FROM d_documents WHERE {LIVE} AND origin_document_id = (SELECT max(origin_document_id) FROM d_documents WHERE {LIVE})"))
def f1_origin(spark, sf):
    docs = S.scope(_docs(spark, sf))
    return S.filter_metadata(docs, origin=docs.agg(F.max("origin_document_id")).first()[0] or 0).select("id", "creation_time", "lifecycle_status")


@query("f2_requires_attention", oracle(f"SELECT id, review_reasons FROM d_documents WHERE {LIVE} AND review_reasons <> 0 AND review_disposition <> 30"))
def f2(spark, sf):
    return S.filter_metadata(S.scope(_docs(spark, sf)), has_review_reasons=True).select("id", "review_reasons")


@query("f2_false_filters_nothing", oracle(f"SELECT id, review_reasons FROM d_documents WHERE {LIVE}"))
def f2_false(spark, sf):
    return S.filter_metadata(S.scope(_docs(spark, sf)), has_review_reasons=False).select("id", "review_reasons")


@query("f3_creation_range", oracle(f"SELECT id, creation_time FROM d_documents WHERE {LIVE} AND creation_time >= DATE '1995-01-01' AND creation_time < DATE '1996-01-01'"))
def f3(spark, sf):
    return S.filter_metadata(S.scope(_docs(spark, sf)), created_from=dt.date(1995, 1, 1), created_to=dt.date(1995, 12, 31)).select("id", "creation_time")


@query("f4_text", _field_oracle(_exists(102, "text_value = '1-URGENT'")))
def f4(spark, sf):
    return _searched(spark, sf, [S.FieldFilter("priority", "1-URGENT")])


@query("f5_boolean", _field_oracle(_exists(105, "boolean_value")))
def f5(spark, sf):
    return _searched(spark, sf, [S.FieldFilter("urgent", " TRUE ")])


@query("f6_number_range", _field_oracle(_exists(101, "number_value BETWEEN 9999.5 AND 100000")))
def f6(spark, sf):
    return _searched(spark, sf, [S.FieldFilter("amount", min="9,999.5", max="100,000")])


@query("f6_number_open", _field_oracle(_exists(101, "number_value >= 200000")))
def f6_open(spark, sf):
    return _searched(spark, sf, [S.FieldFilter("amount", min="200000")])


@query("f7_date", _field_oracle(_exists(103, "date_value BETWEEN DATE '1996-02-01' AND DATE '1996-03-31'")))
def f7(spark, sf):
    return _searched(spark, sf, [S.FieldFilter("signed_on", min="1996-02-01T09:30:00", max="1996-03-31")])


@query("f8_datetime", _field_oracle(_exists(104, "datetime_value <= TIMESTAMP '1993-05-05 12:00:00'")))
def f8(spark, sf):
    return _searched(spark, sf, [S.FieldFilter("received_at", max="1993-05-05T12:00:00")])


@query("f10_no_filters", oracle("SELECT id FROM d_documents WHERE false"))
def f10(spark, sf):
    return S.matching_ids(D.extracted_fields(spark, sf), [])


@query("f11_field_search", _field_oracle(_exists(102, "text_value = '1-URGENT'"), _exists(101, "number_value BETWEEN 100000 AND 200000"), more="AND lifecycle_status = 30"))
def f11(spark, sf):
    return _searched(spark, sf, [S.FieldFilter("priority", "1-URGENT"), S.FieldFilter("amount", min="100000", max="200000")], lifecycle=30)


@query("f11_multi_value", oracle("SELECT d.id FROM d_documents d WHERE tenant_id IS NULL AND NOT is_deleted AND document_type_id = 1 AND id IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name = (SELECT min(p_name) FROM part)) AND id IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 0.000001)"))
def f11_multi(spark, sf):
    name = D.table(spark, sf, "part").agg(F.min("p_name")).first()[0] or ""
    return _searched(spark, sf, [S.FieldFilter("parts", name), S.FieldFilter("amount", min="0.000001")]).select("id")


@query("f12_resolution", oracle("SELECT id, name, data_type FROM d_field_definitions WHERE document_type_id = 1 AND NOT is_deleted AND id IN (SELECT field_definition_id FROM d_extracted_fields)"))
def f12(spark, sf):
    """Every live name of a type is resolved, and those definitions that have values are given."""
    definitions = D.field_definitions(spark)
    names = [f[1] for f in D.FIELDS if not f[7]]
    ids = [q.definition_id for q in S.resolve([S.FieldFilter(n, value="x") for n in names], definitions, 1)]
    used = D.extracted_fields(spark, sf).select(F.col("field_definition_id").alias("id")).where(F.col("id").isin(ids)).distinct()
    return definitions.join(used, "id", "left_semi").select("id", "name", "data_type")


@query("f13_id_in", _field_oracle(_exists(106, "text_value LIKE '%1'")).replace(TEXTUAL, "id"))
def f13(spark, sf):
    ids = D.extracted_fields(spark, sf, (6,)).where("field_definition_id = 106 AND text_value LIKE '%1'").select(F.col("document_id").alias("id")).distinct()
    return S.filter_metadata(S.scope(_docs(spark, sf)), type_id=1).join(ids, "id", "left_semi").select("id")


@query("f14_reprocess", oracle(f"SELECT id FROM d_documents WHERE {LIVE} AND title <> '' AND (review_reasons & 1) <> 0 AND review_disposition <> 20"))
def f14(spark, sf):
    return S.to_reprocess(S.scope(_docs(spark, sf)), **S.reprocess_scope("PendingReviewQueue")).select("id")


@query("f15_reprocess_type", oracle(f"SELECT id FROM d_documents WHERE {LIVE} AND title <> '' AND document_type_id = 3"))
def f15(spark, sf):
    return S.to_reprocess(S.scope(_docs(spark, sf)), **S.reprocess_scope("OnlyCurrentType", 3)).select("id")


@query("f17_guarded_search", oracle(f"SELECT id, total, total > 50 AS truncated FROM (SELECT id, count(*) OVER () AS total, row_number() OVER (ORDER BY creation_time DESC, id DESC) AS place FROM d_documents WHERE {LIVE} AND cabinet_id = 2) WHERE place <= 50"))
def f17(spark, sf):
    asked = S.search_scope(None, "no number", "2", 500, "nonsense")
    rows = S.filter_metadata(S.scope(_docs(spark, sf)), cabinet=asked["cabinet"], origin=asked["origin"], lifecycle=asked["lifecycle"])
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return S.page(rows, 0, asked["limit"]).select("id").crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > asked["limit"])


@query("f18_probes", oracle("SELECT d.id, EXISTS (SELECT 1 FROM d_extracted_fields f WHERE f.field_definition_id = d.id) AS has_values FROM d_field_definitions d"))
def f18(spark, sf):
    used = D.extracted_fields(spark, sf).select(F.col("field_definition_id").alias("id")).distinct().withColumn("has_values", F.lit(True))
    return D.field_definitions(spark).select("id").join(used, "id", "left").select("id", F.coalesce("has_values", F.lit(False)).alias("has_values"))


@query("f18_document_probes", oracle("SELECT id, id IN (SELECT origin_document_id FROM d_documents WHERE origin_document_id IS NOT NULL) AS has_children, EXISTS (SELECT 1 FROM d_documents o WHERE o.origin_document_id = d.origin_document_id AND o.content_hash = d.content_hash AND NOT o.is_deleted AND o.id <> d.id) AS has_live_copy FROM d_documents d"))
def f18_documents(spark, sf):
    return S.document_probes(D.documents(spark, sf))


@query("p1_ids", oracle(f"SELECT id FROM d_documents WHERE {LIVE} AND document_type_id = 2"))
def p1(spark, sf):
    return S.filter_metadata(S.scope(_docs(spark, sf)), type_id=2).select("id")


@query("p9_declined", oracle(f"SELECT id, (review_reasons & 16) <> 0 AS declined FROM d_documents WHERE {LIVE}"))
def p9(spark, sf):
    return S.scope(_docs(spark, sf)).select("id", V.has(F.col("review_reasons"), 16).alias("declined"))


@query("p10_form_filters", _field_oracle(_exists(102, "text_value = '2-HIGH'")))
def p10(spark, sf):
    types = {r.name: r.data_type for r in D.field_definitions(spark).where("document_type_id = 1").collect()}
    form = [{"name": " priority ", "value": " 2-HIGH "}, {"name": "amount"}, {"name": "customer", "min": "a"}, {"value": "x"}]
    return _searched(spark, sf, S.compose_filters(form, types))


def _ranked(order):
    return oracle(f"SELECT id, creation_time FROM d_documents WHERE {LIVE} ORDER BY {order} LIMIT 40 OFFSET 20")


@query("o1_newest_page", _ranked("creation_time DESC, id DESC"))
def o1(spark, sf):
    return S.page(S.scope(_docs(spark, sf)), 20, 40, "title").select("id", "creation_time")


@query("o2_oldest_page", _ranked("creation_time, id"))
def o2(spark, sf):
    return S.page(S.scope(_docs(spark, sf)), 20, 40, "CreationTime ASC").select("id", "creation_time")


@query("o4_keyset_page", oracle(f"SELECT id FROM d_documents WHERE {LIVE} AND id > 700 ORDER BY id LIMIT 100"))
def o4(spark, sf):
    return S.after(S.scope(_docs(spark, sf)), 700, 100)
