"""Requests of operators as registered queries: events ask for runs, orders bring fields typed in by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.operators import interventions as I
from vellumflow.operators import relations as R
from vellumflow.plans.registry import query
from vellumflow.plans.relation_queries import _LATEST
from vellumflow.sources import derived as D
from vellumflow.sources.derived import oracle


def _documents(spark, sf):
    """Documents with a text, which every eleventh lacks."""
    docs = D.documents(spark, sf)
    return docs.withColumn("markdown", F.when(F.col("id") % 11 != 3, F.col("title")))


def _requests(spark, sf):
    """A request for each event: half of them on documents that have runs, some on no document or about no pipeline."""
    events = D.table(spark, sf, "events")
    action = F.when(F.col("event_type") == "signup", "rerecognize").when(F.col("event_type") == "purchase", "reextract").otherwise("retry")
    pipeline = F.when(F.col("event_id") % 89 == 0, "layout").when(F.col("event_type") == "view", "text-extraction").when(F.col("event_type") == "click", "classification").when(F.col("event_type") == "error", "field-extraction")
    return events.select(F.col("event_id").alias("request"), F.when(F.col("event_id") % 97 == 0, -1).otherwise(F.col("event_id") % 300).alias("id"), action.alias("action"), pipeline.alias("pipeline"))


_REQUESTS = """requests AS (
  SELECT event_id AS request, CASE WHEN event_id % 97 = 0 THEN -1 ELSE event_id % 300 END AS id, event_type IN ('view', 'click', 'error') AS again, event_type,
    CASE WHEN event_type = 'signup' THEN 'classification' WHEN event_type = 'purchase' THEN 'field-extraction' WHEN event_id % 89 = 0 THEN 'layout' WHEN event_type = 'view' THEN 'text-extraction' WHEN event_type = 'click' THEN 'classification' ELSE 'field-extraction' END AS pipeline
  FROM events
), known AS (
  SELECT q.*, d.id IS NOT NULL AS found, d.is_deleted, d.document_type_id, r.status, r.attempt
  FROM requests q LEFT JOIN d_documents d ON d.id = q.id
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id, pipeline ORDER BY attempt DESC) AS back FROM d_runs) r ON r.document_id = q.id AND r.pipeline = q.pipeline AND r.back = 1
), alone AS (
  SELECT *, pipeline = 'layout' OR NOT found OR is_deleted OR (NOT again AND id % 11 = 3) OR (event_type = 'purchase' AND document_type_id IS NULL) AS stops,
    CASE WHEN again THEN coalesce(status = 90, false) ELSE coalesce(status NOT IN (10, 20), true) END AS may
  FROM known
), placed AS (
  SELECT *, min(request) FILTER (WHERE NOT stops AND may) OVER (PARTITION BY id, pipeline) AS first_one FROM alone
), judged AS (
  SELECT request, id, pipeline, attempt AS last_attempt, CASE WHEN pipeline = 'layout' THEN 'UnknownPipeline' WHEN NOT found THEN 'NotFound' WHEN is_deleted THEN 'Deleted'
    WHEN event_type = 'purchase' AND document_type_id IS NULL THEN 'NoType' WHEN NOT again AND id % 11 = 3 THEN 'NoText' WHEN request > first_one OR status IN (10, 20) THEN 'InProgress'
    WHEN again AND status IS NULL THEN 'NeverRan' WHEN again AND status <> 90 THEN 'NotRetryable' END AS code
  FROM placed
)
"""


@query("g18_reruns", oracle(f"WITH {_REQUESTS.strip()[:-1].rstrip()}\n)\nSELECT request, id, pipeline, code, CASE WHEN code IS NULL THEN coalesce(last_attempt, 0) + 1 END AS attempt FROM judged"))
def g18_reruns(spark, sf):
    return I.reruns(_documents(spark, sf), D.runs(spark, sf), _requests(spark, sf))


@query("g18_lifecycle_after", oracle(f"""WITH {_REQUESTS.strip()[:-1].rstrip()}
), pending AS (
  SELECT id, bool_or(pipeline = 'text-extraction') AS p0, bool_or(pipeline = 'classification') AS p1, bool_or(pipeline = 'field-extraction') AS p2 FROM judged WHERE code IS NULL GROUP BY id
), latest AS (
  {_LATEST}
)
SELECT d.id, CAST(CASE WHEN (s0 = 90 AND NOT coalesce(p0, false)) OR (s1 = 90 AND NOT coalesce(p1, false)) OR (NOT is_container AND s2 = 90 AND NOT coalesce(p2, false)) THEN 99 WHEN (review_reasons & 57) <> 0 THEN 25
  WHEN coalesce(s0 = 30 AND NOT coalesce(p0, false), false) AND coalesce(s1 = 30 AND NOT coalesce(p1, false), false) AND (is_container OR coalesce(s2 = 30 AND NOT coalesce(p2, false), false)) THEN 30 ELSE 20 END AS BIGINT) AS derived_status
FROM d_documents d LEFT JOIN pending p ON p.id = d.id LEFT JOIN latest l ON l.document_id = d.id"""))
def g18_after(spark, sf):
    """The lifecycle of all documents once the accepted runs are queued."""
    docs, runs = _documents(spark, sf), D.runs(spark, sf)
    queued = I.queued_runs(I.reruns(docs, runs, _requests(spark, sf)))
    return R.derive_lifecycle(docs, runs.select(*queued.columns).unionByName(queued))


def _edited(spark, sf):
    """One edit for each order, of six kinds; two for every tenth, and some for no document."""
    orders = D.table(spark, sf, "orders")
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    whole = F.concat(F.lit('{"amount": '), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(', "customer": '), quoted(F.lit("by hand "), F.col("o_custkey")), F.lit(', "parts": ["one", '), quoted(F.col("o_orderpriority")), F.lit("]}"))
    some = F.concat(F.lit('{"priority": '), quoted(F.col("o_orderpriority")), F.lit(', "parts": [], "urgent": '), (F.col("o_custkey") % 2 == 0).cast("string"), F.lit("}"))
    kind = F.col("o_orderkey") % 6
    text = F.when(kind == 0, whole).when(kind == 1, '{"amount": "12", "customer": "c", "note": 5}').when(kind == 2, '{"colour": "red", "legacy": "x", "amount": 1}').when(kind == 3, F.when(F.col("o_custkey") % 2 == 0, "{}")).when(kind == 4, some).otherwise("[1]")
    first = orders.select(F.col("o_orderkey").alias("edit"), F.when(F.col("o_orderkey") % 40 == 36, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("id"), text.alias("values"))
    second = orders.where("o_orderkey % 10 = 0").select((1_000_000_000_000 + F.col("o_orderkey")).alias("edit"), F.col("o_orderkey").alias("id"), F.lit('{"customer": "again"}').alias("values"))
    return I.edit_fields(D.documents(spark, sf), D.extracted_fields(spark, sf), D.field_definitions(spark), D.document_types(spark), D.runs(spark, sf), first.unionByName(second))


#: By order: k the kind, t the type, twice whether a second edit follows, far whether the first is for no document.
_EDITS = f"SELECT o_orderkey AS id, o_orderkey % 6 AS k, CASE WHEN o_orderkey % 20 = 7 THEN NULL ELSE 1 + o_orderkey % 3 END AS t, o_orderkey % 10 = 0 AS twice, o_orderkey % 40 = 36 AS far, o_totalprice, o_custkey, o_orderpriority FROM orders"
_HOLDS = f"SELECT e.*, CASE WHEN twice THEN 'again' WHEN k = 0 THEN 'whole' WHEN k = 3 THEN 'none' ELSE 'some' END AS kind FROM ({_EDITS}) e WHERE id IN (SELECT id FROM d_documents) AND t IS NOT NULL AND (twice OR (NOT far AND k IN (0, 3, 4)))"
_NEW = f"""SELECT id AS document_id, t * 100 + n AS field_definition_id, CAST(o AS BIGINT) AS order_no, v FROM (
  SELECT id, t, 6 AS n, 0 AS o, 'again' AS v FROM holds WHERE kind = 'again'
  UNION ALL SELECT id, t, 1, 0, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM holds WHERE kind = 'whole'
  UNION ALL SELECT id, t, 6, 0, 'by hand ' || o_custkey FROM holds WHERE kind = 'whole'
  UNION ALL SELECT id, t, 8, 0, 'one' FROM holds WHERE kind = 'whole'
  UNION ALL SELECT id, t, 8, 1, o_orderpriority FROM holds WHERE kind = 'whole'
  UNION ALL SELECT id, t, 2, 0, o_orderpriority FROM holds WHERE kind = 'some'
  UNION ALL SELECT id, t, 5, 0, CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END FROM holds WHERE kind = 'some') x"""


@query("g19_edit_refusals", oracle(f"""SELECT id AS edit, CASE WHEN far THEN -id ELSE id END AS id, field, code FROM (
  SELECT id, far, NULL AS field, CASE WHEN far OR id NOT IN (SELECT id FROM d_documents) THEN 'NotFound' WHEN t IS NULL THEN 'NotClassified' WHEN k = 5 THEN 'NotAnObject' END AS code FROM ({_EDITS})
  UNION ALL SELECT id, far, unnest(CASE k WHEN 1 THEN ['amount', 'note'] ELSE ['colour', 'legacy'] END), CASE k WHEN 1 THEN 'InvalidValue' ELSE 'Unknown' END FROM ({_EDITS}) WHERE k IN (1, 2) AND NOT far AND t IS NOT NULL AND id IN (SELECT id FROM d_documents)
) r WHERE code IS NOT NULL
UNION ALL SELECT 1000000000000 + id, id, NULL, CASE WHEN t IS NULL THEN 'NotClassified' ELSE 'NotFound' END FROM ({_EDITS}) WHERE twice AND (t IS NULL OR id NOT IN (SELECT id FROM d_documents))"""))
def g19_refusals(spark, sf):
    return _edited(spark, sf).refusals


@query("g19_edit_changes", oracle(f"""WITH holds AS (
  {_HOLDS}
), typed AS (
  {_NEW}
), before AS (
  SELECT document_id, field_definition_id, order_no, CASE field_definition_id % 100 WHEN 1 THEN CAST(CAST(number_value AS DECIMAL(18,2)) AS VARCHAR) WHEN 5 THEN CASE WHEN boolean_value THEN 'true' ELSE 'false' END ELSE text_value END AS v FROM d_extracted_fields WHERE document_id IN (SELECT id FROM holds)
)
SELECT coalesce(b.document_id, a.document_id) AS document_id, coalesce(b.field_definition_id, a.field_definition_id) AS field_definition_id, coalesce(b.order_no, a.order_no) AS order_no,
  CASE WHEN a.document_id IS NULL THEN 'Remove' WHEN b.document_id IS NULL THEN 'Add' WHEN a.v = b.v THEN 'Keep' ELSE 'Update' END AS action
FROM before b FULL JOIN typed a ON a.document_id = b.document_id AND a.field_definition_id = b.field_definition_id AND a.order_no = b.order_no"""))
def g19_changes(spark, sf):
    return _edited(spark, sf).changes


@query("g19_edited_documents", oracle(f"""WITH holds AS (
  {_HOLDS}
), flagged AS (
  SELECT d.id, is_container, type_code, kind, CASE WHEN kind = 'whole' THEN review_reasons & ~18 ELSE (review_reasons & ~16) | 2 END AS review_reasons FROM holds h JOIN d_documents d ON d.id = h.id JOIN d_document_types y ON y.id = h.t
)
SELECT f.id, type_code, review_reasons, CAST(CASE WHEN s0 = 90 OR s1 = 90 OR (NOT is_container AND s2 = 90) THEN 99 WHEN (review_reasons & 57) <> 0 THEN 25
  WHEN coalesce(s0 = 30, false) AND coalesce(s1 = 30, false) AND (is_container OR coalesce(s2 = 30, false)) THEN 30 ELSE 20 END AS BIGINT) AS lifecycle_status,
  CAST(CASE kind WHEN 'whole' THEN 3 WHEN 'again' THEN 1 WHEN 'some' THEN 2 ELSE 0 END AS BIGINT) AS field_count
FROM flagged f LEFT JOIN ({_LATEST}) l ON l.document_id = f.id"""))
def g19_documents(spark, sf):
    """Documents as the edits leave them, with their events."""
    edited = _edited(spark, sf)
    return edited.documents.select("id", "review_reasons", "lifecycle_status").join(edited.events, "id")
