"""Decisions around model calls, and streams, as registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellumflow.functions import model as M
from vellumflow.functions import text as X
from vellumflow.operators import decisions as G
from vellumflow.operators import relations as R
from vellumflow.operators import search as S
from vellumflow.plans.registry import query
from vellumflow.plans.relation_queries import _PRINTS, _printed
from vellumflow.sources import derived as D
from vellumflow.sources.derived import oracle
from vellumflow.streaming import events as E


def _classified(spark, sf):
    rows = D.classification(spark, sf).withColumns({"is_container": F.col("doc_id") % 23 == 0, "is_derived": F.col("doc_id") % 5 == 0, "review_reasons": F.col("doc_id") % 64})
    return G.route(rows, D.document_types(spark))


_ROUTED = "SELECT doc_id, type_id, confidence, doc_id % 64 AS review_reasons, CASE WHEN doc_id % 23 = 0 AND doc_id % 5 <> 0 THEN 'Container' WHEN confidence BETWEEN 0 AND 1 AND confidence >= 0.7 THEN 'Classified' ELSE 'Review' END AS outcome FROM d_classification"


@query("g1_route", oracle(f"SELECT doc_id, outcome FROM ({_ROUTED})"))
def g1(spark, sf):
    return _classified(spark, sf).select("doc_id", "outcome")


@query("g2_apply_route", oracle(f"SELECT doc_id, CASE WHEN outcome = 'Classified' THEN type_id END AS document_type_id, CASE WHEN outcome = 'Classified' THEN confidence ELSE 0 END AS classification_confidence, CASE outcome WHEN 'Classified' THEN review_reasons & ~1 WHEN 'Container' THEN review_reasons & ~3 ELSE (review_reasons & ~42) | 1 END AS review_reasons, outcome <> 'Classified' AS fields_cleared FROM ({_ROUTED})"))
def g2(spark, sf):
    return G.apply_route(_classified(spark, sf)).select("doc_id", "document_type_id", "classification_confidence", "review_reasons", "fields_cleared")


@query("g3_low_confidence", oracle(f"SELECT doc_id FROM ({_ROUTED}) WHERE outcome = 'Review'"))
def g3(spark, sf):
    return G.apply_route(_classified(spark, sf)).where("outcome = 'Review' AND document_type_id IS NULL").select("doc_id")


@query("g4_segmentation_rule", oracle(f"SELECT doc_id, doc_id % 5 <> 0 AND (outcome = 'Container' OR doc_id % 7 = 0) AS needs FROM ({_ROUTED})"))
def g4(spark, sf):
    return _classified(spark, sf).select("doc_id", G.needs_segmentation(F.col("outcome"), F.col("is_derived"), F.col("doc_id") % 7 == 0).alias("needs"))


@query("g5_oversized", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN (doc_id % 64) | 16 ELSE doc_id % 64 END AS flags FROM documents")
def g5(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", G.decline_oversized(F.col("text"), F.col("doc_id") % 64, 2000).alias("flags"))


@query("g6_flags_after_extraction", oracle(f"""SELECT d.id, ((d.review_reasons & ~58) | CASE WHEN EXISTS (SELECT 1 FROM d_field_definitions f WHERE f.document_type_id = d.document_type_id AND f.is_required AND NOT EXISTS (SELECT 1 FROM d_extracted_fields v WHERE v.document_id = d.id AND v.field_definition_id = f.id)) THEN 2 ELSE 0 END
 | CASE WHEN count(*) FILTER (NOT d.is_deleted) OVER (PARTITION BY d.tenant_id, d.document_type_id, p.fingerprint) > 1 AND p.fingerprint IS NOT NULL AND NOT d.is_deleted THEN 8 ELSE 0 END | CASE WHEN d.id % 6 = 0 THEN 32 ELSE 0 END) AS review_reasons FROM d_documents d JOIN ({_PRINTS}) p ON p.id = d.id"""))
def g6(spark, sf):
    docs, fields, definitions = D.documents(spark, sf), D.extracted_fields(spark, sf), D.field_definitions(spark)
    printed = docs.join(R.fingerprints(docs, fields, definitions), "id")
    return G.flags_after_extraction(docs, R.missing_required(docs, fields, definitions), R.duplicate_candidates(printed.where(~F.col("is_deleted"))), docs.where("id % 6 = 0"))


@query("g7_types_without_fields", oracle("SELECT id FROM d_documents WHERE document_type_id IS NOT NULL AND document_type_id <> 2"))
def g7(spark, sf):
    with_fields = D.field_definitions(spark).where("document_type_id = 2").select("document_type_id").distinct()
    return D.documents(spark, sf).where("document_type_id IS NOT NULL").join(with_fields, "document_type_id", "left_anti").select("id")


_SUBS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, regexp_replace('## Turn ' || turn || chr(10) || text, '^\\s+|\\s+$', '', 'g') AS text, role FROM conversations WHERE conv_id % 2 = 0"
_SEGMENTS = f"SELECT conv_id, ordinal, sha256(text) AS segment_key, text FROM ({_SUBS}) WHERE role <> 'system' QUALIFY count(*) OVER (PARTITION BY conv_id) BETWEEN 2 AND 50"


@query("g8_segments", _SEGMENTS)
def g8(spark, sf):
    return G.segment(D.bundles(spark, sf))


_CUT_OUT = "SELECT conv_id * 100 + ordinal AS id, CASE WHEN ordinal % 5 = 4 THEN conv_id + 2 WHEN ordinal % 5 < 3 THEN conv_id END AS origin_document_id, CASE ordinal % 4 WHEN 3 THEN '' ELSE segment_key END AS origin_key"


@query("j7_segment_seeds", f"WITH cut AS ({_SEGMENTS}) SELECT c.id, s.text AS seed FROM ({_CUT_OUT} FROM cut) c LEFT JOIN (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY conv_id, segment_key ORDER BY ordinal) = 1) s ON s.conv_id = c.origin_document_id AND s.segment_key = c.origin_key")
def j7_seeds(spark, sf):
    """Documents cut out of containers: some without origin, some of another one, some without a key."""
    segments = G.segment(D.bundles(spark, sf))
    return G.seed_texts(spark.sql(_CUT_OUT + " FROM {cut}", cut=segments), segments).select("id", "seed")


@query("g9_new_segments", f"SELECT conv_id, ordinal FROM ({_SEGMENTS}) WHERE ordinal % 2 = 1")
def g9(spark, sf):
    segments = G.segment(D.bundles(spark, sf))
    return G.new_segments(segments, segments.where("ordinal % 2 = 0")).select("conv_id", "ordinal")


@query("g10_incomplete", f"SELECT c.conv_id, s.conv_id IS NULL AS incomplete FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0) c LEFT JOIN (SELECT DISTINCT conv_id FROM ({_SEGMENTS})) s ON s.conv_id = c.conv_id")
def g10(spark, sf):
    bundles = D.bundles(spark, sf)
    return G.segmentation_incomplete(bundles, G.segment(bundles))


@query("g11_retract_children", oracle("SELECT id FROM d_documents WHERE origin_document_id IN (SELECT id FROM d_documents WHERE is_container) AND id % 4 <> 1 AND NOT is_deleted"))
def g11(spark, sf):
    docs = D.documents(spark, sf)
    boxes = docs.where("is_container").select(F.col("id").alias("origin_document_id"))
    return docs.where("id % 4 <> 1 AND NOT is_deleted").join(boxes, "origin_document_id", "left_semi").select("id")


@query("g12_cabinet", oracle("SELECT id, coalesce(cabinet_id, CASE WHEN id % 8 BETWEEN 1 AND 5 AND (id % 10) / 10.0 >= 0.6 THEN id % 8 END) AS cabinet FROM d_documents"))
def g12(spark, sf):
    return D.documents(spark, sf).select("id", G.suggest_cabinet(F.col("cabinet_id"), F.col("id") % 8, (F.col("id") % 10) / 10, F.lit(5)).alias("cabinet"))


@query("g13_reprocess_batches", oracle("SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS batch FROM d_documents WHERE tenant_id IS NULL AND NOT is_deleted AND document_type_id = 3"))
def g13(spark, sf):
    return S.batches(S.to_reprocess(S.scope(D.documents(spark, sf)), type_id=3), 100)


@query("f16_duplicate_basis", oracle(f"""WITH prints AS ({_PRINTS}
)
SELECT d.id, d.is_deleted FROM d_documents d JOIN prints p ON p.id = d.id WHERE d.document_type_id = 1 AND (p.fingerprint IS NOT NULL OR (d.review_reasons & 8) <> 0)"""))
def f16(spark, sf):
    return R.duplicate_basis(_printed(spark, sf), 1).select("id", "is_deleted")


@query("g14_cleanup", oracle("SELECT id, CASE WHEN document_type_id = 1 THEN review_reasons & ~8 ELSE review_reasons END AS review_reasons FROM d_documents WHERE (review_reasons & 8) <> 0"))
def g14(spark, sf):
    suspected = D.documents(spark, sf).where("(review_reasons & 8) <> 0")
    return G.clear_duplicate_flag(suspected, D.field_definitions(spark).where("document_type_id <> 1"))


@query("g14_warnings", oracle("SELECT d.id, CASE WHEN EXISTS (SELECT 1 FROM d_extracted_fields f WHERE f.document_id = d.id AND f.field_definition_id = 109) AND NOT EXISTS (SELECT 1 FROM d_extracted_fields f WHERE f.document_id = d.id AND f.field_definition_id = 106) THEN review_reasons & ~32 ELSE review_reasons END AS review_reasons FROM d_documents d"))
def g14_warnings(spark, sf):
    """Values of two fields as warnings, of which one field goes."""
    warnings = D.extracted_fields(spark, sf, (6, 9)).select(F.col("document_id").alias("id"), "field_definition_id")
    return G.drop_warnings(D.documents(spark, sf), warnings, 109)[0]


@query("g15_change_guard", oracle("SELECT id, EXISTS (SELECT 1 FROM d_extracted_fields f WHERE f.field_definition_id = d.id) AND (name = 'amount' OR allow_multiple) AS blocked FROM d_field_definitions d"))
def g15(spark, sf):
    used = D.extracted_fields(spark, sf).select(F.col("field_definition_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    return D.field_definitions(spark).join(used, "id", "left").select("id", (F.coalesce("_used", F.lit(False)) & ((F.col("name") == "amount") | F.col("allow_multiple"))).alias("blocked"))


@query("g16_type_in_use", oracle("SELECT t.id, EXISTS (SELECT 1 FROM d_documents d WHERE d.document_type_id = t.id) AS in_use FROM d_document_types t"))
def g16(spark, sf):
    used = D.documents(spark, sf).select(F.col("document_type_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    return D.document_types(spark).join(used, "id", "left").select("id", F.coalesce("_used", F.lit(False)).alias("in_use"))


@query("g17_review_actions", oracle("SELECT id, CASE id % 3 WHEN 0 THEN 30 WHEN 1 THEN 20 ELSE review_disposition END AS review_disposition, CASE WHEN id % 3 = 0 THEN 99 ELSE lifecycle_status END AS lifecycle_status, CASE id % 3 WHEN 1 THEN review_reasons & ~1 WHEN 2 THEN review_reasons & ~8 ELSE review_reasons END AS review_reasons FROM d_documents"))
def g17(spark, sf):
    docs = D.documents(spark, sf)
    parts = [G.review(docs.where(F.col("id") % 3 == k), action) for k, action in enumerate(("reject", "confirm", "allow_duplicate"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "review_disposition", "lifecycle_status", "review_reasons")


@query("g18_reject_code", oracle("SELECT id, CASE WHEN is_deleted THEN 'Deleted' WHEN lifecycle_status = 20 THEN 'InProgress' WHEN document_type_id IS NULL THEN 'NoType' END AS code FROM d_documents"))
def g18(spark, sf):
    docs = D.documents(spark, sf)
    return docs.select("id", G.reject_code(docs).alias("code"))


@query("g19_manual_edit", oracle("SELECT coalesce(a.document_id, b.document_id) AS id, CASE WHEN b.document_id IS NULL THEN 'Remove' WHEN a.document_id IS NULL THEN 'Add' WHEN a.text_value = b.v THEN 'Keep' ELSE 'Update' END AS action FROM (SELECT document_id, text_value FROM d_extracted_fields WHERE field_definition_id = 106) a FULL JOIN (SELECT document_id, CASE WHEN document_id % 2 = 0 THEN text_value ELSE lower(text_value) END AS v FROM d_extracted_fields WHERE field_definition_id = 102 AND document_id % 5 <> 0) b ON a.document_id = b.document_id"))
def g19(spark, sf):
    fields = D.extracted_fields(spark, sf)
    old = fields.where("field_definition_id = 106").select(F.col("document_id").alias("id"), F.col("text_value").alias("value"))
    new = fields.where("field_definition_id = 102 AND document_id % 5 <> 0").select(F.col("document_id").alias("id"), F.when(F.col("document_id") % 2 == 0, F.col("text_value")).otherwise(F.lower("text_value")).alias("value"))
    return R.reconcile(old, new, ["id"], "value").select("id", "action")


@query("g_model_call", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' ELSE 'prose' END AS answer FROM documents")
def g_model(spark, sf):
    def rules(prompts):
        return ["license" if "license" in p.lower() else "prose" for p in prompts]

    return G.call_model(D.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt")), "prompt", "answer", rules).select("doc_id", "answer")


@query("t5_warnings", "SELECT user_id AS id, event_type AS field, arg_min(event_type || event_id || '!', event_id) AS message FROM events WHERE event_type <> 'view' AND event_id % 7 > 1 GROUP BY ALL")
def t5_warnings(spark, sf):
    """Each event is a warning of its user's answer; some are blank, some no texts, and one kind is about a field that is not declared."""
    events = D.table(spark, sf, "events")
    message = F.when(F.col("event_id") % 7 == 0, '" "').when(F.col("event_id") % 7 == 1, "17").otherwise(F.concat(F.lit('" '), F.col("event_type"), F.col("event_id"), F.lit('! "')))
    warning = F.struct("event_id", F.concat(F.lit('{"fieldName": "'), F.col("event_type"), F.lit('", "message": '), message, F.lit("}")).alias("w"))
    json = F.concat(F.lit('{"validationWarnings": ['), F.array_join(F.transform(F.array_sort(F.collect_list(warning)), lambda x: x["w"]), ","), F.lit("]}"))
    answers = events.groupBy(F.col("user_id").alias("id")).agg(json.alias("json")).select("id", F.lit(1).alias("document_type_id"), G.parse_answer(F.col("json")).alias("answer"))
    declared = events.where("event_type <> 'view'").select(F.lit(1).alias("document_type_id"), F.col("event_type").alias("name"))
    return G.warnings_of(answers, declared)


@query("x1_absorbed", "SELECT DISTINCT user_id AS document_id, event_type, ts AS event_time FROM events")
def x1(spark, sf):
    """Redelivered under other ids, and each once."""
    rows = E.collect_stream(E.absorb(E.read_events(spark, sf)), "append", "absorbed")
    return rows.select("document_id", "event_type", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


@query("k4_event_sink", "SELECT user_id AS document_id, event_type, ts AS event_time, CAST(ts AS DATE) AS day FROM events GROUP BY ALL")
def k4(spark, sf):
    """All events delivered twice by two streams, into a table that has each once."""
    base = f"{E.shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    for delivery in ("first", "again"):
        E.deliver(E.read_events(spark, sf), f"{base}/table", f"{base}/{delivery}")
    return spark.read.parquet(f"{base}/table").select("document_id", "event_type", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "day")


@query("x2_current_only", oracle("SELECT event_id, e.user_id AS document_id FROM events e WHERE event_type = 'purchase' AND user_id IN (SELECT id FROM d_documents WHERE lifecycle_status = 30 AND NOT is_container)"))
def x2(spark, sf):
    live = E.current_only(E.read_events(spark, sf, None), D.documents(spark, sf), "purchase", M.READY)
    return E.collect_stream(live, "append", "current").select("event_id", "document_id")


#: Events as changes of runs: a run per day and pipeline, and every seventh event of another run with the same number.
_CHANGES = """SELECT event_id, user_id AS document_id, ['text-extraction', 'classification', 'field-extraction'][event_id % 3 + 1] AS pipeline, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS attempt,
    CASE WHEN event_id % 7 = 0 THEN -CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) ELSE CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) END AS run_id,
    CASE event_type WHEN 'signup' THEN 10 WHEN 'view' THEN 20 WHEN 'purchase' THEN 30 WHEN 'error' THEN 90 ELSE 95 END AS status, ts FROM events"""


@query("x3_run_states", f"""WITH changes AS ({_CHANGES}),
owned AS (SELECT *, first_value(run_id) OVER (PARTITION BY document_id, pipeline, attempt ORDER BY ts, event_id) AS owner FROM changes),
own AS (SELECT *, row_number() OVER (PARTITION BY document_id, pipeline ORDER BY ts DESC, event_id DESC) AS back FROM owned WHERE run_id = owner)
SELECT o.document_id, o.pipeline, count(DISTINCT o.attempt) AS attempts, max(o.attempt) AS attempt, max(run_id) FILTER (back = 1) AS run_id, CAST(max(o.status) FILTER (back = 1) AS BIGINT) AS status, count(*) FILTER (o.status = 90) AS failed,
    (SELECT count(*) FROM owned c WHERE c.document_id = o.document_id AND c.pipeline = o.pipeline AND c.run_id <> c.owner) AS collisions, CAST(0 AS BIGINT) AS stale FROM own o GROUP BY o.document_id, o.pipeline""")
def x3(spark, sf):
    attempt = F.date_diff(F.to_date("event_time"), F.lit("2024-01-01").cast("date")).cast("long") + 1
    status = F.expr("case event_type when 'signup' then 10 when 'view' then 20 when 'purchase' then 30 when 'error' then 90 else 95 end").cast("long")
    changes = E.read_events(spark, sf, None).select(
        "event_id", "document_id", "event_time", status.alias("status"), attempt.alias("attempt"),
        F.element_at(F.array(*map(F.lit, M.PIPELINES)), (F.col("event_id") % 3 + 1).cast("int")).alias("pipeline"),
        F.when(F.col("event_id") % 7 == 0, -attempt).otherwise(attempt).alias("run_id"),
    )
    return E.latest(E.collect_stream(E.run_states(changes), "update", "states"), "document_id", "pipeline")


@query("x4_rate_limit", "SELECT user_id AS document_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS requests, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY ALL")
def x4(spark, sf):
    rows = E.rate(E.read_events(spark, sf, None), limit=2, width="1 day", watermark="1 hour")
    last = E.latest(E.collect_stream(rows, "update", "rates"), "document_id", "window_start")
    return last.select("document_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests", "rejected")


@query("t35_draft_field", """SELECT event_id, CASE WHEN k = 5 THEN '' ELSE 'Field ' || event_type END AS display_name, CASE WHEN k = 5 OR event_id % 2 = 1 THEN '' ELSE 'field_' || event_type END AS name,
    CASE k WHEN 0 THEN 'Number' WHEN 2 THEN 'Date' WHEN 3 THEN 'LongText' ELSE 'Text' END AS data_type, k IN (0, 1, 2) AS is_required, k IN (1, 4) AS allow_multiple FROM (SELECT event_id, event_type, event_id % 6 AS k FROM events)""")
def t35(spark, sf):
    """Answers with JSON booleans, texts and numbers for flags, odd type names, and no JSON at all."""
    rest = F.element_at(F.array(*[F.lit(x) for x in (
        '"dataType": " NUMBER ", "isRequired": true, "allowMultiple": true}',
        '"dataType": "text", "isRequired": "TRUE", "allowMultiple": 1}',
        '"dataType": "date", "isRequired": 2.5, "allowMultiple": "true"}',
        '"dataType": "LongText", "isRequired": "1", "allowMultiple": null}',
        '"dataType": 7, "isRequired": 0, "allowMultiple": true}',
        '"dataType": "text", "isRequired": true',
    )]), (F.col("event_id") % 6 + 1).cast("int"))
    answer = F.concat(F.lit(' {"displayName": "Field\\n'), F.col("event_type"), F.lit('", "name": "Field '), F.col("event_type"), F.lit('!", '), rest)
    draft = G.draft_field(answer, F.col("event_id") % 2 == 0)
    return D.table(spark, sf, "events").select("event_id", draft.alias("d")).select("event_id", "d.*")
