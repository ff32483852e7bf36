"""What operators ask for on documents, many at once: pipelines to be run again, and fields typed in by hand.

A request that breaks a rule gets a code and changes nothing. Requests of one table count as made one after the other, by
their number, so the second of two equal ones meets the run that the first has queued.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import model as M
from vellumflow.functions import text as X
from vellumflow.functions import values as V
from vellumflow.operators import decisions as G
from vellumflow.operators import relations as R

#: The pipeline of a request that does not name one.
RERUNS = {"rerecognize": "classification", "reextract": "field-extraction"}


def reruns(docs: DataFrame, runs: DataFrame, requests: DataFrame) -> DataFrame:
    """request, id, pipeline, code, attempt: whether each pipeline may run again, and as which attempt.

    docs: id, is_deleted, document_type_id, markdown; requests: request (a number), id, action, pipeline. A retry needs a
    pipeline whose last run has failed: UnknownPipeline, NotFound, Deleted, NeverRan, InProgress and NotRetryable are the codes, the
    first that holds. Rerecognize and reextract only need that none is under way, and a text (NoText), reextract a type too
    (NoType), asked first. Other actions are UnknownAction. The code of an accepted request is null, and only those have an attempt.

    The first accepted request of a document and pipeline is a grouped minimum, so one document may have any number of them.
    """
    asked = requests.select("request", "id", "action", F.coalesce(_pipeline_of(F.col("action")), F.col("pipeline")).alias("pipeline"))
    state = docs.select("id", F.lit(True).alias("found"), "is_deleted", F.col("document_type_id").isNotNull().alias("typed"), (F.coalesce("markdown", F.lit("")) != "").alias("readable"))
    last = R.latest_runs(runs).select(F.col("document_id").alias("id"), "pipeline", F.col("attempt").alias("last_attempt"), "status")
    met = asked.join(state, "id", "left").join(last, ["id", "pipeline"], "left")
    again, extract = F.col("action") == "retry", F.col("action") == "reextract"
    under_way = F.col("status").isin(M.RUN_PENDING, M.RUN_RUNNING)
    fixed = (
        F.when(~F.coalesce(F.col("action").isin("retry", *RERUNS), F.lit(False)), "UnknownAction")
        .when(~F.coalesce(F.col("pipeline").isin(*M.PIPELINES), F.lit(False)), "UnknownPipeline")
        .when(F.col("found").isNull(), "NotFound")
        .when(F.col("is_deleted"), "Deleted")
        .when(extract & ~F.col("typed"), "NoType")
        .when(~again & ~F.col("readable"), "NoText")
    )
    verdict = F.nullif(R.retry_verdict(F.col("status")), F.lit("Ok"))
    by_run = F.when(again, verdict).when(under_way, "InProgress")
    judged = met.select("request", "id", "pipeline", "last_attempt", fixed.alias("fixed"), by_run.alias("by_run"))
    first = judged.where("fixed IS NULL AND by_run IS NULL").groupBy("id", "pipeline").agg(F.min("request").alias("first"))
    told = judged.join(first, ["id", "pipeline"], "left")
    queued = F.col("request") > F.col("first")
    code = F.coalesce("fixed", F.when(queued, "InProgress"), "by_run")
    return told.select("request", "id", "pipeline", code.alias("code"), F.when(code.isNull(), F.coalesce("last_attempt", F.lit(0)) + 1).alias("attempt"))


def _pipeline_of(action: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pipeline in RERUNS.items():
        out = F.when(action == name, pipeline).otherwise(out)
    return out


def queued_runs(judged: DataFrame) -> DataFrame:
    """document_id, pipeline, attempt, status: the pending runs of accepted requests, as reruns() judged them."""
    return judged.where("code IS NULL").select(F.col("id").alias("document_id"), "pipeline", "attempt", F.lit(M.RUN_PENDING).cast("long").alias("status"))


class Edited(NamedTuple):
    """What edits by hand come to; see edit_fields()."""

    refusals: DataFrame
    changes: DataFrame
    fields: DataFrame
    documents: DataFrame
    events: DataFrame


def _typed(value: Column) -> dict[str, Column]:
    """The typed columns of a field row whose value, a variant, fits data_type."""
    kind, text = F.col("data_type"), F.try_variant_get(value, "$", "string")
    return {
        "text_value": F.when(kind == "Text", text),
        "long_text_value": F.when(kind == "LongText", text),
        "number_value": F.when(kind == "Number", F.try_variant_get(value, "$", "decimal(38,6)")),
        "boolean_value": F.when(kind == "Boolean", F.try_variant_get(value, "$", "boolean")),
        "date_value": F.when(kind == "Date", text.try_cast("date")),
        "datetime_value": F.when(kind == "DateTime", text.try_cast("timestamp_ntz")),
    }


def edit_fields(docs: DataFrame, fields: DataFrame, definitions: DataFrame, types: DataFrame, runs: DataFrame, edits: DataFrame) -> Edited:
    """Replace the fields of documents by what operators typed in.

    edits: edit (a number), id, values: the text of a JSON object of values by field name, null for none. An edit is refused as
    a whole, with one row (edit, id, field, code) for each reason: NotFound, NotClassified, NotAnObject, and by field Unknown
    (no live field of the document's type has this name, letter by letter) and InvalidValue (see decisions.fits). Of a
    document's accepted edits the last one holds.

    changes: document_id, field_definition_id, order_no, action (Add, Update, Keep, Remove) by the typed values as text; fields:
    all field rows of the edited documents as they are then; documents: rows of edited documents, with the flag of missing fields as it
    is then, that of an incomplete extraction gone, and the lifecycle that follows from these and the runs; events: id,
    type_code and field_count, the number of fields with a value.
    """
    known = docs.select("id", F.lit(True).alias("found"), "document_type_id")
    parsed = X.once(F.try_parse_json(F.coalesce("values", F.lit("{}"))), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    met = edits.select("edit", "id", parsed.alias("object")).join(known, "id", "left")
    of_edit = F.when(F.col("found").isNull(), "NotFound").when(F.col("document_type_id").isNull(), "NotClassified").when(F.col("object").isNull(), "NotAnObject")
    judged = met.withColumn("code", of_edit)
    live = definitions.where("NOT is_deleted").select("document_type_id", F.col("name").alias("field"), F.col("id").alias("field_definition_id"), "data_type", F.coalesce("allow_multiple", F.lit(False)).alias("allow_multiple"))
    each = judged.where("code IS NULL").select("edit", "id", "document_type_id", F.explode(F.try_variant_get("object", "$", "map<string,variant>")).alias("field", "value")).join(live, ["document_type_id", "field"], "left")
    of_field = F.when(F.col("field_definition_id").isNull(), "Unknown").when(~G.fits(F.col("value"), F.col("data_type"), F.col("allow_multiple")), "InvalidValue")
    each = each.withColumn("code", of_field)
    refusals = judged.where("code IS NOT NULL").select("edit", "id", F.lit(None).cast("string").alias("field"), "code").unionByName(each.where("code IS NOT NULL").select("edit", "id", "field", "code"))

    fine = judged.where("code IS NULL").select("edit", "id").join(refusals.select("edit"), "edit", "left_anti")
    last = fine.groupBy("id").agg(F.max("edit").alias("edit"))
    values = each.join(last, ["edit", "id"], "left_semi")
    spread = F.when(F.col("allow_multiple"), F.try_variant_get("value", "$", "array<variant>")).otherwise(F.array("value"))
    rows = values.select(F.col("id").alias("document_id"), "field_definition_id", "data_type", F.posexplode(spread).alias("order_no", "v"))
    rows = rows.select("document_id", "field_definition_id", F.col("order_no").cast("long").alias("order_no"), *[c.alias(n) for n, c in _typed(F.col("v")).items()])

    key = ["document_id", "field_definition_id", "order_no"]
    old = fields.join(last.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    changes = R.reconcile(old.select(*key, V.cell_text().alias("value")), rows.select(*key, V.cell_text().alias("value")), key, "value").select(*key, "action")

    edited = docs.join(last.select("id"), "id", "left_semi")
    lacking = R.missing_required(edited, rows, definitions).select("id").distinct().withColumn("lacks", F.lit(True))
    flags = V.without_flag(F.col("review_reasons"), M.EXTRACTION_INCOMPLETE)
    flags = F.when(F.col("lacks"), V.with_flag(flags, M.MISSING_REQUIRED)).otherwise(V.without_flag(flags, M.MISSING_REQUIRED))
    flagged = edited.join(lacking, "id", "left").withColumn("review_reasons", flags).drop("lacks")
    derived = flagged.join(R.derive_lifecycle(flagged.select("id", "is_container", "review_reasons"), runs), "id")
    documents = derived.withColumn("lifecycle_status", F.col("derived_status")).select(*docs.columns)

    counts = rows.groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("field_definition_id").alias("n"))
    code_of = types.select(F.col("id").alias("document_type_id"), "type_code")
    events = edited.select("id", "document_type_id").join(code_of, "document_type_id", "left").join(counts, "id", "left").select("id", "type_code", F.coalesce("n", F.lit(0)).cast("long").alias("field_count"))
    return Edited(refusals, changes, rows, documents, events)
