"""Decision logic around model calls, as column rewrites and relations. The model itself is a callable of the user's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions import model as M
from vellumflow.functions import text as X
from vellumflow.functions import values as V
from vellumflow.operators.graph import unused


def call_model(rows: DataFrame, prompt: str, answer: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds the answers of a model that takes and gives lists of texts; called once per Arrow batch."""
    schema = T.StructType([*rows.schema.fields, T.StructField(answer, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{answer: model(batch[prompt].tolist())})

    return rows.mapInPandas(run, schema)


def route(docs: DataFrame, types: DataFrame) -> DataFrame:
    """Adds outcome: Container, Classified or Review, from is_container, is_derived, type_id and confidence."""
    key, least = unused(docs, "of_type"), unused(docs, "least")
    known = types.select(F.col("id").alias(key), F.col("threshold").alias(least))
    confidence = V.normal_confidence(F.col("confidence"))
    sure = F.coalesce(confidence >= F.col(least), F.lit(False))
    outcome = F.when(F.col("is_container") & ~F.col("is_derived"), "Container").when(sure, "Classified").otherwise("Review")
    return docs.join(known, F.col("type_id") == F.col(key), "left").withColumn("outcome", outcome).drop(key, least)


def apply_route(docs: DataFrame) -> DataFrame:
    """State after classification: type and confidence kept or cleared, the unresolved flag set or cleared, containers marked."""
    flags = F.col("review_reasons")
    done, box = F.col("outcome") == "Classified", F.col("outcome") == "Container"
    review = V.with_flag(V.without_flag(flags, M.MISSING_REQUIRED | M.DUPLICATE | M.WARNING), M.UNRESOLVED)
    return docs.withColumns(
        {
            "document_type_id": F.when(done, F.col("type_id")),
            "classification_confidence": F.when(done, V.normal_confidence(F.col("confidence"))).otherwise(F.lit(0.0)),
            "review_reasons": F.when(done, V.without_flag(flags, M.UNRESOLVED)).when(box, V.without_flag(flags, M.UNRESOLVED | M.MISSING_REQUIRED)).otherwise(review),
            "fields_cleared": ~done,
        }
    )


def needs_segmentation(outcome: Column, is_derived: Column, has_figures: Column) -> Column:
    """Containers are cut into documents; others only for figures inside, and never a derived document."""
    return ~is_derived & ((outcome == "Container") | has_figures)


def decline_oversized(text: Column, flags: Column, most: int = M.EXTRACT_CHARS) -> Column:
    """Review flags with extraction-incomplete set for a text too long to extract from."""
    return F.when(F.char_length(text) > most, V.with_flag(flags, M.EXTRACTION_INCOMPLETE)).otherwise(flags)


#: Numbers from here on have no exact decimal form.
DECIMAL_LIMIT = 79_228_162_514_264_337_593_543_950_335


def _kind(value: Column) -> Column:
    """The JSON kind of a variant, as Spark names it: STRING, BOOLEAN, BIGINT, DECIMAL(p,s), DOUBLE, ARRAY<..>, OBJECT<..>, VOID."""
    return F.schema_of_variant(value)


def _fits(value: Column, data_type: Column) -> Column:
    """Whether one JSON value, as a variant, is of the type: its kind must agree, nothing is converted."""
    kind = _kind(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.abs(F.try_variant_get(value, "$", "double")) <= F.lit(float(DECIMAL_LIMIT)))
    day = text.rlike(r"^(?!0000)\d{4}-\d\d-\d\d\z") & text.try_cast("date").isNotNull()
    moment = text.rlike(r"^(?!0000)\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?)?\z") & text.try_cast("timestamp_ntz").isNotNull()
    fits = F.when(data_type == "Text", F.char_length(text) <= M.TEXT_LIMIT).when(data_type == "LongText", F.char_length(text) <= M.LONG_TEXT_LIMIT)
    fits = fits.when(data_type == "Number", number).when(data_type == "Boolean", kind == "BOOLEAN").when(data_type == "Date", day).when(data_type == "DateTime", moment)
    return F.coalesce(fits, F.lit(False))


def fits(value: Column, data_type: Column, allow_multiple: Column) -> Column:
    """Whether a JSON value, as a variant, may stand in a field: one value of the field's type or, where it takes several, an array of at most VALUES_LIMIT of them.

    Dates are yyyy-MM-dd; times are ISO dates with or without a time of day, never with an offset. A null value or type fits nothing.
    """
    many = F.try_variant_get(value, "$", "array<variant>")
    all_of = X.once(F.when(_kind(value).startswith("ARRAY"), many), lambda vs: (F.size(vs) <= M.VALUES_LIMIT) & F.forall(vs, lambda v: v.isNotNull() & _fits(v, data_type)))
    return F.coalesce(F.when(allow_multiple, all_of).otherwise(X.once(value, lambda v: _fits(v, data_type))), F.lit(False))


def valid_value(json: Column, data_type: Column, allow_multiple: Column | bool = False) -> Column:
    """The JSON text of a value if it may stand in a field (see fits()), else null. What is no JSON is not valid."""
    multiple = F.lit(allow_multiple) if isinstance(allow_multiple, bool) else allow_multiple
    return X.once(F.try_parse_json(json), lambda v: F.when(fits(v, data_type, multiple), F.to_json(v)))


def parse_answer(json: Column) -> Column:
    """A model's answer {"values": {name: value}, "validationWarnings": [{"fieldName", "message"}]} as struct (values: map of variants, warnings: array of variants).

    Both halves are read on their own: one that is missing or of another kind is null, and so are both if the text is no JSON object.
    """
    def halves(root: Column) -> Column:
        values, warnings = F.try_variant_get(root, "$.values", "variant"), F.try_variant_get(root, "$.validationWarnings", "variant")
        return F.struct(
            F.when(_kind(values).startswith("OBJECT"), F.try_variant_get(root, "$.values", "map<string,variant>")).alias("values"),
            F.when(_kind(warnings).startswith("ARRAY"), F.try_variant_get(root, "$.validationWarnings", "array<variant>")).alias("warnings"),
        )

    return X.once(F.try_parse_json(json), halves)


def typed_answers(answers: DataFrame, definitions: DataFrame, id_col: str = "id", type_col: str = "document_type_id", answer: str = "answer") -> DataFrame:
    """id, field, value: a row for every declared field of each answer's document type, with the JSON text of its value.

    definitions: document_type_id, name, data_type, allow_multiple. The value is null where the answer has none, or one that may
    not stand in the field. Fields that are not declared are left out.
    """
    dims = definitions.select(F.col("document_type_id").alias(type_col), F.col("name").alias("field"), "data_type", F.coalesce("allow_multiple", F.lit(False)).alias("allow_multiple"))
    rows = answers.select(id_col, type_col, F.col(f"{answer}.values").alias("values")).join(dims, type_col)
    value = X.once(F.try_element_at("values", F.col("field")), lambda v: F.when(fits(v, F.col("data_type"), F.col("allow_multiple")), F.to_json(v)))
    return rows.select(id_col, "field", value.alias("value"))


def warnings_of(answers: DataFrame, definitions: DataFrame, id_col: str = "id", type_col: str = "document_type_id", answer: str = "answer") -> DataFrame:
    """id, field, message: warnings about declared fields of the answer's document type: both parts JSON texts, the message not blank and cut; the first of each field, at most WARNINGS_LIMIT."""
    text = lambda name: F.when(_kind(F.try_variant_get("w", f"$.{name}", "variant")) == "STRING", F.try_variant_get("w", f"$.{name}", "string"))
    rows = answers.select(id_col, type_col, F.posexplode(F.col(f"{answer}.warnings")).alias("place", "w"))
    rows = rows.select(id_col, type_col, "place", text("fieldName").alias("field"), X.strip(text("message")).alias("message")).where("message <> ''")
    declared = definitions.select(F.col("document_type_id").alias(type_col), F.col("name").alias("field")).distinct()
    first = rows.join(declared, [type_col, "field"], "left_semi").groupBy(id_col, "field").agg(F.min_by("message", "place").alias("message"), F.min("place").alias("place"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("place"))).where(F.col("n") <= M.WARNINGS_LIMIT)
    return first.select(id_col, "field", X.cut(F.col("message"), M.WARNING_TEXT_LIMIT).alias("message"))


def expand_values(rows: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """keep, order_no, value: one row per element of a JSON array, or one for a single value."""
    many = F.from_json(F.col(json), "array<string>")
    return rows.select(*keep, F.posexplode(F.when(F.startswith(F.trim(F.col(json)), F.lit("[")), many).otherwise(F.array(F.col(json)))).alias("order_no", "value"))


def segment(bundles: DataFrame, most: int = M.SEGMENTS_LIMIT) -> DataFrame:
    """conv_id, ordinal, segment_key, text: sub-documents of containers, and figures of any bundle; nothing where the cut fails.

    A figure's text is what stands between its marks; other texts lose the lines of such marks. A cut fails if a marker is
    missing, if two sub-documents are equal, if there are more than most, or fewer than two in a container.
    """
    clean = lambda s: F.when(s["is_figure"], X.ocr_bodies(s["text"])).otherwise(X.strip_ocr(s["text"]))
    least = F.when(F.col("is_container"), 2).otherwise(1)

    def wanted(slices: Column) -> Column:
        subs = F.filter(slices, lambda s: s["is_sub_document"] & (F.col("is_container") | s["is_figure"]))
        return F.transform(subs, lambda s: X.once(clean(s), lambda t: F.struct(s["ordinal"].alias("ordinal"), F.sha2(t, 256).alias("key"), t.alias("text"))))

    def whole(subs: Column) -> Column:
        return F.when(F.size(subs).between(least, F.lit(most)) & (F.size(F.array_distinct(F.transform(subs, lambda s: s["key"]))) == F.size(subs)), subs)

    found = X.once(X.once(X.slices(F.col("markdown"), F.col("markers")), wanted), whole)
    return bundles.select("conv_id", F.explode(found).alias("s")).select("conv_id", "s.ordinal", F.col("s.key").alias("segment_key"), "s.text")


def segmentation_incomplete(bundles: DataFrame, segments: DataFrame) -> DataFrame:
    """conv_id, incomplete: containers without segments."""
    have = segments.select("conv_id").distinct().withColumn("_have", F.lit(True))
    return bundles.where("is_container").select("conv_id").join(have, "conv_id", "left").select("conv_id", F.col("_have").isNull().alias("incomplete"))


def new_segments(segments: DataFrame, existing: DataFrame) -> DataFrame:
    """Segments whose (source, key) has not been spawned yet: running twice spawns nothing twice."""
    return segments.join(existing.select("conv_id", "segment_key"), ["conv_id", "segment_key"], "left_anti")


def seed_texts(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """docs with seed: the text that a derived document was cut out with, by origin_document_id and origin_key.

    Null where the document is not derived, has no key or an empty one, or where its source has no such segment or an empty one:
    such a document is read in the ordinary way. Of segments with one key the first by ordinal counts, so no document is doubled.
    """
    source, key, seed = unused(docs, "source"), unused(docs, "key"), unused(docs, "seed")
    first = segments.groupBy(F.col("conv_id").alias(source), F.col("segment_key").alias(key)).agg(F.min_by("text", "ordinal").alias(seed))
    cut_from = (F.col("origin_document_id") == F.col(source)) & (F.col("origin_key") == F.col(key)) & (F.col("origin_key") != "")
    joined = docs.join(first, cut_from, "left")
    return joined.select(*docs.columns, F.nullif(F.col(seed), F.lit("")).alias("seed"))


def suggest_cabinet(cabinet: Column, index: Column, confidence: Column, count: Column, least: float = M.CABINET_CONFIDENCE) -> Column:
    """The suggested cabinet, if none is set, the index exists and the confidence suffices."""
    fine = index.between(1, count) & (V.normal_confidence(confidence) >= least)
    return F.coalesce(cabinet, F.when(fine, index))


def reject_code(docs: DataFrame) -> Column:
    """Why a document cannot be extracted again: Deleted, InProgress, NoType, NoText, or null."""
    return F.when(F.col("is_deleted"), "Deleted").when(F.col("lifecycle_status") == M.PROCESSING, "InProgress").when(F.col("document_type_id").isNull(), "NoType").when(F.coalesce(F.col("title"), F.lit("")) == "", "NoText")


def review(docs: DataFrame, action: str, type_id: int | None = None) -> DataFrame:
    """A reviewer's action on documents: confirm, reclassify, reject, allow_duplicate or resolve_warnings."""
    flags = F.col("review_reasons")
    if action in ("confirm", "reclassify"):
        changes = {"review_disposition": F.lit(M.CONFIRMED).cast("long"), "review_reasons": V.without_flag(flags, M.UNRESOLVED)}
        if action == "reclassify":
            changes["document_type_id"] = F.lit(type_id).cast("long")
        return docs.withColumns(changes)
    if action == "reject":
        return docs.withColumns({"review_disposition": F.lit(M.REJECTED).cast("long"), "lifecycle_status": F.lit(M.FAILED).cast("long")})
    masks = {"allow_duplicate": M.DUPLICATE, "resolve_warnings": M.WARNING}
    if action not in masks:
        raise ValueError(f"unknown action {action}")
    return docs.withColumn("review_reasons", V.without_flag(flags, masks[action]))


def flags_after_extraction(docs: DataFrame, missing: DataFrame, duplicates: DataFrame, warned: DataFrame) -> DataFrame:
    """id, review_reasons after a result is applied: missing-required, duplicate and warning flags as found, incomplete cleared."""
    mark = lambda rows, name: rows.select("id").distinct().withColumn(name, F.lit(True))
    rows = docs.select("id", "review_reasons").join(mark(missing, "_m"), "id", "left").join(mark(duplicates, "_d"), "id", "left").join(mark(warned, "_w"), "id", "left")
    flags = V.without_flag(F.col("review_reasons"), M.MISSING_REQUIRED | M.DUPLICATE | M.WARNING | M.EXTRACTION_INCOMPLETE)
    for name, bit in (("_m", M.MISSING_REQUIRED), ("_d", M.DUPLICATE), ("_w", M.WARNING)):
        flags = F.when(F.col(name), V.with_flag(flags, bit)).otherwise(flags)
    return rows.select("id", flags.alias("review_reasons"))


def drop_warnings(docs: DataFrame, warnings: DataFrame, field_definition_id: int) -> tuple[DataFrame, DataFrame]:
    """(id, review_reasons of all documents, warnings that stay) once a field is gone: documents without any warning left lose the flag.

    warnings: id, field_definition_id. Deleted documents are cleaned as well, so that none comes back with the flag.
    """
    stay = warnings.where(F.col("field_definition_id") != field_definition_id)
    touched = warnings.where(F.col("field_definition_id") == field_definition_id).select("id").distinct()
    free = touched.join(stay.select("id"), "id", "left_anti").withColumn("_free", F.lit(True))
    rows = docs.select("id", "review_reasons").join(free, "id", "left")
    return rows.select("id", F.when(F.col("_free"), V.without_flag(F.col("review_reasons"), M.WARNING)).otherwise(F.col("review_reasons")).alias("review_reasons")), stay


def clear_duplicate_flag(docs: DataFrame, definitions: DataFrame) -> DataFrame:
    """id, review_reasons: suspected duplicates of types without any unique-key field left lose the flag; untyped documents keep it."""
    keyed = definitions.where("is_unique_key AND NOT is_deleted").select("document_type_id").distinct().withColumn("_keyed", F.lit(True))
    rows = docs.select("id", "document_type_id", "review_reasons").join(keyed, "document_type_id", "left")
    keep = F.col("_keyed") | F.col("document_type_id").isNull()
    return rows.select("id", F.when(F.coalesce(keep, F.lit(False)), F.col("review_reasons")).otherwise(V.without_flag(F.col("review_reasons"), M.DUPLICATE)).alias("review_reasons"))


#: Data types by the names that a model may give them; any other name is a text.
DRAFT_TYPES = {"number": "Number", "boolean": "Boolean", "date": "Date", "datetime": "DateTime", "longtext": "LongText"}


def draft_field(answer: Column, new_field: Column) -> Column:
    """A field definition from a model's JSON answer: struct (display_name, name, data_type, is_required, allow_multiple).

    Whatever is no JSON object gives an empty draft. Names and types count only as JSON strings. Booleans may be JSON
    booleans, the texts true and false in any case, or numbers (0 is false); all else is false. Only new fields get a
    name, and only texts may have several values.
    """
    root = F.try_parse_json(F.trim(answer))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(root, path, "variant"))
    whole = F.schema_of_variant(root).startswith("OBJECT")
    text = lambda name: F.when(whole & (kind(f"$.{name}") == "STRING"), F.try_variant_get(root, f"$.{name}", "string"))

    def flag(name: str) -> Column:
        path = f"$.{name}"
        by_kind = F.when(kind(path) == "BOOLEAN", F.try_variant_get(root, path, "boolean")).when(kind(path) == "STRING", F.lower(X.strip(F.try_variant_get(root, path, "string"))) == "true")
        return F.coalesce(F.when(whole, by_kind.when(kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(root, path, "double") != 0)), F.lit(False))

    said = F.lower(X.strip(text("dataType")))
    data_type = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DRAFT_TYPES.items() for x in kv]), said), F.lit("Text"))
    return F.struct(
        F.coalesce(X.tidy_name(text("displayName")), F.lit("")).alias("display_name"),
        F.when(new_field, F.coalesce(X.slug(text("name")), F.lit(""))).otherwise("").alias("name"),
        data_type.alias("data_type"),
        flag("isRequired").alias("is_required"),
        ((data_type == "Text") & flag("allowMultiple")).alias("allow_multiple"),
    )
