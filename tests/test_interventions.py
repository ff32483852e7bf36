"""Requests of operators on literal cases: which rule speaks first, and what an edit leaves behind."""

import datetime
import decimal

import pytest

from vellumflow.operators import decisions as D
from vellumflow.operators import interventions as I

DOCS = "id long, is_deleted boolean, document_type_id long, markdown string"
RUNS = "document_id long, pipeline string, attempt long, status long"
ASKED = "request long, id long, action string, pipeline string"


@pytest.fixture
def judge(spark):
    docs = spark.createDataFrame([(1, False, 1, "text"), (2, True, None, None), (3, False, None, "text"), (4, False, 1, ""), (5, False, 1, "text")], DOCS)
    runs = spark.createDataFrame([(1, "text-extraction", 1, 90), (1, "text-extraction", 2, 30), (1, "classification", 1, 30), (1, "classification", 2, 90), (5, "classification", 1, 20), (5, "field-extraction", 1, 95)], RUNS)

    def run(*asked):
        rows = I.reruns(docs, runs, spark.createDataFrame(list(asked), ASKED))
        return {r.request: (r.code, r.attempt) for r in rows.collect()}

    return run


def test_the_first_rule_that_is_broken_gives_the_code(judge):
    got = judge(
        (1, 9, "retry", "layout"), (2, 9, "retry", "classification"), (3, 2, "retry", "classification"), (4, 1, "retry", "field-extraction"), (5, 1, "retry", "text-extraction"),
        (6, 5, "retry", "classification"), (7, 5, "retry", "field-extraction"), (8, 2, "reextract", None), (9, 3, "reextract", None), (10, 4, "reextract", None), (11, 4, "rerecognize", None),
        (12, 5, "rerecognize", None), (13, 1, "erase", "classification"), (14, 1, None, None), (15, 1, "retry", None), (16, None, "retry", "classification"),
    )
    codes = ["UnknownPipeline", "NotFound", "Deleted", "NeverRan", "NotRetryable", "InProgress", "NotRetryable", "Deleted", "NoType", "NoText", "NoText", "InProgress", "UnknownAction", "UnknownAction", "UnknownPipeline", "NotFound"]
    assert got == {k + 1: (c, None) for k, c in enumerate(codes)}


def test_accepted_requests_are_attempts_and_stand_in_the_way_of_later_ones(judge):
    got = judge((1, 1, "retry", "classification"), (2, 1, "rerecognize", None), (3, 1, "reextract", None), (4, 1, "retry", "field-extraction"), (5, 3, "rerecognize", "ignored"), (6, 5, "reextract", None))
    assert got == {1: (None, 3), 2: ("InProgress", None), 3: (None, 1), 4: ("InProgress", None), 5: (None, 1), 6: (None, 2)}


def test_one_document_with_many_requests_is_queued_once(spark, judge):
    got = judge(*[(n, 3, "rerecognize", None) for n in range(1, 400)])
    assert got.pop(1) == (None, 1) and set(got.values()) == {("InProgress", None)}


def test_queued_runs_are_pending(spark):
    judged = spark.createDataFrame([(1, 7, "classification", None, 4), (2, 7, "classification", "InProgress", None)], "request long, id long, pipeline string, code string, attempt long")
    assert [tuple(r) for r in I.queued_runs(judged).collect()] == [(7, "classification", 4, 10)]


FIELD = "document_id long, field_definition_id long, order_no long, text_value string, long_text_value string, number_value decimal(38,6), boolean_value boolean, date_value date, datetime_value timestamp_ntz"


@pytest.fixture
def edit(spark):
    docs = spark.createDataFrame([(1, 1, False, 16 | 32, 25, "x"), (2, None, False, 0, 20, "y"), (3, 2, False, 2, 30, "z")], "id long, document_type_id long, is_container boolean, review_reasons long, lifecycle_status long, found string")
    types = spark.createDataFrame([(1, "a"), (2, "b")], "id long, type_code string")
    names = [("total", "Number", True, False, False), ("tags", "Text", False, True, False), ("day", "Date", False, False, False), ("seen", "DateTime", False, False, False), ("paid", "Boolean", False, False, False), ("memo", "LongText", False, False, False), ("gone", "Text", True, False, True)]
    definitions = spark.createDataFrame([(100 + k, 1, *n) for k, n in enumerate(names)] + [(200, 2, "total", "Text", True, False, False)], "id long, document_type_id long, name string, data_type string, is_required boolean, allow_multiple boolean, is_deleted boolean")
    fields = spark.createDataFrame([(1, 100, 0, None, None, decimal.Decimal(5), None, None, None), (1, 101, 0, "old", None, None, None, None, None), (1, 101, 1, "older", None, None, None, None, None), (3, 200, 0, "kept", None, None, None, None, None)], FIELD)
    runs = spark.createDataFrame([(1, p, 1, 30) for p in ("text-extraction", "classification", "field-extraction")], RUNS)

    def run(*edits):
        return I.edit_fields(docs, fields, definitions, types, runs, spark.createDataFrame(list(edits), "edit long, id long, values string"))

    return run


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_an_edit_is_refused_as_a_whole(edit):
    got = edit((1, 1, '{"total": "5", "tags": ["a"], "Total": 1, "gone": "x"}'), (2, 2, "{}"), (3, 8, "{}"), (4, 1, "[]"), (5, 1, "{"), (6, 1, '{"tags": "one"}'), (7, 1, '{"total": null}'), (8, None, None))
    assert rows(got.refusals) == sorted(
        [(1, 1, "Total", "Unknown"), (1, 1, "gone", "Unknown"), (1, 1, "total", "InvalidValue"), (2, 2, None, "NotClassified"), (3, 8, None, "NotFound"), (4, 1, None, "NotAnObject"), (5, 1, None, "NotAnObject"), (6, 1, "tags", "InvalidValue"), (7, 1, "total", "InvalidValue"), (8, None, None, "NotFound")], key=str
    )
    assert not rows(got.changes) and not rows(got.fields) and not rows(got.documents) and not rows(got.events)


def test_an_edit_replaces_all_fields_and_settles_the_flags(edit):
    got = edit((1, 1, '{"total": 5.0, "tags": ["old", "new", "é\\n"], "day": "2024-02-29", "seen": "2024-02-29T10:00:00", "paid": false, "memo": ""}'), (2, 1, '{"total": "no"}'))
    assert rows(got.refusals, "edit", "code") == [(2, "InvalidValue")]
    assert rows(got.changes) == sorted([(1, 100, 0, "Keep"), (1, 101, 0, "Keep"), (1, 101, 1, "Update"), (1, 101, 2, "Add"), (1, 102, 0, "Add"), (1, 103, 0, "Add"), (1, 104, 0, "Add"), (1, 105, 0, "Add")], key=str)
    by = {(r.field_definition_id, r.order_no): r for r in got.fields.collect()}
    assert by[100, 0].number_value == 5 and by[101, 2].text_value == "é\n" and by[102, 0].date_value == datetime.date(2024, 2, 29) and by[103, 0].datetime_value == datetime.datetime(2024, 2, 29, 10) and by[104, 0].boolean_value is False and by[105, 0].long_text_value == ""
    # the warning still blocks; the incomplete extraction is gone
    assert rows(got.documents) == [(1, 1, False, 32, 25, "x")] and rows(got.events) == [(1, "a", 6)]


def test_the_last_accepted_edit_holds_and_an_empty_one_clears(edit):
    got = edit((1, 1, '{"total": 1}'), (2, 1, '{"tags": []}'), (3, 1, '{"nope": 1}'), (4, 3, None))
    assert rows(got.fields) == [] and {r[-1] for r in rows(got.changes)} == {"Remove"} and len(rows(got.changes)) == 4
    assert rows(got.documents) == [(1, 1, False, 34, 25, "x"), (3, 2, False, 2, 20, "z")]
    assert rows(got.events) == [(1, "a", 0), (3, "b", 0)]


def test_no_edits(edit, spark):
    got = edit((1, 2, None))
    assert [rows(t) for t in got] == [[(1, 2, None, "NotClassified")], [], [], [], []]


def test_seeds_of_documents_that_were_cut_out(spark):
    segments = spark.createDataFrame([(1, 0, "a", "first"), (1, 3, "a", "later"), (1, 1, "b", ""), (1, 2, "", "no key"), (2, 0, "c", None)], "conv_id long, ordinal long, segment_key string, text string")
    docs = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "b", "x"), (3, 1, "", "x"), (4, None, "a", "x"), (5, 2, "a", "x"), (6, 2, "c", "x"), (7, 1, None, "x"), (1, 1, "a", "y")], "id long, origin_document_id long, origin_key string, source string")
    got = D.seed_texts(docs, segments)
    assert got.columns == [*docs.columns, "seed"]
    assert rows(got, "id", "seed") == sorted([(1, "first"), (1, "first"), *((k, None) for k in range(2, 8))], key=str)
    assert D.seed_texts(docs, segments.where("false")).where("seed IS NOT NULL").count() == 0
