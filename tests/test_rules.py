"""Rules that refuse, borders and literal cases."""

import datetime as dt
import hashlib
import json
import os
import random
from decimal import Decimal
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumflow.functions import text as X
from vellumflow.functions import values as V
from vellumflow.operators import assemble as A
from vellumflow.operators import decisions as G
from vellumflow.operators import relations as R
from vellumflow.operators import search as S
from vellumflow.sources import derived as D
from vellumflow.sources import files
from vellumflow.streaming import events as E


def refused(code, call):
    with pytest.raises(S.QueryError) as e:
        call()
    assert e.value.code == code


@pytest.mark.parametrize("text,want", [("1,234.5", "1234.5"), (" -5 ", "-5"), ("5-", "-5"), (".5", "0.5"), ("+0010", "10"), ("7.", "7")])
def test_numbers(text, want):
    assert S.parse_number(text) == Decimal(want)


@pytest.mark.parametrize("text", ["", "abc", "1.2.3", "-5-", "0x10", "1e5x", "--1"])
def test_no_numbers(text):
    refused("InvalidValue", lambda: S.parse_number(text))


@pytest.mark.parametrize("text", ["2024-01-01T10:00:00+08:00", "2024-01-01T10:00:00Z", "2024-01-01 10:00:00-0330", "soon"])
def test_offsets_are_refused(text):
    refused("InvalidValue", lambda: S.parse_moment(text))


def test_moments():
    assert S.parse_moment("2024-01-01T10:00") == dt.datetime(2024, 1, 1, 10)
    assert S.parse_date("2024-01-01T23:59:59") == dt.date(2024, 1, 1)


def test_refused_field_queries(spark):
    q = lambda kind, **k: lambda: S.predicate(S.FieldQuery(1, kind, **k))
    refused("NotQueryable", q("LongText", value="x"))
    refused("MissingValue", q("Number"))
    refused("RangeNotSupported", q("Text", min="a"))
    refused("RangeNotSupported", q("Boolean", max="true"))
    refused("InvalidValue", q("Boolean", value="yes"))
    refused("InvalidValue", q("Number", min="many"))
    refused("InvalidValue", q("Date", value="2024-13-01"))
    S.predicate(S.FieldQuery(1, "Number", value="5", min="nonsense"))  # a value wins


def test_refused_searches(spark, sf):
    tables = (D.documents(spark, sf), D.extracted_fields(spark, sf), D.field_definitions(spark), D.document_types(spark))
    refused("TypeRequired", lambda: S.search(*tables, filters=[S.FieldFilter("amount", "1")]))
    refused("UnknownType", lambda: S.search(*tables, type_code="no.such", filters=[S.FieldFilter("amount", "1")]))
    refused("UnknownField", lambda: S.search(*tables, type_code="order.general", filters=[S.FieldFilter("legacy", "L2")]))
    assert S.search(*tables, type_code="no.such").count() == 0
    assert S.search(*tables, type_code="order.general", filters=[]).count() == 0
    refused("ScopeRequired", lambda: S.search_scope(None, None, "", 5))
    refused("InvalidCabinet", lambda: S.search_scope("a", None, "x7", 5))
    assert S.search_scope("a", "x", None, 0, "READY") == {"type_code": "a", "origin": None, "cabinet": None, "limit": 50, "lifecycle": 30}
    assert S.search_scope("a", None, None, -3)["limit"] == 1
    refused("UnknownScope", lambda: S.reprocess_scope("Everything"))
    refused("TooManyRows", lambda: S.at_most(tables[0], 5))


def test_ranges_of_mixed_width(spark):
    rows = spark.createDataFrame([(k, 1, Decimal(v)) for k, v in enumerate(("9", "10", "100.5", "100", "150", "250"))], "document_id long, field_definition_id long, number_value decimal(38,6)")
    hits = lambda low, high: sorted(r.id for r in S.matching_ids(rows, [S.FieldQuery(1, "Number", min=low, max=high)]).collect())
    assert hits("9.5", "99") == [1] and hits("100", "200") == [2, 3, 4] and hits("10", "10") == [1]


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, tenant_id long, document_type_id long, lifecycle_status long, review_reasons long, review_disposition long, is_container boolean, origin_document_id long, file_size long, fingerprint string, creation_time long")


def test_statistics(spark):
    row = lambda k, s, size, reasons=0, disposition=0: (k, None, 1, s, reasons, disposition, False, None, size, None, k)
    rows = [row(1, 10, 100), row(2, 10, 50, 1), row(3, 20, 200), row(4, 30, 300), row(5, 30, 400), row(6, 99, 500), row(7, 99, 60, 4, 30), row(8, 25, 700, 8)]
    assert R.statistics(docs(spark, rows)).first().asDict() == {"total": 8, "uploaded": 2, "processing": 1, "pending_review": 1, "ready": 2, "failed": 2, "needs_review": 2, "bytes": 2310}
    assert set(R.statistics(docs(spark, rows).where("false")).first()) == {0}


def test_duplicate_candidates_are_the_first_twenty(spark):
    rows = [(k, None, 1, 30, 0, 0, False, None, 1, "f", k // 2) for k in range(60)]
    got = R.duplicate_candidates(docs(spark, rows)).collect()
    for k in range(60):
        assert sorted(r.candidate for r in got if r.id == k) == [c for c in range(22) if c != k][:20]


@pytest.mark.parametrize("cell,want", [("a,b", '"a,b"'), ('say "hi"', '"say ""hi"""'), ("line\nbreak", '"line\nbreak"'), (None, ""), ("=1+1", "'=1+1"), ("+1", "'+1"), ("-1+2", "'-1+2"), ("@SUM(A1)", "'@SUM(A1)"), ("  =evil", "'  =evil"), ("\t=evil", "'\t=evil"), ("normal", "normal"), ("123", "123"), ("a=b", "a=b"), ("-5", "'-5"), ("\n=1+1", '"\'\n=1+1"'), ("\u00a0=1", "'\u00a0=1"), ("\x1c=1", "\x1c=1")])
def test_csv_cells(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(A.csv_cell(F.col("c"))).first()[0] == want


def test_csv_export_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=x"), (2, None)], "n long, t string")
    A.write_csv(rows, ["n", "t"], f"file://{tmp_path}/out", ["n"])
    assert A.csv_header(["n", "=t"]) == "﻿n,'=t"
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/out/rows").collect()] == ["1,'=x", "2,"]


def test_export_columns_are_bounded(spark):
    many = spark.createDataFrame([(k, 1, f"f{k}", k, False) for k in range(101)], "id long, document_type_id long, name string, display_order long, is_deleted boolean")
    refused("TooManyColumns", lambda: A.export_columns(many, 1))


@pytest.mark.parametrize("value,want", [(0.85, 0.85), (85.0, 0.85), (101.0, None), (-1.0, None), (float("nan"), None), (None, None)])
def test_confidence(spark, value, want):
    assert spark.createDataFrame([(value,)], "c double").select(V.normal_confidence(F.col("c"))).first()[0] == want


@pytest.mark.parametrize("value,want", [("100", "100"), ("1000.500000", "1000.5"), ("0.000001", "0.000001"), ("-3.10", "-3.1"), ("0", "0")])
def test_plain_numbers(spark, value, want):
    assert spark.createDataFrame([(Decimal(value),)], "c decimal(38,6)").select(V.plain_number(F.col("c"))).first()[0] == want


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def cut_up(spark, text, markers):
    schema = "t string, m array<struct<marker:string,is_sub_document:boolean>>"
    found = spark.createDataFrame([(text, [(m, True) for m in markers])], schema).select(X.slices(F.col("t"), F.col("m"))).first()[0]
    return None if found is None else [s.text for s in found]


def test_slicer(spark):
    assert cut_up(spark, "intro\n# A\none\n# A\ntwo", ["# A", "# A"]) == ["intro\n# A\none", "# A\ntwo"]
    assert cut_up(spark, "see # A here\n# A\nx", ["# A"]) == ["see # A here\n# A\nx"]
    assert cut_up(spark, "# A\none", ["# A", "# B"]) is None
    assert cut_up(spark, "a\n<b> c\nd", ["a", "&lt;b> c"]) == ["a", "<b> c\nd"]
    assert cut_up(spark, "mid # A", ["# A"]) is None
    assert cut_up(spark, "a\n \nb", ["a", " "]) is None and cut_up(spark, "a", []) is None and cut_up(spark, "", ["a"]) is None
    schema = "t string, m array<struct<marker:string,is_sub_document:boolean>>"
    text = "head\n*[Image OCR p:2]*\nread\n*[End OCR]*\ntail"
    row = spark.createDataFrame([(text, [("head", False), ("*[Image OCR p:2]*", True), ("tail", False)])], schema).select(X.slices(F.col("t"), F.col("m"))).first()[0]
    assert [(s.ordinal, s.is_sub_document, s.is_figure) for s in row] == [(0, False, False), (1, True, True), (2, False, False)]


def test_figures_are_segments_of_any_bundle(spark):
    schema = "conv_id long, is_container boolean, markdown string, markers array<struct<marker:string,is_sub_document:boolean>>"
    figure = "*[Image OCR]*\n{}\n*[End OCR]*"
    rows = [
        (1, False, "own\n" + figure.format("photo"), [("own", True), ("*[Image OCR]*", True)]),  # only the figure is spawned, without its marks
        (2, True, "a\n" + figure.format("inside") + "\nb\nb2", [("a", True), ("b", True)]),  # a text that folds a figure in
        (3, True, "a\nb", [("a", True), ("b", False)]),  # a container needs two
        (4, True, "a\na", [("a", True), ("a", True)]),  # equal ones
        (5, False, "a\nb", [("a", True), ("b", True)]),  # neither container nor figure
    ]
    got = G.segment(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.conv_id, r.text) for r in got) == [(1, "photo"), (2, "a\ninside"), (2, "b\nb2")]


def test_titles(spark):
    title = lambda t: one(spark, t, X.title_of)
    assert title("text\n## **Big** [title](x) ##\nmore") == "Big title"
    assert title("```\ncode\n```\n---\n|---|---|\n> - First `line` here") == "First line here"
    assert title("#\n\n") == "#" and title("---\n\n```\nx\n```\n ") is None and title("   ") is None
    assert title("1. *one* two\n###\n# __Real__ title #") == "Real title" and title("### ###") == "#"
    assert title("> - item\n") == "item" and title("~~~\na\n~~~\r\n\tplain\t text") == "plain text"
    assert len(title("# " + "x" * 500)) == 256


def test_repetition_guard(spark):
    loops = lambda t: one(spark, t, X.repeats_itself)
    assert loops("x\n" * 24) and not loops("x\n" * 23)
    assert not loops(None) and not loops(" \n ") and loops("a\r\n \r\n" * 24)
    assert loops("0" * 200) and not loops("0" * 199) and loops("ab c1" * 50) and not loops("|---" * 100) and not loops("-" * 500)
    assert loops(("x" * 119 + "y") * 8) and not loops(("x" * 120 + "y") * 8) and not loops(("x" * 119 + "y") * 7 + "x" * 60)
    assert loops("\n".join(f"l{k % 10}" for k in range(40))) and not loops("\n".join(f"l{k}" for k in range(400)))


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=80))
def test_slug_has_no_odd_characters(spark, text):
    slug = one(spark, text, X.slug)
    assert len(slug) <= 64 and all(c in "abcdefghijklmnopqrstuvwxyz0123456789_" for c in slug) and slug.strip("_") == slug and "__" not in slug


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_ocr_markup_round_trip(spark, text):
    if "\n" not in text and "OCR]" not in text:
        wrapped = spark.createDataFrame([(text,)], "t string").select(X.wrap_ocr(F.col("t"), F.lit(3)).alias("w"))
        row = wrapped.select(X.ocr_bodies(F.col("w")).alias("b"), X.ocr_page(F.split("w", "\n")[0]).alias("p"), X.has_ocr(F.col("w")).alias("h"), X.strip_ocr(F.col("w")).alias("s")).first()
        assert (row.b, row.p, row.h, row.s) == (text, 3, True, text)


def test_ocr_marks(spark):
    bare, paged = "*[Image OCR]*\na\n\nb\n*[End OCR]*", " *[Image OCR p:12]* \nc"
    rows = [(f"x\n{bare}\ny\n{paged}",), ("see *[Image OCR]* here",), ("*[Image OCR p:]*\nq",), ("*[End OCR]*",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(X.has_ocr(F.col("t")), X.ocr_bodies(F.col("t")), X.strip_ocr(F.col("t")), X.ocr_page(F.col("t"))).collect()
    assert tuple(got[0]) == (True, "a\n\nb\nc", "x\na\n\nb\ny\nc", None)
    assert [tuple(r) for r in got[1:]] == [(False, "", t[0] or "", None) for t in rows[1:]]
    assert one(spark, "*[Image OCR p:12]*", X.ocr_page) == 12 and one(spark, "*[Image OCR]*", X.ocr_page) is None
    assert one(spark, "t", lambda t: X.wrap_ocr(t, F.lit(0))) == "*[Image OCR]*\nt\n*[End OCR]*"


def test_plain_text(spark):
    plain = lambda t: one(spark, t, X.plain_text)
    cases = {
        "# Title\n\nsome **bold** and _it_ `code`": "Title\n\nsome bold and it code",
        "![alt](u) and [text](v \"t\")": "alt and text",
        "| a | b |\n|---|---|\n| 1 | 2 |": "a   b  \n\n  1   2",
        "> quote\n- item\n12. more\n": "quote\nitem\nmore",
        "***\nx\n\n\n\n\ny": "x\n\ny",
        "```py\ncode\n```\nafter": "code\nafter",
        "snake_case_name __init__ 2*3*4 <b>tag</b>": "snake_case_name init 2*3*4 <b>tag</b>",
        "\u3000wide\u00a0": "wide",
    }
    assert {t: plain(t) for t in cases} == cases and plain(None) == ""


def test_fingerprints(spark):
    """The canonical text by hand: which values count, in which order, and when there is none."""
    definitions = [(1, 10, "n", "Number", True, False), (2, 10, "t", "Text", True, False), (3, 10, "l", "LongText", True, False), (4, 20, "d", "Date", True, False), (5, 30, "x", "Text", False, False), (6, 20, "gone", "Text", True, True)]
    definitions = spark.createDataFrame(definitions, "id long, document_type_id long, name string, data_type string, is_unique_key boolean, is_deleted boolean")
    schema = "document_id long, field_definition_id long, order_no long, text_value string, long_text_value string, number_value decimal(38,12), boolean_value boolean, date_value date, datetime_value timestamp_ntz"
    row = lambda doc, field, order=0, text=None, long=None, number=None, day=None: (doc, field, order, text, long, None if number is None else Decimal(number), None, day, None)
    fields = [
        row(1, 2, 1, "Two\t WORDS "), row(1, 2, 0, " one"), row(1, 1, number="100.000000100"), row(1, 3, long="A  long\nText"),
        row(2, 1, number="100"), row(2, 2, text=" "), row(2, 3, long="x"),  # a blank value
        row(3, 1, number="100"), row(3, 3, long="x"),  # no value
        row(4, 4, day=dt.date(2024, 2, 29)), row(5, 5, text="x"),
        row(6, 1, number="0"), row(6, 2, text="a"), row(6, 2, 1, " "), row(6, 3, long="x"),  # one of two is blank
        row(7, 1, text="100"), row(7, 2, text="a"), row(7, 3, long="x"),  # of another type
    ]
    docs = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 20), (5, 30), (6, 10), (7, 10), (8, None)], "id long, document_type_id long")
    got = {r.id: r.fingerprint for r in R.fingerprints(docs, spark.createDataFrame(fields, schema), definitions).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: sha("1=100.0000001\x1e2=one\x1ftwo words\x1e3=a long text\x1e"), 4: sha("4=2024-02-29\x1e")} | dict.fromkeys((2, 3, 5, 6, 7, 8))


def test_running_lines(spark):
    page = lambda doc, k, *lines: (doc, k, list(lines))
    rows = [page(1, k, "Report  7", f"page {k} of 10", "body", f"only {'x' * k}", "body2", "Total", "\uff11\uff12 end") for k in range(1, 11) if k % 2]
    rows += [page(1, k, "a", "b", "c", "d", "e", "f", "g" * k) for k in range(2, 11, 2)] + [page(2, 1, "x", "x"), page(3, 1, "x"), page(3, 2, "X")]
    got = {(r.document, r.band, r.line, r.pages) for r in R.running_lines(spark.createDataFrame(rows, "document long, page long, lines array<string>")).collect()}
    odd = {(1, "top", "report #", 5), (1, "top", "page # of #", 5), (1, "top", "body", 5), (1, "bottom", "body#", 5), (1, "bottom", "total", 5), (1, "bottom", "# end", 5)}
    even = {(1, "top", t, 5) for t in "abc"} | {(1, "bottom", t, 5) for t in "ef"}
    assert got == odd | even | {(3, "top", "x", 2), (3, "bottom", "x", 2)}


def test_run_states_over_batches(spark, tmp_path):
    """New attempts, runs that collide, stale changes and a retry in place, in three batches of a stream."""
    schema = "document_id long, pipeline string, attempt long, run_id long, status long, event_time timestamp, event_id long"
    at = lambda k: dt.datetime(2024, 1, 1, 0, k)
    batches = [
        [(1, "p", 1, 7, 10, at(0), 0), (1, "p", 1, 7, 20, at(1), 1), (2, "p", 1, 3, 10, at(0), 2)],
        [(1, "p", 1, 8, 10, at(2), 3), (1, "p", 1, 7, 90, at(3), 4), (1, "p", 1, 7, 20, at(4), 5), (1, "p", 1, 7, 90, at(5), 6)],
        [(1, "p", 3, 9, 20, at(6), 7), (1, "p", 2, 6, 30, at(7), 8), (1, "p", 3, 9, 30, at(8), 9), (1, "q", 1, 5, 95, at(0), 10)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        os.utime(next(Path(f"{tmp_path}/in/{k}").glob("*.parquet")), (k + 1, k + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    got = E.latest(E.collect_stream(E.run_states(stream), "update", "test-states"), "document_id", "pipeline").collect()
    assert {tuple(r) for r in got} == {(1, "p", 2, 3, 9, 30, 2, 1, 1), (1, "q", 1, 1, 5, 95, 0, 0, 0), (2, "p", 1, 1, 3, 10, 0, 0, 0)}


def test_draft_fields(spark):
    draft = lambda t, new=True: tuple(one(spark, t, lambda c: G.draft_field(c, F.lit(new))))
    assert draft(None) == draft("[1]") == draft("nonsense") == ("", "", "Text", False, False)
    assert draft('{"displayName": "  A\\tb ", "name": "Due Date!", "dataType": " DATE", "isRequired": 1, "allowMultiple": true}') == ("A b", "due_date", "Date", True, False)
    assert draft('{"name": "x", "dataType": 3, "isRequired": " True ", "allowMultiple": "true"}', new=False) == ("", "", "Text", True, True)
    assert draft('{"displayName": 5, "dataType": "datetime", "isRequired": "1", "allowMultiple": null}') == ("", "", "DateTime", False, False)


VALUES = [
    ('"2024-02-29"', "Date", True), ('"2023-02-29"', "Date", False), ('"2024-1-1"', "Date", False), ('"0000-01-01"', "Date", False), ("20240101", "Date", False), ('"2024-01-01T10:00:00Z"', "DateTime", False), ('"2024-01-01T10:00:00"', "DateTime", True),
    ('"2024-01-01"', "DateTime", True), ('"2024-01-01T10:00:00+02:00"', "DateTime", False), ('"' + "x" * 257 + '"', "Text", False), ('"' + "x" * 257 + '"', "LongText", True), ("12", "Text", False), ("1e3", "Number", True), ("1e40", "Number", False), ('"12"', "Number", False),
    ("1,0", "Number", False), ("True", "Boolean", False), ("true", "Boolean", True), ('"true"', "Boolean", False), ('"x"', "Unknown", False), ("null", "Text", False), (None, "Text", False), ('["a"]', "Text", False), ("{}", "Text", False),
]


def test_valid_values(spark):
    rows = spark.createDataFrame([(k, v, t) for k, (v, t, _) in enumerate(VALUES)], "n int, v string, k string").select("n", G.valid_value(F.col("v"), F.col("k")).isNotNull().alias("ok")).collect()
    assert {r.n: r.ok for r in rows} == {k: ok for k, (_, _, ok) in enumerate(VALUES)}


def test_several_values(spark):
    cases = {"[1, 2.5]": True, '["1", "2"]': False, "[]": True, "1": False, "[1, null]": False, str(list(range(100))): True, str(list(range(101))): False, "[[1]]": False, None: False}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", G.valid_value(F.col("v"), F.lit("Number"), True).isNotNull().alias("ok")).collect()
    assert {r.v: r.ok for r in rows} == cases


def test_answers_by_field(spark):
    """Every declared field has a row; values keep their kind; halves are read on their own."""
    answers = [(1, 1, '{"values": {"a": 12, "b": "x", "c": ["p", "q"], "zz": 1}, "validationWarnings": 5}'), (2, 1, "{bad"), (3, 1, '{"values": [], "validationWarnings": [{"fieldName": "a", "message": " m "}]}'), (4, 1, None), (5, 9, '{"values": {"a": 1}}'), (6, 1, '{"values": {"a": "12", "b": null, "c": "p"}}'), (7, 1, "[1]")]
    declared = spark.createDataFrame([(1, "a", "Number", False), (1, "b", "Text", False), (1, "c", "Text", True), (2, "d", "Text", False)], "document_type_id long, name string, data_type string, allow_multiple boolean")
    parsed = spark.createDataFrame(answers, "id long, document_type_id long, j string").withColumn("answer", G.parse_answer(F.col("j")))
    got = {(r.id, r.field): r.value for r in G.typed_answers(parsed, declared).collect()}
    none = {(k, f): None for k in (1, 2, 3, 4, 6, 7) for f in "abc"}
    assert got == none | {(1, "a"): "12", (1, "b"): '"x"', (1, "c"): '["p","q"]'}
    assert [tuple(r) for r in G.warnings_of(parsed, declared).collect()] == [(3, "a", "m")]


def test_warnings(spark):
    said = [{"fieldName": "a", "message": "\u00a0first "}, {"fieldName": "a", "message": "second"}, {"fieldName": "zz", "message": "m"}, {"fieldName": "b", "message": " "}, {"fieldName": "b", "message": 5}, "x", {"field": "b", "message": "m"}, {"fieldName": "b", "message": "y" * 600}]
    many = [{"fieldName": f"f{k}", "message": "m"} for k in range(40)]
    rows = [(1, 1, json.dumps({"validationWarnings": said})), (2, 1, json.dumps({"validationWarnings": many}))]
    declared = spark.createDataFrame([(1, n) for n in ["a", "b", *(f"f{k}" for k in range(40))]], "document_type_id long, name string")
    got = G.warnings_of(spark.createDataFrame(rows, "id long, document_type_id long, j string").withColumn("answer", G.parse_answer(F.col("j"))), declared).collect()
    assert {(r.field, r.message) for r in got if r.id == 1} == {("a", "first"), ("b", "y" * 512)}
    assert {r.field for r in got if r.id == 2} == {f"f{k}" for k in range(32)}


def texts(spark, values, function):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "n int, t string").select("n", function(F.col("t")).alias("got")).collect()
    return [r.got for r in sorted(rows)]


def test_escaped_inline(spark):
    cases = {"a*b": r"a\*b", "_under_": r"\_under\_", "`code`": r"\`code\`", "[link](x)": r"\[link\](x)", "a\\b": r"a\\b", "<http://x>": r"\<http://x>", "snake_case": "snake_case", "a__b": r"a\_\_b", "é_1": "é_1", "a|b>c": "a|b>c", None: "", "": ""}
    assert texts(spark, cases, X.escape_inline) == list(cases.values())


def test_escaped_line_starts(spark):
    """What starts a block, and what only looks like it."""
    marked = ["# Heading", "###### six", "> quote", "- bullet", "+ bullet", "* bullet", "---", "***", "___", "===", "--- | ---", "| --- |", ":---:", "-\titem", "_ _ _", "-- -", "#", "==  "]
    plain = ["Hello world", "3.14 is pi", "12:00 noon", "-5 degrees", "well-known", "#hashtag", "--", "１. x", "١. item", "#\u00a0heading", "-", "1.", "1234567890. x", "    # code", "     > x", "####### seven", "|x|", "|", "", "== x"]
    assert texts(spark, marked, X.escape_line) == ["\\" + t for t in marked]
    assert texts(spark, plain, X.escape_line) == plain
    assert texts(spark, ["1. ordered", "12) ordered", "1.\titem", "  # x", "   123456789. x", None], X.escape_line) == [r"1\. ordered", r"12\) ordered", "1\\.\titem", r"  \# x", r"   123456789\. x", ""]
    assert texts(spark, ["# a_\n- *b*\nc", None], X.escape_block) == ["\\# a\\_\n\\- \\*b\\*\nc", ""]


def test_escaped_cells(spark):
    assert texts(spark, [" a|b\\c\r\nd\u00a0", "a  b", None], X.escape_cell) == ["a\\|b\\\\c  d", "a  b", ""]
    assert texts(spark, [" a|b*\nc_d ", None], X.escape_inline_cell) == ["a\\|b\\* c_d", ""]


def test_fences_tags_names(spark):
    assert texts(spark, ["```md\nx\n```", " ```\nx", "```", "``` x ```", "x ```", " \n", None, "```\n \n```"], X.unwrap_fence) == ["x", "x", None, None, "x ```", None, None, None]
    assert texts(spark, [" en ", "de-CH\n", "e n", "en_x", "a" * 17, "", None], X.language_tag) == ["en", "de-CH", None, None, None, None, None]
    assert texts(spark, ["  ", "\x01", " a \t b", None], X.tidy_name) == [None, None, "a b", None]
    assert texts(spark, ["MyField-1", "9a", "a.b", "a b", "a\n", "x" * 65, ""], X.valid_field_name) == [True, True, False, False, False, False, False]
    assert texts(spark, ["Order.General-2", "9", "a..b", ".a", "a.\n"], X.valid_type_code) == [True, True, False, False, False]


def test_resource_text(spark):
    doc = {"id": F.lit(7), "type": F.lit(None), "lifecycle": F.lit("Ready"), "language": F.lit(""), "created": F.expr("timestamp_ntz '2024-01-02 03:04:05'"), "cabinet": F.lit(None), "is_container": F.lit(True), "origin": F.lit(3)}
    (got, short) = spark.range(1).select(A.resource_text(doc, F.lit("a</document>b"), 3), A.resource_text(doc, F.lit(None).cast("string"))).first()
    head = "<!-- extract document metadata\nid: 7\nlifecycle: Ready\ncreatedAt: 2024-01-02T03:04:05.0000000\nisContainer: true\noriginDocumentId: 3\n"
    assert got.startswith(head) and "markdownTotalChars: 13\n" in got and got.endswith("-->\n\n<document>\na&lt;/\n</document>")
    assert "markdownTruncated" not in short and short.endswith("<document>\n\n</document>")


def test_sniffing_and_encodings(spark, tmp_path):
    kinds = {b"\xff\xd8\xff\xe0": "jpeg", b"GIF89a": "gif", b"RIFF\0\0\0\0WEBP": "webp", b"%PDF-1.7": "pdf", b"II*\0": "tiff", b"plain": None}
    rows = spark.createDataFrame(list(kinds.items()), "b binary, k string").select(files.sniff(F.col("b")).alias("got"), "k").collect()
    assert all(r.got == r.k for r in rows)
    texts = {"日本".encode("cp932"): "日本", "é".encode(): "é", b"\xef\xbb\xbfa": "a", "ü".encode("utf-16"): "ü"}
    rows = spark.createDataFrame(list(texts.items()), "b binary, t string").select(files.decoded(F.col("b")).alias("got"), "t").collect()
    assert all(r.got == r.t for r in rows)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-")
    (tmp_path / "b.exe").write_bytes(b"MZ")
    assert [r.path.rsplit("/", 1)[1] for r in files.uploads(spark, f"file://{tmp_path}").collect()] == ["a.pdf"]


def test_plans_prune_and_push_down(spark, sf):
    """Searches read only the columns they use, and joins on dimensions do not shuffle field rows twice."""
    plan = S.filter_metadata(S.scope(D.documents(spark, sf)), type_id=1).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    two = S.matching_ids(D.extracted_fields(spark, sf), [S.FieldQuery(102, "Text", "1-URGENT"), S.FieldQuery(101, "Number", min="5")])
    assert two._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_slices_as_a_table_function(spark):
    """Random texts and markers give the rows of the expression; other arguments are refused."""
    from pyspark.errors import PySparkException

    from vellumflow.operators import table_functions

    table_functions.register(spark)
    r = random.Random(9)
    lines = ["# A", "# B", "<b> c", " ", "", "text", "*[Image OCR p:3]*", "*[Image OCR]*", " x"]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randrange(9))), [(r.choice([*lines[:3], "&lt;b> c", *lines[6:8], "x"]), r.random() < 0.5) for _ in range(r.randrange(4))]) for k in range(900)] + [(900, None, [("a", True)]), (901, "a", None), (902, "a", [(None, True)])]
    df = spark.createDataFrame(rows, "id long, t string, m array<struct<marker:string,is_sub_document:boolean>>")
    got = spark.sql("SELECT d.id, s.* FROM {d} d, LATERAL document_slices(d.t, d.m) s", d=df)
    want = df.select("id", F.explode(X.slices(F.col("t"), F.col("m"))).alias("s")).select("id", "s.*")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50
    for call in ("document_slices(1, array())", "document_slices('a', array('b'))"):
        with pytest.raises(PySparkException, match="document_slices"):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_helper_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, 0.9, False, False, 5, 6)], "type_id long, confidence double, is_container boolean, is_derived boolean, threshold long, least long")
    types = spark.createDataFrame([(1, 0.7)], "id long, threshold double")
    row = G.route(docs, types).first()
    assert (row.outcome, row.threshold, row.least) == ("Classified", 5, 6)


def test_null_ids_are_in_no_batch(spark):
    rows = S.batches(spark.createDataFrame([(1,), (None,), (3,)], "id long"), 2).collect()
    assert {r.id: r.batch for r in rows} == {1: 0, 3: 0}


def test_any_gif(spark):
    assert spark.createDataFrame([(b"GIF8xx",)], "b binary").select(files.sniff(F.col("b"))).first()[0] == "gif"
