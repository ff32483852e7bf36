"""Text functions and file rules as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.functions import text as X
from vellumflow.functions import values as V
from vellumflow.operators import decisions as G
from vellumflow.operators import table_functions
from vellumflow.plans.registry import ORACLES, query
from vellumflow.sources import derived as D
from vellumflow.sources import files as S
from vellumflow.sources.derived import oracle


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(expression: str, steps) -> str:
    for pattern, new in steps:
        new = new.replace("$1", "\\1").replace("$2", "\\2")
        expression = f"regexp_replace({expression}, {_quote(pattern)}, {_quote(new)}, 'g')"
    return expression


def _docs(spark, sf):
    return D.table(spark, sf, "documents")


def _pages(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", S.html_to_markdown(F.col("html")).alias("markdown"))


_MD = f"trim({_re2('html', S.HTML)}, ' ' || chr(10) || chr(9))"


@query("s13_html_to_markdown", f"SELECT page_id, {_MD} AS markdown FROM pages")
def s13(spark, sf):
    return _pages(spark, sf)


@query("s14_decoded", "SELECT doc_id, text AS decoded FROM documents")
def s14(spark, sf):
    return _docs(spark, sf).select("doc_id", S.decoded(F.encode("text", "UTF-8")).alias("decoded"))


_END = "CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'png' ELSE 'exe' END"


def _files(spark, sf):
    return _docs(spark, sf).withColumn("ending", F.expr("case doc_id % 4 when 0 then 'pdf' when 1 then 'docx' when 2 then 'png' else 'exe' end"))


@query("s7_upload_rules", f"SELECT doc_id, {_END} <> 'exe' AND strlen(text) > 0 AND strlen(text) <= 20971520 AS accepted FROM documents")
def s7(spark, sf):
    return _files(spark, sf).select("doc_id", S.accepted(F.concat(F.lit("/in/file."), F.col("ending")), F.octet_length("text")).alias("accepted"))


@query("s8_blob_paths", "SELECT doc_id, substr(sha256(text), 1, 2) || '/' || sha256(text) AS blob FROM documents")
def s8(spark, sf):
    digest = X.sha256_hex(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.concat(F.substring(digest, 1, 2), F.lit("/"), digest).alias("blob"))


@query("s9_provider_choice", f"SELECT doc_id, CASE {_END} WHEN 'pdf' THEN 'layout' WHEN 'docx' THEN 'office' END AS provider FROM documents")
def s9(spark, sf):
    known = S.Providers()
    known.register("plain", ["pdf", "docx"], 0)
    known.register("layout", ["PDF"], 5)
    known.register("office", ["docx"], 5)
    known.register("late", ["docx"], 5)
    return known.choose(_files(spark, sf), "ending").select("doc_id", "provider")


@query("s16_sniff", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' END AS kind FROM pages")
def s16(spark, sf):
    head = F.expr("case page_id % 3 when 0 then unhex('89504E470D0A1A0A') when 1 then unhex('255044462D') else cast('' as binary) end")
    return D.table(spark, sf, "pages").select("page_id", S.sniff(F.concat(head, F.encode("html", "UTF-8"))).alias("kind"))


@query("s20_ocr_routing", f"SELECT doc_id, {_END} = 'png' OR ({_END} = 'pdf' AND NOT regexp_matches(text, '[\\p{{L}}\\p{{Nd}}]')) AS ocr FROM documents")
def s20(spark, sf):
    return _files(spark, sf).select("doc_id", S.needs_ocr(F.col("ending"), F.col("text")).alias("ocr"))


@query("t1_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def t1(spark, sf):
    return _docs(spark, sf).select("doc_id", X.sha256_hex(F.col("text")).alias("sha"))


#: JSON values of every kind, each tried against every type, once as a single value and once as several.
_SAMPLES = ("'\"' || user_id || '\"'", "CAST(user_id AS VARCHAR)", "CAST(user_id AS VARCHAR) || '.25'", "'true'", "'\"true\"'", "'\"' || strftime(ts, '%Y-%m-%d') || '\"'", "'\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\"'", "'\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\"'", "'\"2024-02-30\"'", "'null'", "'{\"a\":1}'", "'[' || user_id || ',2]'", "'[\"' || event_type || '\",\"x\"]'", "'[1,\"x\"]'", "'no json'", "'\"' || repeat(event_type, 60) || '\"'")
_KINDS = ("Text", "Number", "Boolean", "Date", "DateTime", "LongText")


def _fits_sql(v: str) -> str:
    """The rule over DuckDB's own kinds of JSON values."""
    text, kind = f"({v}->>'$')", f"json_type({v})"
    return f"""coalesce(CASE kind WHEN 'Text' THEN {kind} = 'VARCHAR' AND length({text}) <= 256 WHEN 'LongText' THEN {kind} = 'VARCHAR' AND length({text}) <= 8000 WHEN 'Number' THEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') WHEN 'Boolean' THEN {kind} = 'BOOLEAN'
      WHEN 'Date' THEN {kind} = 'VARCHAR' AND regexp_full_match({text}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({text} AS DATE) IS NOT NULL
      WHEN 'DateTime' THEN {kind} = 'VARCHAR' AND regexp_full_match({text}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})?') AND try_cast({text} AS TIMESTAMP) IS NOT NULL END, false)"""


@query("t3_valid_value", f"""WITH v AS (
  SELECT event_id, ['{"', '".join(_KINDS)}'][CAST(event_id % 6 AS INTEGER) + 1] AS kind, event_id // 96 % 2 = 1 AS several, CASE event_id // 6 % 16 {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SAMPLES))} END AS j FROM events
), parsed AS (
  SELECT *, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS p FROM v
)
SELECT event_id, CASE WHEN several THEN CASE WHEN json_type(p) = 'ARRAY' AND json_array_length(p) <= 100 AND len(list_filter(CAST(p AS JSON[]), lambda e: NOT {_fits_sql("e")})) = 0 THEN j END WHEN p IS NOT NULL AND {_fits_sql("p")} THEN j END AS valid FROM parsed""")
def t3(spark, sf):
    """Values of all kinds for fields of all types that take one or several."""
    samples = []
    for x in _SAMPLES:
        x = x.replace("'\"' || user_id || '\"'", "concat('\"', user_id, '\"')").replace("'\"' || repeat(event_type, 60) || '\"'", "concat('\"', repeat(event_type, 60), '\"')")
        samples.append(x.replace("VARCHAR", "STRING").replace("strftime(ts, '%Y-%m-%d')", "date_format(ts, 'yyyy-MM-dd')").replace("strftime(ts, '%Y-%m-%dT%H:%M:%S')", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")").replace("strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))
    json = F.expr("case event_id div 6 % 16 " + " ".join(f"when {i} then {x}" for i, x in enumerate(samples)) + " end")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 6 + 1).cast("int"))
    rows = D.table(spark, sf, "events").select("event_id", json.alias("json"), kind.alias("kind"), F.expr("event_id div 96 % 2 = 1").alias("several"))
    return rows.select("event_id", G.valid_value(F.col("json"), F.col("kind"), F.col("several")).alias("valid"))


@query("t3_valid_values", "SELECT doc_id, CASE WHEN len(ws) <= 100 AND len(list_filter(ws, lambda w: length(w) > 256)) = 0 THEN array_to_string(ws, '/') END AS valid FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)")
def t3_values(spark, sf):
    words = F.to_json(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    valid = G.valid_value(words, F.lit("Text"), True)
    return _docs(spark, sf).select("doc_id", F.array_join(F.from_json(valid, "array<string>"), "/").alias("valid"))


@query("t4_expand", "SELECT doc_id, i - 1 AS order_no, w AS value FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents))")
def t4(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.to_json(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("json"))
    return G.expand_values(rows, "json", ["doc_id"]).withColumn("order_no", F.col("order_no").cast("long"))


@query("t5_parse_answer", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0 END AS warnings FROM events WHERE event_id % 15 > 0")
def t5(spark, sf):
    """Answers of which one half or the other is missing or of another kind."""
    values = F.when(F.col("event_id") % 5 > 0, F.col("props")).otherwise(F.lit('"none"'))
    warnings = F.when(F.col("event_id") % 3 == 0, '[{"fieldName": "k"}]').when((F.col("event_id") % 3 == 1) & (F.col("event_id") % 5 > 0), "[]").otherwise("{}")
    answer = F.concat(F.lit('{"values": '), values, F.lit(', "validationWarnings": '), warnings, F.lit("}"))
    rows = D.table(spark, sf, "events").where("event_id % 15 > 0").withColumn("answer", G.parse_answer(answer))
    return rows.select("event_id", F.try_variant_get(F.try_element_at("answer.values", F.lit("k")), "$", "long").alias("k"), F.when(F.col("answer.warnings").isNotNull(), F.size("answer.warnings")).cast("long").alias("warnings"))


@query("t5_typed_values", """SELECT event_id AS id, field, CASE field WHEN 'k' THEN json_extract_string(props, '$.k') WHEN 'type' THEN '"' || event_type || '"' WHEN 'day' THEN CASE WHEN event_id % 2 = 0 THEN '"' || strftime(ts, '%Y-%m-%d') || '"' END WHEN 'tags' THEN CASE WHEN event_id % 3 = 0 THEN '["' || event_type || '","x"]' END END AS value
  FROM events JOIN (VALUES (0, 'k'), (0, 'type'), (0, 'day'), (1, 'k'), (1, 'spelt'), (1, 'tags'), (1, 'never')) f(type_id, field) ON type_id = event_id % 2""")
def t5_typed(spark, sf):
    """Answers with a number, the same as a text, a date that some spell wrongly, several texts or one where several belong, and a field that nobody declared."""
    day = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "d.M.yyyy"))
    k = F.get_json_object("props", "$.k")
    tags = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('", "x"]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise('["x", 1]')
    json = F.concat(F.lit('{"values": {"k": '), k, F.lit(', "spelt": "'), k, F.lit('", "type": "'), F.col("event_type"), F.lit('", "day": "'), day, F.lit('", "tags": '), tags, F.lit(', "other": "x"}}'))
    answers = D.table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 2).alias("document_type_id"), G.parse_answer(json).alias("answer"))
    declared = [(0, "k", "Number", False), (0, "type", "Text", False), (0, "day", "Date", False), (1, "k", "Number", False), (1, "spelt", "Number", False), (1, "tags", "Text", True), (1, "never", "Boolean", None)]
    return G.typed_answers(answers, D.fixed(spark, declared, "document_type_id long, name string, data_type string, allow_multiple boolean"))


@query("t6_cut", "SELECT doc_id, substr(text, 1, 256) AS head FROM documents")
def t6(spark, sf):
    return _docs(spark, sf).select("doc_id", X.cut(F.col("text"), 256).alias("head"))


#: A Markdown page around each text: marks in front that are known, then the whole text in a paragraph of its own.
_PAGE = {
    0: "## *Deep* [link](u) and ![pic](v) ##\n\n",
    1: "---\n|---|---|\n> 1. quoted **strong** `code` line\n\n",
    2: "```sql\nselect 1\n```\n\n- first _point_\n\n",
    3: "a | b\n\n\n\n",
    4: "",
}
#: What plain text and the title keep of these fronts, by hand.
_PLAIN_FRONT = {0: "Deep link and pic ##\n\n", 1: "quoted strong code line\n\n", 2: "select 1\nfirst point\n\n", 3: "a   b\n\n", 4: ""}
_TITLE_FRONT = {0: "Deep link and pic", 1: "quoted strong code line", 2: "first point", 3: "a | b"}


def _fronted(texts: dict[int, str]) -> str:
    return "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN {_quote(v)}" for k, v in texts.items()) + " END"


def _marked_up(spark, sf):
    front = F.element_at(F.array(*[F.lit(_PAGE[k]) for k in sorted(_PAGE)]), (F.col("doc_id") % 5 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", F.concat(front, F.lit("words: "), F.translate("text", "*_", "~~")).alias("markdown"))


#: The rules in RE2, which has neither look-around nor back-references: so the texts' own stars and underscores become '~' first.
_WORDS = "'words: ' || translate(text, '*_', '~~')"
_STRIPPED = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(
    {_WORDS}, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '|', ' '), '(?m)^\s{{0,3}}#{{1,6}}\s*', '', 'g'), '(?m)^\s{{0,3}}>\s?', '', 'g'), '(?m)^\s{{0,3}}([-*+]|\d+\.)\s+', '', 'g'),
    '`([^`]+)`', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"""


@query("t7_plain_text", f"SELECT doc_id, {_fronted(_PLAIN_FRONT)} || {_STRIPPED} AS plain FROM documents")
def t7(spark, sf):
    return _marked_up(spark, sf).select("doc_id", X.plain_text(F.col("markdown")).alias("plain"))


@query("t8_title", rf"SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN {_fronted(_TITLE_FRONT)} ELSE substr(trim(regexp_replace(regexp_extract({_WORDS}, '^[^\n]*'), '\s+', ' ', 'g')), 1, 256) END AS title FROM documents")
def t8(spark, sf):
    return _marked_up(spark, sf).select("doc_id", X.title_of(F.col("markdown")).alias("title"))


@query("t9_title_chain", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Model ' || doc_id WHEN 1 THEN 'About ' || lang ELSE 'report' || doc_id END AS title FROM documents")
def t9(spark, sf):
    """A third of the documents has a title of the model, a third a heading, a third only a file name."""
    model = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Model "), F.col("doc_id"))).otherwise(" ")
    page = F.when(F.col("doc_id") % 3 == 2, F.lit("\n \n---\n")).otherwise(F.concat(F.lit("# About "), F.col("lang"), F.lit("\n\n"), F.col("text")))
    rows = _docs(spark, sf).select("doc_id", model.alias("model"), page.alias("page"), F.concat(F.lit("/in/report"), F.col("doc_id"), F.lit(".pdf")).alias("file"))
    return rows.select("doc_id", X.title_chain(F.col("model"), F.col("page"), F.col("file")).alias("title"))


_FOLD = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' ')"


@query("t10_tidy_name", f"SELECT doc_id, rtrim(substr({_FOLD.format('text')}, 1, 256), ' ') AS name FROM documents")
def t10(spark, sf):
    return _docs(spark, sf).select("doc_id", X.tidy_name(F.col("text")).alias("name"))


@query("t11_language", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN lang || '-' || doc_id WHEN 2 THEN lang WHEN 3 THEN NULL ELSE NULL END AS tag FROM documents")
def t11(spark, sf):
    """Tags with white space around them, inside them, with an underscore, too long, and good ones."""
    tag = F.expr("case doc_id % 5 when 0 then concat(lang, '_x') when 1 then concat(chr(160), lang, '-', doc_id, '\\n') when 2 then concat(' ', lang, '\t') when 3 then concat(lang, ' x') else concat(lang, '-abcdefghijklmn') end")
    return _docs(spark, sf).select("doc_id", X.language_tag(tag).alias("tag"))


@query("t12_slug", "SELECT p_partkey, trim(substr(trim(regexp_replace(lower(trim(n, ' ')), '[^a-z0-9]+', '_', 'g'), '_'), 1, 64), '_') AS slug FROM (SELECT p_partkey, ' ' || p_name || '!! ' || p_type AS n FROM part)")
def t12(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", X.slug(F.concat(F.lit(" "), F.col("p_name"), F.lit("!! "), F.col("p_type"))).alias("slug"))


@query("t13_boundary", "SELECT page_id, '<document>' || chr(10) || replace(html, '<', '&lt;') || chr(10) || '</document>' AS prompt FROM pages")
def t13(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", X.boundary(F.col("html")).alias("prompt"))


@query("t14_ocr_markup", """SELECT doc_id, doc_id % 4 <> 3 AS has, CASE WHEN doc_id % 4 = 3 THEN 'see *[Image OCR]* here' || chr(10) || text ELSE 'before' || chr(10) || text || CASE WHEN doc_id % 4 = 0 THEN '' ELSE chr(10) || 'after' END END AS stripped,
    CASE doc_id % 4 WHEN 3 THEN '' ELSE text END AS body, CASE WHEN doc_id % 4 = 1 AND doc_id % 9 > 0 THEN CAST(doc_id % 9 AS INTEGER) END AS page FROM documents""")
def t14(spark, sf):
    """Figures that are never closed, with a page, without one, and a text that only mentions the mark."""
    kind, text = F.col("doc_id") % 4, F.col("text")
    whole = lambda figure: F.concat(F.lit("before\n"), figure, F.lit("\nafter"))
    marked = F.when(kind == 0, F.concat(F.lit("before\n *[Image OCR]* \n"), text)).when(kind == 1, whole(X.wrap_ocr(text, F.col("doc_id") % 9))).when(kind == 2, whole(X.wrap_ocr(text))).otherwise(F.concat(F.lit("see *[Image OCR]* here\n"), text))
    rows = _docs(spark, sf).select("doc_id", marked.alias("m"))
    return rows.select("doc_id", X.has_ocr(F.col("m")).alias("has"), X.strip_ocr(F.col("m")).alias("stripped"), X.ocr_bodies(F.col("m")).alias("body"), X.ocr_page(F.try_element_at(F.split("m", "\n"), F.lit(2))).alias("page"))


#: Each text word by word on lines, by turns followed by a line 25 times, by 30 lines that alternate, or by one line that repeats a unit.
_LOOPING = """SELECT doc_id, replace(text, ' ', chr(10)) || chr(10) || CASE doc_id % 4 WHEN 0 THEN repeat('again' || chr(10), 25) WHEN 1 THEN repeat('row ' || lang || chr(10) || 'sum' || chr(10), 30) WHEN 2 THEN repeat('unit ' || lang || ';', 40) ELSE repeat('-=', 200) END AS t FROM documents"""


@query("t15_repetition", f"""WITH lines AS (SELECT doc_id, i, trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS i FROM ({_LOOPING})) WHERE trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS island FROM lines),
islands AS (SELECT doc_id, count(*) AS n FROM numbered GROUP BY doc_id, l, island),
shares AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d FROM lines GROUP BY doc_id),
tiled AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, l, unnest(range(1, 121)) AS p FROM (SELECT DISTINCT doc_id, l FROM lines WHERE length(l) >= 200 AND 2 * length(regexp_replace(l, '[^\\pL\\p{{Nd}}]', '', 'g')) > length(l))) WHERE length(l) // p >= 8 AND substr(l, p + 1) = substr(l, 1, length(l) - p))
SELECT doc_id, doc_id IN (SELECT doc_id FROM islands WHERE n >= 24) OR doc_id IN (SELECT doc_id FROM shares WHERE n >= 40 AND d / n < 0.3) OR doc_id IN (SELECT doc_id FROM tiled) AS loops FROM documents""")
def t15(spark, sf):
    more = F.expr("case doc_id % 4 when 0 then repeat('again\n', 25) when 1 then repeat(concat('row ', lang, '\nsum\n'), 30) when 2 then repeat(concat('unit ', lang, ';'), 40) else repeat('-=', 200) end")
    return _docs(spark, sf).select("doc_id", X.repeats_itself(F.concat(F.replace(F.col("text"), F.lit(" "), F.lit("\n")), F.lit("\n"), more)).alias("loops"))


@query("t16_drop_fences", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'head' || chr(10) || text ELSE '```not `one``' || chr(10) || text END AS text FROM documents")
def t16(spark, sf):
    """Fences around the whole, around a part and never closed, and a line that is none."""
    fenced = F.expr("case doc_id % 3 when 0 then concat('```md\n', text, '\n```') when 1 then concat('head\n  ~~~~\n', text) else concat('```not `one``\n', text, '\n```` x') end")
    return _docs(spark, sf).select("doc_id", X.drop_fences(fenced).alias("text"))


@query("t17_unwrap_fence", r"SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN NULL WHEN 2 THEN 'head ```' || chr(10) || nullif(regexp_replace(text, '[\s\x{85}\x{A0}]+$', ''), '') || chr(10) || '```' ELSE nullif(regexp_replace(text, '^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$', '', 'g'), '') END AS text FROM documents WHERE text NOT LIKE '%```%'")
def t17(spark, sf):
    """Texts in a fence, in one that is never closed, behind other words, without one, and a fence around nothing."""
    text = "regexp_replace(text, '(?U)\\\\s+$', '')"
    wrapped = F.expr(f"case doc_id % 5 when 0 then concat(' \n```md\n', text, '\n```\n') when 1 then concat('```\n', text) when 2 then concat('head ```\n', nullif({text}, ''), '\n```') when 3 then text else '```md\n \n```' end")
    return _docs(spark, sf).where("text NOT LIKE '%```%'").select("doc_id", X.unwrap_fence(wrapped).alias("text"))


@query("t18_slices", oracle("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, regexp_replace('## Turn ' || turn || chr(10) || text, '^\\s+|\\s+$', '', 'g') AS text, role <> 'system' AS is_sub_document FROM conversations WHERE conv_id IN (SELECT conv_id FROM d_bundles)"))
def t18(spark, sf):
    cut_up = D.bundles(spark, sf).select("conv_id", F.explode(X.slices(F.col("markdown"), F.col("markers"))).alias("s"))
    return cut_up.select("conv_id", "s.ordinal", "s.text", "s.is_sub_document")


@query("t18_slices_sql", ORACLES["t18_slices"])
def t18_sql(spark, sf):
    """The same rows from a SQL text with a lateral join."""
    table_functions.register(spark)
    return spark.sql("SELECT b.conv_id, s.ordinal, s.text, s.is_sub_document FROM {bundles} b, LATERAL document_slices(b.markdown, b.markers) s", bundles=D.bundles(spark, sf))


#: Underscores inside words are set aside, then every mark is escaped.
_BETWEEN = "'([\\p{L}\\p{Nd}])_([\\p{L}\\p{Nd}])', '\\1' || chr(57344) || '\\2', 'g'"
_INLINE_SQL = f"replace(regexp_replace(regexp_replace(regexp_replace(t, {_BETWEEN}), {_BETWEEN}), '[\\\\`*_\\[\\]<]', '\\\\\\0', 'g'), chr(57344), '_')"


@query("t19_escaped", f"SELECT doc_id, {_INLINE_SQL} AS escaped FROM (SELECT doc_id, translate(text, 'aeiu', '_*[\\') || 'snake_case_ a_b_c <a|b>' AS t FROM documents)")
def t19(spark, sf):
    """All texts with letters in the place of marks."""
    marked = F.concat(F.translate("text", "aeiu", "_*[\\"), F.lit("snake_case_ a_b_c <a|b>"))
    return _docs(spark, sf).select("doc_id", X.escape_inline(marked).alias("escaped"))


_STARTS = ("# ", "######", "#######", "#x ", "> ", ">", "=== ", "==x", "* * *", "-- -\t", "--", "_ _ _", "--- | :--", ":-:", "|x|", "- ", "-", "+\t", "*x", "1. ", "123456789) ", "1234567890. ", "3.14 ", "1.", "   # ", "    # ", "     > ", "１. ", "", "** *", "*-*-", "|-")


def _line_sql(t: str) -> str:
    """The rules one after the other, on the line behind up to three spaces."""
    rest = f"regexp_replace({t}, '^ {{0,3}}', '')"
    packed = f"regexp_replace({rest}, '[ \\t]', '', 'g')"
    whole = f"(regexp_full_match({rest}, '#{{1,6}}([ \\t].*)?', 's') OR starts_with({rest}, '>') OR regexp_full_match({rest}, '=+[ \\t]*') OR ({rest} NOT LIKE ' %' AND {rest} NOT LIKE chr(9) || '%' AND length({packed}) >= 3 AND (regexp_full_match({packed}, '-+') OR regexp_full_match({packed}, '\\*+') OR regexp_full_match({packed}, '_+'))) OR ({rest} NOT LIKE ' %' AND {rest} NOT LIKE chr(9) || '%' AND regexp_full_match({packed}, '[-:|]+') AND {packed} LIKE '%-%' AND regexp_matches({packed}, '[:|]')) OR regexp_full_match({rest}, '[-+*][ \\t].*', 's'))"
    number = f"regexp_extract({rest}, '^([0-9]{{1,9}})[.)][ \\t]', 1)"
    spaces = f"substr({t}, 1, length({t}) - length({rest}))"
    return f"CASE WHEN {whole} THEN {spaces} || '\\' || {rest} WHEN {number} <> '' THEN {spaces} || {number} || '\\' || substr({rest}, length({number}) + 1) ELSE {t} END"


@query("t19_escaped_line", f"SELECT doc_id, {_line_sql('t')} AS escaped FROM (SELECT doc_id, CASE doc_id % {len(_STARTS)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_STARTS)) + " END || CASE WHEN doc_id % 3 > 0 THEN regexp_extract(text, '^[^\n]*') ELSE '' END AS t FROM documents)")
def t19_line(spark, sf):
    """The first lines of texts, or none, behind everything that may start a block and what only looks like it."""
    start = F.element_at(F.array(*map(F.lit, _STARTS)), (F.col("doc_id") % len(_STARTS) + 1).cast("int"))
    line = F.concat(start, F.when(F.col("doc_id") % 3 > 0, F.regexp_extract("text", r"^[^\n]*", 0)).otherwise(""))
    return _docs(spark, sf).select("doc_id", X.escape_line(line).alias("escaped"))


@query("t19_escaped_block", f"SELECT doc_id, array_to_string(list_transform(string_split({_INLINE_SQL}, chr(10)), lambda u: {_line_sql('u')}), chr(10)) AS escaped FROM (SELECT doc_id, text AS t FROM documents)")
def t19_block(spark, sf):
    return _docs(spark, sf).select("doc_id", X.escape_block(F.col("text")).alias("escaped"))


@query("t19_escaped_cell", r"SELECT doc_id, trim(replace(replace(replace(replace(text, '\', '\\'), '|', '\|'), chr(13), ' '), chr(10), ' '), ' ' || chr(9) || chr(11) || chr(12) || chr(133) || chr(160)) AS cell FROM documents")
def t19_cell(spark, sf):
    return _docs(spark, sf).select("doc_id", X.escape_cell(F.col("text")).alias("cell"))


@query("t20_table", "SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) || '| end |  |' AS md FROM nation GROUP BY n_regionkey")
def t20(spark, sf):
    rows = D.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("l", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"])), F.array(F.array(F.lit("end"))))
    return rows.select("n_regionkey", X.table_text(cells).alias("md"))


@query("t21_folded", f"SELECT doc_id, {_FOLD.format('text')} AS label FROM documents")
def t21(spark, sf):
    return _docs(spark, sf).select("doc_id", X.fold(F.col("text")).alias("label"))


@query("t22_confidence", "SELECT event_id, CASE WHEN v BETWEEN 0 AND 1 THEN v WHEN v > 1 AND v <= 100 THEN v / 100 END AS c FROM (SELECT event_id, value * 3 - 1 AS v FROM events)")
def t22(spark, sf):
    return D.table(spark, sf, "events").select("event_id", V.normal_confidence(F.col("value") * 3 - 1).alias("c"))


@query("t23_meaningful", "SELECT doc_id, regexp_matches(regexp_replace(text, '[a-zA-Z]', '', 'g'), '[\\p{L}\\p{Nd}]') AS ok FROM documents")
def t23(spark, sf):
    return _docs(spark, sf).select("doc_id", X.meaningful(F.regexp_replace("text", "[a-zA-Z]", "")).alias("ok"))


@query("t34_identifiers", r"SELECT p_partkey, len(list_filter(string_split(c, '.'), lambda x: x = '' OR translate(lower(x), 'abcdefghijklmnopqrstuvwxyz0123456789_-', '') <> '')) = 0 AS code_ok, length(c) BETWEEN 1 AND 64 AND translate(lower(c), 'abcdefghijklmnopqrstuvwxyz0123456789_-', '') = '' AS name_ok FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_type WHEN 1 THEN replace(p_type, ' ', '.') WHEN 2 THEN replace(p_type, ' ', '_') || '-1' WHEN 3 THEN p_partkey || 'a' WHEN 4 THEN replace(p_type, ' ', '..') WHEN 5 THEN repeat(p_brand[1:5], 1 + p_size // 2) ELSE p_type || chr(10) END AS c FROM part)")
def t34(spark, sf):
    """Codes with capitals, digits first, hyphens, spaces, empty parts, a line end, and too long ones."""
    code = F.expr("case p_partkey % 7 when 0 then p_type when 1 then replace(p_type, ' ', '.') when 2 then concat(replace(p_type, ' ', '_'), '-1') when 3 then concat(p_partkey, 'a') when 4 then replace(p_type, ' ', '..') when 5 then repeat(substr(p_brand, 1, 5), cast(1 + p_size div 2 as int)) else concat(p_type, '\n') end")
    return D.table(spark, sf, "part").select("p_partkey", X.valid_type_code(code).alias("code_ok"), X.valid_field_name(code).alias("name_ok"))


@query("t36_flags", oracle("SELECT id, review_reasons | 8 AS added, review_reasons & ~8 AS removed, (review_reasons & 57) <> 0 AS blocking FROM d_documents"))
def t36(spark, sf):
    flags = F.col("review_reasons")
    return D.documents(spark, sf).select("id", V.with_flag(flags, 8).alias("added"), V.without_flag(flags, 8).alias("removed"), V.blocking(flags).alias("blocking"))
