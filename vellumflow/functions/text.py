"""Text functions as Columns. White space is Unicode white space unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumflow.functions import model as M

WS = r"(?U)\s+"


def _chain(text: Column, steps) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def cut(text: Column, most: int) -> Column:
    """The first so many characters (code points, so no pair is ever split)."""
    return F.substr(text, F.lit(1), F.lit(most))


#: The patterns of Markdown and what plain text keeps of each, in the order in which they apply. (?d) makes only
#: \n a line end, (?U) makes \s, \w and \d those of Unicode.
_IMAGE = (r"!\[([^\]]*)\]\([^)]*\)", "$1")
_LINK = (r"\[([^\]]+)\]\([^)]*\)", "$1")
_STRONG = (r"(?d)(\*\*|__)(.+?)\1", "$2")
_EMPHASIS = (r"(?dU)(?<!\w)([*_])(.+?)\1(?!\w)", "$2")
_CODE = (r"`([^`]+)`", "$1")
_PLAIN = (
    (r"(?dm)^```[^\n]*\n", ""),
    (r"(?dmU)\n```\s*$", ""),
    _IMAGE,
    _LINK,
    (r"(?dmU)^\s*\|?[\s:\-|]+\|\s*$", ""),
    (r"\|", " "),
    (r"(?dmU)^\s{0,3}#{1,6}\s*", ""),
    (r"(?dmU)^\s{0,3}>\s?", ""),
    (r"(?dmU)^\s{0,3}([-*+]|\d+\.)\s+", ""),
    (r"(?dmU)^\s{0,3}([-*_]\s*){3,}$", ""),
    _STRONG,
    _EMPHASIS,
    _CODE,
    (r"\n{3,}", "\n\n"),
)
_INLINE = (_IMAGE, _LINK, _STRONG, _EMPHASIS, _CODE)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once, however often use names it: inside a lambda it is a variable."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plain_text(markdown: Column) -> Column:
    """Markdown without its marks; lines and single blank lines stay. Null gives an empty text."""
    return F.coalesce(strip(_chain(markdown, _PLAIN)), F.lit(""))


def fold(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(text, WS, " "), F.lit(" "))


def title_of(markdown: Column, most: int = M.TEXT_LIMIT) -> Column:
    """The first heading with a text; else the first line with one outside fenced blocks, no table or other rule, without its quote and list mark. Folded and cut."""
    lines = F.transform(F.split(F.replace(markdown, F.lit("\r\n"), F.lit("\n")), "\n"), strip)
    clean = lambda t: F.nullif(cut(fold(_chain(t, _INLINE)), most), F.lit(""))
    heading = r"(?dU)^#{1,6}\s+(.+?)\s*#*\s*$"
    headings = F.filter(F.transform(F.filter(lines, lambda t: t.rlike(heading)), lambda t: clean(F.regexp_replace(t, heading, "$1"))), lambda t: t.isNotNull())
    body = lambda t: clean(_chain(t, ((r"(?U)^>\s*", ""), (r"(?U)^([-*+]|\d+\.)\s+", ""))))
    # inside: whether a line stands in a fenced block, by the fences before it
    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("string").alias("first"))
    fence = lambda t: t.rlike(r"^(```|~~~)")
    rule = lambda t: t.rlike(r"(?U)^\|?[\s:\-|]+\|?$|^([-*_]\s*){3,}$")
    step = lambda s, t: F.struct((s["inside"] != fence(t)).alias("inside"), F.coalesce(s["first"], F.when(~s["inside"] & ~fence(t) & ~rule(t), body(t))).alias("first"))
    return F.coalesce(F.try_element_at(headings, F.lit(1)), F.aggregate(lines, start, step)["first"])


def title_chain(model: Column, markdown: Column, file_name: Column) -> Column:
    """The model's title, else the document's, else the file name without its ending."""
    blank = lambda t: F.nullif(F.trim(t), F.lit(""))
    return F.coalesce(blank(model), blank(title_of(markdown)), blank(F.regexp_replace(F.regexp_extract(file_name, r"([^/\\]*)$", 1), r"\.[^.]*$", "")))


def tidy_name(text: Column, most: int = M.TEXT_LIMIT) -> Column:
    """A display name: control characters as spaces, folded, cut, no space at the end; null if nothing is left."""
    return F.nullif(F.rtrim(cut(fold(F.regexp_replace(text, r"\p{Cc}", " ")), most)), F.lit(""))


def language_tag(text: Column) -> Column:
    """The text without white space at its ends if that is a tag of letters, digits and hyphens, else null."""
    tag = strip(text)
    return F.when(tag.rlike(r"^[A-Za-z0-9-]{1,16}\z"), tag)


def slug(text: Column, most: int = 64) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends, at most so long."""
    inner = F.btrim(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.btrim(cut(inner, most), F.lit("_"))


def boundary(text: Column, tag: str = "document") -> Column:
    """A text that cannot break out of its tag in a prompt."""
    return F.concat(F.lit(f"<{tag}>\n"), F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(f"\n</{tag}>"))


#: The lines around a text that was read from an embedded image.
OCR_OPEN, OCR_PAGE, OCR_PAGE_END, OCR_CLOSE = "*[Image OCR]*", "*[Image OCR p:", "]*", "*[End OCR]*"


def wrap_ocr(text: Column, page: Column | None = None) -> Column:
    """A text between the marks, each on a line of its own. A page that is null or not positive leaves no number."""
    mark = F.lit(OCR_OPEN) if page is None else F.when(page > 0, F.concat(F.lit(OCR_PAGE), page.cast("string"), F.lit(OCR_PAGE_END))).otherwise(OCR_OPEN)
    return F.concat(mark, F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n" + OCR_CLOSE))


def is_ocr_open(line: Column) -> Column:
    return strip(line).rlike(r"^\*\[Image OCR(?: p:[0-9]+)?\]\*$")


def is_ocr_close(line: Column) -> Column:
    return strip(line) == OCR_CLOSE


def has_ocr(text: Column) -> Column:
    """Whether a line is an opening mark; one that a longer line only mentions does not count."""
    return F.coalesce(F.exists(F.split(text, "\n"), is_ocr_open), F.lit(False))


def strip_ocr(text: Column) -> Column:
    """The text without the lines of the marks, bodies kept. Without an opening mark it stays as it is; null gives an empty text."""
    bare = F.array_join(F.filter(F.split(text, "\n"), lambda t: ~is_ocr_open(t) & ~is_ocr_close(t)), "\n")
    return F.coalesce(F.when(has_ocr(text), bare).otherwise(text), F.lit(""))


def ocr_bodies(text: Column) -> Column:
    """What stands between the marks, joined by line ends; a mark that is never closed opens the rest."""
    start = F.struct(F.lit(False).alias("inside"), F.lit("").alias("body"))
    marked = lambda t: is_ocr_open(t) | is_ocr_close(t)
    more = lambda s, t: F.when(s["inside"] & ~marked(t), F.concat(s["body"], F.when(s["body"] != "", F.lit("\n")).otherwise(""), t)).otherwise(s["body"])
    step = lambda s, t: F.struct((is_ocr_open(t) | (s["inside"] & ~is_ocr_close(t))).alias("inside"), more(s, t).alias("body"))
    return F.coalesce(F.aggregate(F.split(text, "\n"), start, step)["body"], F.lit(""))


def ocr_page(line: Column) -> Column:
    """The page of an opening line; null without one."""
    return F.regexp_extract(strip(line), r"^\*\[Image OCR p:([0-9]+)\]\*$", 1).try_cast("int")


def repeats_itself(text: Column, run: int = 24, ratio: float = 0.3, lines: int = 40, longest: int = 200, period: int = 120, times: int = 8) -> Column:
    """Output of a model that fell into a loop, by any of three rules. Lines are stripped, empty ones don't count.

    At least so many equal lines in a row (2 at least); with so many lines, a share of different ones below the ratio; or a
    line of at least `longest` characters, most of them letters or digits, that repeats a unit of at most `period`
    characters at least so many times.
    """
    full = F.filter(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), strip), lambda t: t != "")
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))
    count = lambda s, t: F.when(t == s["last"], s["n"] + 1).otherwise(1)
    most = F.aggregate(full, start, lambda s, t: F.struct(t.alias("last"), count(s, t).alias("n"), F.greatest(s["most"], count(s, t)).alias("most")))["most"]
    few = (F.size(full) >= lines) & (F.size(F.array_distinct(full)) / F.greatest(F.size(full), F.lit(1)) < ratio)
    n = F.char_length
    # a unit of p characters tiles a line that is the same when shifted by p
    tiled = lambda t: F.exists(F.sequence(F.lit(1), F.lit(period)), lambda p: (F.floor(n(t) / p) >= times) & (F.substr(t, p + 1) == F.left(t, n(t) - p)))
    heavy = lambda t: n(F.regexp_replace(t, r"[^\p{L}\p{Nd}]", "")) * 2 > n(t)
    loop = F.exists(full, lambda t: F.when(n(t) >= longest, F.when(heavy(t), tiled(t)).otherwise(False)).otherwise(False))
    return F.coalesce((most >= max(2, run)) | few | loop, F.lit(False))


def drop_fences(text: Column) -> Column:
    """Without the lines that open or close a code fence, wherever they stand: three marks or more and an info text without a backtick."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda t: ~strip(t).rlike(r"(?s)^(```+|~~~+)[^`]*$")), "\n")


def unwrap_fence(text: Column) -> Column:
    """A text without the fence that it begins with and, if there is one, the fence at its end; null if nothing is left."""
    inner = F.regexp_replace(F.regexp_replace(strip(text), r"^```[^\n]*(\n|\z)", ""), r"```\z", "")
    return F.nullif(F.when(strip(text).startswith("```"), strip(inner)).otherwise(strip(text)), F.lit(""))


#: What is a mark inside a line, and what is a block at the start of one, behind three spaces at most.
INLINE_MARKS = r"[\\`*\[\]<]|(?<![\p{L}\p{Nd}])_|_(?![\p{L}\p{Nd}])"
_HEADING, _QUOTE, _SETEXT, _BREAK = r"#{1,6}(?:[ \t]|\z)", ">", r"=+[ \t]*\z", r"([-*_])(?:[ \t]*\2){2,}[ \t]*\z"
_TABLE_RULE, _BULLET = r"(?=[-:|])(?=[^-]*-)(?=[^|:]*[|:])[-|: \t]+\z", r"[-+*][ \t]"
BLOCK_START = "^( {0,3})(?=" + "|".join((_HEADING, _QUOTE, _SETEXT, _BREAK, _TABLE_RULE, _BULLET)) + ")"
ORDERED_START = r"^( {0,3}[0-9]{1,9})(?=[.)][ \t])"


def escape_inline(text: Column) -> Column:
    """Marks with a backslash before them; an underscore inside a word is none. Null gives an empty text."""
    return F.coalesce(F.regexp_replace(text, INLINE_MARKS, r"\\$0"), F.lit(""))


def escape_line(text: Column) -> Column:
    """A line that would start a heading, quote, list, rule or table with a backslash before its mark. Null gives an empty text."""
    return F.coalesce(_chain(text, ((BLOCK_START, r"$1\\"), (ORDERED_START, r"$1\\"))), F.lit(""))


def escape_block(text: Column) -> Column:
    """A text of several lines whose marks stand for themselves, inside the lines and at their starts."""
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda t: escape_line(escape_inline(t))), "\n")


def _one_line(text: Column) -> Column:
    return strip(F.translate(text, "\r\n", "  "))


def escape_cell(text: Column) -> Column:
    """A table cell: backslashes and bars escaped, line ends as spaces, no white space at its ends."""
    return F.coalesce(_one_line(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))), F.lit(""))


def escape_inline_cell(text: Column) -> Column:
    """A table cell whose marks stand for themselves."""
    return _one_line(F.replace(escape_inline(text), F.lit("|"), F.lit("\\|")))


def table_text(rows: Column) -> Column:
    """An array of arrays as a Markdown table: short rows padded, a rule behind the first. Cells stay as they are: see escape_cell(). No cells give an empty text."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(width > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")).otherwise("")


def meaningful(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{Nd}]")


def valid_type_code(text: Column) -> Column:
    """Letters, digits, underscores and hyphens, in parts between dots."""
    return text.rlike(r"^[A-Za-z0-9_\-]+(\.[A-Za-z0-9_\-]+)*\z")


def valid_field_name(text: Column) -> Column:
    """At most 64 letters, digits, underscores and hyphens."""
    return text.rlike(r"^[A-Za-z0-9_\-]{1,64}\z")


def slices(markdown: Column, markers: Column) -> Column:
    """Array of (ordinal, text, is_sub_document, is_figure) between markers (struct marker, is_sub_document).

    Null where the cut cannot be trusted: no text or no markers, a marker that is blank or is not found, or no slice left.
    Markers stand at line starts, in order, each searched behind the one before; a marker with '&lt;' is tried with '<' as
    well. The first slice begins at the start of the text, the last ends with it; slices are stripped, empty ones left out.
    A slice is a figure if its marker is the opening line of an image's text.
    """
    end = F.char_length(markdown) + 1

    def at_line(marker: Column, start: Column) -> Column:
        first = F.when((start == 1) & F.startswith(markdown, marker), F.lit(1))
        hit = F.call_function("locate", F.concat(F.lit("\n"), marker), markdown, start)
        return F.coalesce(first, F.when(hit > 0, hit + 1))

    def step(state: Column, m: Column) -> Column:
        start = state["next"]
        found = F.when(~m["marker"].rlike(r"(?U)^\s*$"), F.coalesce(at_line(m["marker"], start), at_line(F.replace(m["marker"], F.lit("&lt;"), F.lit("<")), start)))
        return F.struct(F.when(state["ok"] & found.isNotNull(), found + 1).otherwise(start).cast("int").alias("next"), (state["ok"] & found.isNotNull()).alias("ok"), F.concat(state["starts"], F.array(F.struct(F.coalesce(found, F.lit(0)).cast("int").alias("at"), m["is_sub_document"].alias("sub"), is_ocr_open(m["marker"]).alias("figure")))).alias("starts"))

    zero = F.struct(F.lit(1).alias("next"), F.lit(True).alias("ok"), F.slice(F.transform(markers, lambda m: F.struct(F.lit(0).alias("at"), m["is_sub_document"].alias("sub"), is_ocr_open(m["marker"]).alias("figure"))), 1, 0).alias("starts"))

    def cut_at(run: Column) -> Column:
        starts = run["starts"]

        def piece(s: Column, k: Column) -> Column:
            first = F.when(k == 0, F.lit(1)).otherwise(s["at"])
            after = F.when(k + 1 < F.size(starts), F.try_element_at(starts, k + 2)["at"]).otherwise(end)
            return F.struct(strip(F.substr(markdown, first, after - first)).alias("text"), s["sub"].alias("is_sub_document"), s["figure"].alias("is_figure"))

        parts = F.filter(F.transform(starts, piece), lambda p: p["text"] != "")
        return F.when(run["ok"], F.transform(parts, lambda p, k: F.struct(k.cast("long").alias("ordinal"), p["text"].alias("text"), p["is_sub_document"].alias("is_sub_document"), p["is_figure"].alias("is_figure"))))

    return once(once(F.aggregate(markers, zero, step), cut_at), lambda found: F.when(F.size(found) > 0, found))
