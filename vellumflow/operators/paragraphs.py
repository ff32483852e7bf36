"""Lines of pages to headings and paragraphs: sizes give the headings, the pitch of wrapped lines tells paragraphs apart.

Lines are rows (keys, line, text, left, right, bottom, top, as layout.text_lines gives them). A page's windows sort its lines;
what is gathered in a row is the text of one paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions import text as X
from vellumflow.operators.graph import cut
from vellumflow.operators.layout import median_positive

LEVELS, BOLD_GAP = 6, 2  # most heading levels; points above body text from which a heading need not be bold
FULL_LINES, MARGIN, PITCH = 3, 2.0, 1.2  # full lines that a model needs; line heights within which a line reaches the margin; wrap pitches within which a paragraph goes on
PLAIN_PITCH = 1.6  # line heights within which it does without a model

#: Letters of scripts that put no spaces between words: kana, unified and compatibility ideographs, wide forms, punctuation (fixed values).
UNSPACED = "\u3000-\u303f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff00-\uffef"


def heading_scale(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, body, levels: the commonest size of each document, of equally common ones the largest, and up to six larger ones, the largest first.

    sizes: keys, size, count (letters of that size). Sizes are rounded to points, halves to even; sizes and counts that are not
    positive, and nulls, count nothing. The different sizes of a document are few, so they stand in one array.
    """
    counted = sizes.select(*keys, F.bround("size").cast("int").alias("size"), "count").where("size > 0 AND count > 0").groupBy(*keys, "size").agg(F.sum("count").alias("n"))
    both = counted.groupBy(*keys).agg(F.max_by("size", F.struct("n", "size")).alias("body"), F.collect_set("size").alias("levels"))
    larger = F.filter("levels", lambda s: s > F.col("body"))
    return both.withColumn("levels", F.slice(F.sort_array(larger, asc=False), 1, LEVELS))


def heading_level(size: Column, bold: Column, body: Column, levels: Column) -> Column:
    """The level of a line with this largest size, from 1, or 0 for body text; little larger than body text needs to be bold. Nulls give 0."""
    points = F.bround(size).cast("int")
    strong = (points - body >= BOLD_GAP) | F.coalesce(bold, F.lit(False))
    return F.coalesce(F.when(strong, F.array_position(levels, points)), F.lit(0)).cast("int")


def with_levels(lines: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """lines (of columns keys, size, bold and others) with level, by the sizes of their documents."""
    scale = heading_scale(sizes, keys).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("body").alias("_body"), F.col("levels").alias("_levels"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    level = heading_level(F.col("size"), F.col("bold"), F.col("_body"), F.col("_levels"))
    return lines.join(scale, same, "left").withColumn("level", level).select(*lines.columns, "level")


def paragraph_model(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, height, pitch, margin, tolerance: how each page's lines wrap.

    height is the median of the positive line heights. The margin is the median of the right ends of the wider half of lines, so
    one line that is too wide does not move it. Lines that end within two heights of it are full, and the median of the steps
    down from them, times 1.2, is the pitch up to which a paragraph goes on. A page with fewer than three such steps, or
    without height, has no model: pitch, margin and tolerance are null.
    """
    page = Window.partitionBy(*keys)
    rank, n = F.row_number().over(page.orderBy("right")) - 1, F.count(F.lit(1)).over(page)
    down = page.orderBy(F.desc("top"), "line")
    placed = lines.select(*keys, "line", "right", (F.col("top") - F.col("bottom")).alias("high"), rank.alias("rank"), n.alias("n"), (F.lag("top").over(down) - F.col("top")).alias("step"), F.lag("right").over(down).alias("above"))
    lower = F.floor(F.col("n") / 2)
    middle = lower + F.floor((F.col("n") - lower) / 2)
    sides = placed.groupBy(*keys).agg(median_positive(F.col("high")).alias("height"), F.max(F.when(F.col("rank") == middle, F.col("right"))).alias("margin"), F.max("n").alias("n"))
    margins = sides.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "margin", "height", (F.col("height") * MARGIN).alias("tolerance"), F.col("n").alias("lines"))
    full = F.when((F.col("step") > 0) & (F.col("above") >= F.col("margin") - F.col("tolerance")), F.col("step"))
    met = placed.join(margins, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    out = met.groupBy(*keys, "margin", "height", "tolerance", "lines").agg(F.count(full).alias("steps"), median_positive(full).alias("wrap"))
    sure = (F.col("lines") > FULL_LINES) & (F.col("height") > 0) & (F.col("steps") >= FULL_LINES)
    return out.select(*keys, "height", F.when(sure, F.col("wrap") * PITCH).alias("pitch"), F.when(sure, F.col("margin")).alias("margin"), F.when(sure, F.col("tolerance")).alias("tolerance"))


def paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, level, lines, text, markdown: headings and paragraphs of each page, numbered from 0 in the order of lines.

    lines: as above, with level. A line goes on the paragraph of the line before it if that one is full and the step down to it is
    within the page's pitch; on a page without a model, if the step is within 1.6 line heights. A heading is a block of its own;
    headings of one level that follow each other are one. Lines are joined by a space, but not between two letters of a script
    without spaces in a paragraph, nor where one is empty there. Lines with a null side have no place and are left out; a null level is 0.
    """
    known = lines.where("right IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL").select(*keys, "line", F.coalesce("text", F.lit("")).alias("text"), "right", "bottom", "top", F.coalesce("level", F.lit(0)).alias("level"))
    known = cut(known, "leveled")  # read for the model and for the paragraphs
    model = paragraph_model(known, keys).select(*[F.col(k).alias(f"_of_{k}") for k in keys], "height", "pitch", "margin", "tolerance")
    rows = known.join(model, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    along = Window.partitionBy(*keys).orderBy("line")
    step, before = F.lag("top").over(along) - F.col("top"), F.lag("level").over(along)
    was_full = F.lag(F.col("right") >= F.col("margin") - F.col("tolerance")).over(along)
    wraps = F.when(F.col("pitch").isNotNull(), was_full & (step <= F.col("pitch"))).otherwise((F.col("height") > 0) & (step <= F.col("height") * PLAIN_PITCH))
    goes_on = F.when((F.col("level") > 0) | (before > 0), F.col("level") == before).otherwise(wraps)
    starts = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    last = F.lag("text").over(along)
    tight = (F.col("level") == 0) & ((last == "") | (F.col("text") == "") | (F.regexp_like(last, F.lit(f"[{UNSPACED}]\\z")) & F.regexp_like("text", F.lit(f"^[{UNSPACED}]"))))
    glued = rows.withColumn("starts", starts).withColumn("glue", F.when((F.col("starts") == 1) | tight, "").otherwise(" "))
    numbered = glued.withColumn("block", (F.sum("starts").over(along) - 1).cast("long"))
    joined = F.array_sort(F.collect_list(F.struct("line", F.concat("glue", "text").alias("t"))))
    text = F.array_join(F.transform("w", lambda w: w["t"]), "")
    heading = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), X.escape_inline(F.col("text")))
    return numbered.groupBy(*keys, "block").agg(F.first("level").alias("level"), F.count(F.lit(1)).alias("lines"), joined.alias("w")).withColumn("text", text).select(
        *keys, "block", "level", "lines", "text", F.when(F.col("level") > 0, heading).otherwise(X.escape_line(X.escape_inline(F.col("text")))).alias("markdown")
    )
