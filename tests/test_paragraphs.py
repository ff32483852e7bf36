"""Headings by size and paragraphs by pitch, on literal pages and against plain Python."""

import random
import statistics

from pyspark.sql import functions as F

from vellumflow.operators import paragraphs as P

LINE = "page long, line long, text string, left double, right double, bottom double, top double, level int"


def scale_of(spark, *sizes):
    return [(r.doc, r.body, r.levels) for r in P.heading_scale(spark.createDataFrame(list(sizes), "doc string, size double, count long"), ["doc"]).orderBy("doc").collect()]


def test_larger_sizes_are_levels_in_order(spark):
    assert scale_of(spark, ("d", 10.0, 500), ("d", 18.0, 5), ("d", 14.0, 20), ("d", 8.0, 900 - 800), ("d", 14.4, 1)) == [("d", 10, [18, 14])]


def test_one_size_has_no_headings_and_ties_take_the_larger_body(spark):
    assert scale_of(spark, ("a", 10.2, 5), ("a", 9.9, 5), ("b", 9.0, 5), ("b", 12.0, 5), ("c", 0.4, 5), ("c", None, 5), ("d", 11.0, 0)) == [("a", 10, []), ("b", 12, [])]


def test_more_than_six_sizes_leave_the_smaller_ones_to_the_body(spark):
    assert scale_of(spark, ("d", 10.0, 99), *[("d", 10.0 + k, 1) for k in range(1, 9)]) == [("d", 10, [18, 17, 16, 15, 14, 13])]


def test_halves_are_rounded_to_even(spark):
    assert scale_of(spark, ("d", 10.5, 9), ("d", 11.5, 1), ("d", 12.5, 2)) == [("d", 10, [12])]


def test_a_little_larger_needs_bold(spark):
    rows = spark.createDataFrame([(11.0, False), (11.0, True), (12.0, False), (10.0, True), (13.0, True), (None, True), (11.0, None)], "size double, bold boolean")
    scale = F.lit(10), F.array(F.lit(12), F.lit(11))
    assert [r[0] for r in rows.select(P.heading_level(F.col("size"), F.col("bold"), *scale)).collect()] == [0, 2, 1, 0, 0, 0, 0]


def test_levels_of_a_document_without_sizes(spark):
    lines = spark.createDataFrame([(1, 30.0, True), (None, 30.0, True)], "page long, size double, bold boolean")
    sizes = spark.createDataFrame([(None, 30.0, 1), (None, 10.0, 5)], "page long, size double, count long")
    assert {r.page: r.level for r in P.with_levels(lines, sizes, ["page"]).collect()} == {1: 0, None: 1}


def page(spark, *rows, number=1):
    return spark.createDataFrame([(number, k, *r[:1], 0.0, *r[1:]) for k, r in enumerate(rows)], LINE)


def blocks(df):
    return [(r.level, r.lines, r.text) for r in P.paragraphs(df, ["page"]).orderBy("block").collect()]


def test_a_short_line_ends_its_paragraph_and_so_does_a_wide_step(spark):
    full = [("one", 500.0, 690.0, 700.0, 0), ("two", 499.0, 670.0, 680.0, 0), ("three", 501.0, 650.0, 660.0, 0), ("four", 500.0, 630.0, 640.0, 0), ("short", 200.0, 610.0, 620.0, 0), ("new", 500.0, 590.0, 600.0, 0), ("far", 500.0, 560.0, 570.0, 0)]
    assert blocks(page(spark, *full)) == [(0, 5, "one two three four short"), (0, 1, "new"), (0, 1, "far")]
    model = P.paragraph_model(page(spark, *full), ["page"]).first()
    assert (model.height, model.pitch, model.margin, model.tolerance) == (10.0, 24.0, 500.0, 20.0)


def test_without_a_model_line_heights_decide(spark):
    assert blocks(page(spark, ("a", 10.0, 90.0, 100.0, 0), ("b", 500.0, 74.0, 84.0, 0), ("c", 9.0, 57.0, 67.0, None))) == [(0, 2, "a b"), (0, 1, "c")]
    assert blocks(page(spark, ("flat", 10.0, 5.0, 5.0, 0), ("flat", 10.0, 5.0, 5.0, 0))) == [(0, 1, "flat"), (0, 1, "flat")]


def test_headings_stand_alone_and_meet_their_like(spark):
    rows = page(spark, ("Big", 10.0, 90.0, 100.0, 1), ("title*", 10.0, 88.0, 98.0, 1), ("sub", 10.0, 86.0, 96.0, 2), ("# body", 10.0, 84.0, 94.0, 0), ("more", 10.0, 82.0, 92.0, 0))
    got = P.paragraphs(rows, ["page"]).orderBy("block").collect()
    assert [(r.block, r.level, r.text, r.markdown) for r in got] == [(0, 1, "Big title*", "# Big title\\*"), (1, 2, "sub", "## sub"), (2, 0, "# body more", "\\# body more")]


def test_no_space_between_letters_of_scripts_without_spaces(spark):
    same = lambda *texts: page(spark, *[(t, 10.0, 90.0, 100.0, 0) for t in texts])
    assert blocks(same("ウ", "ェブサイト", "and", "漢", "Ａ", "", None, "x")) == [(0, 8, "ウェブサイト and 漢Ａx")]
    assert blocks(same("。", "ﬀ")) == [(0, 2, "。 ﬀ")]


def test_null_pages_lines_without_place_and_no_lines(spark):
    rows = spark.createDataFrame([(None, 0, "a", 0.0, 1.0, 0.0, 2.0, 0), (None, 1, "b", 0.0, 1.0, 0.0, 2.0, 0), (1, 0, "x", 0.0, None, 0.0, 2.0, 0)], LINE)
    assert [(r.page, r.text) for r in P.paragraphs(rows, ["page"]).collect()] == [(None, "a b")]
    assert P.paragraphs(rows.where("false"), ["page"]).count() == 0 and P.paragraph_model(rows.where("false"), ["page"]).count() == 0


def by_hand(lines):
    """(level, text) of each block of one page's lines (text, right, bottom, top, level)."""
    heights = [t - b for _, _, b, t, _ in lines if t > b]
    height = statistics.median(heights) if heights else 0.0
    ends = sorted(right for _, right, *_ in lines)
    upper = ends[len(ends) // 2 :]
    margin, reach = upper[len(upper) // 2], 2 * height
    down = sorted(lines, key=lambda x: -x[3])
    steps = [a[3] - b[3] for a, b in zip(down, down[1:]) if a[3] > b[3] and a[1] >= margin - reach]
    pitch = statistics.median(steps) * 1.2 if len(lines) > 3 and height > 0 and len(steps) >= 3 else None
    out, last = [], None
    for x in lines:
        if last is None:
            joins = False
        elif x[4] or last[4]:
            joins = x[4] == last[4]
        elif pitch is not None:
            joins = last[1] >= margin - reach and last[3] - x[3] <= pitch
        else:
            joins = height > 0 and last[3] - x[3] <= height * 1.6
        if joins:
            out[-1][1] += " " + x[0]
        else:
            out.append([x[4], x[0]])
        last = x
    return [tuple(o) for o in out]


def test_random_pages_agree_with_plain_python(spark):
    r = random.Random(5)
    pages = {}
    for p in range(40):
        top, lines = 800.0, []
        for k in range(r.choice((1, 3, 4, 9, 30))):
            top -= r.choice((12, 12, 12, 12.5, 20, 40, 0, -30))
            lines.append((f"w{k}", float(r.choice((500, 500, 490, 503, 200))), top - r.choice((8, 9, 10)), top, r.choice((0, 0, 0, 0, 0, 1, 2))))
        pages[p] = lines
    df = spark.createDataFrame([(p, k, t, 0.0, a, b, c, v) for p, lines in pages.items() for k, (t, a, b, c, v) in enumerate(lines)], LINE)
    got = {}
    for row in P.paragraphs(df, ["page"]).orderBy("page", "block").collect():
        got.setdefault(row.page, []).append((row.level, row.text))
    assert got == {p: by_hand(lines) for p, lines in pages.items()}
