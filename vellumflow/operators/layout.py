"""Page geometry as joins, windows and rounds: overlaps, nearest neighbours, column cuts, ruled grids, group transforms.

Boxes and points are rows; a page is a key. Nothing gathers a page in a task: what is near each other meets in bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.operators.graph import along_hierarchy, cut, linked_components

BIN_ROWS = 20_000  # of one side in a bin; a fuller bin is dealt to several tasks
CAPTION_LINES = 6  # a caption stands within so many line heights of its figure
BRIDGES = 0.34  # share of lines that may reach over a gap between columns
RULE_LENGTH, RULE_THICKNESS, TOLERANCE = 18.0, 3.0, 3.0  # of drawn rules, in points


def _binned(rows: DataFrame, low: str, high: str, width: float) -> DataFrame:
    finite = f"{low} <= {high} AND abs({low}) < 1e300 AND abs({high}) < 1e300"
    return rows.where(finite).withColumn("bin", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))


def _meeting(left: DataFrame, right: DataFrame, keys: list[str], width: float | None, bin_rows: int) -> DataFrame:
    """touching() with the bin and the task where a pair met: about bin_rows rows of the left side are in one, and pairs are partitioned by them."""
    if width is None:
        lengths = left.select(F.col("high") - F.col("low")).union(right.select(F.col("high") - F.col("low"))).toDF("n")
        width = lengths.where("n > 0 AND n < 1e300").agg(F.percentile_approx("n", 0.9)).first()[0] or 1.0
    a = _binned(left.select(*keys, "low", "high", F.struct(*left.columns).alias("a")), "low", "high", width)
    b = _binned(right.select(*keys, F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.struct(*right.columns).alias("b")), "low_b", "high_b", width)
    place = [*keys, "bin"]
    full = a.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / bin_rows).cast("int").alias("tasks")).where("tasks > 1")
    full = F.broadcast(full)  # at most a row for each bin_rows rows
    a = a.join(full, place, "left").withColumn("task", F.pmod(F.xxhash64("a"), F.coalesce("tasks", F.lit(1)).cast("long")).cast("int")).drop("tasks")
    b = b.join(full, place, "left").withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    met = a.join(b, [*place, "task"]).where("low <= high_b AND low_b <= high")
    return met.where(F.floor(F.greatest("low", "low_b") / width).cast("long") == F.col("bin")).select(*place, "task", "a", "b")


def touching(left: DataFrame, right: DataFrame, keys: list[str], width: float | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Pairs of rows with equal keys whose intervals [low, high] have a point in common: keys, a and b (the rows as structs).

    Both sides have the columns low and high. Each interval goes to the bins that it touches, bins are joined by number, and a
    pair counts where the later of both starts. A bin with many rows of the left side is dealt to several tasks, and the right
    rows go to each of them. Without a width, bins are as wide as nine tenths of the intervals at most. Nulls, infinite ends and
    intervals that end before they start touch nothing.
    """
    return _meeting(left, right, keys, width, bin_rows).select(*keys, "a", "b")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], share: float = 0.5, width: float | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """keys, a, b, overlap of the touching pairs that have at least a share of the shorter interval in common.

    An interval without length overlaps nothing.
    """
    # both sides are read several times: for the width of bins, for full bins, for the join
    left, right = (cut(left, "intervals"),) * 2 if left is right else (cut(left, "intervals"), cut(right, "intervals"))
    both = F.least("a.high", "b.high") - F.greatest("a.low", "b.low")
    shorter = F.least(F.col("a.high") - F.col("a.low"), F.col("b.high") - F.col("b.low"))
    pairs = touching(left, right, keys, width, bin_rows).where((both > 0) & (shorter > 0))
    return pairs.withColumn("overlap", both / shorter).where(F.col("overlap") >= share)


def median_positive(value: Column) -> Column:
    """The median of the positive values; 0 if there are none."""
    return F.coalesce(F.percentile(F.when(value > 0, value), 0.5), F.lit(0.0))


def near(items: DataFrame, targets: DataFrame, keys: list[str], wrap: tuple[str, str] = ("item", "target")) -> DataFrame:
    """keys, item, place, target, target_place, distance (squared) of the pairs within reach of each other.

    Items and targets have the columns keys, id, place, x, y; reach is a column of items, one value for each key. Items go to the
    cells that they reach of a grid twice as wide as the reach, which are four. Nulls are near to nothing; a reach that is not positive reaches nothing.
    """
    item, target = wrap
    reaches = items.where("reach > 0").groupBy(*keys).agg(F.max("reach").alias("reach"))
    cell = lambda c, by=0: F.floor((F.col(c) + by * F.col("reach")) / (2 * F.col("reach"))).cast("long")
    placed = items.drop("reach").join(reaches, keys).select(*keys, F.col("id").alias(item), "place", F.col("x").alias("ix"), F.col("y").alias("iy"), "reach")
    for c in "xy":  # a little more than the reach, as distances are rounded
        placed = placed.withColumn(f"c{c}", F.explode(F.sequence(cell(f"i{c}", -1.000001), cell(f"i{c}", 1.000001))))
    others = targets.join(reaches, keys).select(*keys, F.col("id").alias(target), F.col("place").alias("target_place"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    met = placed.join(others, [*keys, "cx", "cy"])
    squared = (F.col("x") - F.col("ix")) * (F.col("x") - F.col("ix")) + (F.col("y") - F.col("iy")) * (F.col("y") - F.col("iy"))
    return met.withColumn("distance", squared).where("distance <= reach * reach").select(*keys, item, "place", target, "target_place", "distance")


def bind_captions(items: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, target, distance: items take, in the order of their place, the nearest target within reach that is still free.

    Of targets equally near, the one with the largest place counts. In each round those pairs are bound of which the target is
    the item's nearest free one and the item the first free one in the target's reach: no earlier item can want that target, and
    the first free item of a key always finds its own, so rounds end, usually after a few. For columns see near(); ids and
    places are unique within a key.
    """
    free = cut(near(items, targets, keys), "near")
    bound = None
    while True:
        nearest = free.groupBy(*keys, "item").agg(F.min_by(F.struct("target", "distance"), F.struct("distance", (-F.col("target_place")).alias("p"))).alias("n")).select(*keys, "item", "n.*")
        first = free.groupBy(*keys, "target").agg(F.min_by("item", F.struct("place", "item")).alias("item"))
        pairs = cut(nearest.join(first, [*keys, "item", "target"]), "bound")
        if pairs.isEmpty():
            return pairs if bound is None else bound
        bound = pairs if bound is None else bound.unionByName(pairs)
        free = cut(free.join(pairs, [*keys, "item"], "left_anti").join(pairs, [*keys, "target"], "left_anti"), "near")


def _islands(rows: DataFrame, groups: list[str], gap: Column) -> DataFrame:
    """groups, left, right: intervals of a group that are joined where the gap to all before is at most so wide."""
    along = Window.partitionBy(*groups).orderBy("left", "right")
    reached = F.max("right").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(reached.isNull() | (F.col("left") - reached > gap), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*groups, "island").agg(F.min("left").alias("left"), F.max("right").alias("right"))


def column_cuts(cells: DataFrame, keys: list[str], bridges: float = BRIDGES) -> DataFrame:
    """keys, cuts: where the columns of each table are cut, ascending.

    Cells have keys, line, left, right and gutter, the least width of a gap, one value for each table. Each line is a set of spans, its cells
    with smaller gaps closed. One model cuts before every span of the first line but the first; the other sweeps over the ends
    of all spans and cuts in the middle of each gap within the table that a share of the lines at most reaches over. The model
    with more cuts counts; of equals, the sweep. Tables without a cut have an empty array. Ends may come in either order; cells
    with a null are left out.
    """
    whole = cells.where("left IS NOT NULL AND right IS NOT NULL AND line IS NOT NULL").select(*keys, "line", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "gutter")
    tables = whole.groupBy(*keys).agg(F.min("left").alias("x0"), F.max("right").alias("x1"), F.max("gutter").alias("gutter"), F.count_distinct("line").alias("lines"), F.min("line").alias("top"))
    spans = _islands(whole, [*keys, "line", "gutter"], F.col("gutter"))
    header = spans.join(tables.select(*keys, F.col("top").alias("line")), [*keys, "line"]).where("island > 1")
    header = header.groupBy(*keys).agg(F.array_sort(F.collect_list("left")).alias("header"))
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col("left").alias("x"), F.lit(1).alias("step")), F.struct(F.col("right").alias("x"), F.lit(-1).alias("step")))).alias("e")).select(*keys, "e.*")
    edges = ends.groupBy(*keys, "x").agg(F.sum("step").alias("step"))
    along = Window.partitionBy(*keys).orderBy("x")
    depth = edges.withColumn("depth", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("x").over(along)).where("next IS NOT NULL")
    low = depth.join(tables, keys).withColumn("open", F.col("depth") <= F.floor(F.col("lines") * F.lit(bridges)))
    changed = F.when(F.col("open") != F.lag("open", 1).over(along), 1).otherwise(0)
    stretches = low.withColumn("changed", changed).withColumn("stretch", F.sum("changed").over(along.rowsBetween(Window.unboundedPreceding, 0))).where("open")
    gaps = stretches.groupBy(*keys, "stretch").agg(F.min("x").alias("start"), F.max("next").alias("stop"), F.first("gutter").alias("gutter"), F.first("x0").alias("x0"), F.first("x1").alias("x1"))
    swept = gaps.where("stop - start >= gutter AND start > x0 AND stop < x1").groupBy(*keys).agg(F.array_sort(F.collect_list((F.col("start") + F.col("stop")) / 2)).alias("swept"))
    none = F.array().cast("array<double>")
    both = tables.select(*keys).join(header, keys, "left").join(swept, keys, "left").select(*keys, F.coalesce("header", none).alias("header"), F.coalesce("swept", none).alias("swept"))
    return both.select(*keys, F.when(F.size("header") > F.size("swept"), F.col("header")).otherwise(F.col("swept")).cast("array<double>").alias("cuts"))


def column_bands(cells: DataFrame, keys: list[str], cuts: DataFrame) -> DataFrame:
    """keys, column, left, right, cells: the extent of the cells whose middle lies in each column; a middle on a cut lies before it. Empty columns are left out."""
    middle = (F.least("left", "right") + F.greatest("left", "right")) / 2
    placed = cells.where("left IS NOT NULL AND right IS NOT NULL AND line IS NOT NULL").join(cuts, keys).withColumn("column", F.size(F.filter("cuts", lambda c: c < middle)))
    return placed.groupBy(*keys, "column").agg(F.min(F.least("left", "right")).alias("left"), F.max(F.greatest("left", "right")).alias("right"), F.count(F.lit(1)).alias("cells"))


def rules(boxes: DataFrame, length: float = RULE_LENGTH, thickness: float = RULE_THICKNESS) -> DataFrame:
    """page, rule, across, at, low, high: the straight rules that boxes (page, id, left, bottom, right, top) draw.

    A long thin box is a rule in its middle; a box that is long both ways is four, its sides; others, and those with a null, are none.
    across is true for horizontal rules, whose at is y and whose low and high are x. Ends may come in either order.
    """
    sorted_ = boxes.select("page", "id", F.least("left", "right").alias("l"), F.greatest("left", "right").alias("r"), F.least("bottom", "top").alias("b"), F.greatest("bottom", "top").alias("t")).where("l IS NOT NULL AND r IS NOT NULL AND b IS NOT NULL AND t IS NOT NULL")

    def one(across: bool, at: str, low: str, high: str) -> Column:
        return F.struct(F.lit(across).alias("across"), F.expr(at).cast("double").alias("at"), F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high"))

    wide, high = F.col("r") - F.col("l"), F.col("t") - F.col("b")
    drawn = F.when((wide >= length) & (high <= thickness), F.array(one(True, "(t + b) / 2", "l", "r"))).when((high >= length) & (wide <= thickness), F.array(one(False, "(l + r) / 2", "b", "t")))
    drawn = drawn.when((wide >= length) & (high >= length), F.array(one(True, "t", "l", "r"), one(True, "b", "l", "r"), one(False, "l", "b", "t"), one(False, "r", "b", "t")))
    return sorted_.select("page", "id", F.posexplode(drawn).alias("side", "rule")).select("page", (F.col("id") * 4 + F.col("side")).alias("rule"), "rule.*")


def clustered(values: Column, tolerance: float = TOLERANCE) -> Column:
    """Ascending means of sorted values: a cluster takes what is within the tolerance of its first value."""
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(None).cast("double").alias("first"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def add(s: Column, v: Column) -> Column:
        joins = s["first"].isNotNull() & (v - s["first"] <= tolerance)
        done = F.when(joins | s["first"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["sum"] / s["n"])))
        return F.struct(done.alias("done"), F.when(joins, s["first"]).otherwise(v).alias("first"), (F.when(joins, s["sum"]).otherwise(0.0) + v).alias("sum"), (F.when(joins, s["n"]).otherwise(0) + 1).alias("n"))

    return F.reduce(values, start, add, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["sum"] / s["n"]))).otherwise(s["done"]))


def ruled_grids(drawn: DataFrame, tolerance: float = TOLERANCE, bin_rows: int = BIN_ROWS) -> DataFrame:
    """page, grid, columns, rows: ascending boundaries of each drawn table of two columns and two rows at least.

    A table is what crossing rules connect, directly or over others; grid is its least rule. Rules (see rules()) that nearly
    coincide are one boundary. The rules of one table are gathered in a row, those of a page are not. Where rules meet, all that
    cross the same upright one are linked with the least of them, so links are about as many as rules, not as crossings.
    """
    drawn = cut(drawn, "rules")
    lying = drawn.where("across").select("page", "rule", "at", F.col("low").alias("from"), F.col("high").alias("to"), (F.col("low") - tolerance).alias("low"), (F.col("high") + tolerance).alias("high"))
    upright = drawn.where("NOT across").select("page", "rule", "at", F.col("low").alias("from"), F.col("high").alias("to"), F.col("at").alias("low"), F.col("at").alias("high"))
    met = _meeting(lying, upright, ["page"], 128.0, bin_rows).where(F.col("a.at").between(F.col("b.from") - tolerance, F.col("b.to") + tolerance))
    met = met.select("page", "bin", "task", F.col("a.rule").alias("a"), F.col("b.rule").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    met = met.withColumn("least", F.min("a").over(Window.partitionBy("page", "bin", "task", "b")))  # where they met: no exchange, about bin_rows rows at most
    linked = linked_components(met.select(F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("least").alias("b")))
    placed = drawn.where("rule IS NOT NULL").join(linked.withColumnRenamed("node", "rule"), "rule", "left").withColumn("grid", F.coalesce("component", "rule"))
    gathered = placed.groupBy("page", "grid").agg(F.array_sort(F.collect_list(F.when(~F.col("across"), F.col("at")))).alias("x"), F.array_sort(F.collect_list(F.when(F.col("across"), F.col("at")))).alias("y"))
    # written, so that each filter and join condition on the boundaries does not cluster them again
    found = cut(gathered.select("page", "grid", clustered(F.col("x"), tolerance).alias("columns"), clustered(F.col("y"), tolerance).alias("rows")), "grids")
    return found.where(F.least(F.size("columns"), F.size("rows")) >= 3)


def in_grids(points: DataFrame, grids: DataFrame) -> DataFrame:
    """points (page, x, y, ...) with the grid, row and column whose half-open bands hold them, rows from the top; nulls for points outside all grids of their page.

    A point in several grids gives a row for each.
    """
    bounds = grids.select("page", "grid", "columns", "rows", *(F.element_at(c, i).alias(n) for n, c, i in (("x0", "columns", 1), ("x1", "columns", -1), ("y0", "rows", 1), ("y1", "rows", -1))))
    inside = (points["page"] == bounds["page"]) & (points["x"] >= bounds["x0"]) & (points["x"] < bounds["x1"]) & (points["y"] >= bounds["y0"]) & (points["y"] < bounds["y1"])
    met = points.join(bounds, inside, "left")
    column = F.size(F.filter("columns", lambda c: c <= points["x"])) - 1
    row = F.size("rows") - 1 - F.size(F.filter("rows", lambda c: c <= points["y"]))
    return met.select(*(points[c] for c in points.columns), "grid", F.when(F.col("grid").isNotNull(), row).alias("row"), F.when(F.col("grid").isNotNull(), column).alias("column"))


def group_transforms(groups: DataFrame, deepest: int = 64) -> DataFrame:
    """groups with off_x, off_y, scale_x, scale_y, depth: slide = off + scale * local for what stands in each group.

    Groups have id, parent and, for both axes, offset, extent, child_offset and child_extent (offset_x and so on), each of
    which may be null. A null or zero child extent, or a null extent, scales by 1. Groups that no root reaches get nulls.
    """
    root, child = {}, {}
    for axis in "xy":
        scale = F.when(F.col(f"child_extent_{axis}") != 0, F.col(f"extent_{axis}").cast("double") / F.col(f"child_extent_{axis}"))
        scale = F.coalesce(scale, F.lit(1.0))
        offset, shift = (F.coalesce(F.col(f"{n}_{axis}"), F.lit(0)).cast("double") for n in ("offset", "child_offset"))
        root[f"off_{axis}"], root[f"scale_{axis}"] = offset - shift * scale, scale
        above, by = F.col(f"above_off_{axis}"), F.col(f"above_scale_{axis}")
        child[f"off_{axis}"], child[f"scale_{axis}"] = above + by * offset - by * shift * scale, by * scale
    return along_hierarchy(groups, root, child, deepest)


def on_slide(local: Column, off: Column, scale: Column) -> Column:
    """Where a local offset lies on the slide, cut to a whole number; without one, where the group's frame begins."""
    return F.when(local.isNull(), off).otherwise(off + scale * local).cast("long")


ROW_OVERLAP, FULL_WIDTH = 0.5, 0.7  # share of the smaller height that puts two boxes in a row; share of the content's width that makes a block a band


def _fold_rows(rows: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Numbers of rows within a strip, from boxes sorted by strip and downwards. Only rows that a further box can join are held."""
    strip, numbers, open_rows = None, 0, []
    for batch in rows:
        out = []
        for at, top, bottom in zip(zip(*(batch[k].tolist() for k in keys)), batch["top"].tolist(), batch["bottom"].tolist()):
            if at != strip:
                strip, numbers, open_rows = at, 0, []
            open_rows = [r for r in open_rows if r[1] < top]
            for r in open_rows:
                least = min(r[0] - r[1], top - bottom)
                if least > 0 and (min(r[0], top) - max(r[1], bottom)) / least >= ROW_OVERLAP:
                    r[:2] = top, bottom
                    out.append(r[2])
                    break
            else:
                open_rows.append([top, bottom, numbers])
                out.append(numbers)
                numbers += 1
        yield batch.assign(row=out)


def in_rows(items: DataFrame, keys: list[str]) -> DataFrame:
    """items (keys, place, top, bottom, ...) with strip and row: boxes side by side have the same of both.

    From the top down, a box joins the first row whose last box it overlaps by half of the smaller height; boxes equally high
    come by place. A strip is what lies between heights that no box reaches over, so strips of a page are dealt out and a task
    holds the open rows of one. Boxes with a null are left out; keys are compared as texts; one without height is a row of its own.
    """
    known = items.where("top IS NOT NULL AND bottom IS NOT NULL")
    down = Window.partitionBy(*keys).orderBy(F.desc("top"), "place")
    lowest = F.min("bottom").over(down.rowsBetween(Window.unboundedPreceding, -1))
    marked = known.withColumn("starts", F.when(lowest.isNull() | (lowest >= F.col("top")), 1).otherwise(0))
    marked = marked.withColumn("strip", F.sum("starts").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")
    # what a task needs is the order, so only the geometry goes through it
    slim = marked.select(F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in keys)).alias("of"), "strip", "place", "top", "bottom")
    spread = slim.repartition("of", "strip").sortWithinPartitions("of", "strip", F.desc("top"), "place")
    numbered = spread.mapInPandas(lambda batches: _fold_rows(batches, ["of", "strip"]), "of string, strip long, place long, top double, bottom double, row long")
    of = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in keys))
    found = numbered.select(F.col("of").alias("_of"), F.col("place").alias("_place"), "row")
    return marked.join(found, (of == F.col("_of")) & (F.col("place") == F.col("_place"))).drop("_of", "_place")


def text_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, text, left, right, bottom, top, words: the lines of each page's words, from the top, then the left, numbered from 0.

    Words have keys, place (their order, unique within the keys), text and the four sides. Blank words are none. Words of a line
    stand from left to right.
    """
    placed = in_rows(words.where(F.length(F.regexp_replace("text", r"(?U)\s+", "")) > 0), keys)
    ordered = F.array_sort(F.collect_list(F.struct("left", (-F.col("top")).alias("down"), "place", "text")))
    lines = placed.groupBy(*keys, "strip", "row").agg(ordered.alias("w"), F.min("left").alias("left"), F.max("right").alias("right"), F.min("bottom").alias("bottom"), F.max("top").alias("top"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("top"), "left", "strip", "row")) - 1
    return lines.select(*keys, number.cast("long").alias("line"), F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"), "left", "right", "bottom", "top", F.size("w").cast("long").alias("words"))


def reading_order(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys, place, left, right, bottom, top) with band and position, from 0, in which they are read.

    A block nearly as wide as its page's content is a band of its own; between such, the others are. Bands are read downwards,
    inside them rows (see in_rows()), and in a row from left to right. Blocks with a null are left out.
    """
    known = blocks.where("left IS NOT NULL AND right IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL")
    page, down = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("top"), "place")
    width = F.max(F.greatest("left", "right")).over(page) - F.min(F.least("left", "right")).over(page)
    wide = known.withColumn("wide", (F.abs(F.col("right") - F.col("left")) >= width * FULL_WIDTH).cast("int"))
    # a wide block starts a band, and so does the block after it
    breaks = F.greatest("wide", F.coalesce(F.lag("wide").over(down), F.lit(1)))
    banded = wide.withColumn("breaks", breaks).withColumn("band", F.sum("breaks").over(down) - 1).drop("wide", "breaks")
    placed = in_rows(banded, [*keys, "band"])
    highest = F.max("top").over(Window.partitionBy(*keys, "band", "strip", "row"))
    ranked = placed.withColumn("highest", highest)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("band", F.desc("highest"), "strip", "row", "left", F.desc("top"), "place")) - 1
    return ranked.withColumn("position", position.cast("long")).drop("highest", "strip", "row")


def xy_cut(boxes: DataFrame, keys: list[str], gap_x: float, gap_y: float, deepest: int = 32) -> DataFrame:
    """boxes (keys, left, right, bottom, top, ...) with path: where each lies when its page is cut in two at the widest gap, and the parts again.

    A gap counts in units of the least gap of its direction, and must have one at least; of equally wide ones the upright cut
    goes first, then the one further left or up. 0 is the left or upper part, so paths in order are a reading order. All parts
    of all pages are cut in one round; a part is not cut deeper than deepest. Boxes with a null have a null path.
    """
    sides = ["left", "right", "bottom", "top"]
    missing = " OR ".join(f"{s} IS NULL" for s in sides)
    going = boxes.where(f"NOT ({missing})").withColumn("path", F.lit(""))
    found = boxes.where(missing).withColumn("path", F.lit(None).cast("string"))
    part = [*keys, "path"]
    whole, across, down = Window.partitionBy(*part), Window.partitionBy(*part).orderBy("left", "right"), Window.partitionBy(*part).orderBy(F.desc("top"), F.desc("bottom"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    widest = lambda free, edge: F.max(F.struct(F.col(free).alias("free"), edge.alias("edge"))).over(whole)
    for _ in range(deepest):
        # all windows are over the same parts, so a round is one exchange of the boxes whose part was cut in the round before
        free_x = (F.col("left") - F.max("right").over(before(across))) / gap_x
        free_y = (F.min("bottom").over(before(down)) - F.col("top")) / gap_y
        gaps = going.withColumn("_fx", free_x).withColumn("_fy", free_y)
        gaps = gaps.withColumn("_x", widest("_fx", -F.col("left"))).withColumn("_y", widest("_fy", F.col("top")))
        upright = F.coalesce((F.col("_x.free") >= 1) & (F.col("_x.free") >= F.coalesce("_y.free", F.lit(0.0))), F.lit(False))
        behind = F.when(upright, F.col("left") >= -F.col("_x.edge")).when(F.col("_y.free") >= 1, F.col("top") <= F.col("_y.edge"))
        state = gaps.withColumn("_cut", behind.isNotNull()).withColumn("path", F.concat("path", F.when(behind, "1").when(~behind, "0").otherwise("")))
        state = cut(state.select(*boxes.columns, "path", "_cut"), "parts")
        found = found.unionByName(state.where("NOT _cut").drop("_cut"))
        going = state.where("_cut").drop("_cut")
        if going.isEmpty():
            return found
    return found.unionByName(going)


#: A placeholder without a type is a body, and a centred title is a title.
BODY, TITLES = "body", {"ctrTitle": "title"}


def _placeholder(rows: DataFrame, *keep: str) -> DataFrame:
    kind = F.coalesce("type", F.lit(BODY))
    for name, same in TITLES.items():
        kind = F.when(kind == name, same).otherwise(kind)
    return rows.select(*keep, F.coalesce("index", F.lit(0)).cast("long").alias("index"), kind.alias("type"))


def shape_positions(shapes: DataFrame, frames: DataFrame, layouts: DataFrame, masters: DataFrame) -> DataFrame:
    """id, pos_x, pos_y: where each shape lies on its slide, as whole numbers.

    shapes: id, parent (its group, null on the slide itself), x, y (its own offset), is_placeholder, index, type, layout, master.
    frames: what group_transforms() gives. layouts and masters: of (a layout's or master's id), place, x, y, index, type. A shape with an
    offset lies where its group puts that; a half offset counts as none. Without one, in a group, it lies where the group begins; on
    the slide, a placeholder takes the offset of the first placeholder with its index (null is 0) and type in its layout, else in
    its master; all others lie at 0. Shapes in a group that no root reaches have nulls. Ids are unique; nulls match no layout.
    """
    known = shapes.withColumn("own", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y")))
    slots = _placeholder(known.where("own IS NULL AND parent IS NULL AND is_placeholder"), "id", "layout", "master")
    for name, source in (("layout", layouts), ("master", masters)):
        whole = source.where("x IS NOT NULL AND y IS NOT NULL").withColumn("at", F.struct("x", "y"))
        first = _placeholder(whole, "of", "place", "at").groupBy("of", "index", "type").agg(F.min_by("at", "place").alias(f"by_{name}")).withColumnRenamed("of", name)
        slots = slots.join(first, [name, "index", "type"], "left")
    inherited = slots.select("id", F.coalesce("by_layout", "by_master").alias("inherited"))
    placed = frames.where("id IS NOT NULL").select(F.struct(F.lit(0).cast("long").alias("spread"), F.col("id").alias("of")).alias("_group"), *(F.col(f"{n}_{a}").alias(f"frame_{n}_{a}") for n in ("off", "scale") for a in "xy"))
    # shapes on the slide itself are in no group; by a key of null they would all come into one task
    group = F.struct(F.when(F.col("parent").isNull(), F.xxhash64("id")).otherwise(F.lit(0).cast("long")).alias("spread"), F.col("parent").alias("of"))
    met = known.withColumn("_group", group).join(placed, "_group", "left").join(inherited, "id", "left")

    def at(axis: str) -> Column:
        off, scale = F.col(f"frame_off_{axis}"), F.col(f"frame_scale_{axis}")
        in_group = on_slide(F.col("own")[axis], off, scale)
        return F.when(F.col("parent").isNotNull(), in_group).otherwise(F.coalesce(F.col("own")[axis], F.col("inherited")[axis], F.lit(0))).cast("long").alias(f"pos_{axis}")

    return met.select("id", at("x"), at("y"))
