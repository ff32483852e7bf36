"""Page geometry as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumflow.operators import layout as L
from vellumflow.operators import paragraphs as P
from vellumflow.operators.graph import cut
from vellumflow.plans.registry import query
from vellumflow.sources import derived as D
from vellumflow.sources.derived import oracle


@query("j9_overlaps", oracle("""SELECT a.page, a.id AS a, b.id AS b, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) AS overlap FROM d_boxes a JOIN d_boxes b ON a.page = b.page AND a.id < b.id
  WHERE least(a.y1, b.y1) > greatest(a.y0, b.y0) AND (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) >= 0.5"""))
def j9(spark, sf):
    rows = D.drawn(spark, sf, "d_boxes").select("page", "id", F.col("y0").alias("low"), F.col("y1").alias("high"))
    return L.overlap_join(rows, rows, ["page"]).where("a.id < b.id").select("page", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "overlap")


def _captions(spark, sf):
    """Figures, and the lines that could be captions, with the reach of each page."""
    boxes = D.drawn(spark, sf, "d_boxes").select("page", "id", F.col("id").alias("place"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("y1") - F.col("y0")).alias("height"), "kind")
    boxes = cut(boxes.drop("place"), "boxes").withColumn("place", F.col("id"))  # for figures, lines and the reach
    lines = boxes.where("kind <> 1")
    reach = lines.groupBy("page").agg((L.CAPTION_LINES * F.greatest(L.median_positive(F.col("height")), F.lit(1.0))).alias("reach"))
    return boxes.where("kind = 1").join(reach, "page"), lines.where("kind IN (2, 3)")


@query("j10_captions", oracle("""WITH RECURSIVE reach AS (
  SELECT page, 6 * greatest(coalesce(median(y1 - y0) FILTER (y1 > y0), 0), 1) AS reach FROM d_boxes WHERE kind <> 1 GROUP BY page
), figures AS (
  SELECT page, id, x0 + x1 AS x2, y0 + y1 AS y2, reach, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM d_boxes JOIN reach USING (page) WHERE kind = 1
), pairs AS MATERIALIZED (
  SELECT f.page, f.id AS item, l.id AS target, (f.x2 / 2 - (l.x0 + l.x1) / 2) * (f.x2 / 2 - (l.x0 + l.x1) / 2) + (f.y2 / 2 - (l.y0 + l.y1) / 2) * (f.y2 / 2 - (l.y0 + l.y1) / 2) AS distance, reach, f.k
  FROM figures f JOIN d_boxes l ON l.page = f.page AND l.kind IN (2, 3)
), possible AS MATERIALIZED (
  SELECT page, k, item, list((target, distance) ORDER BY distance, target DESC) AS choices FROM pairs WHERE distance <= reach * reach GROUP BY page, k, item
), ordered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) AS turn FROM possible
), taken(page, turn, item, target, distance, used) AS (
  SELECT page, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST([] AS BIGINT[]) FROM ordered WHERE turn = 1
  UNION ALL
  SELECT page, turn, item, pick[1][1], pick[1][2], CASE WHEN len(pick) > 0 THEN list_append(used, pick[1][1]) ELSE used END
  FROM (SELECT o.page, o.turn, o.item, t.used, list_filter(o.choices, lambda c: NOT list_contains(t.used, c[1])) AS pick FROM taken t JOIN ordered o ON o.page = t.page AND o.turn = t.turn + 1) n
)
SELECT page, item, target, distance FROM taken WHERE target IS NOT NULL"""))
def j10(spark, sf):
    return L.bind_captions(*_captions(spark, sf), ["page"]).select("page", "item", "target", "distance")


_CUTS = """WITH s AS (
  SELECT page, line, x0, x1, gutter, max(x1) OVER (PARTITION BY page, line ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM d_cells
), numbered AS (
  SELECT *, sum(CASE WHEN reached IS NULL OR x0 - reached > gutter THEN 1 ELSE 0 END) OVER (PARTITION BY page, line ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS span FROM s
), spans AS MATERIALIZED (
  SELECT page, line, span, min(x0) AS a, max(x1) AS b FROM numbered GROUP BY page, line, span
), whole AS MATERIALIZED (
  SELECT page, min(x0) AS x0, max(x1) AS x1, max(gutter) AS gutter, CAST(floor(count(DISTINCT line) * CAST(0.34 AS DOUBLE)) AS BIGINT) AS bridges, min(line) AS top FROM d_cells GROUP BY page
), ends AS (
  SELECT page, a AS x FROM spans UNION SELECT page, b FROM spans
), slices AS MATERIALIZED (
  SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS until FROM ends
), dense AS MATERIALIZED (
  SELECT i.page, i.x FROM slices i JOIN whole w USING (page) WHERE until IS NOT NULL AND (SELECT count(*) FROM spans p WHERE p.page = i.page AND p.a <= i.x AND p.b > i.x) > w.bridges
), open AS (
  SELECT i.page, i.x, i.until, (SELECT max(d.x) FROM dense d WHERE d.page = i.page AND d.x < i.x) AS behind FROM slices i WHERE until IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dense d WHERE d.page = i.page AND d.x = i.x)
), gaps AS (
  SELECT page, behind, min(x) AS a, max(until) AS b FROM open GROUP BY page, behind
), swept AS (
  SELECT g.page, list((a + b) / 2 ORDER BY a) AS cuts FROM gaps g JOIN whole w USING (page) WHERE b - a >= gutter AND a > x0 AND b < x1 GROUP BY g.page
), header AS (
  SELECT p.page, list(a ORDER BY a) AS cuts FROM spans p JOIN whole w ON w.page = p.page AND w.top = p.line WHERE span > 1 GROUP BY p.page
), cuts AS MATERIALIZED (
  SELECT w.page, CASE WHEN coalesce(len(h.cuts), 0) > coalesce(len(s.cuts), 0) THEN h.cuts ELSE coalesce(s.cuts, []) END AS cuts FROM whole w LEFT JOIN swept s ON s.page = w.page LEFT JOIN header h ON h.page = w.page
)
"""


def _cells(spark, sf):
    return D.drawn(spark, sf, "d_cells").withColumnsRenamed({"x0": "left", "x1": "right"})


@query("t27_column_cuts", oracle(_CUTS + "SELECT page, unnest(range(1, len(cuts) + 1)) AS cut_no, unnest(cuts) AS cut FROM cuts"))
def t27_cuts(spark, sf):
    return L.column_cuts(_cells(spark, sf), ["page"]).select("page", F.posexplode("cuts").alias("cut_no", "cut")).withColumn("cut_no", (F.col("cut_no") + 1).cast("long"))


@query("t27_column_bands", oracle(_CUTS + """SELECT page, CAST(len(list_filter(cuts, lambda c: c < (x0 + x1) / 2)) AS BIGINT) AS "column", min(x0) AS "left", max(x1) AS "right", count(*) AS cells FROM d_cells JOIN cuts USING (page) GROUP BY ALL"""))
def t27_bands(spark, sf):
    cells = _cells(spark, sf)
    return L.column_bands(cells, ["page"], L.column_cuts(cells, ["page"])).withColumn("column", F.col("column").cast("long"))


_GRIDS = """WITH RECURSIVE rules AS MATERIALIZED (
  SELECT page, id * 4 AS rule, true AS across, (y0 + y1) / 2 AS spot, x0 AS a, x1 AS b FROM d_drawn WHERE x1 - x0 >= 18 AND y1 - y0 <= 3
  UNION ALL SELECT page, id * 4, false, (x0 + x1) / 2, y0, y1 FROM d_drawn WHERE y1 - y0 >= 18 AND x1 - x0 <= 3
  UNION ALL SELECT page, id * 4 + n, n < 2, CASE n WHEN 0 THEN y1 WHEN 1 THEN y0 WHEN 2 THEN x0 ELSE x1 END, CASE WHEN n < 2 THEN x0 ELSE y0 END, CASE WHEN n < 2 THEN x1 ELSE y1 END FROM d_drawn, range(4) t(n) WHERE x1 - x0 >= 18 AND y1 - y0 >= 18
), met AS MATERIALIZED (
  SELECT h.page, h.rule AS f, v.rule AS t FROM rules h JOIN rules v ON v.page = h.page WHERE h.across AND NOT v.across AND v.spot BETWEEN h.a - 3 AND h.b + 3 AND h.spot BETWEEN v.a - 3 AND v.b + 3
), close AS MATERIALIZED (
  SELECT f, t FROM met UNION SELECT t, f FROM met
), reached(f, t) AS (
  SELECT rule, rule FROM rules UNION SELECT r.f, n.t FROM reached r JOIN close n ON n.f = r.t
), owned AS MATERIALIZED (
  SELECT f AS rule, min(t) AS grid FROM reached GROUP BY f
), spots AS MATERIALIZED (
  SELECT page, grid, across, spot FROM rules JOIN owned USING (rule)
), firsts(page, grid, across, spot) AS (
  SELECT page, grid, across, min(spot) FROM spots GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT f.page, f.grid, f.across, (SELECT min(s.spot) FROM spots s WHERE s.grid = f.grid AND s.across = f.across AND s.spot - f.spot > 3) AS n FROM firsts f) x WHERE n IS NOT NULL
), bounds AS MATERIALIZED (
  SELECT f.page, f.grid, f.across, f.spot AS first, sum(s.spot) / count(*) AS bound FROM firsts f JOIN spots s ON s.grid = f.grid AND s.across = f.across AND s.spot >= f.spot AND s.spot - f.spot <= 3 GROUP BY ALL
), grids AS MATERIALIZED (
  SELECT page, grid, list(bound ORDER BY bound) FILTER (NOT across) AS xs, list(bound ORDER BY bound) FILTER (across) AS ys FROM bounds GROUP BY page, grid HAVING count(*) FILTER (across) >= 3 AND count(*) FILTER (NOT across) >= 3
)
"""


def _grids(spark, sf):
    return L.ruled_grids(L.rules(D.drawn(spark, sf, "d_drawn").withColumnsRenamed({"x0": "left", "x1": "right", "y0": "bottom", "y1": "top"})))


@query("t28_ruled_grids", oracle(_GRIDS + "SELECT page, grid, 'x' AS axis, unnest(range(1, len(xs) + 1)) AS place, unnest(xs) AS bound FROM grids UNION ALL SELECT page, grid, 'y', unnest(range(1, len(ys) + 1)), unnest(ys) FROM grids"))
def t28_grids(spark, sf):
    found = _grids(spark, sf)
    axes = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("columns").alias("bounds")), F.struct(F.lit("y").alias("axis"), F.col("rows").alias("bounds")))).alias("a")
    return found.select("page", "grid", axes).select("page", "grid", "a.axis", F.posexplode("a.bounds").alias("place", "bound")).withColumn("place", (F.col("place") + 1).cast("long"))


@query("t28_grid_cells", oracle(_GRIDS + """SELECT p.page, g.grid, CASE WHEN g.grid IS NOT NULL THEN len(ys) - 1 - len(list_filter(ys, lambda v: v <= p.y)) END AS "row", CASE WHEN g.grid IS NOT NULL THEN len(list_filter(xs, lambda v: v <= p.x)) - 1 END AS "column", count(*) AS points
  FROM d_points p LEFT JOIN grids g ON g.page = p.page AND p.x >= xs[1] AND p.x < xs[-1] AND p.y >= ys[1] AND p.y < ys[-1] GROUP BY ALL"""))
def t28_cells(spark, sf):
    placed = L.in_grids(D.drawn(spark, sf, "d_points"), _grids(spark, sf))
    return placed.groupBy("page", "grid", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column")).agg(F.count(F.lit(1)).alias("points"))


@query("t33_group_transforms", oracle("""WITH RECURSIVE scaled AS (
  SELECT id, parent, CAST(offset_x AS DOUBLE) AS ox, CAST(offset_y AS DOUBLE) AS oy, CAST(child_offset_x AS DOUBLE) AS cx, CAST(child_offset_y AS DOUBLE) AS cy,
    CASE WHEN child_extent_x <> 0 THEN CAST(extent_x AS DOUBLE) / child_extent_x ELSE 1 END AS sx, CASE WHEN child_extent_y <> 0 THEN CAST(extent_y AS DOUBLE) / child_extent_y ELSE 1 END AS sy FROM d_groups
), placed(id, fx, fy, kx, ky, depth) AS (
  SELECT id, ox - cx * sx, oy - cy * sy, sx, sy, 0 FROM scaled WHERE parent IS NULL
  UNION ALL SELECT c.id, p.fx + p.kx * c.ox - p.kx * c.cx * c.sx, p.fy + p.ky * c.oy - p.ky * c.cy * c.sy, p.kx * c.sx, p.ky * c.sy, p.depth + 1 FROM scaled c JOIN placed p ON p.id = c.parent
)
SELECT g.id, p.depth, round(p.kx, 6) AS scale_x, round(p.ky, 6) AS scale_y, CAST(trunc(p.fx) AS BIGINT) AS origin_x, CAST(trunc(p.fy) AS BIGINT) AS origin_y, CAST(trunc(p.fx + p.kx * (g.id % 400)) AS BIGINT) AS x, CAST(trunc(p.fy + p.ky * (g.id % 300)) AS BIGINT) AS y FROM d_groups g LEFT JOIN placed p ON p.id = g.id"""))
def t33(spark, sf):
    placed = L.group_transforms(D.drawn(spark, sf, "d_groups"))
    frame = {a: (F.col(f"off_{a}"), F.col(f"scale_{a}")) for a in "xy"}
    return placed.select(
        "id", "depth", F.round("scale_x", 6).alias("scale_x"), F.round("scale_y", 6).alias("scale_y"),
        L.on_slide(F.lit(None), *frame["x"]).alias("origin_x"), L.on_slide(F.lit(None), *frame["y"]).alias("origin_y"),
        L.on_slide(F.col("id") % 400, *frame["x"]).alias("x"), L.on_slide(F.col("id") % 300, *frame["y"]).alias("y"),
    )


def _leaves(spark, sf):
    """Boxes on pages of some twenty."""
    boxes = D.drawn(spark, sf, "d_boxes").groupBy("id").agg(*(F.max(c).alias(c) for c in ("x0", "x1", "y0", "y1")))
    wide = F.when(F.col("id") % 11 == 0, 600.0).otherwise(0.0)
    return boxes.select(F.expr("id div 50").alias("page"), F.col("id").alias("place"), F.col("x0").alias("left"), (F.col("x1") + wide).alias("right"), F.col("y0").alias("bottom"), F.col("y1").alias("top"), F.when(F.col("id") % 13 == 0, "  ").otherwise(F.concat(F.lit("w"), "id")).alias("text"))


#: Rows by a walk over each page's boxes from the top, with the last box of every row so far.
_ROWS = """WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT id // 50 AS page, id AS place, max(x0) AS l, max(x1) + CASE WHEN id % 11 = 0 THEN 600 ELSE 0 END AS r, max(y0) AS b, max(y1) AS t FROM d_boxes GROUP BY id
), wide AS (
  SELECT *, abs(r - l) >= (max(r) OVER (PARTITION BY page) - min(l) OVER (PARTITION BY page)) * CAST(0.7 AS DOUBLE) AS full_width FROM leaves
), lagged AS (
  SELECT *, CASE WHEN full_width OR coalesce(lag(full_width) OVER (PARTITION BY page ORDER BY t DESC, place), true) THEN 1 ELSE 0 END AS starts FROM wide
), banded AS MATERIALIZED (
  SELECT *, {band} AS band FROM lagged{where}
), ordered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY page, band ORDER BY t DESC, place) AS k FROM banded
), walk(page, band, k, place, hit, lasts) AS (
  SELECT page, band, k, place, CAST(1 AS BIGINT), [[b, t]] FROM ordered WHERE k = 1
  UNION ALL
  SELECT page, band, k, place, coalesce(hit, len(lasts) + 1), CASE WHEN hit IS NULL THEN list_append(lasts, [b, t]) ELSE list_concat(lasts[1:hit - 1], [[b, t]], lasts[hit + 1:]) END
  FROM (SELECT o.page, o.band, o.k, o.place, o.b, o.t, w.lasts, CAST(list_position(list_transform(w.lasts, lambda q: least(q[2] - q[1], o.t - o.b) > 0 AND (least(q[2], o.t) - greatest(q[1], o.b)) / least(q[2] - q[1], o.t - o.b) >= 0.5), true) AS BIGINT) AS hit
        FROM walk w JOIN ordered o ON o.page = w.page AND o.band = w.band AND o.k = w.k + 1) n
), rowed AS MATERIALIZED (
  SELECT o.*, w.hit FROM ordered o JOIN walk w ON w.page = o.page AND w.place = o.place
)
"""


@query("t24_text_lines", oracle(_ROWS.format(band="0", where=" WHERE place % 13 > 0") + """SELECT page, row_number() OVER (PARTITION BY page ORDER BY max(t) DESC, min(l), hit) - 1 AS line, string_agg('w' || place, ' ' ORDER BY l, t DESC, place) AS text, min(l) AS "left", max(r) AS "right", min(b) AS bottom, max(t) AS top, count(*) AS words FROM rowed GROUP BY page, hit"""))
def t24(spark, sf):
    return L.text_lines(_leaves(spark, sf), ["page"])


@query("t26_reading_order", oracle(_ROWS.format(band="sum(starts) OVER (PARTITION BY page ORDER BY t DESC, place) - 1", where="") + """SELECT page, place, CAST(band AS BIGINT) AS band, row_number() OVER (PARTITION BY page ORDER BY band, high DESC, hit, l, t DESC, place) - 1 AS position FROM (SELECT *, max(t) OVER (PARTITION BY page, band, hit) AS high FROM rowed) h"""))
def t26(spark, sf):
    return L.reading_order(_leaves(spark, sf), ["page"]).select("page", "place", "band", "position")


@query("t26_xy_cut")
def t26_cut(spark, sf):
    return L.xy_cut(_leaves(spark, sf).drop("text"), ["page"], 8.0, 5.0).select("page", "place", "path")


#: Shapes from lines of orders, placeholders of layouts and masters from suppliers.
_SHAPES = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN max(l_partkey) % 3 = 0 THEN max(l_partkey) END AS parent, CASE WHEN max(l_suppkey) % 2 = 0 THEN max(l_partkey) % 900 END AS x, CASE WHEN max(l_suppkey) % 2 = 0 THEN max(l_suppkey) * 3 END AS y,
  max(l_partkey) % 4 > 0 AS is_placeholder, CASE WHEN l_orderkey % 4 > 0 THEN l_orderkey % 4 END AS "index", CASE l_orderkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'ctrTitle' END AS type, l_orderkey % 7 AS layout, l_orderkey % 2 AS master FROM lineitem GROUP BY l_orderkey, l_linenumber"""
_SLOTS = """SELECT s_suppkey % {0} AS "of", s_suppkey AS place, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 11 END AS x, s_suppkey * 7 AS y, s_suppkey % 3 AS "index", CASE s_suppkey // 3 % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'body' END AS type FROM supplier"""
_KIND = "CASE coalesce({0}.type, 'body') WHEN 'ctrTitle' THEN 'title' ELSE coalesce({0}.type, 'body') END"


def _first_slot(name: str, column: str) -> str:
    return f"(SELECT arg_min({column}, m.place) FROM {name} m WHERE m.x IS NOT NULL AND m.\"of\" = s.{name[:-1]} AND coalesce(m.\"index\", 0) = coalesce(s.\"index\", 0) AND {_KIND.format('m')} = {_KIND.format('s')})"


@query("t33_shape_positions", oracle(f"""WITH RECURSIVE scaled AS (
  SELECT id, parent, CAST(offset_x AS DOUBLE) AS ox, CAST(offset_y AS DOUBLE) AS oy, CAST(child_offset_x AS DOUBLE) AS cx, CAST(child_offset_y AS DOUBLE) AS cy,
    CASE WHEN child_extent_x <> 0 THEN CAST(extent_x AS DOUBLE) / child_extent_x ELSE 1 END AS sx, CASE WHEN child_extent_y <> 0 THEN CAST(extent_y AS DOUBLE) / child_extent_y ELSE 1 END AS sy FROM d_groups
), placed(id, fx, fy, kx, ky) AS (
  SELECT id, ox - cx * sx, oy - cy * sy, sx, sy FROM scaled WHERE parent IS NULL
  UNION ALL SELECT c.id, p.fx + p.kx * c.ox - p.kx * c.cx * c.sx, p.fy + p.ky * c.oy - p.ky * c.cy * c.sy, p.kx * c.sx, p.ky * c.sy FROM scaled c JOIN placed p ON p.id = c.parent
), shapes AS MATERIALIZED (
  {_SHAPES}
), layouts AS (
  {_SLOTS.format(7)}
), masters AS (
  {_SLOTS.format(2)}
), wanted AS (
  SELECT DISTINCT layout, master, "index", type FROM shapes s
), slots AS MATERIALIZED (
  SELECT s.*, coalesce({_first_slot('layouts', 'm.x')}, {_first_slot('masters', 'm.x')}) AS ix, coalesce({_first_slot('layouts', 'm.y')}, {_first_slot('masters', 'm.y')}) AS iy FROM wanted s
)
SELECT s.id, CAST(CASE WHEN s.parent IS NOT NULL THEN trunc(CASE WHEN s.x IS NULL THEN p.fx ELSE p.fx + p.kx * s.x END) WHEN s.x IS NOT NULL THEN s.x WHEN s.is_placeholder THEN coalesce(t.ix, 0) ELSE 0 END AS BIGINT) AS pos_x,
  CAST(CASE WHEN s.parent IS NOT NULL THEN trunc(CASE WHEN s.x IS NULL THEN p.fy ELSE p.fy + p.ky * s.y END) WHEN s.x IS NOT NULL THEN s.y WHEN s.is_placeholder THEN coalesce(t.iy, 0) ELSE 0 END AS BIGINT) AS pos_y
FROM shapes s LEFT JOIN placed p ON p.id = s.parent LEFT JOIN slots t ON t.layout = s.layout AND t.master = s.master AND t."index" IS NOT DISTINCT FROM s."index" AND t.type IS NOT DISTINCT FROM s.type"""))
def t33_positions(spark, sf):
    spelt = lambda text: text.replace('"', "`").replace("s_suppkey // 3", "s_suppkey div 3")
    shapes = spark.sql(spelt(_SHAPES).replace("FROM lineitem", "FROM {lineitem}"), lineitem=D.table(spark, sf, "lineitem"))
    slots = [spark.sql(spelt(_SLOTS).replace("{0}", str(n)).replace("FROM supplier", "FROM {supplier}"), supplier=D.table(spark, sf, "supplier")) for n in (7, 2)]
    return L.shape_positions(shapes, L.group_transforms(D.drawn(spark, sf, "d_groups")), *slots)


_SIZED = """sized AS (
  SELECT page, line, CAST(round_even(size, 0) AS INTEGER) AS pt, bold, length(text) AS letters FROM d_textlines
), body AS (
  SELECT page, pt AS body FROM (SELECT page, pt, sum(letters) AS n FROM sized GROUP BY page, pt) c QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, pt DESC) = 1
), ranked AS (
  SELECT page, pt, body, row_number() OVER (PARTITION BY page ORDER BY pt DESC) AS place FROM (SELECT DISTINCT page, pt FROM sized) JOIN body USING (page) WHERE pt > body
), leveled AS (
  SELECT s.page, s.line, CAST(CASE WHEN r.place <= 6 AND (s.bold OR s.pt > r.body + 1) THEN r.place ELSE 0 END AS INTEGER) AS level FROM sized s LEFT JOIN ranked r ON r.page = s.page AND r.pt = s.pt
)"""
_MODEL = """heights AS (
  SELECT page, median(top - bottom) AS height, count(*) AS n, list_sort(list("right")) AS ends FROM d_textlines GROUP BY page
), margins AS (
  SELECT page, height, n, ends[n // 2 + (n - n // 2) // 2 + 1] AS margin FROM heights
), steps AS (
  SELECT t.page, m.height, m.n, m.margin, list(u.top - t.top) FILTER (u.top > t.top AND u."right" >= m.margin - 2 * m.height) AS wraps
  FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top DESC, line) AS d FROM d_textlines) t JOIN margins m ON m.page = t.page
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top DESC, line) AS d FROM d_textlines) u ON u.page = t.page AND u.d = t.d - 1 GROUP BY ALL
), model AS (
  SELECT page, height, n > 3 AND coalesce(len(wraps), 0) > 2 AS sure, margin, 2 * height AS tolerance, list_median(wraps) * 1.2 AS pitch FROM steps
)"""


def _leveled(spark, sf):
    lines = cut(D.drawn(spark, sf, "d_textlines"), "textlines")  # for the sizes and for the lines
    return P.with_levels(lines, lines.select("page", "size", F.length("text").alias("count")), ["page"])


@query("a11_heading_levels", oracle(f"WITH {_SIZED[:-2]}\n)\nSELECT page, line, level FROM leveled"))
def a11_levels(spark, sf):
    return _leveled(spark, sf).select("page", "line", "level")


@query("w8_paragraph_model", oracle(f"WITH {_MODEL[:-2]}\n)\nSELECT page, height, CASE WHEN sure THEN pitch END AS pitch, CASE WHEN sure THEN margin END AS margin, CASE WHEN sure THEN tolerance END AS tolerance FROM model"))
def w8_model(spark, sf):
    return P.paragraph_model(D.drawn(spark, sf, "d_textlines"), ["page"])


@query("t24_paragraphs", oracle(f"""WITH {_SIZED}, {_MODEL}, along AS (
  SELECT t.page, t.line, t.text, v.level, lag(v.level) OVER w AS level_before, lag(t.text) OVER w AS text_before, lag(t."right") OVER w AS right_before, lag(t.top) OVER w - t.top AS step, m.*EXCLUDE(page)
  FROM d_textlines t JOIN leveled v ON v.page = t.page AND v.line = t.line JOIN model m ON m.page = t.page WINDOW w AS (PARTITION BY t.page ORDER BY t.line)
), marked AS (
  SELECT *, CASE WHEN level_before IS NULL THEN true WHEN level <> level_before THEN true WHEN level > 0 THEN false WHEN sure THEN right_before < margin - tolerance OR step > pitch ELSE step > height * 1.6 END AS opens FROM along
), numbered AS (
  SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY page ORDER BY line) - 1 AS block FROM marked
)
SELECT page, block, min(level) AS level, count(*) AS lines, string_agg(CASE WHEN opens OR (level = 0 AND text_before LIKE '%条' AND text LIKE '第%') THEN '' ELSE ' ' END || text, '' ORDER BY line) AS text,
  CASE WHEN min(level) > 0 THEN repeat('#', min(level)) || ' ' ELSE '' END || string_agg(CASE WHEN opens OR (level = 0 AND text_before LIKE '%条' AND text LIKE '第%') THEN '' ELSE ' ' END || replace(text, '*', chr(92) || '*'), '' ORDER BY line) AS markdown
FROM numbered GROUP BY page, block"""))
def t24_paragraphs(spark, sf):
    return P.paragraphs(_leveled(spark, sf), ["page"])
