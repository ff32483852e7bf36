"""Page geometry against plain Python, and its plans."""

import random

import pytest
from pyspark.sql import functions as F

from vellumflow.operators import graph as G
from vellumflow.operators import layout as L
from vellumflow.plans import layout_queries as Q


def intervals(seed, n, hot=0.3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        low = 50.0 if r.random() < hot else r.randrange(-300, 300) / 2
        rows.append((r.choice((1, 2, None)), k, low, low + r.choice((0, 1, 2.5, 8, 40))))
    return [*rows, (1, -1, None, 3.0), (1, -2, 5.0, 1.0), (1, -3, float("inf"), float("inf")), (1, -4, float("nan"), 1.0)]


@pytest.mark.parametrize("width,bin_rows", [(None, 10_000), (3.0, 5), (1000.0, 7)])
def test_overlap_join(spark, width, bin_rows):
    left, right = intervals(1, 120), intervals(2, 100)
    frame = lambda rows: spark.createDataFrame(rows, "page long, id long, low double, high double")
    joined = L.overlap_join(frame(left), frame(right), ["page"], 0.5, width, bin_rows)
    got = sorted((r.a.id, r.b.id, r.overlap) for r in joined.collect())
    want = []
    for p, i, a, b in left:
        for q, j, c, d in right:
            if p is not None and p == q and i >= 0 and j >= 0 and min(b, d) > max(a, c) and min(b - a, d - c) > 0:
                ratio = (min(b, d) - max(a, c)) / min(b - a, d - c)
                if ratio >= 0.5:
                    want.append((i, j, ratio))
    assert got == sorted(want) and len(want) > 100
    assert L.overlap_join(frame(left).where("false"), frame(right), ["page"]).count() == 0


def test_no_nested_loop_and_a_full_bin_is_dealt_out(spark, sf):
    plan = Q.j9(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    one = spark.range(400).select(F.lit(1).alias("page"), "id", F.lit(0.0).alias("low"), (F.col("id") % 2 + 1.0).alias("high"))
    pairs = L.touching(one, one.limit(3), ["page"], 10.0, bin_rows=50)
    assert pairs.count() == 1200
    assert "explode(sequence(0" in pairs._jdf.queryExecution().optimizedPlan().toString().lower()


def test_captions_as_the_greedy_rule(spark):
    r = random.Random(3)
    items = [(p, k, r.choice((k, 50 - k)) + 100 * k, r.randrange(20) / 1.0, r.randrange(20) / 1.0, 4.0 + p) for p in range(4) for k in range(25)]
    targets = [(p, 1000 + k, k, r.randrange(20) / 1.0, r.randrange(20) / 1.0) for p in range(4) for k in range(15)]
    got = L.bind_captions(spark.createDataFrame([*items, (9, 1, 1, 0.0, 0.0, 0.0), (9, 2, 2, None, 0.0, None)], "page long, id long, place long, x double, y double, reach double"), spark.createDataFrame([*targets, (9, 5, 5, 0.0, 0.0)], "page long, id long, place long, x double, y double"), ["page"])
    taken, want = set(), []
    for p, i, _, x, y, reach in sorted(items, key=lambda t: t[2]):
        best, least = None, reach * reach
        for q, j, place, u, v in sorted(targets, key=lambda t: t[2]):
            if q == p and j not in {t for s, t in taken if s == p} and (u - x) ** 2 + (v - y) ** 2 <= least:
                best, least = j, (u - x) ** 2 + (v - y) ** 2
        if best is not None:
            taken.add((p, best))
            want.append((p, i, best, least))
    assert sorted(tuple(row) for row in got.collect()) == sorted(want) and len(want) > 30


def cuts_by_hand(lines, gutter):
    def spans(cells):
        out = []
        for a, b in sorted((min(c), max(c)) for c in cells):
            if out and a - out[-1][1] <= gutter:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    rows = [spans(lines[k]) for k in sorted(lines)]
    header = [s[0] for s in rows[0][1:]]
    every = [s for row in rows for s in row]
    xs = sorted({x for s in every for x in s})
    low, high, swept, start = min(s[0] for s in every), max(s[1] for s in every), [], None
    for a, b in zip([*xs[:-1], None], [*xs[1:], None]):
        if a is not None and sum(s <= a < e for s, e in every) <= int(len(rows) * 0.34):
            start = a if start is None else start
            continue
        end = xs[-1] if a is None else a
        if start is not None and end - start >= gutter and start > low and end < high:
            swept.append((start + end) / 2)
        start = None
    return header if len(header) > len(swept) else swept


def test_column_cuts(spark):
    r = random.Random(4)
    tables = {}
    for t in range(40):
        tables[t] = {k: [(c * 60 + r.randrange(12), c * 60 + 20 + r.randrange(30) + r.choice((0, 0, 0, 45))) for c in range(4) if r.random() < 0.8] or [(0, 30)] for k in range(r.choice((1, 2, 3, 7)))}
    cells = [(t, k, float(a), float(b), 10.0) for t, lines in tables.items() for k, row in lines.items() for a, b in row]
    got = L.column_cuts(spark.createDataFrame([*cells, (0, 0, None, 5.0, 10.0), (0, None, 1.0, 5.0, 10.0)], "page long, line long, left double, right double, gutter double"), ["page"])
    want = {t: cuts_by_hand(lines, 10) for t, lines in tables.items()}
    assert {row.page: row.cuts for row in got.collect()} == want and len({len(c) for c in want.values()}) > 3


def test_tie_goes_to_the_sweep(spark):
    """One cut by either model: the header's would lie at 40, the sweep's in the middle of the gap."""
    cells = [(1, 0, 0.0, 20.0, 5.0), (1, 0, 40.0, 60.0, 5.0), (1, 1, 0.0, 30.0, 5.0), (1, 1, 38.0, 60.0, 5.0)]
    df = spark.createDataFrame(cells, "page long, line long, left double, right double, gutter double")
    (row,) = L.column_cuts(df, ["page"]).collect()
    assert row.cuts == [34.0]
    assert sorted(tuple(b) for b in L.column_bands(df, ["page"], L.column_cuts(df, ["page"])).collect()) == [(1, 0, 0.0, 30.0, 2), (1, 1, 38.0, 60.0, 2)]


def test_rules_and_clusters(spark):
    boxes = [(1, 1, 0.0, 5.0, 100.0, 6.0), (1, 2, 7.0, 90.0, 9.0, 10.0), (1, 3, 0.0, 0.0, 30.0, 40.0), (1, 4, 0.0, 0.0, 10.0, 1.0), (1, 5, None, 0.0, 10.0, 1.0)]
    got = sorted((r.rule, r.across, r["at"], r.low, r.high) for r in L.rules(spark.createDataFrame(boxes, "page long, id long, left double, bottom double, right double, top double")).collect())
    assert got == [(4, True, 5.5, 0, 100), (8, False, 8, 10, 90), (12, True, 40, 0, 30), (13, True, 0, 0, 30), (14, False, 0, 0, 40), (15, False, 30, 0, 40)]
    values = spark.createDataFrame([([1.0, 2.0, 4.0, 4.5, 7.0, 7.25],), ([],), ([3.0],)], "v array<double>")
    # a cluster reaches as far as the tolerance from its first value, not from its last
    assert [r.c for r in values.select(L.clustered(F.col("v"), 3.0).alias("c")).collect()] == [[7 / 3, 18.75 / 3], [], [3.0]]


def _grids_by_hand(rows):
    """page and least rule of each table, with its columns and rows; a rule without number is none, without page it crosses none, and those of one number are one."""
    rows = [r for r in rows if r[1] is not None]
    label = {r[1]: r[1] for r in rows}
    changed = True
    while changed:
        changed = False
        for page, a, across, at, low, high in rows:
            for other, b, upright, x, bottom, top in rows if across else ():
                if page is not None and page == other and not upright and low - 3 <= x <= high + 3 and bottom - 3 <= at <= top + 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    found = {}
    for page, rule, across, at, _, _ in rows:
        found.setdefault((page, label[rule]), ([], []))[across].append(at)

    def clusters(values):
        done = []
        for v in sorted(values):
            if done and v - done[-1][0] <= 3:
                done[-1].append(v)
            else:
                done.append([v])
        return [sum(c) / len(c) for c in done]

    tables = {k: (clusters(x), clusters(y)) for k, (x, y) in found.items()}
    return {k: t for k, t in tables.items() if min(map(len, t)) >= 3}


@pytest.mark.parametrize("bin_rows", [L.BIN_ROWS, 2])
def test_ruled_grids(spark, bin_rows):
    """Random rules over several bins, numbered in any order; bins that are dealt to tasks; rules in a chain, without number, without page, and a number that is repeated."""
    r, rows = random.Random(11), []
    for page in range(12):
        numbers = r.sample(range(page * 100, page * 100 + 100), 40)
        for k in numbers:
            low, at = float(r.randrange(400)), float(r.randrange(500))
            rows.append((page, k, r.random() < 0.5, at, low, low + r.choice((18, 60, 200))))
    # a stair, each step crosses the next one only
    rows += [(50, 5000 + (7 * k) % 41, k % 2 == 0, 100.0 * (k // 2) + 100 * (k % 2), 100.0 * ((k + 1) // 2) + (0 if k % 2 == 0 else -100), 100.0 * ((k + 1) // 2) + (100 if k % 2 == 0 else 0)) for k in range(40)]
    rows += [(None, 6000 + k, k < 3, 10.0 * k, 0.0, 90.0) for k in range(6)] + [(60, None, k < 3, 10.0 * k, 0.0, 90.0) for k in range(6)]
    rows += [(61, 7000, k < 3, 1000.0 * k, 0.0, 20.0) for k in range(6)]
    got = L.ruled_grids(spark.createDataFrame(rows, "page long, rule long, across boolean, at double, low double, high double"), bin_rows=bin_rows).collect()
    want = _grids_by_hand(rows)
    assert len(got) == len(want) > 6 and {(g.page, g.grid): (g["columns"], g["rows"]) for g in got} == want and {(50, 5000), (61, 7000)} <= set(want)


def test_half_open_bands(spark):
    grids = spark.createDataFrame([(1, 7, [0.0, 10.0, 20.0], [0.0, 5.0, 9.0])], "page long, grid long, columns array<double>, rows array<double>")
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 5.0), (1, 20.0, 5.0), (1, 19.9, 8.9), (1, -0.1, 1.0), (2, 1.0, 1.0), (1, None, 1.0)], "page long, x double, y double")
    got = [(r.x, r.row, r.column) for r in L.in_grids(points, grids).collect()]
    assert sorted(got, key=str) == sorted([(0.0, 1, 0), (10.0, 0, 1), (20.0, None, None), (19.9, 0, 1), (-0.1, None, None), (1.0, None, None), (None, None, None)], key=str)


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(None, 1), (5, 5), (7, 8), (7, 8)]
    nodes = {n for pair in links for n in pair if n is not None} | {999}
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = G.components(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {row.node: row.component for row in got.collect()} == label
    with pytest.raises(RuntimeError, match="come to rest"):
        G.components(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "node long"), rounds=1)


def test_links_in_a_long_chain_and_in_any_order(spark):
    """Twelve rounds are enough for chains of 400 links, however their nodes are numbered; hubs may be the least or the greatest node."""
    r = random.Random(3)
    numbers = r.sample(range(10_000, 20_000), 400)
    links = [(k, k + 1) for k in range(400)] + list(zip(numbers, numbers[1:], strict=False)) + [(30_000, k) for k in range(30_001, 30_050)] + [(40_000, k) for k in range(39_950, 40_000)] + [(1, None)]
    r.shuffle(links)
    got = {row.node: row.component for row in G.linked_components(spark.createDataFrame(links, "a long, b long"), rounds=12).collect()}
    want = dict.fromkeys(range(401), 0) | dict.fromkeys(numbers, min(numbers)) | dict.fromkeys(range(30_000, 30_050), 30_000) | dict.fromkeys(range(39_950, 40_001), 39_950)
    assert got == want


def test_transforms_along_chains_circles_and_orphans(spark):
    """A chain of 16 groups, a circle, an orphan and a group without numbers."""
    plain = lambda i, parent: (i, parent, 10, 20, 2, 3, 300, 100, 100, 0)
    rows = [plain(k, k - 1 if k else None) for k in range(16)] + [plain(100, 101), plain(101, 100), plain(102, 101), plain(200, 77), (300, None, *[None] * 8), plain(301, 300)]
    names = [f"{n}_{a}" for n in ("offset", "child_offset", "extent", "child_extent") for a in "xy"]
    got = {r.id: r for r in L.group_transforms(spark.createDataFrame(rows, "id long, parent long, " + ", ".join(f"{n} long" for n in names))).collect()}
    assert len(got) == len(rows)
    off, scale = 0.0, 1.0
    for k in range(16):
        off, scale = off + scale * 10 - scale * 2 * 3.0, scale * 3.0
        assert (got[k].off_x, got[k].scale_x, got[k].off_y, got[k].scale_y, got[k].depth) == (off, scale, 17.0 * (k + 1), 1.0, k)
    assert all(got[k].off_x is None and got[k].depth is None for k in (100, 101, 102, 200))
    assert (got[300].off_x, got[300].scale_x, got[301].off_x, got[301].depth) == (0.0, 1.0, 4.0, 1)
    short = L.group_transforms(spark.createDataFrame(rows, "id long, parent long, " + ", ".join(f"{n} long" for n in names)), deepest=3)
    assert {r.id for r in short.where("depth IS NULL").collect()} == {*range(4, 16), 100, 101, 102, 200}


def rows_by_hand(boxes):
    """Rows of (place, top, bottom): a box joins the first whose last box it overlaps by half."""
    rows = []
    for place, top, bottom in sorted(boxes, key=lambda b: (-b[1], b[0])):
        for row in rows:
            t, b = row[-1][1:]
            least = min(t - b, top - bottom)
            if least > 0 and (min(t, top) - max(b, bottom)) / least >= 0.5:
                row.append((place, top, bottom))
                break
        else:
            rows.append([(place, top, bottom)])
    return rows


def random_boxes(seed, pages, n, across=40, height=60):
    r = random.Random(seed)
    out = []
    for p in range(pages):
        for k in range(r.randrange(n)):
            left, bottom = r.randrange(across), r.randrange(height)
            out.append((p, k, float(left), float(left + r.choice((1, 2, 5, 9))), float(bottom), float(bottom + r.choice((0, 1, 2, 4, 12)))))
    return out


SIDES = "page long, place long, left double, right double, bottom double, top double"


def test_rows_and_lines(spark):
    boxes = random_boxes(7, 12, 60)
    df = spark.createDataFrame([*boxes, (0, 900, 1.0, 2.0, None, 5.0)], SIDES)
    got = {}
    for row in L.in_rows(df, ["page"]).collect():
        got.setdefault((row.page, row.strip, row.row), set()).add(row.place)
    want = [(p, row) for p in range(12) for row in rows_by_hand([(b[1], b[5], b[4]) for b in boxes if b[0] == p])]
    assert sorted((p, sorted(s)) for (p, _, _), s in got.items()) == sorted((p, sorted(x[0] for x in row)) for p, row in want)
    words = df.withColumn("text", F.when(F.col("place") % 9 == 0, "  ").otherwise(F.concat(F.lit("w"), "place")))
    lines = {(r.page, r.line): r.text for r in L.text_lines(words, ["page"]).collect()}
    sides = {(b[0], b[1]): b for b in boxes}
    for p in range(12):
        expected = []
        for row in rows_by_hand([(b[1], b[5], b[4]) for b in boxes if b[0] == p and b[1] % 9]):
            left = lambda place: sides[p, place][2]
            expected.append((-max(x[1] for x in row), min(left(x[0]) for x in row), " ".join(f"w{x[0]}" for x in sorted(row, key=lambda x: left(x[0])))))
        shown = [lines[p, k] for k in range(len(expected))]
        assert sorted(shown) == sorted(e[2] for e in expected)
        assert [e[:2] for e in sorted(expected, key=lambda e: e[:2])] == [next(e[:2] for e in expected if e[2] == text) for text in shown]
    assert L.text_lines(words.where("false"), ["page"]).count() == 0


def test_reading_order(spark):
    """A title over the page, two columns side by side, a rule over the page, a block below."""
    blocks = [(1, 0, 0.0, 100.0, 90.0, 99.0), (1, 1, 55.0, 99.0, 60.0, 80.0), (1, 2, 0.0, 45.0, 58.0, 79.0), (1, 3, 60.0, 70.0, 82.0, 88.0), (1, 4, 5.0, 98.0, 50.0, 51.0), (1, 5, 0.0, 20.0, 10.0, 20.0), (1, 6, None, 1.0, 1.0, 1.0), (2, 0, 0.0, 1.0, 0.0, 1.0)]
    got = {(r.page, r.place): (r.band, r.position) for r in L.reading_order(spark.createDataFrame(blocks, SIDES), ["page"]).collect()}
    assert got == {(1, 0): (0, 0), (1, 3): (1, 1), (1, 2): (1, 2), (1, 1): (1, 3), (1, 4): (2, 4), (1, 5): (3, 5), (2, 0): (0, 0)}


def cut_by_hand(boxes, gap_x, gap_y, path=""):
    """place: path of (place, left, right, bottom, top)."""
    best = (0, 0, 0)
    by_x, by_y = sorted(boxes, key=lambda b: b[1]), sorted(boxes, key=lambda b: -b[4])
    for k in range(1, len(boxes)):
        best = max(best, ((by_x[k][1] - max(b[2] for b in by_x[:k])) / gap_x, 1, -by_x[k][1]))
    for k in range(1, len(boxes)):
        best = max(best, ((min(b[3] for b in by_y[:k]) - by_y[k][4]) / gap_y, 0, by_y[k][4]))
    if best[0] < 1:
        return {b[0]: path for b in boxes}
    behind = [b for b in boxes if (b[1] >= -best[2] if best[1] else b[4] <= best[2])]
    front = [b for b in boxes if b not in behind]
    return cut_by_hand(front, gap_x, gap_y, path + "0") | cut_by_hand(behind, gap_x, gap_y, path + "1")


def test_xy_cut(spark):
    boxes = random_boxes(8, 10, 14, 120, 150)
    got = {(r.page, r.place): r.path for r in L.xy_cut(spark.createDataFrame([*boxes, (0, 900, None, 1.0, 1.0, 1.0)], SIDES), ["page"], 3.0, 2.0).collect()}
    want = {(p, place): path for p in range(10) for place, path in cut_by_hand([b[1:] for b in boxes if b[0] == p], 3.0, 2.0).items()}
    assert got == want | {(0, 900): None} and max(len(p) for p in want.values()) > 4
    flat = L.xy_cut(spark.createDataFrame(boxes, SIDES), ["page"], 3.0, 2.0, deepest=1).collect()
    assert max(len(r.path) for r in flat) == 1


def test_shape_positions(spark):
    """Own offsets, groups, placeholders of the layout and of the master, a lost group."""
    slots = "of long, place long, x long, y long, index long, type string"
    layouts = spark.createDataFrame([(1, 2, 70, 71, 0, "title"), (1, 1, None, 5, None, "title"), (1, 3, 80, 81, 0, "title"), (1, 4, 90, 91, 1, None)], slots)
    masters = spark.createDataFrame([(9, 1, 50, 51, 2, "body"), (9, 2, 60, 61, 0, "ctrTitle")], slots)
    shapes = [
        (1, None, 3, 4, True, None, "title", 1, 9), (2, None, None, None, True, None, "ctrTitle", 1, 9), (3, None, None, None, True, 1, "body", 1, 9), (4, None, None, None, True, 2, None, 1, 9),
        (5, None, None, None, True, 7, None, 1, 9), (6, None, None, None, False, None, "title", 1, 9), (7, 100, 10, 20, True, None, "title", 1, 9), (8, 100, None, None, True, None, "title", 1, 9),
        (9, 555, 1, 1, False, None, None, 1, 9), (10, None, 5, None, True, None, "title", 2, 9), (11, None, None, None, True, None, "title", None, None),
    ]
    frames = spark.createDataFrame([(100, 1000.5, 2000.0, 2.0, 0.5)], "id long, off_x double, off_y double, scale_x double, scale_y double")
    got = L.shape_positions(spark.createDataFrame(shapes, "id long, parent long, x long, y long, is_placeholder boolean, index long, type string, layout long, master long"), frames, layouts, masters)
    assert {r.id: (r.pos_x, r.pos_y) for r in got.collect()} == {1: (3, 4), 2: (70, 71), 3: (90, 91), 4: (50, 51), 5: (0, 0), 6: (0, 0), 7: (1020, 2010), 8: (1000, 2000), 9: (None, None), 10: (60, 61), 11: (0, 0)}
