"""Plans that keep the work of large tables spread and small: which joins are broadcast, what is exchanged, how often a value is spelt."""

import re

import pytest
from pyspark.sql import functions as F

from vellumflow.operators import graph as G
from vellumflow.operators import layout as L
from vellumflow.operators import relations as R
from vellumflow.plans import catalog
from vellumflow.sources import derived as D


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ["g6_flags_after_extraction", "t5_typed_values", "g19_edit_changes", "j8_schema_drift"])
def test_no_shuffle_by_the_few_keys_of_a_fixed_table(spark, sf, name):
    """Definitions have a few dozen ids and two or three types: rows that are hashed by these come into as many tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")  # less than any given table
    try:
        shown = plan(catalog.QUERIES[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if name == "t5_typed_values":
        assert "Exchange" not in shown.replace("BroadcastExchange", "")
    assert not re.findall(r"Exchange hashpartitioning\((?:field_definition_id|document_type_id)#\d+L?(?:, field#\d+)?, ", shown)


def test_fixed_tables_keep_nulls_and_types(spark):
    rows = D.fixed(spark, [(1, "a", True, None), (2, None, None, 0.5)], "k long, name string, flag boolean, share double")
    assert [tuple(r) for r in rows.orderBy("k").collect()] == [(1, "a", True, None), (2, None, None, 0.5)]
    assert [t for _, t in rows.dtypes] == ["bigint", "string", "boolean", "double"]


def test_shapes_on_the_slide_are_not_one_key(spark):
    """Shapes without a parent are spread over the tasks of the join with their groups' frames."""
    shapes = spark.range(2000).selectExpr("id", "cast(null as bigint) as parent", "id as x", "id as y", "false as is_placeholder", "0L as index", "'a' as type", "1L as layout", "1L as master")
    frames = spark.createDataFrame([(5, 1.0, 1.0, 1.0, 1.0)], "id long, off_x double, off_y double, scale_x double, scale_y double")
    slots = spark.createDataFrame([], "of long, place long, x long, y long, index long, type string")
    out = L.shape_positions(shapes, frames, slots, slots)
    assert "hashpartitioning(parent#" not in plan(out) and "xxhash64(id" in plan(out)
    assert out.where("pos_x = id AND pos_y = id").count() == 2000


def test_a_round_of_cuts_exchanges_what_goes_on_once(spark, monkeypatch):
    rounds, real = [], L.cut

    def watched(df, name):
        rounds.append((df.count(), plan(df).count("Exchange hashpartitioning")))
        return real(df, name)

    monkeypatch.setattr(L, "cut", watched)
    # page 0 is cut again and again, page 1 not at all
    rows = [(0, k, 20.0 * k, 20.0 * k + 5, 0.0, 5.0) for k in range(5)] + [(1, k, 0.0, 5.0, 0.0, 5.0) for k in range(50)]
    got = L.xy_cut(spark.createDataFrame(rows, "page long, place long, left double, right double, bottom double, top double"), ["page"], 3.0, 3.0).collect()
    assert len(got) == 55 and {r.path for r in got if r.page == 1} == {""} and len({r.path for r in got if r.page == 0}) == 5
    assert rounds[0] == (55, 1) and all(n <= 5 and exchanges == 1 for n, exchanges in rounds[1:]) and len(rounds) > 2


def test_intervals_are_read_once_and_exchanged_once_for_a_join(spark, sf):
    shown = plan(catalog.QUERIES["j9_overlaps"](spark, sf))
    assert "l_orderkey" not in shown and shown.count("Exchange hashpartitioning") <= 3


def test_values_are_spelt_once(spark, sf):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    fields, shown = (plan(catalog.QUERIES[name](spark, sf), "optimizedPlan") for name in ("p3_field_map", "p8_tool_fields"))
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(re.findall(r"(?<![a-z_])filter\(found#", fields)) == 1 and "isnotnull(CASE WHEN data_type" not in fields
    assert shown.count("map_filter(") == shown.count("transform_values(") > 0 and shown.count("map_filter(") <= 2  # of single fields and of lists


def test_what_is_exactly_within_reach_is_near(spark):
    items = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 2.0), (1, 2, 2, -2.0, 6.0, 2.0)], "page long, id long, place long, x double, y double, reach double")
    targets = [(1, 10 + k, k, x, y) for k, (x, y) in enumerate([(2.0, 0.0), (-2.0, 0.0), (0.0, 2.0), (0.0, -2.0), (2.0, 0.001), (-4.0, 6.0), (-2.0, 4.0), (-2.0, 8.0)])]
    met = L.near(items, spark.createDataFrame(targets, "page long, id long, place long, x double, y double"), ["page"])
    assert sorted((r.item, r.target) for r in met.collect()) == [(1, 10), (1, 11), (1, 12), (1, 13), (2, 15), (2, 16), (2, 17)]
    assert "dx" not in plan(met, "analyzed")  # four cells for an item, not nine


def test_running_lines_exchange_pages_by_document(spark):
    """Repeated pages, null pages and pages without lines, and one exchange of the lines."""
    rows = [(1, 1, ["Head 1", "a"]), (1, 1, ["Head 2", "b"]), (1, 2, ["HEAD  7", "c"]), (1, None, ["Head 9"]), (1, 3, None), (2, 1, ["x"]), (None, 1, ["Head"]), (None, 2, ["Head"])]
    out = R.running_lines(spark.createDataFrame(rows, "document long, page long, lines array<string>"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "bottom", "head #", 2), (1, "top", "head #", 2)]
    assert "hashpartitioning(document#" in plan(out) and not re.findall(r"hashpartitioning\(document#\d+L, (?:band|line)", plan(out))


def test_captions_and_paragraphs_read_their_boxes_once(spark, sf, monkeypatch):
    from vellumflow.plans import layout_queries as Q

    items, targets = Q._captions(spark, sf)
    for df in (items, targets, Q._leveled(spark, sf)):
        assert "l_orderkey" not in plan(df)


def test_a_change_of_a_run_is_one_column_on_its_way(spark):
    """Spark makes a Series of each column of each group, and most groups are small."""
    from vellumflow.streaming import events as E

    changes = spark.readStream.format("rate").load().selectExpr("value AS document_id", "'p' AS pipeline", "value AS attempt", "value AS run_id", "value AS status", "timestamp AS event_time", "value AS event_id")
    states = E.run_states(changes)
    assert states.columns == "document_id pipeline attempts attempt run_id status failed collisions stale".split()
    assert re.search(r"FlatMapGroupsInPandasWithState step\(document_id#\d+L, pipeline#\d+, change#\d+\)", plan(states, "analyzed"))


def test_links_of_a_drawn_table_are_as_many_as_its_rules(spark, monkeypatch):
    """40 rules across 40 others: 1600 crossings, but 79 links that are at rest when they are written, and boundaries that are clustered once."""
    written, real = [], L.cut

    def watched(df, name):
        out = real(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(L, "cut", watched)
    monkeypatch.setattr(G, "cut", watched)
    rows = [(1, k, True, 20.0 * k, 0.0, 400.0) for k in range(40)] + [(1, 100 + k, False, 10.0 * k, 0.0, 800.0) for k in range(40)]
    found = L.ruled_grids(spark.createDataFrame(rows, "page long, rule long, across boolean, at double, low double, high double"))
    assert [tuple(r) for r in found.collect()] == [(1, 0, [10.0 * k for k in range(40)], [20.0 * k for k in range(40)])]
    assert [n for name, n in written if name == "links"] == [79]
    placed = L.in_grids(spark.createDataFrame([(1, 5.0, 5.0)], "page long, x double, y double"), found)
    assert "reduce(" not in plan(placed, "optimizedPlan")
