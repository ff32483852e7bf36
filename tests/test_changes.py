"""Versioned tables survive failed changes; what is refused is not written."""

import pytest
from pyspark.sql import functions as F

from vellumflow.operators import changes as C
from vellumflow.sources.versions import Conflict, VersionedTable


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=4)
    made.create(spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v")))
    return made


def test_upsert_and_remove(spark, table):
    actions = table.upsert(spark.createDataFrame([(3, "new"), (100, None)], "k long, v string"))
    assert rows_of(actions) == [(3, "Updated"), (100, "Created")]
    now = dict(rows_of(table.read().fillna("null")))
    assert now[3] == "new" and now[100] == "null" and len(now) == 41 and dict(rows_of(table.read(1)))[3] == "v3"
    table.remove(spark.createDataFrame([(3,), (999,)], "k int"))  # of another type, and by a handle with another number of buckets
    again = VersionedTable(spark, table.path, ["k"], 99)
    again.upsert(spark.createDataFrame([(5, "five")], "k int, v string"))
    assert dict(rows_of(table.read().fillna("null")))[5] == "five" and table.read().count() == 40
    table.upsert(spark.createDataFrame([(5, "v5")], "k long, v string"))
    assert 3 not in dict(rows_of(table.read())) and table.versions() == [1, 2, 3, 4, 5]
    table.upsert(spark.createDataFrame([], "k long, v string"))
    assert table.versions() == [1, 2, 3, 4, 5]


def test_only_touched_buckets_are_written(spark, table):
    before = table._state()["folders"]
    table.upsert(spark.createDataFrame([(3, "new")], "k long, v string"))
    after = table._state()["folders"]
    assert sum(before[k] != after[k] for k in before) == 1 and set(before) == set(after)


def test_a_crash_before_publication_leaves_the_old_version(spark, table, monkeypatch):
    old = rows_of(table.read())
    monkeypatch.setattr(table, "_publish", lambda state: (_ for _ in ()).throw(RuntimeError("the driver is lost")))
    with pytest.raises(RuntimeError, match="lost"):
        table.upsert(spark.createDataFrame([(3, "new")], "k long, v string"))
    monkeypatch.undo()
    assert rows_of(table.read()) == old and table.versions() == [1]
    table.upsert(spark.createDataFrame([(3, "newer")], "k long, v string"))
    assert dict(rows_of(table.read()))[3] == "newer"


def test_two_writers(spark, table, monkeypatch):
    """The slower of two writers that began with the same version fails."""
    late = VersionedTable(spark, table.path, ["k"], 4)
    state = late._state()
    table.upsert(spark.createDataFrame([(1, "first")], "k long, v string"))
    monkeypatch.setattr(late, "_state", lambda version=None: state)
    with pytest.raises(Conflict, match="version 2"):
        late.upsert(spark.createDataFrame([(1, "second")], "k long, v string"))
    assert dict(rows_of(table.read()))[1] == "first"
    with pytest.raises(Conflict):
        table.create(spark.createDataFrame([(1, "x")], "k long, v string"))


def test_keys_are_unique_and_known(spark, table):
    for rows in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="null or repeated"):
            table.upsert(spark.createDataFrame(rows, "k long, v string"))
    assert table.versions() == [1]
    with pytest.raises(ValueError, match="no version"):
        table.read(9)


def test_forget(spark, table):
    for n in range(3):
        table.upsert(spark.createDataFrame([(1, f"n{n}")], "k long, v string"))
    old = rows_of(table.read())
    table.forget(keep=1)
    assert table.versions() == [4] and rows_of(table.read()) == old


def config(spark, rows):
    return spark.createDataFrame([(t, n, None, 1, kind, False, multiple, False, 0, prompt, gone) for t, n, kind, multiple, prompt, gone in rows], "type_code string, name string, display_name string, priority long, data_type string, is_required boolean, allow_multiple boolean, is_unique_key boolean, display_order long, prompt string, is_deleted boolean")


def test_pack_rules(spark, tmp_path):
    have = config(spark, [("a", "", None, None, None, False), ("a", "n", "Number", False, "p", False), ("a", "m", "Text", True, None, False), ("a", "old", "Text", False, None, True)])
    packs = config(spark, [("a", "", None, None, None, False), ("a", "n", "Text", False, "q", False), ("a", "m", "Text", False, None, False), ("a", "old", "Date", False, None, False), ("b", "", None, None, None, False), ("b", "x", "Text", False, "y" * 40_000, False)]).drop("is_deleted").withColumn("version", F.lit(1))
    unused, used = have.where("false"), have.where("name IN ('n', 'm', 'old')")
    rows, actions, refused = C.import_packs(have, packs, unused, update=True)
    assert {(r.type_code, r.name): r.action for r in actions.collect()} == {("a", ""): "Updated", ("a", "n"): "Updated", ("a", "m"): "Updated", ("a", "old"): "Created", ("b", ""): "Created", ("b", "x"): "Created"}
    assert rows_of(refused) == [("b", "", "SchemaPromptTooLong")]
    assert rows_of(C.import_packs(have, packs, used, update=True)[2]) == [("a", "m", "MultiValueChangeNotAllowed"), ("a", "n", "DataTypeChangeNotAllowed"), ("b", "", "SchemaPromptTooLong")]
    rows, actions, refused = C.import_packs(have, packs.where("type_code = 'a'"), used, update=False)
    assert rows_of(refused) == [] and rows_of(rows.select("type_code", "name")) == [("a", "old")]
    assert rows_of(C.import_packs(have, packs.where("name = 'n'").withColumn("version", F.lit(2)), unused, True)[2]) == [("a", "n", "UnsupportedVersion")]
    table = VersionedTable(spark, f"file://{tmp_path}/c", C.KEY, 2)
    table.create(have)
    rows, _, refused = C.import_packs(table.read(), packs, used, update=True)
    with pytest.raises(C.Refused, match="NotAllowed"):
        C.apply(table, rows, refused)
    assert table.versions() == [1]


def test_types_in_use_stay(spark):
    have = config(spark, [("a", "", None, None, None, False), ("a", "n", "Number", False, None, False), ("b", "", None, None, None, False), ("b", "m", "Text", False, None, False)])
    codes = spark.createDataFrame([("a",), ("b",), ("zz",)], "type_code string")
    rows, refused = C.delete_types(have, codes, codes.where("type_code = 'b'"))
    assert rows_of(rows.select("type_code", "name", "is_deleted")) == [("a", "", True), ("a", "n", True)] and rows_of(refused) == [("b", "", "InUse")]
    assert rows_of(C.restore_types(rows, codes).select("type_code", "name", "is_deleted")) == [("a", "", False), ("a", "n", False)]


def test_restore_refuses_content_that_is_there(spark):
    docs = spark.createDataFrame([(1, None, "h", False), (2, None, "h", True), (3, 5, "h", True), (4, 5, "h", True), (5, None, None, True), (6, None, None, True), (7, None, "i", False)], "id long, tenant_id long, content_hash string, is_deleted boolean")
    rows, refused = C.restore(docs, spark.range(10))
    assert rows_of(rows.select("id")) == [(3,), (5,), (6,)] and rows_of(refused) == [(2, "ContentExists"), (4, "ContentExists")]
    assert rows_of(C.recycle(docs, spark.range(3)).select("id", "is_deleted")) == [(1, True)]
