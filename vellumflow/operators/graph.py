"""Rounds over tables: cutting lineage between rounds, connected components, recursion along a hierarchy."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.streaming.events import shared_folder


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again, so that the next round neither recomputes it nor depends on lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linked_components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """node, component: for each node that a link (a, b) joins with another one the least node that links reach, itself included.

    Links lead down from the greater end. In a round a link comes to lead to the least neighbour of its lower end, then all ends
    of links from one node to the least of them. At rest, a node with a lesser neighbour has no other. Links with a null end are
    none; links to oneself and repeated ones do no harm. RuntimeError if it has not come to rest after so many rounds.
    """
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(rounds):
        down = cut(down.distinct(), "links")
        ends = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = cut(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.max("b").alias("most")), "components")
        if ends.where("least < node AND least <> most").isEmpty():
            return ends.select("node", F.least("node", "least").alias("component"))
        lower = cut(down.join(ends, F.col("b") == F.col("node")).select("a", F.least("b", "least").alias("b")).distinct(), "links")
        first = lower.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        pairs = F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        down = lower.join(first, F.col("a") == F.col("node")).select(F.explode(pairs).alias("link")).select("link.*").where("a <> b")
    raise RuntimeError(f"components have not come to rest after {rounds} rounds")


def components(links: DataFrame, nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """node, component of linked_components() for all nodes; one without links is its own component."""
    linked = linked_components(links, rounds).withColumnRenamed("node", "linked")
    return nodes.select("node").where("node IS NOT NULL").distinct().join(linked, F.col("node") == F.col("linked"), "left").select("node", F.coalesce("component", "node").alias("component"))


def along_hierarchy(rows: DataFrame, root: dict[str, Column], child: dict[str, Column], deepest: int = 64) -> DataFrame:
    """rows (id, parent, ...) with new columns that depend on the parent's, level by level from the roots, and depth (roots: 0).

    root gives the new columns of a row without parent; child those of the others, where the parent's are named above_<name>.
    A level is one join, so there are as many as the hierarchy is deep. Rows that no root reaches within deepest levels, because
    their parents go in circles, are missing or are null ids, get nulls. An id that is repeated counts each time.
    """
    level = rows.where("parent IS NULL").select("id", *(c.alias(n) for n, c in root.items()), F.lit(0).alias("depth"))
    found, below = [], rows.where("parent IS NOT NULL")
    for depth in range(deepest + 1):
        level = cut(level, "level")
        if level.isEmpty():
            break
        found.append(level)
        above = level.select(F.col("id").alias("above_id"), *(F.col(n).alias(f"above_{n}") for n in root)).distinct()
        level = below.join(above, F.col("parent") == F.col("above_id")).select("id", *(c.alias(n) for n, c in child.items()), F.lit(depth + 1).alias("depth"))
    if not found:
        found = [level]
    done = found[0]
    for part in found[1:]:
        done = done.unionByName(part)
    return rows.join(done.distinct(), "id", "left")
