"""Connected components of links, as alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.shared import cut, drop_cut


def _towards_least(both: DataFrame) -> DataFrame:
    """node, least: the smallest of a node and its neighbours, from links in both directions."""
    return both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of links (a, b): the smallest node that links reach. Written to the shared folder.

    Links to oneself and repeated links do no harm; links with a null end are none. Every step is a grouped minimum and a
    join; nothing is gathered per node.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours move to the smallest neighbour
        large = both.join(_towards_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()
        stars = cut(small, "stars")
        drop_cut(edges)
        edges = stars
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
