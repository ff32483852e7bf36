"""Exact Jaccard join of documents by their word n-grams, in Jaccard's metric space.

One minus the Jaccard similarity is a metric, so pivots divide documents into regions and the triangle inequality says
which documents near a border have to stand in more than one.

Most documents are at distance 1 from all others, where pivots tell nothing apart. These leave first: what two sets have in
common are shingles that several documents have, so a document of which less than the threshold's share of shingles occurs
elsewhere links with nothing, and for the others these shingles and the size of the whole set give exact distances.

First level. Two documents within the threshold t have one of the first n - ceil(t n) + 1 shingles of both in common, in
one order for all: shingles by the number of documents that have them, rare ones first. Of the documents that stand under
a shingle, the one that stands under most shingles is the pivot, and its cell gathers the documents of all its shingles.
A group of alike documents thus has one or a few pivots, not one cell for each shingle.

Further levels. A cell of up to LEAF documents is joined inside one task. In a larger one PIVOTS documents become pivots
and their distances to all members are found, in parts of bounded size. Each member goes to the Voronoi cell of its nearest
pivot, and stands as a replica in the cells of the pivots that are farther by two thresholds at most: by the triangle
inequality everything linked to it has its home there or finds it there. Pivots leave, for they have met all members; cells
whose members are all connected are done; the rest is divided again. Where windows are so wide that this divides nothing
(everything alike and little linked), the members outside the cell's largest component meet the whole cell, block by block.
Components are exact, and no pair of documents is ever a row unless it is a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.components import components
from vellumflow.llm.shared import cut, drop_cut, map_slices, unused
from vellumflow.llm.wordhash import chunks, shingle_sets

SIMILARITY = 80  # hundredths
SHINGLE = 5
LEAF = 512  # documents of a cell that one task joins
PIVOTS = 16  # of a larger cell
DENSE = 2.0  # times the members of a cell that its divisions may have together, or else it is joined in blocks
SHRINK = 0.75  # of a cell's members that one division may have, likewise
PACKED = 4 << 20  # bytes of text whose shingles travel together
BUCKET = 1 << 20  # shingles of a bucket, about
BROADCAST_IDS = 1 << 20  # ids that may be broadcast, 8 MB
SLACK = 1e-9  # of comparisons of distances


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace") if t else b"" for t in texts]


def first_part(n: int, similarity: int = SIMILARITY) -> int:
    """Shingles of a set of n that it must be placed under."""
    return n - -(-similarity * n // 100) + 1 if n else 0


def describe(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the shingle set), digest (of the set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = _encoded(batch["text"]), batch["doc_id"]
            for first, last in chunks(texts):
                sets = list(shingle_sets(texts[first:last], k))
                yield pd.DataFrame({"doc_id": ids[first:last], "n": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]})

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, digest binary")


def _squeeze(rising: np.ndarray) -> bytes:
    """Steps between rising 56-bit numbers, low bytes of all first, so that the high ones, mostly 0, compress."""
    return np.diff(rising, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def _spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(7, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :7] = planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def _packed(docs: DataFrame, buckets: int, k: int) -> DataFrame:
    """The shingles of documents (ids not repeated), by range of their 56-bit hashes and by chunk of documents.

    A chunk is named by its first document. Its head tells the ids and set sizes of its documents and goes along in one of
    its buckets.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = _encoded(batch["text"]), batch["doc_id"].to_numpy(np.int64)
            for start, stop in chunks(texts, PACKED):
                for first in range(start, stop, 1 << 16):
                    last = min(stop, first + (1 << 16))
                    sets = list(shingle_sets(texts[first:last], k))
                    sizes = np.array([len(s) for s in sets], "<i8")
                    shingles = np.concatenate(sets) >> np.uint64(8)
                    order = np.argsort(shingles)
                    shingles, owner = shingles[order], np.repeat(np.arange(len(sets)).astype("<u2"), sizes)[order]
                    edges = np.searchsorted((shingles >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                    chunk = int(ids[first])
                    rows = [(chunk, chunk % buckets, True, ids[first:last].astype("<i8").tobytes(), sizes.tobytes())]
                    rows += [(chunk, int(b), False, _squeeze(shingles[edges[b] : edges[b + 1]]), owner[edges[b] : edges[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(edges))]
                    yield pd.DataFrame(rows, columns=["chunk", "bucket", "head", "shingles", "owners"])

    return map_slices(docs, run, "chunk long, bucket int, head boolean, shingles binary, owners binary")


def _several(group: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket, the shingles that several documents have, with the number of these; heads pass through."""
    heads, rows = group[group["head"]], group[~group["head"]]
    out = [(c, True, s, o, b"") for c, s, o in zip(heads["chunk"], heads["shingles"], heads["owners"])]
    parts = [_spread(s) for s in rows["shingles"]]
    if parts:
        shingles = np.concatenate(parts)
        order = np.argsort(shingles)
        ranked = shingles[order]
        begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        times = np.diff(np.append(begins, len(ranked)))
        counts = np.empty(len(ranked), "<u4")
        counts[order] = np.repeat(times, times)
        edge = 0
        for chunk, part, owners in zip(rows["chunk"], parts, rows["owners"]):
            count = counts[edge : edge + len(part)]
            edge += len(part)
            again = count > 1
            if again.any():
                out.append((chunk, False, _squeeze(part[again]), np.frombuffer(owners, "<u2")[again].tobytes(), count[again].tobytes()))
    return pd.DataFrame(out, columns=["chunk", "head", "shingles", "owners", "counts"])


def _sets_of(similarity: int):
    def of_chunk(group: pd.DataFrame) -> pd.DataFrame:
        """Documents of a chunk that may link: their shared shingles, rare ones first, and those that they stand under."""
        head, rows = group[group["head"]].iloc[0], group[~group["head"]]
        ids, sizes = np.frombuffer(head["shingles"], "<i8"), np.frombuffer(head["owners"], "<i8")
        out = []
        if len(rows):
            shingles = np.concatenate([_spread(s) for s in rows["shingles"]])
            owners, counts = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("owners", "<u2"), ("counts", "<u4")))
            order = np.lexsort((shingles, counts, owners))
            shingles, edges = shingles[order].astype(np.int64), np.searchsorted(owners[order], np.arange(len(ids) + 1))
            for doc, n, a, b in zip(ids.tolist(), sizes.tolist(), edges, edges[1:]):
                under = first_part(n, similarity) - (n - int(b - a))  # shingles of no other document come first of all
                if under > 0:
                    out.append((doc, n, shingles[a:b].tobytes(), shingles[a : a + under]))
        return pd.DataFrame(out, columns=["doc_id", "n", "shingles", "stands_under"])

    return of_chunk


def shared_sets(docs: DataFrame, total: int, similarity: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """doc_id, n, shingles (those that another document has too), stands_under: of the documents that may link with another.

    docs: ids and texts, no id and no set twice, total shingles together. Two shuffles: the shingles by range of their
    hashes, and those that several documents have back to the chunks of documents that they came from.
    """
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    several = _packed(docs, buckets, k).groupBy("bucket").applyInPandas(_several, "chunk long, head boolean, shingles binary, owners binary, counts binary")
    return several.groupBy("chunk").applyInPandas(_sets_of(similarity), "doc_id long, n long, shingles binary, stands_under array<long>")


class _Cell:
    """Documents of one task: sizes of their sets, shared shingles, and which of them are connected."""

    def __init__(self, n: pd.Series, shingles: pd.Series, component: np.ndarray, similarity: int):
        self.n, self.similarity = n.to_numpy(np.int64), similarity
        sizes = np.array([len(s) // 8 for s in shingles], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        distinct, self.column = np.unique(np.frombuffer(b"".join(shingles), np.int64), return_inverse=True)
        self.mark = np.zeros(len(distinct), np.int64)
        self.component = component.copy()
        self.found: list[tuple[int, int]] = []

    def common(self, x: int, others: np.ndarray | None = None) -> np.ndarray:
        """Shingles that document x has in common with all documents, or with some."""
        own = self.column[self.ends[x] : self.ends[x + 1]]
        self.mark[own] = 1
        if others is None:
            out = np.add.reduceat(self.mark[self.column], self.ends[:-1])
        else:
            out = np.array([self.mark[self.column[self.ends[y] : self.ends[y + 1]]].sum() for y in others], np.int64)
        self.mark[own] = 0
        return out

    def meet(self, x: int, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances of x to all documents or some, and which are links; links that connect anything new are kept."""
        common = self.common(x, others)
        union = self.n[x] + (self.n if others is None else self.n[others]) - common
        linked = 100 * common >= self.similarity * union
        for y in np.flatnonzero(linked) if others is None else others[linked]:
            if self.component[y] != self.component[x]:
                self.found.append((x, int(y)))
                self.component[self.component == self.component[y]] = self.component[x]
        return 1 - common / union, linked


def _join_inside(similarity: int):
    """Links that connect the documents of a cell, of which one at least of each pair has its home there."""
    eps = 1 - similarity / 100

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["home", "doc_id"]).drop_duplicates("doc_id", keep="last").reset_index(drop=True)
        ids, home = group["doc_id"].to_numpy(np.int64), group["home"].to_numpy(bool)
        cell = _Cell(group["n"], group["shingles"], group["component"].to_numpy(np.int64), similarity)
        pivots, seen = np.argsort(-np.diff(cell.ends), kind="stable")[:8], []
        for x in pivots:
            if (cell.component == cell.component[0]).all():
                break
            seen.append(cell.meet(int(x))[0])
        far = np.array(seen).reshape(len(seen), len(ids))
        names, counts = np.unique(cell.component, return_counts=True)
        largest = names[counts.argmax()]
        # of two documents that aren't connected, one at least is outside the largest component
        for x in np.flatnonzero(cell.component != largest):
            if x in pivots[: len(seen)]:
                continue
            open_to = (cell.component != cell.component[x]) & (home | home[x])
            open_to &= (100 * cell.n >= similarity * cell.n[x]) & (100 * cell.n[x] >= similarity * cell.n)
            open_to &= (np.abs(far - far[:, [x]]) <= eps + SLACK).all(axis=0)  # the windows of the pivots
            others = np.flatnonzero(open_to)
            if len(others):
                cell.meet(int(x), others if 4 * len(others) < len(ids) else None)
        return pd.DataFrame([(ids[x], ids[y]) for x, y in cell.found], columns=["a", "b"], dtype=np.int64)

    return join


def _deal(similarity: int):
    """Members of a part of a cell to Voronoi cells: the nearest pivot, and pivots that are farther by two thresholds at most."""
    eps = 1 - similarity / 100

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pivot", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        count, ids = int(group["pivot"].sum()), group["doc_id"].to_numpy(np.int64)
        cell = _Cell(group["n"], group["shingles"], np.arange(len(group)), similarity)
        met = [cell.meet(p) for p in range(count)]
        far, linked = np.stack([m[0] for m in met]), np.stack([m[1] for m in met])
        nearest = far.argmin(axis=0)
        window = far - far.min(axis=0) <= 2 * eps + SLACK
        out = []
        for x in range(len(ids)):
            to = ids[:count][linked[:, x] & (ids[:count] != ids[x])]
            if x < count or ids[x] in ids[:count]:  # pivots have met every member
                out.append((group["cell"][x], ids[x], False, True, ids[x], [], to))
            else:
                window[nearest[x], x] = False
                out.append((group["cell"][x], ids[x], group["home"][x], False, ids[nearest[x]], ids[:count][window[:, x]], to))
        return pd.DataFrame(out, columns=["cell", "doc_id", "home", "pivot", "nearest", "replicas", "linked"])

    return deal


def _rank(under: Column) -> Column:
    """Of documents, the one that stands under most shingles comes first."""
    return F.struct((-under).alias("under"), F.xxhash64("doc_id").alias("hash"), "doc_id")


def _different(cells: DataFrame) -> DataFrame:
    """Of cells with the same members one, and none without two members of which one is at home.

    Two independent 64-bit sums stand for the members, so nothing is gathered.
    """
    sums = [F.bit_xor(F.xxhash64("doc_id", "home", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    of = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.max("home").alias("any_home"), *sums).where("members > 1 AND any_home")
    chosen = of.groupBy("members", "x1", "x2").agg(F.min("cell").alias("chosen")).select("chosen")
    return cells.join(chosen, F.col("cell") == F.col("chosen"), "left_semi")


def first_cells(sets: DataFrame) -> DataFrame:
    """cell (its pivot), doc_id, home: documents with the pivots of the shingles that they stand under."""
    placed = sets.select("doc_id", _rank(F.size("stands_under")).alias("rank"), F.explode("stands_under").alias("region"))
    pivots = placed.groupBy("region").agg(F.min("rank").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    pivots = pivots.select(F.col("region").alias("of_region"), F.col("pivot.doc_id").alias("cell"))
    return placed.join(pivots, F.col("region") == F.col("of_region")).select("cell", "doc_id").distinct().withColumn("home", F.lit(True))


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows with the sets of their documents. rows: a written table, so that the smaller side is known and small ones are not shuffled for."""
    return rows.join(sets.select(F.col("doc_id").alias("_of"), "n", "shingles"), F.col("doc_id") == F.col("_of")).drop("_of")


def _blocks(cells: DataFrame) -> DataFrame:
    """Cells whose members outside the largest component meet the whole cell, in blocks: part, other, with home for those outside."""
    counted = cells.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("size"))
    whole = counted.groupBy("cell").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("members"))
    whole = whole.select(F.col("cell").alias("of_cell"), F.col("top.component").alias("largest"), F.ceil(F.col("members") / LEAF).alias("parts"), F.ceil((F.col("members") - F.col("top.size")) / LEAF).alias("others"))
    rows = cells.join(whole.where("others > 0"), F.col("cell") == F.col("of_cell"))
    part, other = (F.pmod(F.xxhash64("doc_id", F.lit(s)), F.col(c)) for s, c in (("part", "parts"), ("other", "others")))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    inside = rows.withColumn("part", part).withColumn("other", every("others")).withColumn("home", F.lit(False))
    outside = rows.where("component <> largest").withColumn("other", other).withColumn("part", every("parts")).withColumn("home", F.lit(True))
    names = ["cell", "part", "other", "doc_id", "home", "component"]
    return inside.select(names).unionByName(outside.select(names))


def _divide(cells: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Deal the members of large cells to the Voronoi cells of pivots. Written to the shared folder."""
    top = cells.where("home").join(sets.select(F.col("doc_id").alias("_of"), F.size("stands_under").alias("under")), F.col("doc_id") == F.col("_of"))
    top = top.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy(_rank(F.col("under"))))).where(F.col("at") <= PIVOTS)
    parts = F.ceil(F.col("members") / LEAF)
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    members = cells.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts)).withColumn("pivot", F.lit(False))
    chosen = top.withColumn("part", every).withColumn("pivot", F.lit(True))
    names = ["cell", "part", "doc_id", "home", "pivot"]
    both = _with_sets(cut(members.select(names).unionByName(chosen.select(names)), "members"), sets)
    return cut(both.groupBy("cell", "part").applyInPandas(_deal(similarity), "cell long, doc_id long, home boolean, pivot boolean, nearest long, replicas array<long>, linked array<long>"), "dealt")


def region_links(docs: DataFrame, described: DataFrame, similarity: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """Links (a, b), repeats possible, that connect all documents which any links connect. Equal sets link to the smallest id among them.

    docs: doc_id, text, no id twice; described: what describe() tells of them, written to a table.
    """
    known = described.where("n > 0 AND doc_id IS NOT NULL")
    least = cut(known.groupBy("digest").agg(F.min("doc_id").alias("head"), F.min("n").alias("n")), "heads")
    links = [known.join(least.drop("n"), "digest").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).where("a <> b")]

    size = least.agg(F.count(F.lit(1)).alias("heads"), F.sum("n").alias("total")).first()
    heads = least.select("head")
    few = size.heads <= BROADCAST_IDS  # else the texts are shuffled to the ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(heads) if few else heads, F.col("doc_id") == F.col("head"), "left_semi")
    sets = cut(shared_sets(texts, size.total or 0, similarity, k), "sets")

    cells = cut(first_cells(sets).withColumn("component", F.col("doc_id")), "cells")
    cells = _different(cells)
    while True:
        sized = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).select(F.col("cell").alias("of_cell"), "members")
        cells = cut(cells.join(sized, F.col("cell") == F.col("of_cell")).drop("of_cell"), "cells")
        inside = _with_sets(cells.where(F.col("members") <= LEAF).drop("members"), sets)
        links.append(cut(inside.groupBy("cell").applyInPandas(_join_inside(similarity), "a long, b long"), "links"))
        large = cells.where(F.col("members") > LEAF)
        if large.isEmpty():
            break
        dealt = _divide(large, sets, similarity)
        links.append(dealt.select(F.col("doc_id").alias("a"), F.explode("linked").alias("b")))

        of = cut(components(_all(links)), "components").withColumnRenamed("component", "_component")
        with_component = lambda rows: rows.join(of, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("_component", "doc_id")).drop("node", "_component")
        spots = F.concat(F.array(F.struct(F.col("nearest").alias("pivot"), "home")), F.transform("replicas", lambda p: F.struct(p.alias("pivot"), F.lit(False).alias("home"))))
        deeper = dealt.where("NOT pivot").select(F.col("cell").alias("parent"), "doc_id", F.explode(spots).alias("spot"))
        deeper = deeper.select("parent", F.xxhash64("parent", "spot.pivot").alias("cell"), "doc_id", "spot.home")
        deeper = cut(with_component(deeper), "divided")
        before = large.groupBy("cell").agg(F.count(F.lit(1)).alias("before"))
        after = deeper.groupBy("parent", "cell").agg(F.count(F.lit(1)).alias("size")).groupBy(F.col("parent").alias("cell")).agg(F.sum("size").alias("after"), F.max("size").alias("most"))
        dense = cut(before.join(after, "cell").where((F.col("after") > DENSE * F.col("before")) | (F.col("most") > SHRINK * F.col("before"))).select(F.col("cell").alias("dense")), "dense")
        blocks = _with_sets(cut(_blocks(with_component(large.drop("component").join(dense, F.col("cell") == F.col("dense"), "left_semi"))), "blocks"), sets)
        links.append(cut(blocks.groupBy("cell", "part", "other").applyInPandas(_join_inside(similarity), "a long, b long"), "links"))

        deeper = deeper.join(dense, F.col("parent") == F.col("dense"), "left_anti")
        several = deeper.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(F.col("cell").alias("open"))
        divided = cells
        cells = cut(_different(deeper.join(several, F.col("cell") == F.col("open"), "left_semi").select("cell", "doc_id", "home", "component")), "cells")
        drop_cut(divided)
        if cells.isEmpty():
            break
    return _all(links)


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _repeats(docs: DataFrame) -> bool:
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def _row_components(rows: DataFrame, row: str, similarity: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Described rows (_id, and doc_id as the row's key), and the components (node, component) of the keys. Rows without an id link with nothing."""
    keyed = rows.select(F.col(row).alias("doc_id"), "text", F.col("doc_id").cast("long").alias("_id"))
    described = cut(describe(keyed, k).join(keyed.select(F.col("doc_id").alias("_key"), "_id"), F.col("doc_id") == F.col("_key")).drop("_key"), "described-rows")
    links = region_links(keyed.where("_id IS NOT NULL").drop("_id"), described.where("_id IS NOT NULL").drop("_id"), similarity, k)
    return described, components(links)


def jaccard_components(docs: DataFrame, similarity: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    Words are runs of characters that are no white space, A-Z lower-cased. A text with fewer than k words is one shingle;
    null, empty and blank texts have none and link with nothing. A null id links with nothing and has a null component.
    Rows that repeat an id are joined each by its own text, and the links of all of them are links of the id; each row
    keeps its own n_shingles. Other columns are ignored; an empty table gives no rows.
    """
    if _repeats(docs):
        rows = cut(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "rows")
        described, of_row = _row_components(rows, "_row", similarity, k)
        named = described.join(of_row, F.col("doc_id") == F.col("node")).select(F.col("_id").alias("a"), F.col("component").alias("of"))
        least = named.groupBy("of").agg(F.min("a").alias("b"))
        of = components(named.join(least, "of").where("a <> b").select("a", "b").distinct())
        described = described.select(F.col("_id").alias("doc_id"), "n")
    else:
        described = cut(describe(docs, k), "described-all")
        of = components(region_links(docs.where("doc_id IS NOT NULL"), described, similarity, k))
    return described.join(of, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, similarity: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """The rows of docs of which one stays per component: that with the smallest id. All columns as they came.

    Rows with a null id all stay. Rows that repeat an id are rows of their own: of those in one component one stays, by the
    smallest id and then the smallest digest of the text.
    """
    if not _repeats(docs):
        gone = jaccard_components(docs, similarity, k).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    row = unused(docs, "row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    _, of = _row_components(rows, row, similarity, k)
    rank = F.struct(F.col("doc_id").cast("long").alias("id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), F.col(row).alias("row"))
    ranked = rows.select(rank.alias("_rank")).join(of, F.col("_rank.row") == F.col("node"))
    first = ranked.groupBy("component").agg(F.min("_rank")["row"].alias("_first")).select("_first")
    gone = of.join(first, F.col("node") == F.col("_first"), "left_anti").select(F.col("node").alias("_gone"))
    return rows.join(gone, F.col(row) == F.col("_gone"), "left_anti").select(*docs.columns)
