"""Exact near-duplicates of vectors: a metric range join over pivots.

Vectors of one direction and length class are compared by cosine, which for unit vectors is a distance: a cosine
of at least c is a distance of at most e = sqrt(2 - 2c). Each vector lives in the cell of its nearest pivot. The
triangle inequality says in which other cells a vector within e of it may live: in that of pivot q only if the
vector is at most e away from the plane between its own pivot and q, and at most e farther from q
than that cell's farthest vector. Of two cells that may share links one, the lower or the higher by turns, gets the other's
vectors as visitors. Cells join independently: the cell's own vectors meet all that are in it, own and visiting, block by
block. Cells with very many own vectors are dealt over several tasks, each with a part of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of
from .shared import connected_components, saved

LEAST = 0.9
#: Own vectors that a task is meant to hold, and the most pivots (their table goes to every task). More
#: vectors than that in a cell are dealt over several tasks, so neither number bounds the input.
CELL, MOST_PIVOTS = 4096, 2048
#: Distances that differ by less than this may be one and the same but for rounding.
TWINS = 1e-6
OWN, NEIGHBOUR, VISITOR = range(3)


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def units(vectors: np.ndarray) -> np.ndarray:
    # by the largest component first, so that squares neither overflow nor vanish
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def homes(d: np.ndarray) -> np.ndarray:
    return d.argmin(axis=1)


def link_vectors(table: DataFrame, least: float = LEAST, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row ``vec_id, n_links, component_id, kept``; two vectors link if their cosine is at least ``least`` (0 to 1).

    Vectors that are null, empty, zero, or have null or non-finite components link with nothing, and neither do vectors
    of different lengths. Equal vectors link with each other; they are compared once. Rows that share a ``vec_id`` are
    separate vectors that count each, in one component. Rows without a ``vec_id`` link with nothing, have no component and are
    not kept: null, null and false. An empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.coalesce(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    usable = rows.where(fine)
    kinds = saved(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vectors")

    links, edges = [], []
    for size, count in kinds.groupBy(F.size("v")).count().collect():  # a row for each length of vectors
        found = saved(joined(kinds.where(F.size("v") == size), count, least), "links")
        links.append(found.where("n >= 0").groupBy("a").agg(F.sum("n").alias("n_other")))
        edges.append(found.where("n < 0").select("a", "b"))
    if not links:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    every_link, every_edge = links[0], edges[0]
    for x, y in zip(links[1:], edges[1:], strict=True):
        every_link, every_edge = every_link.union(x), every_edge.union(y)
    group = connected_components(every_edge, "vector-components")
    answer = (
        kinds.select("v", "rep", "weight")
        .join(every_link.withColumnRenamed("a", "rep"), "rep", "left")
        .join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .select("v", (F.coalesce("n_other", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    whole = rows.withColumn("v", F.when(fine, F.col("v"))).join(answer, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def joined(kinds: DataFrame, count: int, least: float) -> DataFrame:
    """Rows ``(a, n, b)``: with n >= 0 a part of the vectors that a links with, weights counted; with n < 0 an edge of a forest of the links."""
    spark = kinds.sparkSession
    n_pivots = max(1, min(MOST_PIVOTS, math.ceil(count / CELL)))
    sample = kinds.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(n_pivots).select("v").toArrow()
    pivots = units(vectors_of(sample.column(0).combine_chunks()))
    pivots = pivots[~np.triu(distances(pivots, pivots) < TWINS, 1).any(axis=0)]  # of pivots in one direction the first
    radius_of = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    shared = spark.sparkContext.broadcast(pivots)

    def census(batches):
        for batch in batches:
            if batch.num_rows:
                d = distances(units(vectors_of(batch.column("v"))), shared.value)
                home = homes(d)
                # a vector counts as far for every pivot that is as near as its own but for rounding
                row, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + TWINS)
                most, n = np.full(d.shape[1], -1.0), np.bincount(home, minlength=d.shape[1])
                np.maximum.at(most, cell, d[row, cell])
                cells = np.flatnonzero(most >= 0)
                yield batch_of(cell=cells.astype(np.int32), n=n[cells].astype(np.int64), far=most[cells])

    found = kinds.select("v").mapInArrow(census, "cell int, n long, far double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()
    blocks, far = np.ones(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for r in found:  # a row for each pivot at most
        blocks[r["cell"]], far[r["cell"]] = max(1, math.ceil(r["n"] / CELL)), r["far"]
    # squares of distances are right to this, so a distance near 0 only to its root: bounds allow for it, which can only add visits
    slack = 1e-12 + 4e-15 * pivots.shape[1]
    far = np.where(far >= 0, np.sqrt(far * far + slack), far)
    plan = spark.sparkContext.broadcast((pivots, blocks, far, np.sqrt(distances(pivots, pivots) ** 2 + slack)))

    def deal(batches):
        pivots, blocks, far, between = plan.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rep, weight = part.column("rep").to_numpy(), part.column("weight").to_numpy()
                d = distances(units(vectors_of(part.column("v"))), pivots)
                home = homes(d)
                own = d[np.arange(len(home)), home][:, None]
                visits = (d * d - own * own <= 2 * between[home] * radius_of + slack) & (d <= far[None, :] + radius_of)
                # cells i < j meet in i if i + j is odd, else in j
                there, mine = np.arange(len(pivots))[None, :], home[:, None]
                visits &= np.where((there + mine) % 2 == 1, there < mine, there > mine)
                visits[np.arange(len(home)), home] = True
                row, cell = np.nonzero(visits)
                times = blocks[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                # a vector is an own one in one block of its home, and a neighbour in the others
                own = (block == (rep[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[cell])
                kind = np.where(cell != home[row], VISITOR, np.where(own, OWN, NEIGHBOUR)).astype(np.int8)
                for i in range(0, len(row), 8192):
                    s = slice(i, i + 8192)
                    yield batch_of(cell=cell[s].astype(np.int32), block=block[s].astype(np.int32), kind=kind[s], rep=rep[row[s]], weight=weight[row[s]], v=part.column("v").take(pa.array(row[s])))

    def meet(batches):
        group, held = None, []
        state = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if group is None or tuple(keys[b]) != group:
                    if group is not None:
                        yield from (state or Meeting(held, least)).ended()
                    group, held, state = tuple(keys[b]), [], None
                part = batch.slice(b, e - b)
                bounds = np.searchsorted(part.column(2).to_numpy(), [OWN, NEIGHBOUR, VISITOR, VISITOR + 1]).tolist()
                if bounds[1]:
                    held.append(part.slice(0, bounds[1]))
                for kind, x, y in zip((NEIGHBOUR, VISITOR), bounds[1:], bounds[2:]):
                    if y > x:
                        state = state or Meeting(held, least)
                        yield from state.visited(part.slice(x, y - x), kind == VISITOR)
        if group is not None:
            yield from (state or Meeting(held, least)).ended()

    dealt = kinds.mapInArrow(deal, "cell int, block int, kind byte, rep long, weight long, v array<double>")
    return dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(meet, "a long, n long, b long")


class Meeting:
    """The own vectors of a task's part of a cell: they meet themselves, then neighbours of the cell's other parts and visitors as they come.

    Neighbours meet the own ones of this part here and this part's in theirs; a visitor's links are counted here for both sides.
    """

    def __init__(self, own: list[pa.RecordBatch], least: float):
        self.least = least
        self.rep = np.concatenate([b.column(3).to_numpy() for b in own]) if own else np.zeros(0, np.int64)
        self.weight = np.concatenate([b.column(4).to_numpy() for b in own]) if own else np.zeros(0, np.int64)
        self.x = units(np.concatenate([vectors_of(b.column(5)) for b in own])) if own else None
        self.x32 = self.x.astype(np.float32) if own else None
        self.count = np.zeros(len(self.rep), np.int64)
        self.root = np.arange(len(self.rep))
        if own:
            for at in range(0, len(self.rep), 2048):
                self.links(self.x[at : at + 2048], self.rep[at : at + 2048], self.weight[at : at + 2048], at)

    def links(self, y: np.ndarray, rep: np.ndarray, weight: np.ndarray, own_at: int | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Counts the links with ``y`` and joins what they connect; for others than own ones, gives an edge for each that links, and its number of links."""
        # single precision finds candidates, double precision decides
        near = self.x32 @ y.T.astype(np.float32) >= self.least - 1e-5 - 2e-7 * y.shape[1]
        i, j = np.nonzero(near)
        other = self.rep[i] != rep[j]
        i, j = i[other], j[other]
        keep = np.concatenate([np.einsum("ij,ij->i", self.x[i[k : k + 65536]], y[j[k : k + 65536]]) >= self.least for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[keep], j[keep]
        np.add.at(self.count, i, weight[j])
        theirs = np.zeros(len(y), np.int64)
        np.add.at(theirs, j, self.weight[i])
        edges = []
        if own_at is not None:
            for a, b in self.forest(i, j + own_at):
                self.join(a, b)
        else:
            order = np.argsort(j, kind="stable")
            i, j = i[order], j[order]
            first = np.concatenate(([True], j[1:] != j[:-1])) if len(j) else np.zeros(0, bool)
            for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                edges.append((int(rep[b]), int(self.rep[a])))
            lead = i[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))] if len(i) else i
            for a, b in self.forest(lead, i):
                self.join(a, b)
        return edges, theirs

    def forest(self, a: np.ndarray, b: np.ndarray):
        """Pairs whose roots differ still, each pair of roots once."""
        ra, rb = self.root[a], self.root[b]
        differ = ra != rb
        if differ.any():
            yield from np.unique(np.stack((ra[differ], rb[differ]), axis=1), axis=0).tolist()

    def join(self, a: int, b: int) -> None:
        a, b = self.root[a], self.root[b]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)

    def visited(self, part: pa.RecordBatch, counted: bool):
        if self.x is not None:
            for at in range(0, part.num_rows, 2048):
                some = part.slice(at, 2048)
                rep = some.column(3).to_numpy()
                edges, theirs = self.links(units(vectors_of(some.column(5))), rep, some.column(4).to_numpy(), None)
                if edges:
                    a, b = zip(*edges, strict=True)
                    yield batch_of(a=pa.array(a, pa.int64()), n=pa.array([-1] * len(a), pa.int64()), b=pa.array(b, pa.int64()))
                if counted and len(linked := np.flatnonzero(theirs)):
                    yield batch_of(a=rep[linked], n=theirs[linked], b=rep[linked])

    def ended(self):
        if len(self.rep):
            joined = self.root != np.arange(len(self.root))
            yield batch_of(a=self.rep[joined], n=np.full(joined.sum(), -1), b=self.rep[self.root[joined]])
            some = self.count > 0
            yield batch_of(a=self.rep[some], n=self.count[some], b=self.rep[some])


def query(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         coalesce(len(embedding) > 0 AND list_count(embedding) = len(embedding)
           AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine
  FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.fine AND b.fine AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a
), found AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, f.component_id, e.vec_id = f.component_id AS kept
FROM embeddings e JOIN found f USING (vec_id) LEFT JOIN n ON n.a = e.vec_id
"""
