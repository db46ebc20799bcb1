"""Graphs as edge tables: components, breadth-first distances, spanning forests of small graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, saved


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``, component being the smallest node reachable.

    Alternating large-star and small-star steps: each replaces the edges of a node by edges to the smallest
    neighbour, so a star of any size is one aggregated minimum per node and no neighbour list is ever
    gathered. Nodes without edges to others aren't returned.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while not is_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u goes to the least of u's neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: the smaller neighbours of u, and u itself, go to the least of them
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = saved(small, name)
        forget(edges.sparkSession, now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def is_stars(edges: DataFrame) -> bool:
    """Whether each node u of ``edges(u, v)``, v below u, has one edge, to a node that has none of its own: then all is done."""
    own = edges.groupBy("u").agg(F.count("*").alias("n"))
    centres = edges.select(F.col("v").alias("u")).distinct().withColumn("centre", F.lit(True))
    return own.join(centres, "u", "left").where("n > 1 OR centre").isEmpty()


def grow_from_seeds(edges: DataFrame, seeds: DataFrame, most: int = 1_000) -> DataFrame:
    """Multi-source breadth-first growth: ``edges(a, b)`` both ways, ``seeds(node, label)`` to ``(node, label, distance)``.

    Each round labels the unlabelled neighbours of the last; of several labels the smallest wins.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    done = front = saved(seeds.groupBy("node").agg(F.min("label").alias("label")).withColumn("distance", F.lit(0)), "grown")
    for step in range(1, most + 1):
        reached = front.join(both, front["node"] == both["a"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"))
        front = saved(reached.join(done, "node", "left_anti").withColumn("distance", F.lit(step)), "grown")
        if front.isEmpty():
            break
        done = done.union(front)
    return done


def spanning_forest(links: DataFrame, group: list[str]) -> DataFrame:
    """Maximum spanning forest within each group of ``links(a, b, weight)``: the heaviest first, ties by names.

    For graphs of the size of a building (a group is one task's work).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        rows = []
        for r in pdf.sort_values(["weight", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
            a, b = find(r.a), find(r.b)
            if a != b:
                root[a] = b
                rows.append(r)
        return pd.DataFrame(rows, columns=pdf.columns)

    return links.groupBy(*group).applyInPandas(run, links.schema)
