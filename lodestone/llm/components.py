"""Connected components of an edge table by contraction, without a vertex or an edge on the driver.

A round hooks every vertex to its smallest neighbour (itself, if that is smaller), shortens the chains that this makes
by pointer jumping, and goes on with the edges between the vertices found. Parents are never larger than their children,
so there are no cycles and the last vertex left of a component is its smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import Workspace


def connected(edges: DataFrame, space: Workspace, jumps: int = 2) -> DataFrame:
    """(node, root) of every vertex of edges (a, b), where root is the smallest vertex of its component."""
    edges = space.write(edges.where("a <> b").distinct(), "links")
    roots = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
        parents = space.write(parents, "parents")
        for _ in range(jumps):
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            parents = parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        parents = space.write(parents, "parents")
        if roots is None:
            roots = parents
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = space.write(roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        ends = [parents.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b")]
        left = edges.join(ends[0], "a").join(ends[1], "b").where("a_root <> b_root")
        edges = space.write(left.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return roots


def merged(roots: DataFrame, edges: DataFrame, space: Workspace) -> DataFrame:
    """The roots of a graph that gets more edges (a, b): only what they touch is contracted again."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    parts = connected(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), space)
    up = parts.select(F.col("node").alias("root"), F.col("root").alias("above"))
    moved = roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return space.write(moved.unionByName(parts.join(roots, "node", "left_anti")), "roots")
