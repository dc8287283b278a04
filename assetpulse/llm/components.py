"""Connected components over an edge table, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node it can reach.

    Each round hooks every node to its smallest neighbour (partial aggregation,
    so a node with very many edges is no hot task), follows the hooks to their
    ends by pointer doubling, and replaces the ends of each edge by their
    roots.  Edges inside one root are settled and leave, and edges between the
    same two roots become one, so only the first round touches all edges.
    Rounds and doublings grow with the logarithm of the nodes and of a chain,
    and are two or three for the star-like edges that the callers make.  Each
    step is written to the shared folder; nothing is collected but a test for
    emptiness.  An empty table gives an empty result; self loops and repeated
    edges are allowed, null ends are left out.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).dropna()
    live, roots = staged(_undirected(e, "u", "v"), "edges"), None
    while roots is None or not live.isEmpty():
        ends = live.union(live.select("v", "u"))
        step = staged(ends.groupBy(F.col("u").alias("node"))
                      .agg(F.least(F.min("v"), F.col("node")).alias("root")), "hooks")
        while True:
            far = staged(step.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
                         .select("node", F.col("next").alias("root"), F.col("root").alias("was")), "hooks")
            step = far.select("node", "root")
            if far.where("root <> was").isEmpty():
                break
        if roots is None:
            roots = step
        else:
            top = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = staged(roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        moved = (live.join(step.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
                 .join(step.select(F.col("node").alias("v"), F.col("root").alias("b")), "v").where("a <> b"))
        live = staged(_undirected(moved, "a", "b"), "edges")
    return roots


def _undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge once, its smaller end first."""
    return edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
