"""Connected components of a link table, by alternating star contractions.

Each round is two shuffles on node ids and is written to the shared folder; nothing
but whether a round was the last reaches the driver. The number of rounds grows
with the logarithm of the longest path, so chains of links are cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the others) to its smallest one."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Each node is linked to one smaller node, which is linked to no smaller one: nothing is left to contract."""
    of_node = edges.groupBy("a").agg(F.count("*").alias("n"))
    roots = edges.select(F.col("b").alias("a"), F.lit(0).alias("n")).distinct()
    return of_node.unionByName(roots).groupBy("a").agg(F.count("*").alias("seen"), F.max("n").alias("n")).filter("seen > 1 or n > 1").isEmpty()


def contracted(stars: DataFrame, jumps: int = 3) -> DataFrame:
    """``(node, root)`` of ``stars(a, b)``, where each b has one smaller a: pointers followed ``2**jumps`` steps.

    Cheaper than components, and finer where chains are longer.
    """
    parent = stars.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(jumps):
        above = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        parent = materialize(parent.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "pointers")
    return parent


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, root)``, root the smallest node it reaches.

    Nodes without a link to another node are not listed. Null ends are ignored, and
    repeated, reversed and self links change nothing; an empty table gives an empty one.
    """
    edges = materialize(links.select("a", "b").dropna().filter("a <> b").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        before, edges = edges, materialize(_star(_star(edges, large=True), large=False), "links")
        discard(before)
        if _are_stars(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
