"""Connected components of a distributed edge list, by alternating stars.

The large star links each node's larger neighbours to its least neighbour, the small star its smaller ones;
both keep components and make them shallower, until every node points at its component's least node. A
node's least neighbour is an aggregate with partial sums, joined back, so that a hub with a third of all edges
is split like any skewed join. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import materialize

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star over edges (u, v), which may repeat: it has no more rows than edges, or for the small star than edges and nodes."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node of each component; nodes without edges are not listed."""
    edges = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        edges = materialize(_star(_star(edges, True), False).distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
