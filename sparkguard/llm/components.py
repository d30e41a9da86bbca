"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are tied to the smallest among the node and its neighbours.

    large: the larger neighbours of every node; else the smaller ones and the node itself. Edges have u > v, here and in
    the result, so a node's smallest neighbour is found under u alone: edges are not doubled, and a round is one small plan.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        tied = edges.join(least.withColumnRenamed("u", "v"), "v", "left")
        return tied.select("u", F.coalesce("m", "v").alias("v")).distinct()
    tied = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
    return tied.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v) reaches; isolated nodes have no row.

    Each round writes its edges to the shared folder, so rounds do not pile up lineage.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    state = None
    for _ in range(most_rounds):
        after = materialize(_star(_star(now, True), False), "components")
        found = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        # Settled: every node points at a root, and another round changes nothing.
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
