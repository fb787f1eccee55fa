"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch


def _parents(edges: DataFrame) -> DataFrame:
    """``id, m``: the smallest ``v`` of every ``u``. Written, so that a join's two sides are shuffles of their own, which Spark can split at a hub, and no plan holds a round."""
    return scratch.written(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")), "cc")


def _lifted(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Large star: each ``u`` linked with the parent of ``v``, where it has one (``moved``), instead of ``v``."""
    parent = parents.select(F.col("id").alias("v"), "m")
    return scratch.shuffled(edges, parent, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of every vertex of ``edges(u, v)`` that is not itself the smallest.

    Alternating large and small stars: a logarithmic number of rounds in practice, each of two map-side combined minima and two joins, one plan for each,
    since what the driver keeps for a plan grows with its square. Every edge leads from the greater id to the smaller, so a vertex's smallest neighbour or itself
    is a minimum over its own edges. Rounds end when each vertex has one edge, to one that has none. No vertex's neighbours meet in one list.
    Loops and repeated edges are fine; edges with a null end are left out.
    """
    edges = scratch.written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    while True:
        parents = _parents(edges)
        large = scratch.written(_lifted(edges, parents), "cc")
        ends = large.select("moved", F.lit(1).alias("n")).unionByName(parents.select(F.lit(False).alias("moved"), F.lit(-1).alias("n")))
        now = ends.agg(F.max("moved").alias("moved"), F.sum("n").alias("more")).first()
        if not now["moved"] and not now["more"]:
            scratch.drop(parents, large)
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        least = _parents(large)
        # small star: all of a vertex's smaller neighbours, and itself, linked with the smallest
        small = scratch.shuffled(large, least.withColumnRenamed("id", "u"), "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        old, edges = edges, scratch.written(small.distinct(), "cc")
        scratch.drop(old, parents, large, least)


def roots(forest: DataFrame) -> DataFrame:
    """``id, component`` of a forest ``u, v``: each ``u`` has one ``v``, a smaller one; the component is the root. Each round doubles the reach."""
    now = scratch.written(forest.select("u", "v", F.lit(True).alias("moved")), "roots")
    while now.where("moved").limit(1).count():
        old, now = now, scratch.written(_lifted(now, now.select(F.col("u").alias("id"), F.col("v").alias("m"))), "roots")
        scratch.drop(old)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
