"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.session import cut_lineage


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node of the component.

    Alternates large-star and small-star steps: first every larger neighbour of a
    node is tied to the smallest node around it, then every smaller neighbour.
    Each step is a grouped minimum with map-side combining and one join, whose
    hot nodes adaptive execution can split; edges are checkpointed after each
    round.  Ends when a round changes nothing (a few rounds for star-like input,
    a number logarithmic in the diameter for chains).
    """
    e = cut_lineage(edges.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # e holds (u, v) with v < u: seen from v, u is the larger neighbour
        large = e.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).filter("u != v").distinct()
        large = cut_lineage(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.withColumnRenamed("m", "v")).distinct())
        e = cut_lineage(small)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    own = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return own.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
