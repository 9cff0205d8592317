"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, label``: every node of the edge table with the smallest node it is linked to.

    Distributed union-find: each round hangs every node under the smallest node known near
    it, first the larger neighbours, then the smaller ones. Minima are grouped with
    map-side combining, so a node with very many neighbours does not fill one task; the
    edges of a round are written to the shared folder, so lost executors lose no work.
    Null ends and loops are dropped; an edge table without rows gives an empty one.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-0")
    for step in range(1, most_rounds + 1):
        if _settled(now):
            return _named(now)
        # Edges point from a larger node to a smaller one, so the least node near one is among its own edges.
        # Minima are written, so that both sides of a join are plain exchanges and Spark can split a node with very many neighbours.
        low = written(now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v"), "cc-low")
        large = written(now.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "cc-large")
        # Small-star joins the smaller neighbours.
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        old, now = now, written(small, f"cc-{step}")
        discard(old, low, large, least)
    if _settled(now):
        return _named(now)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _named(edges: DataFrame) -> DataFrame:
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels.written_to = edges.written_to
    return labels


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each larger node has one edge, and no smaller one is a larger one elsewhere. A further round would change nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("own"), F.lit(0).alias("over")), F.struct(F.col("v").alias("x"), F.lit(0).alias("own"), F.lit(1).alias("over")))).alias("e")).select("e.*")
    loose = ends.groupBy("x").agg(F.sum("own").alias("own"), F.max("over").alias("over")).filter("own > 1 or own = 1 and over = 1")
    return loose.agg(F.count("*")).first()[0] == 0
