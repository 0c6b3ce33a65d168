"""Connected components of a table of links, without gathering any node's links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.plans.storage import stored


#: A table of more links than this is split where a node has many of them: what is joined is written first, so that AQE
#: sees two plain exchanges. Up to so many, a node's links are at most a few MB of one task.
SPLIT = 500_000


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and ``label`` (its component's smallest node) of every node in ``links`` (``a``, ``b``).

    Alternating star contraction: every node hands its larger neighbours, then itself and its smaller neighbours,
    to its smallest neighbour, until every edge points at a component's smallest node; as many rounds as the
    logarithm of the longest chain. Minima combine on the map side, and beyond ``SPLIT`` links AQE can split the joins
    that hand them on, so a node with a third of all links is no hot spot. Tables are written between rounds. Links with a null end
    count for nothing. Raises if ``rounds`` don't suffice.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    many, before = edges.count() > SPLIT, None

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stored(df, name) if many else df

    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        large = kept(both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        lower = kept(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "lower")
        small = large.join(lower, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
