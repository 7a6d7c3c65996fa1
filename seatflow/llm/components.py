"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.llm.common import stored


def component_roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``u, v`` edges that is not its component's smallest.

    Nodes can be of any ordered type. A round hands each node the smallest of its neighbours
    and hangs the larger ones under it; the number of rounds grows with the logarithm of the
    nodes. Each round is a stored table, minima are pre-aggregated, and what comes to the
    driver is one figure that shows whether a round changed anything.
    """
    edges = _stored(edges.where(F.col("u") != F.col("v")))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _stored(small.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _stored(edges: DataFrame) -> DataFrame:
    return stored(edges.select("u", "v"), "edges")
