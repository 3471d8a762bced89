"""Connected components of a graph given by its edges, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.sources.files import stored


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node (long) that each node of the edges (a, b) is connected with.

    Large and small stars in turn: nodes are tied to the smallest neighbour of a
    neighbour, so the rounds grow with the logarithm of the longest way. Every
    round is written, and the rounds end when one changes nothing.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        whole = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = whole.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = whole.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = stored(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            out = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return out.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
