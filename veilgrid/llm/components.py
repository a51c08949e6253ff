"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots; a root is the smallest node of its component.

    ``links`` has columns ``a`` and ``b``. Each round hangs every node's larger neighbours, then its smaller
    ones, under the least node it knows, which takes a number of rounds logarithmic in the component's
    size. Only links travel, none to the driver; rounds are cut by reliable checkpoints.
    """
    kept = cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    while True:
        both = kept.union(kept.select("lo", "hi")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        large = both.where("y > x").join(least, "x").where("y <> m").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e")).select("e.hi", F.col("e.m").alias("lo"))
        kept = cut(small.where("hi <> lo").distinct())
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == seen:
            return kept.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = state
