"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long); root is the smallest node it reaches.

    Alternates large-star and small-star steps; each round is written to the shared folder, and a round's rows are
    no more than the edges. Aggregates combine before the shuffle, and joins on a hub have one row on the other side.
    """
    e = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, e = e, stage(small.filter("u <> v").distinct(), "edges")
        unstage(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select("v", "v").distinct().toDF("node", "root"))
        last = now
