"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being the smallest node reachable.

    Alternating large-star and small-star rounds: each links nodes to the smallest neighbour they know, without ever
    gathering a node's neighbours in one row. Each round is written to the shared folder and read again, and only a
    count and a checksum of its links reach the driver. Links with a null end and links to oneself are ignored; repeated
    links count once. The links of a hub meet in joins that Spark may split.
    """
    links = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo"), F.col("hi")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = written(large.filter("hi <> lo").distinct(), "large-star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        links = written(small.select("e.hi", "e.lo").filter("hi <> lo").distinct(), "small-star")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(links.select(F.col("lo"), F.col("lo")).distinct())
