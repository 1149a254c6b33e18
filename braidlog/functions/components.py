"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.functions.runtime import written

#: Edges above which a round writes its minima.
MANY_EDGES = 1_000_000


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` of every node of an undirected edge list; component is the smallest node.

    Each round rewires every node to the smallest node of its neighbourhood, so a
    star of any width takes two rounds. Only grouped minima and equi-joins are used:
    the minima combine before the shuffle and the joins can be split when a hub is hot.
    Null ends are ignored, an edge from a node to itself yields that node alone,
    repeated edges count once and no edges give an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    pairs = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v"))
    links = pairs.where(F.col("u") != F.col("v"))
    seen = None
    # Large edge lists: the minima are written, so that the joins are between plain tables and hubs can be split.
    hold = (lambda low: written(low, "cc")) if pairs.count() > MANY_EDGES else (lambda low: low)
    while True:
        both = links.union(links.select("v", "u"))
        low = hold(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = hold(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        links = written(small.where(F.col("u") != F.col("v")).distinct(), "cc")
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == seen:
            break
        seen = state
    roots = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.distinct().join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
