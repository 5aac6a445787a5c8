"""Connected components of an edge table, without any node's neighbours in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the long columns x and y; component is the smallest node that
    can be reached. Alternates large-star and small-star steps (their number grows with the logarithm
    of the longest chain); each step is a map-side combined minimum and a join that can be split.
    Null nodes and loops are ignored; without edges there are no rows."""
    now = X.written(edges.filter("x is not null and y is not null and x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = X.written(large, "edges")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = X.written(small, "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum("u").alias("a"), F.sum("v").alias("b"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("the components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
