"""Ranks, fusion and re-weighting over long candidate tables (query, doc, score or rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Spark prunes each task to k rows a group before the shuffle (window group limit)."""
    return ranked(df, by, order, name).filter(F.col(name) <= k)


def rrf(candidates: DataFrame, weights: dict[str, float], k: int = RRF_K, keys: tuple[str, ...] = ("query", "doc")) -> DataFrame:
    """Weighted reciprocal rank fusion: sum of weight / (k + rank), weights over 0 only, with the sources.
    Terms are decimals, so that sums don't depend on their order."""
    pairs = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    w = F.coalesce(F.element_at(pairs, F.col("source")), F.lit(1.0))
    term = (w.cast("decimal(20,9)") / (F.lit(k) + F.col("rank")).cast("decimal(20,0)")).cast("decimal(20,12)")
    return candidates.filter(w > 0).groupBy(*keys).agg(F.sum(term).cast("double").alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def priority_weighted(hits: DataFrame, priorities: DataFrame, default: int = 80) -> DataFrame:
    """score * priority / 100; the old rank stays and final_rank is new."""
    out = hits.join(priorities, "doc", "left").withColumn("score", F.col("score") * F.coalesce("priority", F.lit(default)) / 100)
    return ranked(out.drop("priority"), ["query"], [F.desc("score"), F.asc("doc")], "final_rank")


def personalised(hits: DataFrame, state: DataFrame, mastered: float = -0.15, weak: float = 0.10) -> DataFrame:
    """state: (doc, mastered, weak); mastered comes before weak."""
    move = F.when(F.coalesce("mastered", F.lit(False)), mastered).when(F.coalesce("weak", F.lit(False)), weak).otherwise(0.0)
    out = hits.join(state, "doc", "left").withColumn("score", F.col("score") + move)
    return ranked(out.drop("mastered", "weak"), ["query"], [F.desc("score"), F.asc("doc")], "final_rank")


def without_forbidden(hits: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Drop hits at rank 2 and below that the query's first hit forbids. forbidden: (doc, other)."""
    first = F.first("doc").over(Window.partitionBy("query").orderBy("rank"))
    edges = forbidden.select(F.col("doc").alias("first"), F.col("other").alias("doc"), F.lit(True).alias("banned")).distinct()
    tagged = hits.withColumn("first", first).join(edges, ["first", "doc"], "left")
    return tagged.filter((F.col("rank") == 1) | F.col("banned").isNull()).select(*hits.columns)


def unlike_first(hits: DataFrame, same: list[str]) -> DataFrame:
    """Drop hits at rank 2 and below that agree with the query's first hit in all columns `same`."""
    w = Window.partitionBy("query").orderBy("rank")
    alike = [F.col(c).eqNullSafe(F.first(c).over(w)) for c in same]
    like = alike[0]
    for a in alike[1:]:
        like = like & a
    return hits.withColumn("like", like).filter((F.col("rank") == 1) | ~F.col("like")).drop("like")


def refused(hits: DataFrame, threshold: float, sentinel: int = -1) -> DataFrame:
    """Queries whose best score lies under the threshold get one sentinel row instead of their hits."""
    low = F.col("best") < threshold
    rows = hits.withColumn("best", F.max("score").over(Window.partitionBy("query"))).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    rows = rows.filter(~low | (F.col("place") == 1))
    pick = lambda a, b: F.when(low, a).otherwise(F.col(b)).alias(b)
    return rows.select("query", pick(F.lit(sentinel).cast("long"), "doc"), pick(F.col("best"), "score"), pick(F.lit(1).cast("long"), "rank"))


def rank_fused(hits: DataFrame, model: Column, head: int, k: int = RRF_K) -> DataFrame:
    """Re-order the first `head` hits by 1/(k + model rank) + 1/(k + rank); the tail follows unchanged."""
    part = Window.partitionBy("query", "head")
    rows = hits.withColumn("head", F.col("rank") <= head).withColumn("model", model)
    rows = rows.withColumn("model_rank", F.row_number().over(part.orderBy(F.desc("model"), F.asc("rank"))))
    rows = rows.withColumn("fused", 1.0 / (k + F.col("model_rank")) + 1.0 / (k + F.col("rank")))
    final = F.when(F.col("head"), F.row_number().over(part.orderBy(F.desc("fused"), F.asc("rank")))).otherwise(F.col("rank"))
    return rows.select("query", "doc", "rank", final.cast("long").alias("final_rank"))


def boosted(hits: DataFrame, same: int = 3, below: int = 1) -> DataFrame:
    """hits (query, doc, rank, level, difficulty): those of the learner's level move up; for advanced learners none."""
    up = F.when(F.col("level") == "advanced", 0).when(F.col("difficulty") == F.col("level"), same).when((F.col("level") == "intermediate") & (F.col("difficulty") == "beginner"), below).otherwise(0)
    return ranked(hits.withColumn("adjusted", F.col("rank") - up), ["query"], [F.asc("adjusted"), F.asc("rank")], "final_rank")


def bucketed(hits: DataFrame, point: Column, fallback: str) -> DataFrame:
    """(query, bucket, docs): each query's hits by learning point, in their order."""
    rows = hits.withColumn("bucket", F.coalesce(point, F.lit(fallback)))
    docs = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"].cast("string"))
    return rows.groupBy("query", "bucket").agg(F.array_join(docs, ",").alias("docs"))


def positions(rows: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """`rows` with their position in the order of `value` (null first) and `ties`. Values are counted first: what
    passes one task is a count for each distinct value, so this is for values that repeat; a row's place among equals
    comes from a window over its value."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.withColumn("before", before).select(F.col(value).alias("own"), "before")
    place = F.row_number().over(Window.partitionBy(value).orderBy(*ties))
    out = rows.withColumn("place", place).join(base, F.col(value).eqNullSafe(F.col("own")))
    return out.withColumn("position", (F.col("before") + F.col("place")).cast("long")).drop("own", "before", "place")
