"""Ranking evaluation over (query, doc, rank) and graded judgements (query, doc, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.vector import quantised


def gain(grade):
    return F.pow(F.lit(2.0), grade) - 1


def discounted(rank):
    return 1 / F.log2(rank + 1)


def metrics(ranking: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """Per query, quantised to a millionth: ndcg, mrr (unbounded depth), hit, recall, forbidden (grade -1, of k)
    and companion (grade 1) rates. Queries without a judgement of grade 1 and more are left out."""
    good = judged.filter("grade > 0")
    ideal = good.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), F.asc("doc"))))
    ideal = ideal.groupBy("query").agg(F.sum(F.when(F.col("r") <= k, quantised(gain(F.col("grade")) * discounted(F.col("r"))))).alias("idcg"), F.count("*").alias("n_good"), F.count_if(F.col("grade") == 1).alias("n_companion"))
    hits = ranking.join(judged, ["query", "doc"]).groupBy("query").agg(
        F.sum(F.when((F.col("rank") <= k) & (F.col("grade") > 0), quantised(gain(F.col("grade")) * discounted(F.col("rank")))).otherwise(F.lit(0))).alias("dcg"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)).alias("found"),
        F.count_if((F.col("rank") <= k) & (F.col("grade") == 1)).alias("companions"),
        F.count_if((F.col("rank") <= k) & (F.col("grade") < 0)).alias("forbidden"),
    )
    rows = ideal.join(hits, "query", "left").fillna(0, ["dcg", "found", "companions", "forbidden"])
    part = lambda a, b: F.floor(1_000_000 * a / F.nullif(b, F.lit(0))).cast("long")
    return rows.select(
        "query",
        part(F.col("dcg"), F.col("idcg")).alias("ndcg"),
        F.coalesce(part(F.lit(1), F.col("first")), F.lit(0)).alias("mrr"),
        (F.col("found") > 0).cast("long").alias("hit"),
        part(F.col("found"), F.col("n_good")).alias("recall"),
        part(F.col("companions"), F.col("n_companion")).alias("companion"),
        part(F.col("forbidden"), F.lit(k)).alias("forbidden"),
    )


def primary_ndcg(ranking: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """Per query with a judgement of grade 3, in millionths: the gain of those alone, each as 1."""
    good = judged.filter("grade = 3").select("query", "doc")
    ideal = good.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("doc"))).groupBy("query").agg(F.sum(F.when(F.col("r") <= k, quantised(discounted(F.col("r"))))).alias("ideal"))
    got = ranking.filter(F.col("rank") <= k).join(good, ["query", "doc"]).groupBy("query").agg(F.sum(quantised(discounted(F.col("rank")))).alias("got"))
    return ideal.join(got, "query", "left").select("query", F.floor(1_000_000 * F.coalesce("got", F.lit(0)) / F.col("ideal")).cast("long").alias("primary_ndcg"))


def by_axes(rows: DataFrame, axes: list[str], measure: str) -> DataFrame:
    """Count and sum of a measure for each value of each axis, in one aggregation. Null is unknown."""
    axis = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias("bucket")) for a in axes)))
    return rows.select(axis.alias("a"), F.col(measure).alias("m")).groupBy("a.axis", "a.bucket").agg(F.count("*").alias("n"), F.sum("m").cast("long").alias("total"))


def nearest_rank(rows: DataFrame, by: str, value: str, bins: int = 4096) -> DataFrame:
    """p50 = sorted[n // 2], p95 = sorted[round half even(.95 (n - 1))], without interpolation. Rows are counted by bins
    of equal width first; only the values of the two bins that hold the ranks are then ranked, so no group is sorted."""
    own = rows.filter(F.col(value).isNotNull()).select(F.col(by).alias("own"), F.col(value).alias("v"))
    ends = own.groupBy("own").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0)) * bins))
    binned = own.join(ends, "own").withColumn("bin", F.coalesce(place, F.lit(0)))
    counts = binned.groupBy("own", "bin").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    w = Window.partitionBy("own").orderBy("bin")  # at most as many rows as bins
    upto = counts.withColumn("upto", F.sum("k").over(w)).withColumn("before", F.col("upto") - F.col("k"))
    ranks = F.array(F.struct(F.lit("p50").alias("name"), (F.floor(F.col("n") / 2) + 1).alias("rank")), F.struct(F.lit("p95").alias("name"), (F.bround(0.95 * (F.col("n") - 1), 0) + 1).cast("long").alias("rank")))
    wanted = upto.select("own", "bin", "before", "upto", "n", F.explode(ranks).alias("r")).filter((F.col("r.rank") > F.col("before")) & (F.col("r.rank") <= F.col("upto"))).select("own", "bin", "n", F.col("r.name").alias("name"), (F.col("r.rank") - F.col("before")).alias("place"))
    inside = binned.select("own", "bin", "v").join(wanted, ["own", "bin"])
    found = inside.withColumn("r", F.row_number().over(Window.partitionBy("own", "name").orderBy("v"))).filter(F.col("r") == F.col("place"))
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("v"))).alias(name)
    return found.groupBy("own").agg(F.max("n").alias("n"), pick("p50"), pick("p95")).withColumnRenamed("own", by)


def threshold_sweep(rows: DataFrame, thresholds: list[int]) -> DataFrame:
    """Refusals under each threshold: right for negatives, spurious for positives. rows: (score, positive)."""
    t = rows.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold long")
    # one row per threshold: bounded by the list, so it is the side that is sent
    grid = rows.groupBy("score", "positive").agg(F.count("*").alias("n")).join(F.broadcast(t), how="cross")
    low = F.col("score") < F.col("threshold")
    return grid.groupBy("threshold").agg(F.sum(F.when(low & ~F.col("positive"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(low & F.col("positive"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~low & ~F.col("positive"), F.col("n")).otherwise(0)).alias("fn"))
