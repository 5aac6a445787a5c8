"""Reports over runs: axes, macro and micro means, hard regressions, gates, preferences, calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_axes(rows: DataFrame, axes: list[str], measures: list[str]) -> DataFrame:
    """(metric, axis, bucket, n, total) of each measure by each axis, in one aggregation. Null is unknown."""
    axis = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias("bucket")) for a in axes)))
    long = rows.select(*measures, axis.alias("a")).groupBy("a.axis", "a.bucket").agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in measures))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("total")) for m in measures)))
    return long.select("axis", "bucket", "n", pairs.alias("p")).select("p.metric", "axis", "bucket", "n", F.col("p.total").cast("long").alias("total"))


def macro_micro(buckets: DataFrame, unknown: bool = False) -> DataFrame:
    """Per metric and axis the mean of bucket means (without the unknown bucket unless asked) and that over all rows."""
    known = F.lit(True) if unknown else F.col("bucket") != "unknown"
    mean = F.when(known, F.floor(F.col("total") / F.col("n")))
    out = buckets.groupBy("metric", "axis").agg(F.floor(F.avg(mean)).cast("long").alias("macro"), F.count(F.when(known, 1)).alias("buckets"), F.floor(F.sum("total") / F.sum("n")).cast("long").alias("micro"))
    return out.filter("buckets > 0")


def hard_regressions(ranking: DataFrame, judged: DataFrame, budget: int, window: int) -> DataFrame:
    """(query, violations, warned) of each query with a judged hit."""
    grade, rank = F.col("grade"), F.col("rank")
    r = ranking.join(judged, ["query", "doc"]).groupBy("query").agg(
        F.min(F.when(grade == 3, rank)).alias("first_primary"),
        F.count_if((grade == 3) & (rank > budget)).alias("over"),
        F.count_if(grade == 3).alias("n_primary"),
        F.count_if((grade == -1) & (rank <= window)).alias("bad"),
        F.min(F.when(grade == 1, rank)).alias("first_companion"),
    )
    kinds = F.array_compact(F.array(F.when(F.col("n_primary") == 0, "primary_not_present"), F.when(F.col("over") > 0, "primary_over_budget"), F.when(F.col("bad") > 0, "forbidden_in_topk")))
    return r.select("query", kinds.alias("violations"), F.coalesce(F.col("first_companion") < F.col("first_primary"), F.lit(False)).alias("warned"))


def gate(runs: DataFrame, buckets: DataFrame, baseline: str, uplift: int = 30_000, loss: int = 50_000, p95: int = 200, mb: int = 4096, least: int = 5) -> DataFrame:
    """`runs` but the baseline, with the checks that each fails. Buckets of few queries are noise; one that a candidate
    lacks is lost."""
    base = runs.filter(F.col("name") == baseline).select(*(F.col(c).alias(f"base_{c}") for c in ("gain", "failures", "forbidden")))
    others = runs.filter(F.col("name") != baseline)
    wanted = buckets.filter((F.col("name") == baseline) & (F.col("n") >= least)).select("bucket", F.col("gain").alias("was"))
    # names of candidates and of buckets: both lists of a report
    grid = others.select("name").crossJoin(F.broadcast(wanted)).join(buckets.select("name", "bucket", F.col("gain").alias("now")), ["name", "bucket"], "left")
    dropped = grid.groupBy("name").agg(F.count_if(F.col("now").isNull() | (F.col("now") - F.col("was") < -loss)).alias("dropped"))
    out = others.crossJoin(F.broadcast(base)).join(dropped, "name")
    failed = F.array_compact(F.array(F.when(F.col("failures") > F.col("base_failures"), "hard_regression"), F.when(F.col("gain") - F.col("base_gain") < uplift, "primary_uplift"), F.when(F.col("dropped") > 0, "bucket_regression"), F.when(F.col("forbidden") > F.col("base_forbidden"), "forbidden_rate"), F.when(F.col("p95") > p95, "warm_p95"), F.when(F.col("mb") > mb, "memory")))
    return out.withColumn("failed", failed).drop("base_gain", "base_failures", "base_forbidden", "dropped")


def pareto(runs: DataFrame, tolerance: int = 20_000) -> DataFrame:
    """Runs by how many others they are preferred to: within the tolerance the smaller, then the faster one, else the
    one with more gain. The preference isn't transitive, so it is counted, not sorted by."""
    a, b = runs.alias("a"), runs.alias("b")
    less = lambda c: F.col(f"a.{c}") < F.col(f"b.{c}")
    differ = lambda c: F.col(f"a.{c}") != F.col(f"b.{c}")
    near = F.when(differ("mb"), less("mb")).when(differ("p95"), less("p95")).when(differ("gain"), ~less("gain")).otherwise(less("name"))
    wins = F.when(F.abs(F.col("a.gain") - F.col("b.gain")) < tolerance, near).otherwise(F.col("a.gain") > F.col("b.gain"))
    out = a.join(b, F.col("a.name") != F.col("b.name")).groupBy(F.col("a.name").alias("name")).agg(F.count_if(wins).alias("wins"))
    return out.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("wins"), "name")).cast("long"))


def ablation(hits: DataFrame, names: list[str]) -> DataFrame:
    """(subset, n_hit): queries that singles, pairs and all of the named retrievers answer. hits: (name, query)."""
    from itertools import combinations

    subsets = [c for n in sorted({1, 2, len(names)}) for c in combinations(names, n)]
    of = F.explode(F.array_compact(F.array(*(F.when(F.col("name").isin(*s), ",".join(s)) for s in subsets))))
    return hits.select("query", of.alias("subset")).groupBy("subset").agg(F.countDistinct("query").alias("n_hit"))


def interpolated(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Interpolated median and 95th percentile with the extremes. Equal values are counted first, so that a group's
    list is as long as its distinct values."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("own"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
    out = counted.groupBy("own").agg(F.percentile("v", 0.5, F.col("k")).alias("p50"), F.percentile("v", 0.95, F.col("k")).alias("p95"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("k").alias("n"))
    return out.withColumnRenamed("own", by)


def recommended(sweep: DataFrame) -> DataFrame:
    """F1 of a sweep (threshold, tp, fp, fn) in millionths, and the best threshold, the lower of equals."""
    total = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    out = sweep.withColumn("f1", F.when(total == 0, 0).otherwise(F.floor(2_000_000 * F.col("tp") / total)).cast("long"))
    best = out.agg(F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("recommended", F.col("threshold") == F.col("best")).drop("best")


def windowed(rows: DataFrame, by: str, windows: list[int], near: int = 5) -> DataFrame:
    """Of judged hits (query, rank, grade, `by`): per window how many queries have a primary hit, how many a forbidden
    one near the top, and which miss."""
    per = rows.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in windows)))).groupBy("query", by, "k").agg(
        F.max(((F.col("grade") == 3) & (F.col("rank") <= F.col("k"))).cast("long")).alias("hit"), F.max(((F.col("grade") == -1) & (F.col("rank") <= near)).cast("long")).alias("bad")
    )
    missing = F.array_join(F.sort_array(F.collect_list(F.when(F.col("hit") == 0, F.col("query")))), ",")
    return per.groupBy(by, "k").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("bad").alias("forbidden"), F.nullif(missing, F.lit("")).alias("missing"))


def incompatible(rows: DataFrame, wanted: dict) -> DataFrame:
    """`rows` with the names of the fields that differ from a manifest."""
    return rows.withColumn("mismatches", F.concat_ws(",", *(F.when(~F.col(k).eqNullSafe(F.lit(v)), k) for k, v in wanted.items())))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
