"""Runs of sets of retrievers over the same queries, and the choice among runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vector import quantised
from sparkloom.operators import evaluation as E
from sparkloom.operators.ranking import RRF_K, ranked, top_k

FUSED = 1_000_000_000_000


def modality_sets(names: DataFrame) -> DataFrame:
    """(run, n, modalities) of the singles, the pairs and all of the different names of (name). Names are few: a list of
    retrievers."""
    every = names.agg(F.sort_array(F.collect_set("name")).alias("names")).filter(F.size("names") > 0)
    masks = every.select("names", F.explode(F.expr("sequence(1L, shiftleft(1L, size(names)) - 1)")).alias("mask"))
    some = masks.filter((F.bit_count("mask") <= 2) | (F.bit_count("mask") == F.size("names")))
    modalities = F.filter("names", lambda x, i: F.getbit(F.col("mask"), i) == 1)
    return some.select(F.array_join(modalities, ",").alias("run"), F.size(modalities).alias("n"), modalities.alias("modalities"))


def fused_runs(hits: DataFrame, sets: DataFrame, k: int = 20) -> DataFrame:
    """(query, run, doc, score, candidates, rank): the hits (query, name, doc, rank) of each set's retrievers, fused by their
    reciprocal ranks; candidates: how many documents they brought."""
    parts = hits.join(sets.select("run", F.explode("modalities").alias("name")), "name")
    score = F.sum(F.floor(F.lit(FUSED) / (RRF_K + F.col("rank"))).cast("long")).alias("score")
    every = parts.groupBy("query", "run", "doc").agg(score)
    counts = every.groupBy("query", "run").agg(F.count("*").alias("candidates"))
    return top_k(every, ["query", "run"], [F.desc("score"), F.asc("doc")], k).join(counts, ["query", "run"])


def primary_by_run(ranking: DataFrame, judged: DataFrame, names: list[str], k: int = 10, near: int = 5) -> DataFrame:
    """(query, run, primary_ndcg, failed, forbidden) of every query with a primary document in `judged` (query, doc, grade)
    and every run, whether it found something or not."""
    good = judged.filter("grade = 3").select("query", "doc")
    ideal = ranked(good, ["query"], [F.asc("doc")], "r").groupBy("query").agg(F.sum(F.when(F.col("r") <= k, quantised(E.discounted(F.col("r"))))).alias("ideal"))
    hits = ranking.join(judged.filter("grade = 3 OR grade = -1"), ["query", "doc"]).groupBy("query", "run").agg(
        F.sum(F.when((F.col("grade") == 3) & (F.col("rank") <= k), quantised(E.discounted(F.col("rank"))))).alias("got"),
        F.min(F.when(F.col("grade") == 3, F.col("rank"))).alias("first"),
        F.count_if((F.col("grade") == -1) & (F.col("rank") <= near)).alias("forbidden"),
    )
    rows = ideal.withColumn("run", F.explode(F.array(*map(F.lit, names)))).join(hits, ["query", "run"], "left")
    gain = F.floor(1_000_000 * F.coalesce("got", F.lit(0)) / F.col("ideal")).cast("long")
    return rows.select("query", "run", gain.alias("primary_ndcg"), F.coalesce(F.col("first") > near, F.lit(True)).alias("failed"), F.coalesce("forbidden", F.lit(0)).alias("forbidden"))


def run_buckets(rows: DataFrame, axes: list[str]) -> DataFrame:
    """(run, axis, bucket, n, gain): mean primary gain of each bucket of each axis."""
    axis = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("bucket")) for a in axes)))
    own = rows.select("run", "primary_ndcg", axis.alias("a")).groupBy("run", "a.axis", "a.bucket").agg(F.count("*").alias("n"), F.sum("primary_ndcg").alias("total"))
    return own.select("run", "axis", "bucket", "n", F.floor(F.col("total") / F.col("n")).cast("long").alias("gain"))


def run_scores(rows: DataFrame, buckets: DataFrame, ranking: DataFrame, sets: DataFrame, sizes: DataFrame, axis: str, near: int = 5) -> DataFrame:
    """(name, n, gain, failures, forbidden, p95, mb) of each run: the mean of its buckets' gains on one axis, its failed
    queries, the share of forbidden documents near the top in millionths, the 95th percentile of candidates a query, and the
    size (name, size) of its retrievers."""
    gain = buckets.filter(F.col("axis") == axis).groupBy("run").agg(F.floor(F.avg("gain")).cast("long").alias("gain"))
    side = rows.groupBy("run").agg(F.count_if("failed").alias("failures"), F.floor(1_000_000 * F.sum("forbidden") / (near * F.count("*"))).cast("long").alias("forbidden"))
    late = E.nearest_rank(ranking.filter("rank = 1"), "run", "candidates").select("run", F.col("p95").cast("long").alias("p95"))
    size = sets.select("run", "n", F.explode("modalities").alias("name")).join(sizes, "name").groupBy("run", "n").agg(F.sum("size").cast("long").alias("mb"))
    return gain.join(side, "run").join(late, "run").join(size, "run").select(F.col("run").alias("name"), "n", "gain", "failures", "forbidden", "p95", "mb")


def best_run(runs: DataFrame) -> DataFrame:
    """The run of the most gain, then of fewest failures, lowest latency, fewest retrievers, first name: one row."""
    best = F.min_by(F.struct(*runs.columns), F.struct(-F.col("gain"), "failures", "p95", "n", "name"))
    return runs.agg(best.alias("r")).filter("r IS NOT NULL").select("r.*")


def preferred_run(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The run whose name is wanted (name), else that of the most gain, the first of equals: one row."""
    asked = runs.join(wanted.select("name", F.lit(0).alias("asked")).distinct(), "name", "left")
    best = F.min_by(F.struct(*runs.columns), F.struct(F.coalesce("asked", F.lit(1)), -F.col("gain"), "name"))
    return asked.agg(best.alias("r")).filter("r IS NOT NULL").select("r.*")


def cutover(buckets: DataFrame, runs: DataFrame, old: str, new: str, tolerance: int = -10_000) -> DataFrame:
    """(axis, bucket, old, new, delta, regressed, passed) of the buckets of two runs; the gate passes if the new run doesn't
    lose in all, or loses more than the tolerance in no bucket that both have."""
    one = lambda name, c: buckets.filter(F.col("run") == name).select("axis", "bucket", F.col("gain").alias(c))
    rows = one(old, "old").join(one(new, "new"), ["axis", "bucket"], "full_outer").withColumn("delta", F.col("new") - F.col("old"))
    rows = rows.withColumn("regressed", F.coalesce(F.col("delta") < tolerance, F.lit(False)))
    gain = lambda name: F.max(F.when(F.col("name") == name, F.col("gain")))
    gate = runs.agg((gain(new) - gain(old)).alias("all")).crossJoin(rows.agg(F.count_if("regressed").alias("n")))  # two rows
    return rows.crossJoin(F.broadcast(gate)).withColumn("passed", (F.col("all") >= 0) | (F.col("n") == 0)).drop("all", "n")


class Undominated:
    """Rows (gain, mb, p95, name) of which no other has at least the gain and at most the size, latency and, all being
    equal, name. Whatever dominates a row is preferred to it."""

    def __init__(self):
        self.kept = np.zeros((0, 4))
        self.rows: list = []

    def add(self, values: np.ndarray, rows: list) -> None:
        """More rows: values are (-gain, mb, p95, name's place)."""
        values, rows = np.concatenate((self.kept, values)), [*self.rows, *rows]
        order = np.lexsort(values.T[::-1])
        kept: list[int] = []
        held = np.empty_like(values)
        for i in order:
            v = values[i]
            # rows come by falling gain, so an earlier one dominates if it is no larger and no slower
            if not (held[: len(kept), 1:3] <= v[1:3]).all(axis=1).any():
                held[len(kept)] = v
                kept.append(i)
        self.kept, self.rows = values[kept], [rows[i] for i in kept]


def undominated(runs: DataFrame, rounds: int = 3, fan: int = 16) -> DataFrame:
    """The rows of (name, gain, mb, p95) that no other dominates: each task keeps its own, and these are merged in rounds of
    `fan` tasks. Null counts are no candidates."""
    runs = runs.select("name", *(F.col(c).cast("long").alias(c) for c in ("gain", "mb", "p95"))).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, schema = Undominated(), None
        for batch in batches:
            schema = batch.schema
            rows = batch.to_pylist()
            rows.sort(key=lambda r: r["name"])
            best.rows.sort(key=lambda r: r["name"])
            every = sorted([*best.rows, *rows], key=lambda r: r["name"])
            best = Undominated()
            best.add(np.array([(-r["gain"], r["mb"], r["p95"], i) for i, r in enumerate(every)], np.float64).reshape(-1, 4), every)
        if schema is not None:
            yield pa.RecordBatch.from_pylist(best.rows, schema=schema)

    n = max(1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = runs.mapInArrow(run, runs.schema)
    sizes = [max(1, n // fan**i) for i in range(1, rounds)] + [1]
    for size in sizes:
        out = out.repartition(size, F.xxhash64("name")).mapInArrow(run, runs.schema)
    return out


def preferences(runs: DataFrame, tolerance: int = 20_000) -> DataFrame:
    """(name, gain, mb, p95, wins, position) of the undominated rows: by how many of the others each is preferred to. Within
    the tolerance the smaller, then the faster, then the better one wins, else the one with more gain. Rows meet only
    rows of their own and the neighbouring band of gains; those of lower bands are counted by sums."""
    left = undominated(runs)
    band = F.floor(F.col("gain") / tolerance).cast("long")
    rows = left.withColumn("band", band)
    counts = rows.groupBy("band").agg(F.count("*").alias("n"))
    near = rows.select(*(F.col(c).alias(f"b_{c}") for c in ("name", "gain", "mb", "p95")), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    less = lambda c: F.col(c) < F.col(f"b_{c}")
    close = F.when(F.col("mb") != F.col("b_mb"), less("mb")).when(F.col("p95") != F.col("b_p95"), less("p95")).when(F.col("gain") != F.col("b_gain"), ~less("gain")).otherwise(less("name"))
    wins = F.when(F.abs(F.col("gain") - F.col("b_gain")) < tolerance, close).otherwise(F.col("gain") > F.col("b_gain"))
    met = rows.join(near, "band").filter(F.col("name") != F.col("b_name")).groupBy("name").agg(F.count_if(wins).alias("met"))
    lower = counts.select((F.col("band") + 2).alias("from"), "n")  # bands far below are beaten as a whole
    below = counts.select("band").join(lower, F.col("band") >= F.col("from")).groupBy("band").agg(F.sum("n").alias("below"))
    out = rows.join(met, "name", "left").join(below, "band", "left").withColumn("wins", F.coalesce("met", F.lit(0)) + F.coalesce("below", F.lit(0)))
    return ranked(out.withColumn("one", F.lit(1)), ["one"], [F.desc("wins"), F.asc("name")], "position").select("name", "gain", "mb", "p95", "wins", "position")


def failure_classes(new: DataFrame, old: DataFrame, judged: DataFrame, categories: DataFrame, k: int = 20) -> DataFrame:
    """(query, category, found, old_rank, new_rank, better, class): what went wrong with each query of (query, doc, rank) of a
    new and an old retriever. judged: (query, doc) of primary documents; categories: (doc, category). A query's category is
    that of its first primary document; a rank after the last stands for none."""
    own = judged.groupBy("query").agg(F.min("doc").alias("doc")).join(categories, "doc", "left").select("query", "category")
    first = lambda h, name: h.filter(F.col("rank") <= k).join(judged, ["query", "doc"]).groupBy("query").agg(F.min("rank").alias(name))
    top = new.filter("rank = 1").join(categories, "doc", "left").select("query", F.col("category").alias("found"))
    rows = own.join(first(old, "old_rank"), "query", "left").join(first(new, "new_rank"), "query", "left").join(top, "query", "left")
    kind = F.when(F.col("new_rank") == 1, "pass_rank1").when(F.col("found").isNotNull() & (F.col("found") != F.col("category")), "top1_cross_category").when(F.col("new_rank").isNull(), "primary_missing_top_k").otherwise("same_category_wrong_rank")
    late = lambda c: F.coalesce(c, F.lit(k + 1))
    better = F.when(late("new_rank") < late("old_rank"), "new").when(late("new_rank") > late("old_rank"), "old").otherwise("tie")
    return rows.select("query", "category", "found", "old_rank", "new_rank", better.alias("better"), kind.alias("class"))
