"""Learner profiles kept by deltas: a batch costs what its own events touch, whatever the history.

The stream holds one additive summary for each user, kind and day (counts, sums, high scores) in state and adds a batch to it;
Spark combines a batch's rows before the shuffle, so a user of a third of all events is as many rows as kinds and days. What
changed is written with its batch; the last row of a key has the largest count. A profile is made of days, not of events:
decay needs the day alone.

Defined cases: a null value counts as an event without points; rows without user, kind or ts are left out; a batch that is run
again replaces its own rows; days of which the watermark (`late`) has passed the end take no more events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import activity as A

HIGH = 30
HALF_LIFE = 14


def summed(events: DataFrame, late: str = "30 days", high: float = HIGH) -> DataFrame:
    """(user_id, kind, day, n, cents, n_high) over a stream or a table of (ts, user_id, event_type, value)."""
    rows = events.filter("ts is not null and user_id is not null and event_type is not null")
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.col("event_type").alias("kind"), F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")), F.lit(0)).alias("cents"),
        F.count_if(F.col("value") >= high).alias("n_high"),
    )
    return out.select("user_id", "kind", F.col("w.start").cast("date").alias("day"), "n", "cents", "n_high")


def maintained(events: DataFrame, path: str, checkpoint: str, late: str = "30 days") -> list[dict]:
    """Take in what is there now: summaries that changed go to `path`/batch=N. Returns, for each batch, the rows read
    and the summaries changed."""

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    query = summed(events, late).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [{"batch": p["batchId"], "read": p["numInputRows"], "changed": sum(s["numRowsUpdated"] for s in p["stateOperators"])} for p in query.recentProgress]


def days(spark: SparkSession, path: str) -> DataFrame:
    """The last summary of each user, kind and day."""
    last = F.max(F.struct("n", "cents", "n_high")).alias("s")
    return spark.read.parquet(path).groupBy("user_id", "kind", "day").agg(last).select("user_id", "kind", "day", "s.*")


def profile(summaries: DataFrame, now: Column) -> DataFrame:
    """(user_id, kind, n, n_days, cents, weighted, status, last_day, mastered) from summaries by day: weights halve in
    fourteen days, in millionths; mastered by two high scores."""
    one = F.floor(A.decayed(F.datediff(now, "day"), HALF_LIFE) * 1_000_000 + 0.5).cast("long")
    out = summaries.groupBy("user_id", "kind").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_days"), F.sum("cents").alias("cents"), F.sum(one * F.col("n")).alias("weighted"), F.max("day").alias("last_day"), (F.sum("n_high") >= 2).alias("mastered")
    )
    return out.withColumn("status", A.recency(F.col("weighted"), F.col("n") * 1_000_000))
