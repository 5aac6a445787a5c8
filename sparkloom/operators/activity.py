"""Learner activity: repeats, streaks, decay, mastery, spaced repetition, feedback, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated_within(events: DataFrame, key: list[str], ts: str, days: int, least: int) -> DataFrame:
    """Events that are at least the `least`-th of their key within the days before."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*key).orderBy("__s").rangeBetween(-days * 86400, 0)
    return events.withColumn("__s", seconds).withColumn("n", F.count("*").over(w)).filter(F.col("n") >= least).drop("__s")


def streaks(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Runs of consecutive active days: gaps and islands."""
    days = events.select(key, F.col(ts).cast("date").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    return days.withColumn("island", island).groupBy(key, "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("island")


def decayed(age_days: Column, half_life: float = 14.0) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


def recency(weighted: Column, raw: Column) -> Column:
    share = weighted / F.nullif(raw, F.lit(0))
    return F.when(share > 0.7, "active").when(share >= 0.3, "cooling").otherwise("dormant")


def trailing(events: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return events.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).filter(F.col("pos") <= n)


def sessions(events: DataFrame, key: str, ts: str, minutes: int = 30) -> DataFrame:
    """Sessions of a key that end after a gap."""
    out = events.groupBy(key, F.session_window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.drop("w")


def feedback_pairs(good: DataFrame, bad: DataFrame, key: list[str], least: int) -> DataFrame:
    """Pairs with enough helpful marks and no unhelpful one."""
    return good.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).join(bad.select(*key).distinct(), key, "left_anti")


def due(reviews: DataFrame, key: list[str], ts: str, gaps: tuple[int, ...] = (3, 7, 14)) -> DataFrame:
    """When each review is due again: the n-th review waits gaps[min(n, last)] days."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(ts, "event_id")) - 1
    wait = F.element_at(F.array(*map(F.lit, gaps)), F.least(n, F.lit(len(gaps) - 1)) + 1)
    return reviews.withColumn("review_no", n.cast("long")).withColumn("due", F.date_add(F.col(ts).cast("date"), wait))
