"""Streaming extensions over an event log: file source, watermarks, windows, duplicates, stateful pairing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, schema: str = SCHEMA, files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once; state older than the watermark goes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def repeats(events: DataFrame, late: str = "1 hour", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Events of a kind by user in sliding windows."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "event_type", "n")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


PAIRS = "user_id long, opened long, closed long, waited double"


def paired(events: DataFrame, opens: str, closes: str, ttl_hours: float = 24.0, late: str = "1 hour") -> DataFrame:
    """Each opening event of a user with the first closing one after it, unless that comes later than the time
    to live. State is one pending event a user; it ends with its timeout."""
    import pandas as pd

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending = state.get if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for e, t, kind in zip(rows["event_id"], rows["ts"], rows["event_type"], strict=True):
            ms = int(t.timestamp() * 1000)
            if kind == opens and pending is None:
                pending = (int(e), ms)
            elif kind == closes and pending is not None:
                if ms - pending[1] <= ttl_hours * 3_600_000:
                    out.append((key[0], pending[0], int(e), (ms - pending[1]) / 1000))
                pending = None
        if pending is None:
            if state.exists:
                state.remove()
        else:
            state.update(pending)
            state.setTimeoutTimestamp(max(pending[1] + int(ttl_hours * 3_600_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "opened", "closed", "waited"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, PAIRS, "event long, at long", "append", "EventTimeTimeout")


def rebuilt(events: DataFrame, path: str, checkpoint: str, profile) -> None:
    """Rebuild the profiles of the users that a batch has news of: `profile` makes them from all their events, which are
    kept in `path`/events; profiles of a batch go to `path`/profiles/batch=N, and the latest one of a user counts."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/events/batch={n}")
        every = spark.read.parquet(f"{path}/events")
        users = batch.select("user_id").distinct()
        profile(every.join(users, "user_id", "left_semi")).write.mode("overwrite").parquet(f"{path}/profiles/batch={n}")

    events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run what is there now into a memory table; for tests and small reports."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
