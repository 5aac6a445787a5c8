"""Queries that run the stateful streams over the event log, with their SQL; results are kept for a state of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.base import query, read
from sparkloom.sources.stored import stored
from sparkloom.streaming import drills, profiles

NOW = "2024-01-31"
TTL_HOURS, TURNS, LATE_HOURS = 72, 6, 1


def log(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a stream of files. The source takes a plain path for a folder, a pattern for a file as well."""
    schema = read(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""WITH e AS (SELECT DISTINCT event_id, user_id, ts, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS drill FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM e WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) FROM e) - {LATE_HOURS * 3_600_000}),
n AS (SELECT *, lead(event_id) OVER w AS next_id, lead(event_type) OVER w AS next_type, lead(turn) OVER w - turn AS turns, lead(epoch_us(ts)) OVER w - epoch_us(ts) AS us FROM p WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id, drill ORDER BY ts, event_id)),
o AS (SELECT *, coalesce(us < {TTL_HOURS * 3_600_000_000} AND turns <= {TURNS}, false) AS alive FROM n WHERE event_type = 'view' AND (next_id IS NOT NULL OR epoch_us(ts) // 1000 + {TTL_HOURS * 3_600_000} <= (SELECT max(epoch_ms(ts)) FROM e) - {LATE_HOURS * 3_600_000}))
SELECT user_id, drill, event_id AS offered, CASE WHEN alive AND next_type = 'click' THEN next_id END AS closed, CASE WHEN alive AND next_type = 'click' THEN us // 1000 END AS waited_ms,
CASE WHEN alive AND next_type = 'click' THEN 'answered' WHEN alive THEN 'superseded' ELSE 'expired' END AS outcome FROM o""")
def drill_outcomes(spark, sf):
    """Views offer a drill, clicks answer it: a state machine with timers over the log as a stream."""
    kind = F.when(F.col("event_type") == "view", "offer").when(F.col("event_type") == "click", "answer").otherwise("other")

    def build(at: str) -> dict[str, str]:
        rows = log(spark, sf).withColumn("kind", kind).withColumn("drill", F.get_json_object("props", "$.k").cast("long") % 10)
        drills.appended(drills.outcomes(rows, TTL_HOURS, TURNS, f"{LATE_HOURS} hour"), f"{at}/outcomes", f"{at}/checkpoint")
        return {}

    return spark.read.parquet(stored(read(spark, sf, "events"), "drill-outcomes", f"3-{TTL_HOURS}-{TURNS}-{LATE_HOURS}", build) + "/outcomes").drop("batch")


@query(f"""WITH d AS (SELECT user_id, event_type AS kind, cast(ts AS DATE) AS day, count(*) AS n, sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS cents, count_if(value >= {profiles.HIGH}) AS high FROM events GROUP BY 1, 2, 3),
p AS (SELECT user_id, kind, cast(sum(n) AS BIGINT) AS n, count(*) AS n_days, cast(coalesce(sum(cents), 0) AS BIGINT) AS cents,
cast(sum(cast(floor(pow(0.5, date_diff('day', day, DATE '{NOW}') / 14.0) * 1000000 + 0.5) AS BIGINT) * n) AS BIGINT) AS weighted, max(day) AS last_day, sum(high) >= 2 AS mastered FROM d GROUP BY 1, 2)
SELECT *, CASE WHEN weighted > 700000 * n THEN 'active' WHEN weighted >= 300000 * n THEN 'cooling' ELSE 'dormant' END AS status FROM p""")
def profile_by_deltas(spark, sf):
    """Profiles of users and kinds from summaries by day that a stream keeps."""

    def build(at: str) -> dict[str, str]:
        profiles.maintained(log(spark, sf), f"{at}/days", f"{at}/checkpoint", "60 days")
        return {}

    path = stored(read(spark, sf, "events"), "profile-days", "1", build) + "/days"
    return profiles.profile(profiles.days(spark, path), F.lit(NOW).cast("date"))
