"""Queries over event logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import activity as A
from sparkloom.operators import evaluation as E
from sparkloom.plans.base import query, read
from sparkloom.sources import pages
from sparkloom.sources.stored import stored

NOW = "2024-01-31"


@query("""SELECT event_id, user_id, event_type, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS n FROM events) t WHERE n >= 3""")
def repeat_7d(spark, sf):
    return A.repeated_within(read(spark, sf, "events"), ["user_id", "event_type"], "ts", 7, 3).select("event_id", "user_id", "event_type", "n")


@query("""WITH d AS (SELECT DISTINCT user_id, cast(ts AS DATE) AS day FROM events), i AS (SELECT *, day - cast(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d)
SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM i GROUP BY user_id, island""")
def streak_days(spark, sf):
    return A.streaks(read(spark, sf, "events"), "user_id", "ts")


@query(f"""WITH w AS (SELECT user_id, cast(sum(cast(floor(pow(0.5, date_diff('day', cast(ts AS DATE), DATE '{NOW}') / 14.0) * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS weighted, count(*) AS raw FROM events GROUP BY 1)
SELECT user_id, weighted, raw, CASE WHEN weighted > 700000 * raw THEN 'active' WHEN weighted >= 300000 * raw THEN 'cooling' ELSE 'dormant' END AS status FROM w""")
def decayed_weight(spark, sf):
    age = F.datediff(F.lit(NOW).cast("date"), F.col("ts").cast("date"))
    w = F.floor(A.decayed(age) * 1_000_000 + 0.5).cast("long")
    out = read(spark, sf, "events").groupBy("user_id").agg(F.sum(w).alias("weighted"), F.count("*").alias("raw"))
    return out.withColumn("status", A.recency(F.col("weighted"), F.col("raw") * 1_000_000))


@query("""SELECT user_id, event_id, event_type, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events) t WHERE pos <= 2""")
def recent_context(spark, sf):
    return A.trailing(read(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 2).select("user_id", "event_id", "event_type", "pos")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf):
    """An extension: sessions that end after half an hour."""
    return A.sessions(read(spark, sf, "events"), "user_id", "ts")


PAIR = "user_id, cast(json_extract(props, '$.k') AS BIGINT) % 10 AS item"


@query(f"""WITH e AS (SELECT {PAIR}, event_type FROM events) SELECT user_id, item, count(*) AS n FROM e WHERE event_type IN ('click', 'purchase')
AND NOT EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'error' AND b.user_id = e.user_id AND b.item = e.item) GROUP BY 1, 2 HAVING count(*) >= 2""")
def golden_promotion(spark, sf):
    rows = read(spark, sf, "events").select("user_id", (F.get_json_object("props", "$.k").cast("long") % 10).alias("item"), "event_type")
    return A.feedback_pairs(rows.filter("event_type in ('click', 'purchase')"), rows.filter("event_type = 'error'"), ["user_id", "item"], 2)


@query("""SELECT event_id, user_id, review_no, due FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS review_no,
cast(ts AS DATE) + cast(CASE least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, 2) WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 14 END AS INTEGER) AS due FROM events WHERE event_type = 'purchase') t""")
def spaced_due(spark, sf):
    return A.due(read(spark, sf, "events").filter("event_type = 'purchase'"), ["user_id"], "ts").select("event_id", "user_id", "review_no", "due")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase')
SELECT user_id, count(*) AS n, cast(sum(cast(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents, count_if(value >= 30) AS n_high, count_if(value >= 30) >= 2 AS mastered FROM l WHERE r <= 5 GROUP BY 1""")
def drill_window_summary(spark, sf):
    """The last five scores of each learner."""
    last = A.trailing(read(spark, sf, "events").filter("event_type = 'purchase'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    high = F.count_if(F.col("value") >= 30)
    return last.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cents"), high.alias("n_high"), (high >= 2).alias("mastered"))


@query("SELECT CASE WHEN event_type = 'error' AND value > 20 THEN 'error_high' WHEN event_type IN ('click', 'view', 'purchase', 'error') THEN event_type ELSE 'unknown' END AS tier, count(*) AS n FROM events GROUP BY 1")
def tier_distribution(spark, sf):
    tier = F.when((F.col("event_type") == "error") & (F.col("value") > 20), "error_high").when(F.col("event_type").isin("click", "view", "purchase", "error"), F.col("event_type")).otherwise("unknown")
    return read(spark, sf, "events").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def signal_histogram(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS absent FROM events WHERE json_valid(props)")
def tolerant_json(spark, sf):
    parsed = F.from_json("props", "k long, none string")
    return read(spark, sf, "events").withColumn("p", parsed).filter("p is not null").select("event_id", "p.k", F.col("p.none").alias("absent"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(CASE WHEN r = n // 2 + 1 THEN value END) AS p50, max(CASE WHEN r = round_even(0.95 * (n - 1), 0) + 1 THEN value END) AS p95 FROM r GROUP BY 1""")
def latency_nearest_rank_percentiles(spark, sf):
    return E.nearest_rank(read(spark, sf, "events"), "event_type", "value")


@query("""SELECT user_id, count_if(event_type = 'click') AS click, count_if(event_type = 'view') AS view, count_if(event_type = 'purchase') AS purchase, count_if(event_type = 'error') AS error, count(*) AS n FROM events GROUP BY 1""")
def learner_counts(spark, sf):
    one = lambda t: F.count_if(F.col("event_type") == t).alias(t)
    return read(spark, sf, "events").groupBy("user_id").agg(*map(one, ("click", "view", "purchase", "error")), F.count("*").alias("n"))


@query("""WITH u AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT DISTINCT event_type FROM events), p AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, event_type FROM p, t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = p.user_id AND u.event_type = t.event_type AND n >= 12)""")
def suggest_next(spark, sf):
    """Kinds that a learner has done less than twelve times."""
    events = read(spark, sf, "events")
    kinds = events.select("event_type").distinct()
    done = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).filter("n >= 12").select("user_id", "event_type")
    every = events.select("user_id").distinct().crossJoin(kinds)  # a catalog of kinds, not of rows
    return every.join(done, ["user_id", "event_type"], "left_anti")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, cast(sum(event_id) AS BIGINT) AS ids, min(event_id) AS first_id FROM events GROUP BY 1")
def dumped_events(spark, sf):
    """Events as the pages of an API's dump, 500 ids a page, read back by ranges of pages."""
    events = read(spark, sf, "events")
    path = stored(events, "event-pages", "1", lambda at: pages.dumped(events.select("event_id", "user_id", "event_type"), f"{at}/pages", F.floor(F.col("event_id") / 500)) or {})
    pages.register(spark)
    rows = spark.read.format("pages").schema("event_id long, user_id long, event_type string").load(f"{path}/pages")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.sum("event_id").alias("ids"), F.min("event_id").alias("first_id"))
