"""Learner profiles, triggers and scalar rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import profile as R
from sparkloom.plans.base import query, read

NOW = "2024-01-31 00:00:00"
#: The last five scored events of a learner, with four dimensions (their ceilings 4, 3, 2, 1) and a category.
DRILLS = """d AS (SELECT user_id, event_id, ts, cast(floor(value) AS BIGINT) % 11 AS total, cast(floor(value) AS BIGINT) % 5 AS accuracy, cast(floor(value * 3) AS BIGINT) % 4 AS depth, cast(floor(value * 7) AS BIGINT) % 3 AS practicality, cast(floor(value * 11) AS BIGINT) % 2 AS completeness, 'cat' || cast(event_id % 4 AS VARCHAR) AS category, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WHERE event_type = 'purchase' AND value IS NOT NULL),
w AS (SELECT * FROM d WHERE back <= 5)"""


def drills(spark, sf):
    v = F.col("value")
    rows = read(spark, sf, "events").filter("event_type = 'purchase' and value is not null")
    whole = lambda x, m: (F.floor(x).cast("long") % m)
    return rows.select("user_id", "event_id", "ts", whole(v, 11).alias("total"), whole(v, 5).alias("accuracy"), whole(v * 3, 4).alias("depth"), whole(v * 7, 3).alias("practicality"), whole(v * 11, 2).alias("completeness"), F.concat(F.lit("cat"), (F.col("event_id") % 4).cast("string")).alias("category"))


VIEW = f"""{DRILLS}, v AS (SELECT user_id, cast(sum(total) AS BIGINT) AS points, count(*) AS n, concat_ws(',', CASE WHEN 10 * sum(accuracy) < 24 * count(*) THEN 'accuracy' END, CASE WHEN 10 * sum(depth) < 18 * count(*) THEN 'depth' END, CASE WHEN 10 * sum(practicality) < 12 * count(*) THEN 'practicality' END, CASE WHEN 10 * sum(completeness) < 6 * count(*) THEN 'completeness' END) AS weak FROM w GROUP BY 1),
c AS (SELECT user_id, category, max(back) AS first FROM w WHERE total < 6 GROUP BY 1, 2), l AS (SELECT user_id, string_agg(category, ',' ORDER BY first DESC) AS low FROM c GROUP BY 1)"""


@query(f"WITH {VIEW} SELECT v.user_id, points, n, CASE WHEN points >= 9 * n THEN 'L5' WHEN points >= 7 * n THEN 'L4' WHEN points >= 5 * n THEN 'L3' WHEN points >= 3 * n THEN 'L2' ELSE 'L1' END AS level, weak, coalesce(low, '') AS low FROM v LEFT JOIN l ON v.user_id = l.user_id")
def drill_view(spark, sf):
    """The last five drills of a learner: mean level, dimensions under 60 % of their ceiling, categories with a low total
    in the order they were first seen."""
    return R.drill_view(drills(spark, sf))


POINTS = """pt AS (SELECT user_id, event_type AS point, count(*) AS n, max(ts) AS latest FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2), pp AS (SELECT user_id, point, n, latest, n >= 3 AS repeated, n = max(n) OVER (PARTITION BY user_id) AS dominant FROM pt)"""
UNIFIED = f"""{VIEW}, {POINTS}, co AS (SELECT user_id, list_sort(list(point) FILTER (repeated)) AS rep, list_sort(list(point) FILTER (dominant)) AS dom FROM pp GROUP BY 1),
un AS (SELECT co.user_id, coalesce(rep, []) AS rep, coalesce(dom, []) AS dom, CASE WHEN coalesce(weak, '') = '' THEN [] ELSE string_split(weak, ',') END AS tags, CASE WHEN coalesce(low, '') = '' THEN [] ELSE string_split(low, ',') END AS lows FROM co LEFT JOIN v ON co.user_id = v.user_id LEFT JOIN l ON co.user_id = l.user_id)"""


def points(spark, sf):
    """What a learner does often, and most."""
    n = read(spark, sf, "events").filter("event_type <> 'purchase'").groupBy("user_id", F.col("event_type").alias("point")).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return n.withColumn("repeated", F.col("n") >= 3).withColumn("dominant", F.col("n") == F.max("n").over(Window.partitionBy("user_id")))


@query(f"WITH {UNIFIED} SELECT user_id, array_to_string(list_sort(list_filter(rep, lambda x: list_contains(dom, x))), ',') AS focus, array_to_string(list_sort(list_filter(rep, lambda x: NOT list_contains(lows, x)))[1:5], ',') AS empirical, array_to_string(list_sort(list_filter(tags, lambda x: NOT list_contains(rep, x) AND NOT list_contains(dom, x)))[1:5], ',') AS theoretical FROM un")
def unified_profile(spark, sf):
    """What a learner repeats and does most, what is only seen in practice, and what is only weak in drills."""
    return R.unified(points(spark, sf), R.drill_view(drills(spark, sf)))


@query(f"WITH {UNIFIED}, f AS (SELECT user_id, coalesce(list_sort(list_filter(rep, lambda x: list_contains(dom, x)))[1], list_sort(rep)[1], list_sort(tags)[1], list_sort(dom)[1]) AS pick FROM un) SELECT user_id, pick FROM f")
def next_focus(spark, sf):
    """The first of the lists that isn't empty gives the focus."""
    u = R.unified(points(spark, sf), R.drill_view(drills(spark, sf)))
    first = lambda c: F.nullif(F.split_part(F.col(c), F.lit(","), F.lit(1)), F.lit(""))
    own = points(spark, sf).filter("dominant").groupBy("user_id").agg(F.min("point").alias("dom"))
    return u.join(own, "user_id", "left").select("user_id", F.coalesce(first("focus"), first("empirical"), first("theoretical"), F.col("dom")).alias("pick"))


RECENT = f"CASE WHEN latest >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY THEN 0 WHEN latest >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY THEN 1 WHEN latest >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY THEN 2 ELSE 3 END"


@query(f"WITH {POINTS}, k AS (SELECT user_id, point, {RECENT} AS band, row_number() OVER (PARTITION BY user_id ORDER BY {RECENT}, point) AS r FROM pp) SELECT user_id, point, band FROM k WHERE r = 1")
def recency_pick(spark, sf):
    """An active point before a cooling one before a dormant one."""
    day = lambda n: F.lit(NOW).cast("timestamp_ntz") - F.expr(f"INTERVAL {n} DAYS")
    band = F.when(F.col("latest") >= day(3), 0).when(F.col("latest") >= day(10), 1).when(F.col("latest") >= day(20), 2).otherwise(3)
    return points(spark, sf).withColumn("band", band).groupBy("user_id").agg(F.min(F.struct("band", "point")).alias("b")).select("user_id", "b.point", "b.band")


DUE = f"""{DRILLS}, u AS (SELECT user_id, event_id, ts + to_days(CASE total % 3 WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 14 END) AS due FROM d), e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY due, event_id) AS r FROM u WHERE due <= TIMESTAMP '{NOW}')"""


@query(f"WITH {DUE} SELECT user_id, event_id, due FROM e WHERE r = 1")
def earliest_due(spark, sf):
    """The drill of a learner that has been due longest."""
    return R.earliest_due(drills(spark, sf), F.lit(NOW).cast("timestamp_ntz"))


@query(f"""WITH {DUE}, x AS (SELECT user_id, max(event_id) AS last, count(*) AS n, count_if(event_type = 'error') AS errors FROM events GROUP BY 1),
t AS (SELECT x.user_id, CASE WHEN last % 3 = 0 THEN NULL WHEN errors >= 2 AND n % 2 = 0 THEN 'self_assessment' WHEN e.event_id IS NOT NULL THEN 'review_drill' WHEN n >= 4 THEN 'follow_up' END AS kind FROM x LEFT JOIN e ON x.user_id = e.user_id AND r = 1)
SELECT user_id, coalesce(kind, 'none') AS kind FROM t""")
def cognitive_trigger(spark, sf):
    """At most one trigger: a due self-assessment, a due review, a follow-up; none while a drill is pending."""
    due = R.earliest_due(drills(spark, sf), F.lit(NOW).cast("timestamp_ntz")).select("user_id", F.lit(True).alias("due"))
    x = read(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("last"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).join(due, "user_id", "left")
    kind = R.trigger(pending=F.col("last") % 3 == 0, assessment=(F.col("errors") >= 2) & (F.col("n") % 2 == 0), review=F.coalesce("due", F.lit(False)), follow_up=F.col("n") >= 4)
    return x.select("user_id", kind.alias("kind"))


@query("""WITH x AS (SELECT user_id, count(*) AS n, count_if(event_type = 'purchase') AS drills, cast(floor(avg(CASE WHEN event_type = 'purchase' THEN value END)) AS BIGINT) AS mean FROM events GROUP BY 1), b AS (SELECT *, CASE WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END AS base FROM x)
SELECT user_id, CASE least(2, greatest(0, base + CASE WHEN mean >= 30 THEN 1 WHEN mean < 15 THEN -1 ELSE 0 END)) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM b""")
def confidence_levels(spark, sf):
    """From how much is known of a learner, moved by how drills went."""
    x = read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.floor(F.avg(F.when(F.col("event_type") == "purchase", F.col("value")))).alias("mean"))
    return x.select("user_id", R.confidence(F.col("n"), F.col("mean"), high=30, low=15).alias("confidence"))


@query(f"""WITH e AS (SELECT event_id, user_id, ts AS issued, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 DAY END AS expires, event_id % 4 AS ttl FROM events)
SELECT event_id, coalesce(expires, issued + INTERVAL 24 HOUR) > TIMESTAMP '{NOW}' - INTERVAL 10 DAY AS live, CASE WHEN ttl - 1 >= 0 THEN ttl - 1 END AS ttl FROM e""")
def trigger_expiry(spark, sf):
    """A trigger lives until it expires, else a day; a pending drill loses a turn, and goes when none is left."""
    expires = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 2 DAYS"))
    now = F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 10 DAYS")
    return read(spark, sf, "events").select("event_id", R.live(expires, F.col("ts"), now).alias("live"), R.turns_left(F.col("event_id") % 4).alias("ttl"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS score, CASE WHEN event_id % 3 = 1 THEN value END AS distance, event_id % 20 + 1 AS rank, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value / 100 END AS a, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value / 7 END AS b FROM events WHERE value IS NOT NULL)
SELECT event_id, cast(floor(coalesce(score, 1 / (1 + distance), 1.0::DOUBLE / rank) * 1000 + 0.5) AS BIGINT) AS row_score, cast(floor(least(1, greatest(0, coalesce(nullif(a, 0), nullif(b, 0), 0) - 0.2)) * 1000 + 0.5) AS BIGINT) AS clamped FROM e""")
def score_fallbacks(spark, sf):
    """A score, else one from the distance, else one from the rank; of alternatives the first that isn't zero, clamped."""
    e, v = F.col("event_id"), F.col("value")
    part = lambda c, n: F.floor(c * 1000 + 0.5).cast("long").alias(n)
    score = R.row_score(F.when(e % 3 == 0, v), F.when(e % 3 == 1, v), e % 20 + 1)
    other = R.first_truthy(F.when(e % 4 == 0, 0.0).otherwise(v / 100), F.when(e % 5 == 0, 0.0).otherwise(v / 7))
    return read(spark, sf, "events").filter("value is not null").select("event_id", part(score, "row_score"), part(R.clamped(other - 0.2), "clamped"))


@query("""SELECT n_nationkey, array_to_string([n_name, cast(n_regionkey AS VARCHAR), 'x', 'y'][1:3], ',') AS first_three, CASE WHEN n_nationkey % 2 = 0 THEN 250 ELSE 100 END AS lexical, 80 AS sparse, n_name || '#' || CASE WHEN n_nationkey % 3 = 0 THEN 'doc' ELSE cast(n_regionkey AS VARCHAR) END AS candidate,
octet_length(encode('{"name":"' || n_name || '","region":' || n_regionkey || '}')) AS n_bytes FROM nation""")
def map_and_json_scalars(spark, sf):
    """Weights that override defaults, maps from parallel arrays, joined heads of lists, candidate ids and JSON sizes."""
    from sparkloom.functions.text import candidate_id

    given = F.when(F.col("n_nationkey") % 2 == 0, F.map_from_arrays(F.array(F.lit("lexical")), F.array(F.lit(250)))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    weights = R.overridden({"lexical": 100, "sparse": 80}, given)
    head = F.array_join(F.slice(F.array("n_name", F.col("n_regionkey").cast("string"), F.lit("x"), F.lit("y")), 1, 3), ",")
    size = F.octet_length(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))))
    return read(spark, sf, "nation").select("n_nationkey", head.alias("first_three"), weights["lexical"].alias("lexical"), weights["sparse"].alias("sparse"), candidate_id(F.col("n_name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey"))).alias("candidate"), size.alias("n_bytes"))


FAMILY = "profile(id, state) AS (VALUES ('spring/bean', 'mastered'), ('spring/bean-life', 'weak'), ('db/tx', 'weak'), ('net', 'weak'))"
CANDIDATE = "CASE doc_id % 7 WHEN 0 THEN 'spring/bean' WHEN 1 THEN 'spring/bean-life-cycle' WHEN 2 THEN 'db/tx' WHEN 3 THEN 'db/txn' WHEN 4 THEN 'net' WHEN 5 THEN 'spring' ELSE 'os/bean' END"


@query(f"""WITH {FAMILY}, c AS (SELECT doc_id, {CANDIDATE} AS cid FROM documents), m AS (SELECT doc_id, cid, max(CASE WHEN state = 'mastered' AND f THEN 1 ELSE 0 END) AS mastered, max(CASE WHEN state = 'weak' AND f THEN 1 ELSE 0 END) AS weak FROM (SELECT *, id = cid OR (contains(id, '/') AND contains(cid, '/') AND split_part(id, '/', 1) = split_part(cid, '/', 1) AND (starts_with(split_part(cid, '/', 2), split_part(id, '/', 2) || '-') OR starts_with(split_part(id, '/', 2), split_part(cid, '/', 2) || '-'))) AS f FROM c CROSS JOIN profile) x GROUP BY 1, 2)
SELECT doc_id, cid, CASE WHEN mastered = 1 THEN -15 WHEN weak = 1 THEN 10 ELSE 0 END AS delta FROM m""")
def concept_family(spark, sf):
    """Candidates move by the learner's state of a concept of the same family: equal, or one's slug begins the other's."""
    k = F.col("doc_id") % 7
    cid = F.when(k == 0, "spring/bean").when(k == 1, "spring/bean-life-cycle").when(k == 2, "db/tx").when(k == 3, "db/txn").when(k == 4, "net").when(k == 5, "spring").otherwise("os/bean")
    rows = read(spark, sf, "documents").select("doc_id", cid.alias("cid"))
    return rows.withColumn("delta", R.family_delta(F.col("cid"), ["spring/bean"], ["spring/bean-life", "db/tx", "net"]))


@query("""WITH old AS (SELECT event_id, user_id FROM events WHERE event_id % 3 = 0), new AS (SELECT event_id, user_id, 'log' || cast(user_id % 3 AS VARCHAR) AS path, event_id AS line FROM events UNION ALL SELECT event_id, user_id, 'log' || cast(user_id % 3 AS VARCHAR), event_id FROM events WHERE event_id % 5 = 0)
SELECT DISTINCT path, line FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.event_id = new.line)""")
def legacy_migration(spark, sf):
    """Rows of old logs that haven't been taken over yet, each once by its path and line."""
    rows = read(spark, sf, "events").select("event_id", F.concat(F.lit("log"), (F.col("user_id") % 3).cast("string")).alias("path"), F.col("event_id").alias("line"))
    every = rows.unionByName(rows.filter("event_id % 5 = 0"))
    done = rows.filter("event_id % 3 = 0").select("path", "line")
    return R.not_migrated(every.select("path", "line"), done, ["path", "line"])


@query("""WITH r AS (SELECT event_id AS response, user_id, cast(json_extract(props, '$.k') AS BIGINT) % 50 AS turn_id FROM events WHERE event_type = 'error'), q AS (SELECT min(event_id) AS question, user_id, cast(json_extract(props, '$.k') AS BIGINT) % 50 AS turn_id FROM events WHERE event_type = 'view' GROUP BY 2, 3) SELECT response, question FROM r JOIN q USING (user_id, turn_id)""")
def quality_by_question(spark, sf):
    """Rated answers with the question of their turn."""
    turn = (F.get_json_object("props", "$.k").cast("long") % 50).alias("turn_id")
    rows = read(spark, sf, "events")
    asked = rows.filter("event_type = 'view'").groupBy("user_id", turn).agg(F.min("event_id").alias("question"))
    return rows.filter("event_type = 'error'").select(F.col("event_id").alias("response"), "user_id", turn).join(asked, ["user_id", "turn_id"]).select("response", "question")


@query("""WITH c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS author FROM orders), s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS is_missing FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(lower(c_name), '') AS author FROM s JOIN c ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = author WHERE is_missing = 0""")
def live_comment_authors(spark, sf):
    """Comments that are still there, with the author of their pull request or none."""
    live = read(spark, sf, "lineitem").filter("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber")
    who = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("c_custkey"))
    return live.join(who, "l_orderkey").join(read(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", "left").select("l_orderkey", "l_linenumber", F.coalesce(F.lower("c_name"), F.lit("")).alias("author"))


@query("""WITH e AS (SELECT a.source AS x, b.source AS y FROM (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 = 0) a JOIN (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 5 = 0) b ON a.lang = b.lang AND a.source <> b.source), f AS (SELECT DISTINCT x, y FROM e), r AS (SELECT y AS x, x AS y FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.x = f.y AND g.y = f.x))
SELECT x, count(*) AS neighbours, cast(sum(added) AS BIGINT) AS added FROM (SELECT x, y, 0 AS added FROM f UNION ALL SELECT x, y, 1 FROM r) t GROUP BY 1""")
def bidirectional_edges(spark, sf):
    """Forbidden neighbours in both directions: reversed edges that aren't there yet are added once."""
    rows = read(spark, sf, "documents")
    a = rows.filter("doc_id % 3 = 0").select(F.col("source").alias("x"), "lang").distinct()
    b = rows.filter("doc_id % 5 = 0").select(F.col("source").alias("y"), "lang").distinct()
    edges = a.join(b, "lang").filter("x <> y").select("x", "y").distinct()
    return R.both_ways(edges).groupBy("x").agg(F.count("*").alias("neighbours"), F.sum("added").alias("added"))


@query("""WITH f AS (SELECT DISTINCT a.source AS x, b.source AS y FROM documents a JOIN documents b ON a.lang = b.lang AND a.doc_id % 97 = 0 AND b.doc_id % 89 = 0 AND a.source <> b.source), c AS (SELECT DISTINCT a.source AS x, b.source AS y FROM documents a JOIN documents b ON a.lang = b.lang AND a.doc_id % 97 = 0 AND b.doc_id % 83 = 0) SELECT x, y FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.x = f.x AND c.y = f.y)""")
def collision_free_edges(spark, sf):
    """Forbidden neighbours without those that are listed as confusable."""
    rows = read(spark, sf, "documents")
    part = lambda m, n: rows.filter(f"doc_id % {m} = 0").select("lang", F.col("source").alias(n)).distinct()
    edge = lambda m: part(97, "x").join(part(m, "y"), "lang").select("x", "y").distinct()
    return edge(89).filter("x <> y").join(edge(83), ["x", "y"], "left_anti")
