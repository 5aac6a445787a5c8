"""Comparisons, catalogs, profiles and set reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vector as V
from sparkloom.operators import evaluation as E
from sparkloom.plans.base import query, read
from sparkloom.plans.evaluation import METRICS, judged
from sparkloom.plans.retrieval import CTE, TF, lexical_hits, sparse_hits


@query(f"""WITH {CTE}, {TF} SELECT count(*) AS n, count_if(n_rank < o_rank) AS better, count_if(n_rank = o_rank) AS same, count_if(n_rank > o_rank) AS worse FROM
(SELECT lex.query, lex.rank AS o_rank, coalesce(sp.rank, 21) AS n_rank FROM lex LEFT JOIN sp USING (query, doc)) t""")
def rank_diff_summary(spark, sf):
    """Hits of one run looked up in another; a missing one counts as the rank after the last."""
    new = sparse_hits(spark, sf).select("query", "doc", F.col("rank").alias("n_rank"))
    rows = lexical_hits(spark, sf).select("query", "doc", F.col("rank").alias("o_rank")).join(new, ["query", "doc"], "left").withColumn("n_rank", F.coalesce("n_rank", F.lit(21)))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("n_rank") < F.col("o_rank")).alias("better"), F.count_if(F.col("n_rank") == F.col("o_rank")).alias("same"), F.count_if(F.col("n_rank") > F.col("o_rank")).alias("worse"))


@query(f"""WITH {CTE}, {TF}, g AS (SELECT doc_id AS doc FROM labels WHERE quality = 1), a AS (SELECT query, min(rank) AS before FROM lex JOIN g USING (doc) GROUP BY 1), b AS (SELECT query, min(rank) AS after FROM sp JOIN g USING (doc) GROUP BY 1)
SELECT query, before, after, coalesce(after, 101) > before AS demoted, before <= 5 AND coalesce(after, 101) > 5 AS lost_top5 FROM a LEFT JOIN b USING (query)""")
def reranker_demotion(spark, sf):
    good = read(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("doc"))
    best = lambda h, n: h.join(good, "doc").groupBy("query").agg(F.min("rank").alias(n))
    out = best(lexical_hits(spark, sf), "before").join(best(sparse_hits(spark, sf), "after"), "query", "left")
    late = F.coalesce("after", F.lit(101))
    return out.select("query", "before", "after", (late > F.col("before")).alias("demoted"), ((F.col("before") <= 5) & (late > 5)).alias("lost_top5"))


@query(f"""{METRICS}, a AS (SELECT 'ndcg' AS name, cast(floor(avg(ndcg)) AS BIGINT) AS value, 100000 AS bound FROM m UNION ALL SELECT 'mrr', cast(floor(avg(mrr)) AS BIGINT), 100000 FROM m UNION ALL SELECT 'recall', cast(floor(avg(recall)) AS BIGINT), 300000 FROM m UNION ALL SELECT 'forbidden', cast(floor(1000000 - avg(forbidden)) AS BIGINT), 900000 FROM m)
SELECT name, value, cast(bound AS BIGINT) AS bound, value >= bound AS passed FROM a""")
def gate_checks(spark, sf):
    mean = lambda c: F.floor(F.avg(c)).cast("long")
    m = E.metrics(*judged(spark, sf)).agg(mean("ndcg").alias("ndcg"), mean("mrr").alias("mrr"), mean("recall").alias("recall"), F.floor(1_000_000 - F.avg("forbidden")).cast("long").alias("forbidden"))
    rows = m.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(b).cast("long").alias("bound")) for n, b in (("ndcg", 100_000), ("mrr", 100_000), ("recall", 300_000), ("forbidden", 900_000))))).alias("r"))
    return rows.select("r.*").withColumn("passed", F.col("value") >= F.col("bound"))


@query("""WITH a AS (SELECT lang AS bucket, cast(avg(n_chars) AS BIGINT) AS value FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT lang AS bucket, cast(avg(n_chars) AS BIGINT) AS value FROM documents WHERE doc_id % 2 = 1 AND lang <> 'es' GROUP BY 1)
SELECT bucket, a.value AS base, b.value AS candidate, coalesce(b.value, 0) - coalesce(a.value, 0) AS delta FROM a FULL OUTER JOIN b USING (bucket)""")
def cutover_compare(spark, sf):
    """Buckets of two runs; one that only one run has counts as 0 in the other."""
    rows = read(spark, sf, "documents")
    mean = lambda d, n: d.groupBy(F.col("lang").alias("bucket")).agg(F.round(F.avg("n_chars")).cast("long").alias(n))
    out = mean(rows.filter("doc_id % 2 = 0"), "base").join(mean(rows.filter("doc_id % 2 = 1 and lang <> 'es'"), "candidate"), "bucket", "full_outer")
    return out.withColumn("delta", F.coalesce("candidate", F.lit(0)) - F.coalesce("base", F.lit(0)))


@query("""SELECT label, i, count(*) AS n, cast(floor(sum(cast(floor(cast(v AS DOUBLE) * 1000000 + 0.5) AS BIGINT)) / count(*)) AS BIGINT) AS mean FROM (SELECT label, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings) t GROUP BY 1, 2""")
def mean_vector(spark, sf):
    """Element-wise means of a scope's vectors, in millionths."""
    rows = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.count("*").alias("n"), F.floor(F.sum(V.quantised(F.col("v").cast("double"))) / F.count("*")).cast("long").alias("mean"))


@query("""SELECT term, dense_rank() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT t AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣]+')) AS t FROM benchmark) x) y""")
def term_vocabulary(spark, sf):
    """Deterministic ids. Ranks come from a range sort and counts by partition, so no task holds all terms."""
    terms = read(spark, sf, "benchmark").select(F.explode(T.feedback_tokens(F.col("text"))).alias("term")).distinct()
    first = terms.withColumn("head", F.substring("term", 1, 2))
    base = first.groupBy("head").agg(F.count("*").alias("n"))
    base = base.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = first.join(base, "head").withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("term")))
    return out.select("term", (F.col("before") + F.col("r") - 1).cast("long").alias("term_id"))


@query("""WITH e AS (SELECT user_id, cast(json_extract(props, '$.k') AS BIGINT) % 10 AS item, event_type FROM events)
SELECT item, count(*) AS n, count_if(event_type = 'error') AS bad FROM e GROUP BY 1 HAVING 10 * count_if(event_type = 'error') >= count(*)""")
def cleanup_candidates(spark, sf):
    rows = read(spark, sf, "events").select((F.get_json_object("props", "$.k").cast("long") % 10).alias("item"), "event_type")
    return rows.groupBy("item").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad")).filter("10 * bad >= n")


@query("""SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1""")
def concept_catalog(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return read(spark, sf, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("""SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1""")
def judged_documents(spark, sf):
    rows = read(spark, sf, "labels")
    return rows.filter("quality = 1").select("doc_id").union(rows.filter("toxic = 1").select("doc_id")).distinct()


@query("SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def primary_forbidden_overlap(spark, sf):
    rows = read(spark, sf, "labels")
    return rows.filter("quality = 0").select("doc_id").intersect(rows.filter("toxic = 1").select("doc_id"))


@query("""WITH r AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16'), l AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16')
SELECT coalesce(r.user_id, l.user_id) AS user_id, coalesce(r.event_type, l.event_type) AS event_type, CASE WHEN r.user_id IS NULL THEN 'new' WHEN l.user_id IS NULL THEN 'gone' ELSE 'kept' END AS state FROM r FULL OUTER JOIN l ON r.user_id = l.user_id AND r.event_type = l.event_type""")
def profile_sets(spark, sf):
    rows = read(spark, sf, "events")
    early = rows.filter("ts < timestamp_ntz '2024-01-16'").select("user_id", "event_type").distinct().withColumn("a", F.lit(True))
    late = rows.filter("ts >= timestamp_ntz '2024-01-16'").select("user_id", "event_type").distinct().withColumn("b", F.lit(True))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("kept")
    return early.join(late, ["user_id", "event_type"], "full_outer").select("user_id", "event_type", state.alias("state"))


@query("""SELECT source, n, cast(floor(1000000 * n / sum(n) OVER ()) AS BIGINT) AS share, cast(sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) t""")
def share_of_total(spark, sf):
    """Over groups that are counted already."""
    rows = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "source")
    return rows.select("source", "n", F.floor(1_000_000 * F.col("n") / F.sum("n").over(Window.partitionBy())).cast("long").alias("share"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(why|how)([^a-z]|$)') THEN 'explain' WHEN regexp_matches(lower(text), '(^|[^a-z])(what|is)([^a-z]|$)') THEN 'define' WHEN text LIKE '%?%' THEN 'ask' ELSE 'other' END AS intent FROM conversations WHERE role = 'user'""")
def intent_inference(spark, sf):
    """The first rule that matches wins."""
    low = F.lower("text")
    intent = F.when(low.rlike("(^|[^a-z])(why|how)([^a-z]|$)"), "explain").when(low.rlike("(^|[^a-z])(what|is)([^a-z]|$)"), "define").when(F.col("text").contains("?"), "ask").otherwise("other")
    return read(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", intent.alias("intent"))


LENSES = {"grammar": ["the", "and"], "tone": ["is", "of"], "origin": ["license", "rights"]}


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS lens, " + " + ".join(f"cast(lower(text) LIKE '%{w}%' AS BIGINT)" for w in ws) + " AS score FROM documents" for n, ws in LENSES.items()) + ") SELECT doc_id, lens, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lens) AS r FROM s WHERE score > 0) t WHERE r = 1")
def lens_scoring(spark, sf):
    """The lens with the most keywords in a text."""
    low = F.lower("text")
    scores = [F.struct((-sum((low.contains(w).cast("long") for w in ws), F.lit(0).cast("long"))).alias("neg"), F.lit(n).alias("lens")) for n, ws in LENSES.items()]
    best = F.array_min(F.array(*scores))
    return read(spark, sf, "documents").select("doc_id", best.alias("b")).filter("b.neg < 0").select("doc_id", "b.lens", (-F.col("b.neg")).alias("score"))


@query("""WITH f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, length(text) <= 200 AND NOT regexp_matches(text, '[0-9]') AS short FROM conversations WHERE role = 'user') SELECT conv_id, turn, r > 1 AND short AS follow_up FROM f""")
def follow_up_detection(spark, sf):
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    short = (F.length("text") <= 200) & ~F.col("text").rlike("[0-9]")
    return read(spark, sf, "conversations").filter("role = 'user'").withColumn("r", r).select("conv_id", "turn", ((F.col("r") > 1) & short).alias("follow_up"))


@query("""SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS score, CASE WHEN value >= 50 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS band FROM events WHERE event_type = 'error'""")
def score_parse(spark, sf):
    band = F.when(F.col("value") >= 50, "high").when(F.col("value") >= 20, "medium").otherwise("low")
    return read(spark, sf, "events").filter("event_type = 'error'").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).try_cast("long").alias("score"), band.alias("band"))


@query("""WITH l AS (SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"#?]*)', 1)) AS link FROM pages) t), h AS (SELECT DISTINCT '/' || split_part(regexp_replace(url, '^https?://[^/]*/', ''), '?', 1) AS link FROM pages)
SELECT page_id, link FROM l WHERE link NOT IN (SELECT link FROM h)""")
def link_integrity(spark, sf):
    """Links within the site that lead to no page."""
    pages = read(spark, sf, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"#?]*)'), F.lit(1))).alias("link")).distinct()
    there = pages.select(F.concat(F.lit("/"), F.split_part(F.regexp_replace("url", "^https?://[^/]*/", ""), F.lit("?"), F.lit(1))).alias("link")).distinct()
    return links.join(there, "link", "left_anti").select("page_id", "link")


@query("""WITH x AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM x GROUP BY 1""")
def first_seen_order(spark, sf):
    """Distinct kinds in the order they were first seen."""
    first = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(ordered, ",").alias("kinds"))


@query(f"""{METRICS} SELECT query, CASE WHEN forbidden > 0 THEN 'forbidden_hit' WHEN ndcg >= 500000 THEN 'primary_hit' WHEN hit = 1 THEN 'acceptable_hit' ELSE 'miss' END AS outcome, CASE WHEN query % 4 = 0 THEN forbidden = 0 ELSE forbidden = 0 AND ndcg >= 500000 END AS passed FROM m""")
def cohort_outcome(spark, sf):
    """Forbidden before primary before acceptable; the probe cohort only asks that nothing is forbidden."""
    m = E.metrics(*judged(spark, sf))
    kind = F.when(F.col("forbidden") > 0, "forbidden_hit").when(F.col("ndcg") >= 500_000, "primary_hit").when(F.col("hit") == 1, "acceptable_hit").otherwise("miss")
    passed = F.when(F.col("query") % 4 == 0, F.col("forbidden") == 0).otherwise((F.col("forbidden") == 0) & (F.col("ndcg") >= 500_000))
    return m.select("query", kind.alias("outcome"), passed.alias("passed"))
