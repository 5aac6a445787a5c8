"""Evaluation queries: lexical rankings of benchmark items against grades from labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import evaluation as E
from sparkloom.operators.ranking import ranked
from sparkloom.plans.base import query, read
from sparkloom.plans.retrieval import CTE, lexical_hits

JUDGED = """, j AS (SELECT query, doc, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 AND doc % 5 = query % 5 THEN 3 WHEN quality = 1 THEN 1 ELSE 0 END AS grade FROM lex JOIN labels ON doc = doc_id)"""


def judged(spark, sf):
    hits = lexical_hits(spark, sf)
    grade = F.when(F.col("toxic") == 1, -1).when((F.col("quality") == 1) & (F.col("doc") % 5 == F.col("query") % 5), 3).when(F.col("quality") == 1, 1).otherwise(0)
    j = hits.join(read(spark, sf, "labels"), F.col("doc") == F.col("doc_id")).select("query", "doc", grade.alias("grade"))
    return hits.select("query", "doc", "rank"), j


METRICS = f"""WITH {CTE}{JUDGED}, g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS r FROM j WHERE grade > 0),
i AS (SELECT query, sum(CASE WHEN r <= 10 THEN cast(floor((pow(2.0, grade) - 1) / log2(r + 1) * 1000000 + 0.5) AS BIGINT) END) AS idcg, count(*) AS n_good, count_if(grade = 1) AS n_companion FROM g GROUP BY 1),
h AS (SELECT query, sum(CASE WHEN rank <= 10 AND grade > 0 THEN cast(floor((pow(2.0, grade) - 1) / log2(rank + 1) * 1000000 + 0.5) AS BIGINT) ELSE 0 END) AS dcg, min(CASE WHEN grade > 0 THEN rank END) AS first,
count_if(rank <= 10 AND grade > 0) AS found, count_if(rank <= 10 AND grade = 1) AS companions, count_if(rank <= 10 AND grade < 0) AS forbidden FROM lex JOIN j USING (query, doc) GROUP BY 1),
m AS (SELECT query, cast(floor(1000000 * dcg / nullif(idcg, 0)) AS BIGINT) AS ndcg, coalesce(cast(floor(1000000 / first) AS BIGINT), 0) AS mrr, cast(found > 0 AS BIGINT) AS hit,
cast(floor(1000000 * found / nullif(n_good, 0)) AS BIGINT) AS recall, cast(floor(1000000 * companions / nullif(n_companion, 0)) AS BIGINT) AS companion, cast(floor(1000000 * forbidden / 10) AS BIGINT) AS forbidden FROM i LEFT JOIN h USING (query))"""


@query(f"{METRICS} SELECT * FROM m")
def ir_metrics_per_query(spark, sf):
    return E.metrics(*judged(spark, sf))


@query(f"{METRICS}, x AS (SELECT m.*, CASE WHEN query % 3 = 0 THEN NULL ELSE 'g' || cast(query % 3 AS VARCHAR) END AS family, CASE WHEN query % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM m) SELECT 'family' AS axis, coalesce(family, 'unknown') AS bucket, count(*) AS n, cast(sum(ndcg) AS BIGINT) AS total FROM x GROUP BY 2 UNION ALL SELECT 'parity', parity, count(*), cast(sum(ndcg) AS BIGINT) FROM x GROUP BY 2")
def bucket_macro_report(spark, sf):
    rows = E.metrics(*judged(spark, sf))
    rows = rows.withColumn("family", F.when(F.col("query") % 3 != 0, F.concat(F.lit("g"), (F.col("query") % 3).cast("string")))).withColumn("parity", F.when(F.col("query") % 2 == 0, "even").otherwise("odd"))
    return E.by_axes(rows, ["family", "parity"], "ndcg")


@query(f"{METRICS} SELECT query, CASE WHEN hit = 0 THEN 'primary_missing' WHEN forbidden > 0 THEN 'forbidden' WHEN mrr < 500000 THEN 'over_budget' ELSE 'pass' END AS outcome FROM m")
def regression_check(spark, sf):
    kind = F.when(F.col("hit") == 0, "primary_missing").when(F.col("forbidden") > 0, "forbidden").when(F.col("mrr") < 500_000, "over_budget").otherwise("pass")
    return E.metrics(*judged(spark, sf)).select("query", kind.alias("outcome"))


@query(f"{METRICS} SELECT CASE WHEN hit = 0 THEN 'primary_missing' WHEN forbidden > 0 THEN 'forbidden' WHEN mrr < 500000 THEN 'over_budget' ELSE 'pass' END AS outcome, count(*) AS n FROM m GROUP BY 1")
def regression_summary(spark, sf):
    return regression_check(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {CTE}, s AS (SELECT score, coalesce(quality, 0) = 1 AS positive FROM lex LEFT JOIN labels ON doc = doc_id WHERE rank = 1), t AS (SELECT unnest([100, 200, 300, 400, 500, 600]) AS threshold)
SELECT cast(threshold AS BIGINT) AS threshold, count_if(score < threshold AND NOT positive) AS tp, count_if(score < threshold AND positive) AS fp, count_if(score >= threshold AND NOT positive) AS fn FROM s, t GROUP BY 1""")
def f1_threshold_sweep(spark, sf):
    rows = lexical_hits(spark, sf).filter("rank = 1").join(read(spark, sf, "labels"), F.col("doc") == F.col("doc_id"), "left").select("score", (F.coalesce("quality", F.lit(0)) == 1).alias("positive"))
    return E.threshold_sweep(rows, [100, 200, 300, 400, 500, 600])


@query("""WITH r AS (SELECT item_id, row_number() OVER (ORDER BY md5(cast(item_id AS VARCHAR) || '#7'), item_id) AS r, count(*) OVER () AS n FROM benchmark) SELECT item_id, CASE WHEN r <= round_even(0.7 * n, 0) THEN 'tune' ELSE 'holdout' END AS part FROM r""")
def tune_holdout_split(spark, sf):
    """A fixed share by hash order. The benchmark is the small side of any use, and is ranked in one task."""
    rows = read(spark, sf, "benchmark")
    n = rows.count()
    r = ranked(rows.withColumn("one", F.lit(1)), ["one"], [F.md5(F.concat(F.col("item_id").cast("string"), F.lit("#7"))), F.asc("item_id")], "r")
    return r.select("item_id", F.when(F.col("r") <= F.bround(F.lit(0.7 * n), 0), "tune").otherwise("holdout").alias("part"))


@query("""SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(cast(doc_id AS VARCHAR)), doc_id) AS rank FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) t WHERE rank <= 25""")
def decoy_sample(spark, sf):
    """Decoys of each language that aren't judged: a sampling operator."""
    rest = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    out = ranked(rest, ["lang"], [F.md5(F.col("doc_id").cast("string")), F.asc("doc_id")])
    return out.filter("rank <= 25").select("doc_id", "lang", "rank")


@query(f"""WITH {CTE}{JUDGED}, w AS (SELECT unnest([5, 10, 20]) AS k), a AS (SELECT query, k, count_if(grade > 0 AND rank <= k) AS found, count_if(grade > 0) AS total FROM lex JOIN j USING (query, doc), w GROUP BY 1, 2)
SELECT cast(k AS BIGINT) AS k, count(*) AS n, cast(sum(found) AS BIGINT) AS found, cast(sum(total) AS BIGINT) AS total, count_if(found > 0) AS n_hit FROM a GROUP BY 1""")
def recall_windows(spark, sf):
    hits, j = judged(spark, sf)
    rows = hits.join(j, ["query", "doc"]).withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in (5, 10, 20)))))
    per = rows.groupBy("query", "k").agg(F.count_if((F.col("grade") > 0) & (F.col("rank") <= F.col("k"))).alias("found"), F.count_if(F.col("grade") > 0).alias("total"))
    return per.groupBy("k").agg(F.count("*").alias("n"), F.sum("found").alias("found"), F.sum("total").alias("total"), F.count_if(F.col("found") > 0).alias("n_hit"))
