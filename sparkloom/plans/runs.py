"""Reports on retrieval runs: primary gains, macro and micro means, gates, Pareto order, ablations, calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import evaluation as E
from sparkloom.operators import reports as R
from sparkloom.operators import selection as S
from sparkloom.plans import indexes
from sparkloom.plans.base import query, read
from sparkloom.plans.evaluation import JUDGED, METRICS, judged
from sparkloom.plans.retrieval import CTE, FIELDS, TF, lexical_fields_topk, lexical_hits, sparse_hits
from sparkloom.sources.stored import cut

MILLION = "cast(floor({x} * 1000000 + 0.5) AS BIGINT)"


@query(f"""WITH {CTE}{JUDGED}, g AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY doc) AS r FROM j WHERE grade = 3), i AS (SELECT query, sum(CASE WHEN r <= 10 THEN {MILLION.format(x='1 / log2(r + 1)')} END) AS ideal FROM g GROUP BY 1),
d AS (SELECT query, sum({MILLION.format(x='1 / log2(rank + 1)')}) AS got FROM lex JOIN g USING (query, doc) WHERE rank <= 10 GROUP BY 1) SELECT query, cast(floor(1000000 * coalesce(got, 0) / ideal) AS BIGINT) AS primary_ndcg FROM i LEFT JOIN d USING (query)""")
def primary_ndcg(spark, sf):
    """Grade 3 alone, with a gain of 1."""
    return E.primary_ndcg(*judged(spark, sf))


AXES = f"""{METRICS}, x AS (SELECT query, ndcg, mrr, recall, hit * 1000000 AS hit, companion, forbidden, CASE WHEN query % 5 = 0 THEN 'unknown' ELSE 'c' || cast(query % 5 AS VARCHAR) END AS category, CASE query % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'advanced' ELSE 'unknown' END AS difficulty, CASE WHEN query % 2 = 0 THEN 'ko' ELSE 'en' END AS language, CASE WHEN query % 4 < 2 THEN 'definition' ELSE 'comparison' END AS intent FROM m),
u AS (UNPIVOT (SELECT query, category, difficulty, language, intent, ndcg, mrr, recall, hit FROM x) ON ndcg, mrr, recall, hit INTO NAME metric VALUE v),
l AS (SELECT metric, v, axis, bucket FROM (UNPIVOT u ON category, difficulty, language, intent INTO NAME axis VALUE bucket)),
b AS (SELECT metric, axis, bucket, count(*) AS n, cast(sum(v) AS BIGINT) AS total FROM l GROUP BY 1, 2, 3)"""


def with_axes(spark, sf):
    q = F.col("query")
    rows = E.metrics(*judged(spark, sf)).withColumn("hit", F.col("hit") * 1_000_000)
    return rows.withColumns({"category": F.when(q % 5 == 0, "unknown").otherwise(F.concat(F.lit("c"), (q % 5).cast("string"))), "difficulty": F.when(q % 3 == 0, "beginner").when(q % 3 == 1, "advanced").otherwise("unknown"), "language": F.when(q % 2 == 0, "ko").otherwise("en"), "intent": F.when(q % 4 < 2, "definition").otherwise("comparison")})


AXIS_NAMES = ["category", "difficulty", "language", "intent"]


@query(f"WITH {AXES[5:] if AXES.startswith('WITH ') else AXES} SELECT metric, axis, bucket, n, total FROM b")
def all_axes_report(spark, sf):
    """Headline metrics by every axis, in one aggregation over grouping sets."""
    return R.by_axes(with_axes(spark, sf), AXIS_NAMES, ["ndcg", "mrr", "recall", "hit"])


@query(f"WITH {AXES[5:]}, k AS (SELECT metric, axis, cast(floor(avg(floor(total / n))) AS BIGINT) AS macro, count(*) AS buckets FROM b WHERE bucket <> 'unknown' GROUP BY 1, 2), o AS (SELECT metric, axis, cast(floor(sum(total) / sum(n)) AS BIGINT) AS micro FROM b GROUP BY 1, 2) SELECT metric, axis, macro, buckets, micro FROM k JOIN o USING (metric, axis)")
def macro_micro_means(spark, sf):
    """The mean of bucket means without the unknown bucket, beside the mean over all rows."""
    return R.macro_micro(R.by_axes(with_axes(spark, sf), AXIS_NAMES, ["ndcg", "mrr", "recall", "hit"]))


HARD = f"""{JUDGED.lstrip(', ')}, r AS (SELECT query, min(CASE WHEN grade = 3 THEN rank END) AS first_primary, max(CASE WHEN grade = 3 AND rank > 5 THEN 1 ELSE 0 END) AS over, count_if(grade = 3) AS n_primary, count_if(grade = -1 AND rank <= 5) AS bad, min(CASE WHEN grade = 1 THEN rank END) AS first_companion FROM lex JOIN j USING (query, doc) GROUP BY 1),
v AS (SELECT query, list_filter([CASE WHEN n_primary = 0 THEN 'primary_not_present' END, CASE WHEN over = 1 THEN 'primary_over_budget' END, CASE WHEN bad > 0 THEN 'forbidden_in_topk' END], lambda x: x IS NOT NULL) AS violations, coalesce(first_companion < first_primary, false) AS warned FROM r)"""


def regressions(spark, sf):
    return R.hard_regressions(*judged(spark, sf), budget=5, window=5)


@query(f"WITH {CTE}, {HARD} SELECT query, len(violations) = 0 AS passed, array_to_string(violations, ',') AS violations, warned FROM v")
def hard_regressions(spark, sf):
    """Primary hits missing or beyond their budget and forbidden ones at the top fail a query; a companion before the
    primary hit is a warning."""
    return regressions(spark, sf).select("query", (F.size("violations") == 0).alias("passed"), F.array_join("violations", ",").alias("violations"), "warned")


@query(f"WITH {CTE}, {HARD}, k AS (SELECT unnest(violations) AS kind, query FROM v UNION ALL SELECT 'companion_before_primary', query FROM v WHERE warned UNION ALL SELECT 'passed', query FROM v WHERE len(violations) = 0) SELECT kind, count(*) AS n, array_to_string(list_sort(list(query)), ',') AS queries FROM k GROUP BY 1")
def violation_summary(spark, sf):
    """Counts by kind, with the ids."""
    v = regressions(spark, sf)
    kinds = v.select(F.explode("violations").alias("kind"), "query").unionByName(v.filter("warned").select(F.lit("companion_before_primary").alias("kind"), "query")).unionByName(v.filter(F.size("violations") == 0).select(F.lit("passed").alias("kind"), "query"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("query")), ",").alias("queries"))


@query(f"""WITH {AXES[5:]}, o AS (SELECT metric, cast(floor(sum(total) / sum(n)) AS BIGINT) AS overall FROM b WHERE axis = 'language' GROUP BY 1), s AS (SELECT cast(floor(avg(companion)) AS BIGINT) AS companion, cast(floor(avg(forbidden)) AS BIGINT) AS forbidden FROM m)
SELECT '{{"hit":' || (SELECT overall FROM o WHERE metric = 'hit') || ',"mrr":' || (SELECT overall FROM o WHERE metric = 'mrr') || ',"ndcg":' || (SELECT overall FROM o WHERE metric = 'ndcg') || ',"recall":' || (SELECT overall FROM o WHERE metric = 'recall') || ',"companion":' || companion || ',"forbidden":' || forbidden || '}}' AS report FROM s""")
def run_report_json(spark, sf):
    """Overall means and side signals of a run as one JSON object."""
    mean = lambda c: F.floor(F.avg(c)).cast("long").alias(c)
    rows = with_axes(spark, sf).agg(*(mean(c) for c in ("hit", "mrr", "ndcg", "recall", "companion", "forbidden")))
    return rows.select(F.to_json(F.struct("*")).alias("report"))


#: Every set of fields is a run: the best 20 of its fields, fused; judged by the documents that any field finds.
POOL = "CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 AND doc % 5 = query % 5 THEN 3 WHEN quality = 1 THEN 1 ELSE 0 END"
RUNS = f"""{FIELDS}, lf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, field ORDER BY score DESC, doc) AS rank FROM s) t WHERE rank <= 20),
ms AS (SELECT list_sort(list(DISTINCT field)) AS ns FROM lf), mk AS (SELECT ns, unnest(range(1, (1 << len(ns)))) AS mask FROM ms), st AS (SELECT list_filter(ns, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS parts FROM mk WHERE bit_count(mask) <= 2 OR bit_count(mask) = len(ns)),
sets AS (SELECT array_to_string(parts, ',') AS run, len(parts) AS n, parts FROM st), x AS (SELECT query, run, doc, cast(sum(1000000000000 // (60 + rank)) AS BIGINT) AS score FROM lf JOIN (SELECT run, unnest(parts) AS field FROM sets) p USING (field) GROUP BY 1, 2, 3),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, run ORDER BY score DESC, doc) AS rank, count(*) OVER (PARTITION BY query, run) AS candidates FROM x) t WHERE rank <= 20),
j AS (SELECT query, doc, {POOL} AS grade FROM (SELECT DISTINCT query, doc FROM lf) t JOIN labels ON doc = doc_id),
id AS (SELECT query, sum(CASE WHEN r <= 10 THEN {MILLION.format(x='1 / log2(r + 1)')} END) AS ideal FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY doc) AS r FROM j WHERE grade = 3) t GROUP BY 1),
h AS (SELECT query, run, sum(CASE WHEN grade = 3 AND rank <= 10 THEN {MILLION.format(x='1 / log2(rank + 1)')} END) AS got, min(CASE WHEN grade = 3 THEN rank END) AS first, count_if(grade = -1 AND rank <= 5) AS bad FROM rk JOIN j USING (query, doc) GROUP BY 1, 2),
pq AS (SELECT id.query, sets.run, cast(floor(1000000 * coalesce(got, 0) / ideal) AS BIGINT) AS gain, coalesce(first > 5, true) AS failed, coalesce(bad, 0) AS bad FROM id CROSS JOIN sets LEFT JOIN h ON h.query = id.query AND h.run = sets.run),
bk AS (SELECT run, axis, bucket, count(*) AS n, cast(floor(sum(gain) / count(*)) AS BIGINT) AS gain FROM (SELECT run, gain, 'category' AS axis, 'c' || cast(query % 5 AS VARCHAR) AS bucket FROM pq UNION ALL SELECT run, gain, 'language', 'l' || cast(query % 2 AS VARCHAR) FROM pq) t GROUP BY 1, 2, 3),
sz AS (SELECT field, count(*) AS size FROM (SELECT DISTINCT field, doc, term FROM w) t GROUP BY 1), cd AS (SELECT run, list_sort(list(candidates)) AS cs FROM rk WHERE rank = 1 GROUP BY 1),
r AS (SELECT sets.run AS name, sets.n, (SELECT cast(floor(avg(gain)) AS BIGINT) FROM bk WHERE bk.run = sets.run AND axis = 'category') AS gain, (SELECT count_if(failed) FROM pq WHERE pq.run = sets.run) AS failures,
(SELECT cast(floor(1000000 * sum(bad) / (5 * count(*))) AS BIGINT) FROM pq WHERE pq.run = sets.run) AS forbidden, (SELECT cs[cast(round_even(0.95 * (len(cs) - 1), 0) AS BIGINT) + 1] FROM cd WHERE cd.run = sets.run) AS p95, (SELECT cast(sum(size) AS BIGINT) FROM sz WHERE list_contains(sets.parts, sz.field)) AS mb FROM sets)"""


class Report:
    """The runs over the four fields, with their parts."""

    def __init__(self, spark, sf):
        hits = cut(lexical_fields_topk(spark, sf).withColumnRenamed("field", "name"))
        self.sets = S.modality_sets(hits.select("name").distinct())
        grade = F.when(F.col("toxic") == 1, -1).when((F.col("quality") == 1) & (F.col("doc") % 5 == F.col("query") % 5), 3).when(F.col("quality") == 1, 1).otherwise(0)
        pool = hits.select("query", "doc").distinct().join(read(spark, sf, "labels"), F.col("doc") == F.col("doc_id")).select("query", "doc", grade.alias("grade"))
        self.ranking = S.fused_runs(hits, self.sets)
        names = sorted(r.run for r in self.sets.select("run").collect())  # sets of a few names
        rows = S.primary_by_run(self.ranking, pool, names).withColumn("category", F.concat(F.lit("c"), (F.col("query") % 5).cast("string"))).withColumn("language", F.concat(F.lit("l"), (F.col("query") % 2).cast("string")))
        rows = cut(rows)
        self.buckets = S.run_buckets(rows, ["category", "language"])
        sizes = indexes.fields(spark, sf).terms.groupBy(F.col("field").alias("name")).agg(F.sum("df").alias("size"))
        self.runs = S.run_scores(rows, self.buckets, self.ranking, self.sets, sizes, "category")


@query(f"WITH {RUNS} SELECT run AS modalities, cast(n AS BIGINT) AS n FROM sets")
def modality_powerset(spark, sf):
    """Singles, pairs and all of the fields that have hits."""
    names = lexical_fields_topk(spark, sf).select(F.col("field").alias("name")).distinct()
    return S.modality_sets(names).select(F.col("run").alias("modalities"), F.col("n").cast("long").alias("n"))


@query(f"WITH {RUNS} SELECT name, cast(n AS BIGINT) AS n, gain, failures, forbidden, p95, mb FROM r")
def run_scores(spark, sf):
    """Gain, failures, forbidden rate, candidates and size of each set of fields."""
    return Report(spark, sf).runs.withColumn("n", F.col("n").cast("long"))


#: Bounds of the gate here: candidates a query instead of milliseconds, postings instead of megabytes.
MOST_CANDIDATES, MOST_POSTINGS = 70, 10_000_000
CHECKS = f"""{RUNS}, z AS (SELECT * FROM r WHERE name = 'title'), u AS (SELECT bucket, gain FROM bk WHERE run = 'title' AND axis = 'category' AND n >= 5), g AS (SELECT r.name, list_filter([CASE WHEN r.failures > z.failures THEN 'hard_regression' END, CASE WHEN r.gain - z.gain < 30000 THEN 'primary_uplift' END,
CASE WHEN (SELECT count(*) FROM u LEFT JOIN bk ON bk.run = r.name AND bk.axis = 'category' AND bk.bucket = u.bucket WHERE bk.gain IS NULL OR bk.gain - u.gain < -50000) > 0 THEN 'bucket_regression' END,
CASE WHEN r.forbidden > z.forbidden THEN 'forbidden_rate' END, CASE WHEN r.p95 > {MOST_CANDIDATES} THEN 'warm_p95' END, CASE WHEN r.mb > {MOST_POSTINGS} THEN 'memory' END], lambda x: x IS NOT NULL) AS failed FROM r, z WHERE r.name <> 'title')"""


@query(f"WITH {CHECKS} SELECT name, len(failed) = 0 AS passed, array_to_string(failed, ',') AS failed FROM g")
def acceptance_gate(spark, sf):
    """Six checks of each set of fields against titles alone; all are made, none ends the others."""
    report = Report(spark, sf)
    buckets = report.buckets.filter("axis = 'category'").select(F.col("run").alias("name"), "bucket", "gain", "n")
    out = R.gate(report.runs, buckets, "title", p95=MOST_CANDIDATES, mb=MOST_POSTINGS)
    return out.select("name", (F.size("failed") == 0).alias("passed"), F.array_join("failed", ",").alias("failed"))


CANDIDATES = "c AS (SELECT item_id AS name, cast(floor(price * 1000 + 0.5) AS BIGINT) AS gain, cast(size AS BIGINT) AS mb, length(name) AS p95 FROM items WHERE price IS NOT NULL AND size IS NOT NULL AND name IS NOT NULL AND item_id IS NOT NULL)"
PREFER = "CASE WHEN abs(a.gain - b.gain) < 20000 THEN CASE WHEN a.mb <> b.mb THEN a.mb < b.mb WHEN a.p95 <> b.p95 THEN a.p95 < b.p95 WHEN a.gain <> b.gain THEN a.gain > b.gain ELSE a.name < b.name END ELSE a.gain > b.gain END"


@query(f"""WITH {CANDIDATES}, d AS (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.gain >= a.gain AND b.mb <= a.mb AND b.p95 <= a.p95 AND (b.gain > a.gain OR b.mb < a.mb OR b.p95 < a.p95 OR b.name < a.name))),
p AS (SELECT a.name, count_if(a.name <> b.name AND {PREFER}) AS wins FROM d a CROSS JOIN d b GROUP BY 1) SELECT name, gain, mb, p95, wins, row_number() OVER (ORDER BY wins DESC, name) AS position FROM d JOIN p USING (name)""")
def pareto_order(spark, sf):
    """Items by price, size and length of name: those that none dominates, by how many of the others they are preferred to."""
    rows = read(spark, sf, "items").select(F.col("item_id").alias("name"), F.floor(F.col("price") * 1000 + 0.5).cast("long").alias("gain"), F.col("size").alias("mb"), F.length("name").alias("p95"))
    return S.preferences(rows)


@query(f"WITH {RUNS} SELECT name, gain FROM r ORDER BY gain DESC, failures, p95, n, name LIMIT 1")
def best_run(spark, sf):
    return S.best_run(Report(spark, sf).runs).select("name", "gain")


@query(f"""WITH {RUNS}, a AS (SELECT name FROM r ORDER BY gain DESC, name LIMIT 1) SELECT (SELECT name FROM r WHERE name = 'body,title') AS wanted, (SELECT name FROM a) AS fallback""")
def preferred_run(spark, sf):
    """The run that is asked for, and the best one where there is none of that name."""
    runs = Report(spark, sf).runs
    pick = lambda name, c: S.preferred_run(runs, spark.createDataFrame([(name,)], "name string")).select(F.col("name").alias(c))
    return pick("body,title", "wanted").crossJoin(pick("no such run", "fallback"))  # a row each


@query(f"""WITH {RUNS}, o AS (SELECT axis, bucket, gain FROM bk WHERE run = 'body'), e AS (SELECT axis, bucket, gain FROM bk WHERE run = 'aliases,body,section,title'), d AS (SELECT axis, bucket, o.gain AS old, e.gain AS new, e.gain - o.gain AS delta, coalesce(e.gain - o.gain < -10000, false) AS regressed FROM o FULL OUTER JOIN e USING (axis, bucket))
SELECT *, (SELECT gain FROM r WHERE name = 'aliases,body,section,title') >= (SELECT gain FROM r WHERE name = 'body') OR (SELECT count_if(regressed) FROM d) = 0 AS passed FROM d""")
def cutover_gate(spark, sf):
    """From the body to all fields: by bucket, and whether the change passes."""
    report = Report(spark, sf)
    return S.cutover(report.buckets, report.runs, "body", "aliases,body,section,title")


@query(f"""WITH {CTE}, {TF}, j AS (SELECT query, doc FROM (SELECT query, doc FROM lex UNION SELECT query, doc FROM sp WHERE rank <= 20) t JOIN labels ON doc = doc_id WHERE quality = 1 AND toxic = 0 AND doc % 5 = query % 5), o AS (SELECT query, min(doc) AS doc FROM j GROUP BY 1),
a AS (SELECT query, min(rank) AS old_rank FROM lex JOIN j USING (query, doc) GROUP BY 1), b AS (SELECT query, min(rank) AS new_rank FROM sp JOIN j USING (query, doc) WHERE rank <= 20 GROUP BY 1), t AS (SELECT query, lang AS found FROM sp JOIN documents ON doc = doc_id WHERE rank = 1)
SELECT o.query, lang AS category, found, old_rank, new_rank, CASE WHEN coalesce(new_rank, 21) < coalesce(old_rank, 21) THEN 'new' WHEN coalesce(new_rank, 21) > coalesce(old_rank, 21) THEN 'old' ELSE 'tie' END AS better,
CASE WHEN new_rank = 1 THEN 'pass_rank1' WHEN found <> lang THEN 'top1_cross_category' WHEN new_rank IS NULL THEN 'primary_missing_top_k' ELSE 'same_category_wrong_rank' END AS class FROM o JOIN documents ON doc = doc_id LEFT JOIN a USING (query) LEFT JOIN b USING (query) LEFT JOIN t USING (query)""")
def failure_classes(spark, sf):
    """Why each query fails with counts of terms, beside its rank by fields."""
    old, new = lexical_hits(spark, sf), sparse_hits(spark, sf)
    good = read(spark, sf, "labels").filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("doc"))
    judged = old.select("query", "doc").union(new.filter("rank <= 20").select("query", "doc")).distinct().filter(F.col("doc") % 5 == F.col("query") % 5).join(good, "doc").select("query", "doc")
    return S.failure_classes(new, old, judged, read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("category")))


MODALITIES = "md(name, hits) AS (SELECT 'lexical', query FROM (SELECT DISTINCT query FROM lex JOIN labels ON doc = doc_id WHERE quality = 1 AND rank <= 3) UNION ALL SELECT 'sparse', query FROM (SELECT DISTINCT query FROM sp JOIN labels ON doc = doc_id WHERE quality = 1 AND rank <= 3))"


@query(f"WITH {CTE}, {TF}, {MODALITIES}, s AS (SELECT 'lexical' AS subset, ['lexical'] AS parts UNION ALL SELECT 'sparse', ['sparse'] UNION ALL SELECT 'lexical,sparse', ['lexical', 'sparse']) SELECT subset, count(DISTINCT hits) AS n_hit FROM s JOIN md ON list_contains(parts, name) GROUP BY 1")
def ablation_by_subset(spark, sf):
    """How many queries each subset of retrievers answers."""
    good = read(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("doc"))
    one = lambda h, n: h.filter("rank <= 3").join(good, "doc").select(F.lit(n).alias("name"), "query").distinct()
    hits = one(lexical_hits(spark, sf), "lexical").unionByName(one(sparse_hits(spark, sf), "sparse"))
    return R.ablation(hits, ["lexical", "sparse"])


@query(f"WITH {CTE}, {TF}, a AS (SELECT query, doc, rank, 'lexical' AS run FROM lex UNION ALL SELECT query, doc, rank, 'sparse' FROM sp), g AS (SELECT run, query, min(rank) AS first FROM a JOIN labels ON doc = doc_id WHERE quality = 1 GROUP BY 1, 2), f AS (SELECT run, count(*) AS n, cast(sum(cast(floor(1000000 / first) AS BIGINT)) AS BIGINT) AS mrr, count_if(first <= 5) AS top5 FROM g GROUP BY 1) SELECT run, n, mrr, top5, row_number() OVER (ORDER BY mrr DESC, run) AS position FROM f")
def backend_compare(spark, sf):
    """Two retrievers over the same queries, the better one first."""
    good = read(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("doc"))
    every = lexical_hits(spark, sf).select("query", "doc", "rank", F.lit("lexical").alias("run")).unionByName(sparse_hits(spark, sf).select("query", "doc", "rank", F.lit("sparse").alias("run")))
    first = every.join(good, "doc").groupBy("run", "query").agg(F.min("rank").alias("first"))
    out = first.groupBy("run").agg(F.count("*").alias("n"), F.sum(F.floor(1_000_000 / F.col("first")).cast("long")).alias("mrr"), F.count_if(F.col("first") <= 5).alias("top5"))
    return out.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mrr"), "run")).cast("long"))


FIELD = "SELECT DISTINCT query, doc FROM q JOIN {f} USING (term)"


@query(f"""WITH {CTE}, g AS (SELECT doc_id AS doc FROM labels WHERE quality = 1), f AS (SELECT 'title' AS fields, query, doc FROM ({FIELD.format(f='title')}) UNION ALL SELECT 'body', query, doc FROM ({FIELD.format(f='body')}) UNION ALL SELECT 'title,body', query, doc FROM (SELECT query, doc FROM ({FIELD.format(f='title')}) UNION SELECT query, doc FROM ({FIELD.format(f='body')})))
SELECT fields, count(*) AS found, count(DISTINCT query) AS n_queries FROM f JOIN g USING (doc) GROUP BY 1""")
def corpus_field_lift(spark, sf):
    """What each set of fields can reach at all."""
    from sparkloom.operators import retrieval
    from sparkloom.plans.retrieval import docs_of, queries_of

    docs, q = docs_of(spark, sf), queries_of(spark, sf)
    good = read(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("doc"))
    reach = lambda f: q.join(retrieval.terms(docs, "doc", F.col(f), "doc"), "term").select("query", "doc").distinct()
    one = {f: reach(f) for f in ("title", "body")}
    every = one["title"].withColumn("fields", F.lit("title")).unionByName(one["body"].withColumn("fields", F.lit("body"))).unionByName(one["title"].unionByName(one["body"]).distinct().withColumn("fields", F.lit("title,body")))
    return every.join(good, "doc").groupBy("fields").agg(F.count("*").alias("found"), F.countDistinct("query").alias("n_queries"))


@query("SELECT event_type, cast(floor(quantile_cont(value, 0.5) * 10000 + 0.5) AS BIGINT) AS p50, cast(floor(quantile_cont(value, 0.95) * 10000 + 0.5) AS BIGINT) AS p95, cast(floor(min(value) * 10000 + 0.5) AS BIGINT) AS least, cast(floor(max(value) * 10000 + 0.5) AS BIGINT) AS most, count(value) AS n FROM events GROUP BY 1")
def interpolated_percentiles(spark, sf):
    part = lambda c, n: F.floor(c * 10_000 + 0.5).cast("long").alias(n)
    return R.interpolated(read(spark, sf, "events"), "event_type", "value").select("event_type", part(F.col("p50"), "p50"), part(F.col("p95"), "p95"), part(F.col("least"), "least"), part(F.col("most"), "most"), "n")


SWEEP = f"""WITH {CTE}, s AS (SELECT score, coalesce(quality, 0) = 1 AS positive FROM lex LEFT JOIN labels ON doc = doc_id WHERE rank = 1), t AS (SELECT unnest([100, 200, 300, 400, 500, 600]) AS threshold),
c AS (SELECT threshold, count_if(score < threshold AND NOT positive) AS tp, count_if(score < threshold AND positive) AS fp, count_if(score >= threshold AND NOT positive) AS fn FROM s, t GROUP BY 1), f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE cast(floor(2000000 * tp / (2 * tp + fp + fn)) AS BIGINT) END AS f1 FROM c)"""


@query(f"{SWEEP} SELECT cast(threshold AS BIGINT) AS threshold, f1, threshold = (SELECT threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1) AS recommended FROM f")
def refusal_calibration(spark, sf):
    """F1 of refusing under each threshold; the lower one wins a tie and is recommended."""
    from sparkloom.plans.evaluation import f1_threshold_sweep

    return R.recommended(f1_threshold_sweep(spark, sf)).select("threshold", "f1", "recommended")


@query("""SELECT 'orders' AS archive, count(*) AS n, count_if(l_orderkey IS NOT NULL) AS reviewed, 5 * count_if(l_orderkey IS NOT NULL) >= 2 * count(*) AS ready, max(o_orderdate) AS latest FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r ON o_orderkey = l_orderkey""")
def archive_readiness(spark, sf):
    """Ready when two in five have a review."""
    reviewed = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey").distinct()
    out = read(spark, sf, "orders").join(reviewed, F.col("o_orderkey") == F.col("l_orderkey"), "left").agg(F.lit("orders").alias("archive"), F.count("*").alias("n"), F.count("l_orderkey").alias("reviewed"), F.max("o_orderdate").alias("latest"))
    return out.withColumn("ready", 5 * F.col("reviewed") >= 2 * F.col("n"))


@query("SELECT lang, count(DISTINCT d.doc_id) AS n_docs, count(DISTINCT l.doc_id) AS n_judged, count(DISTINCT d.source) AS n_sources FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def category_coverage(spark, sf):
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("judged"))
    rows = read(spark, sf, "documents").join(labels, F.col("doc_id") == F.col("judged"), "left")
    return rows.groupBy("lang").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("judged").alias("n_judged"), F.countDistinct("source").alias("n_sources"))


@query(f"""WITH {CTE}{JUDGED}, c AS (SELECT query, CASE query % 3 WHEN 0 THEN 'ko' WHEN 1 THEN 'en' ELSE 'unknown' END AS language, k.k AS k, max(CASE WHEN grade = 3 AND rank <= k.k THEN 1 ELSE 0 END) AS hit, max(CASE WHEN grade = -1 AND rank <= 5 THEN 1 ELSE 0 END) AS bad FROM lex JOIN j USING (query, doc), (SELECT unnest([5, 10, 20]) AS k) k GROUP BY 1, 2, 3)
SELECT language, cast(k AS BIGINT) AS k, count(*) AS n, cast(sum(hit) AS BIGINT) AS hits, cast(sum(bad) AS BIGINT) AS forbidden, array_to_string(list_sort(list(query) FILTER (hit = 0)), ',') AS missing FROM c GROUP BY 1, 2""")
def windowed_recall(spark, sf):
    """Hits within each window by language, with the ids of the queries that miss."""
    hits, j = judged(spark, sf)
    language = F.when(F.col("query") % 3 == 0, "ko").when(F.col("query") % 3 == 1, "en").otherwise("unknown")
    return R.windowed(hits.join(j, ["query", "doc"]).withColumn("language", language), "language", [5, 10, 20])


@query("""WITH a AS (SELECT vec_id, label, CASE WHEN vec_id % 10 = 0 THEN 'model-b' ELSE 'model-a' END AS model, len(embedding) AS dim, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS version FROM embeddings), w AS (SELECT 'model-a' AS model, max(dim) AS dim, 1 AS version FROM a) SELECT vec_id, concat_ws(',', CASE WHEN a.model <> w.model THEN 'model' END, CASE WHEN a.dim <> w.dim THEN 'dim' END, CASE WHEN a.version <> w.version THEN 'version' END) AS mismatches FROM a, w""")
def index_compatibility(spark, sf):
    """Which of the three manifest fields differ from the embedder's; all are named."""
    rows = read(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, "model-b").otherwise("model-a").alias("model"), F.size("embedding").alias("dim"), F.when(F.col("vec_id") % 7 == 0, 2).otherwise(1).alias("version"))
    dim = rows.agg(F.max("dim")).first()[0]
    return R.incompatible(rows, {"model": "model-a", "dim": dim, "version": 1}).select("vec_id", "mismatches")
