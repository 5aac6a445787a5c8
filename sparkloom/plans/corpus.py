"""Queries over the corpus: paths, front matter, anchors, chunks, catalogs, expansion and buckets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import corpus as C
from sparkloom.functions import text as T
from sparkloom.operators import expansion as X
from sparkloom.operators import ranking as K
from sparkloom.plans.base import query, read
from sparkloom.plans.retrieval import CTE, lexical_hits

PATH = "CASE doc_id % 4 WHEN 0 THEN 'knowledge/cs/contents/' || lang || '/' || source || '.md' WHEN 1 THEN 'missions/spring-learning-test/spring-core-' || cast(doc_id % 3 + 1 AS VARCHAR) || '/initial/App.java' WHEN 2 THEN 'contents/net-' || lang || '/a/b.md' ELSE source || '.md' END"
STAGES = {"spring-core-1": "core", "spring-core-2": "core", "spring-core-3": "advanced"}


def paths(spark, sf):
    k, s = F.col("doc_id") % 4, F.lit
    path = F.when(k == 0, F.concat(s("knowledge/cs/contents/"), "lang", s("/"), "source", s(".md"))).when(k == 1, F.concat(s("missions/spring-learning-test/spring-core-"), (F.col("doc_id") % 3 + 1).cast("string"), s("/initial/App.java"))).when(k == 2, F.concat(s("contents/net-"), "lang", s("/a/b.md"))).otherwise(F.concat("source", s(".md")))
    return read(spark, sf, "documents").withColumn("path", path)


@query(f"""WITH p AS (SELECT doc_id, {PATH} AS path FROM documents), m AS (SELECT doc_id, path, coalesce(nullif(regexp_extract(path, '(?:knowledge/cs/)?contents/([a-z][a-z0-9_-]+)/', 1), ''), 'unknown') AS category, nullif(regexp_extract(path, '(spring-[a-z-]+?-[0-9]+)', 1), '') AS module FROM p)
SELECT doc_id, category, module, CASE module WHEN 'spring-core-1' THEN 'core' WHEN 'spring-core-2' THEN 'core' WHEN 'spring-core-3' THEN 'advanced' END AS stage FROM m""")
def path_inference(spark, sf):
    """Category, module and the stage that owns the module, from a path."""
    module = C.module_of(F.col("path"))
    return paths(spark, sf).select("doc_id", C.category_of(F.col("path")).alias("category"), module.alias("module"), C.looked_up(module, STAGES).alias("stage"))


@query("""WITH d AS (SELECT doc_id, lang, text, CASE WHEN doc_id % 3 = 0 THEN lang || ' guide' END AS prefix FROM documents) SELECT doc_id, md5(concat_ws(chr(10) || chr(10), prefix, text)) AS digest FROM d""")
def prefixed_chunks(spark, sf):
    """What is embedded of a chunk: its prefix, if it has one, and its text."""
    prefix = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(" guide")))
    return read(spark, sf, "documents").select("doc_id", F.md5(F.concat_ws("\n\n", prefix, "text").cast("binary")).alias("digest"))


TITLE = "trim(regexp_replace(split_part(text, chr(10), 1), '^#+\\s*', ''))"


@query(f"""WITH d AS (SELECT doc_id, lang, source, coalesce(nullif({TITLE}, ''), source) AS title, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM documents)
SELECT doc_id, md5('---' || chr(10) || 'title: ' || CASE WHEN regexp_matches(title, '[:#"'']') THEN '"' || replace(replace(title, '\\', '\\\\'), '"', '\\"') || '"' ELSE title END || chr(10) || 'category: ' || lang || chr(10) || 'difficulty: ' || CASE WHEN n < 100 THEN 'beginner' WHEN n < 400 THEN 'intermediate' ELSE 'advanced' END || chr(10) || '---' || chr(10)) AS header FROM d""")
def front_matter_headers(spark, sf):
    """Front matter made from a document: its first line as title, and a difficulty by length."""
    return read(spark, sf, "documents").select("doc_id", F.md5(C.front_matter_header(F.col("text"), F.col("lang"), F.col("source")).cast("binary")).alias("header"))


MARKDOWN = "text || chr(10) || '## Setup ' || source || chr(10) || '<a id=\"top-' || lang || '\"></a>' || chr(10) || '### Use {#use-' || lang || '}' || chr(10) || '[see](other.md#part-' || cast(doc_id % 5 AS VARCHAR) || ') and [again](other.md#Part-' || cast(doc_id % 5 AS VARCHAR) || ')' || chr(10) || '**Key**: x'"


def marked(spark, sf):
    lit = F.lit
    part = (F.col("doc_id") % 5).cast("string")
    text = F.concat("text", lit("\n## Setup "), "source", lit('\n<a id="top-'), "lang", lit('"></a>\n### Use {#use-'), "lang", lit("}\n[see](other.md#part-"), part, lit(") and [again](other.md#Part-"), part, lit(")\n**Key**: x"))
    return read(spark, sf, "documents").select("doc_id", text.alias("text"))


@query(f"""WITH t AS (SELECT doc_id, {MARKDOWN} AS text FROM documents), a AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(text, '(?m)^#{{2,6}}\\s+([^{{\\n]+)', 1), lambda x: trim(x)), list_concat(regexp_extract_all(text, '<a id="([^"]+)"', 1), list_concat(regexp_extract_all(text, '\\{{#([A-Za-z0-9_-]+)\\}}', 1), list_concat(regexp_extract_all(text, '\\]\\([^)#]*#([^)]+)\\)', 1), regexp_extract_all(text, '\\*\\*([^*]+)\\*\\*:', 1))))) AS found FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(found, lambda x: lower(x)))), '|') AS anchors FROM a""")
def markdown_anchors(spark, sf):
    """Anchors in five styles (headings, HTML ids, braces, link fragments, bold keys), whatever their case."""
    return marked(spark, sf).select("doc_id", F.array_join(F.sort_array(C.anchors(F.col("text"))), "|").alias("anchors"))


@query("""WITH p AS (SELECT DISTINCT page_id, host, path FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1)) AS path FROM pages) t), c AS (SELECT page_id, CASE WHEN starts_with(path, 'http') THEN 'external' WHEN starts_with(path, '#') THEN 'anchor' WHEN starts_with(path, 'mailto:') THEN 'mail' ELSE 'internal' END AS kind FROM p) SELECT kind, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM c GROUP BY 1""")
def link_targets(spark, sf):
    """Targets of links and media by kind."""
    rows = read(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), F.lit(1)))).alias("path"))
    kind = F.when(F.col("path").startswith("http"), "external").when(F.col("path").startswith("#"), "anchor").when(F.col("path").startswith("mailto:"), "mail").otherwise("internal")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query("""WITH q AS (SELECT item_id, trim(text) AS prompt, 'hint ' || cast(item_id % 3 AS VARCHAR) AS hint, CASE WHEN item_id % 2 = 0 THEN 'previous topic' END AS context, CASE item_id % 4 WHEN 0 THEN ['first rewrite', 'First  Rewrite', 'second'] WHEN 1 THEN ['only one'] WHEN 2 THEN ['a', 'b', 'c', 'd'] ELSE [] END AS rewrites, CASE WHEN item_id % 3 > 0 THEN 'prf term' END AS prf FROM benchmark),
c AS (SELECT item_id, 0 AS pos, 'original' AS kind, 100 AS weight, prompt || chr(10) || chr(10) || hint AS text FROM q UNION ALL SELECT item_id, 1, 'follow_up', 90, 'Previous context: ' || context || chr(10) || 'Current question: ' || prompt FROM q WHERE context IS NOT NULL UNION ALL SELECT item_id, 1 + i, 'rewrite', 80, rewrites[i] FROM (SELECT *, unnest(range(1, len(rewrites) + 1)) AS i FROM q) x UNION ALL SELECT item_id, 100, 'prf', 50, prompt || chr(10) || chr(10) || prf FROM q WHERE prf IS NOT NULL),
u AS (SELECT *, row_number() OVER (PARTITION BY item_id, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) ORDER BY pos) AS copy FROM c WHERE trim(text) <> '')
SELECT item_id, kind, weight, md5(text) AS digest, position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS position FROM u WHERE copy = 1) t WHERE position <= 4""")
def query_candidates(spark, sf):
    """A prompt with its hints, its follow-up form, rewrites and feedback terms: four different ones at most."""
    item = F.col("item_id")
    none = F.array().cast("array<string>")
    words = lambda *xs: F.array(*map(F.lit, xs))
    rows = read(spark, sf, "benchmark").select(
        "item_id", F.trim("text").alias("prompt"), F.array(F.concat(F.lit("hint "), (item % 3).cast("string"))).alias("hints"), F.when(item % 2 == 0, words("previous topic")).otherwise(none).alias("context"),
        F.when(item % 4 == 0, words("first rewrite", "First  Rewrite", "second")).when(item % 4 == 1, words("only one")).when(item % 4 == 2, words("a", "b", "c", "d")).otherwise(none).alias("rewrites"), F.when(item % 3 > 0, words("prf term")).otherwise(none).alias("prf"),
    )
    out = X.candidates(rows, "item_id")
    return out.select("item_id", "kind", "weight", F.md5(F.col("text").cast("binary")).alias("digest"), "position")


@query("""WITH p AS (SELECT item_id, sha1(trim(text) || '#' || CASE WHEN item_id % 2 = 0 THEN 'multi' ELSE 'hyde' END) AS key FROM benchmark), c AS (SELECT sha1(trim(text) || '#multi') AS key, CASE WHEN item_id % 5 = 0 THEN 'broken' ELSE 'ok' END AS state, 'rewritten ' || cast(item_id AS VARCHAR) AS rewrite FROM benchmark)
SELECT item_id, state IS NOT NULL AND state = 'ok' AS hit, CASE WHEN state = 'ok' THEN rewrite END AS rewrite FROM p LEFT JOIN c USING (key)""")
def rewrite_cache(spark, sf):
    """Cached rewrites by the digest of prompt and mode; a broken payload counts as absent."""
    rows = read(spark, sf, "benchmark")
    cache = rows.select(X.cache_key(F.col("text"), F.lit("multi")).alias("key"), F.when(F.col("item_id") % 5 == 0, "broken").otherwise("ok").alias("state"), F.concat(F.lit("rewritten "), F.col("item_id").cast("string")).alias("rewrite"))
    asked = rows.select("item_id", X.cache_key(F.col("text"), F.when(F.col("item_id") % 2 == 0, "multi").otherwise("hyde")).alias("key"))
    return X.cached(asked, cache, F.col("state") == "ok").select("item_id", "hit", "rewrite")


@query(f"""WITH {CTE}, i AS (SELECT doc_id AS doc, CASE WHEN n_chars < 800 THEN 'beginner' WHEN n_chars < 3000 THEN 'intermediate' ELSE 'advanced' END AS difficulty FROM documents), l AS (SELECT *, CASE query % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' ELSE 'advanced' END AS level FROM lex JOIN i USING (doc)),
b AS (SELECT *, rank - CASE WHEN level = 'advanced' THEN 0 WHEN difficulty = level THEN 3 WHEN level = 'intermediate' AND difficulty = 'beginner' THEN 1 ELSE 0 END AS adjusted FROM l) SELECT query, doc, rank, row_number() OVER (PARTITION BY query ORDER BY adjusted, rank) AS final_rank FROM b""")
def difficulty_boost(spark, sf):
    """Hits of a learner's level move up three places; advanced learners keep the order."""
    n = F.col("n_chars")
    level = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.when(n < 800, "beginner").when(n < 3000, "intermediate").otherwise("advanced").alias("difficulty"))
    asked = F.when(F.col("query") % 3 == 0, "beginner").when(F.col("query") % 3 == 1, "intermediate").otherwise("advanced")
    return K.boosted(lexical_hits(spark, sf).join(level, "doc").withColumn("level", asked)).select("query", "doc", "rank", "final_rank")


@query(f"""WITH {CTE}, h AS (SELECT query, doc, rank, coalesce(CASE WHEN doc_id % 6 = 0 THEN NULL ELSE source END, 'general') AS bucket FROM lex JOIN documents ON doc = doc_id) SELECT query, bucket, string_agg(cast(doc AS VARCHAR), ',' ORDER BY rank) AS docs FROM h GROUP BY 1, 2""")
def result_buckets(spark, sf):
    """Hits by learning point; those without one go to a general bucket."""
    info = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 6 != 0, F.col("source")).alias("point"))
    return K.bucketed(lexical_hits(spark, sf).join(info, "doc"), F.col("point"), "general")


WHITELIST = {"src0": ["en", "de"], "src1": ["fr"], "src2": ["es", "en"]}


@query(f"""WITH {CTE}, c(point, category) AS (VALUES ('src0', 'en'), ('src0', 'de'), ('src1', 'fr'), ('src2', 'es'), ('src2', 'en')), w AS (SELECT lex.*, lang, CASE query % 4 WHEN 0 THEN 'src0' WHEN 1 THEN 'src1' WHEN 2 THEN 'src2' ELSE 'other' END AS point FROM lex JOIN documents ON doc = doc_id)
SELECT query, doc, rank FROM w WHERE EXISTS (SELECT 1 FROM c WHERE c.point = w.point AND c.category = w.lang) OR (point = 'other' AND lang = 'en')""")
def category_whitelist(spark, sf):
    """A learning point allows its categories; one that is unknown allows the general one."""
    q = F.col("query") % 4
    hits = lexical_hits(spark, sf).join(read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "lang"), "doc").withColumn("point", F.when(q == 0, "src0").when(q == 1, "src1").when(q == 2, "src2").otherwise("other"))
    return hits.filter(F.array_contains(C.allowed(F.col("point"), WHITELIST, ["en"]), F.col("lang"))).select("query", "doc", "rank")


@query(f"""WITH {CTE}, one AS (SELECT query, doc, 1.0 AS w, rank FROM lex), two AS (SELECT query, doc, 0.8 AS w, row_number() OVER (PARTITION BY query ORDER BY doc) AS rank FROM lex), three AS (SELECT query, doc, 0 AS w, rank FROM lex)
SELECT query, doc, cast(floor(sum(w * 1000 / (60.0 + rank)) * 1000 + 0.5) AS BIGINT) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) x WHERE w > 0 GROUP BY 1, 2""")
def weighted_rankings(spark, sf):
    """Rankings of several forms of one query merged by reciprocal ranks; a weight of 0 takes no part."""
    hits = lexical_hits(spark, sf).select("query", "doc", "rank")
    again = K.ranked(hits.select("query", "doc"), ["query"], [F.asc("doc")])
    every = [hits.withColumn("w", F.lit(1.0)), again.select("query", "doc", "rank").withColumn("w", F.lit(0.8)), hits.withColumn("w", F.lit(0.0))]
    rows = every[0].unionByName(every[1]).unionByName(every[2]).filter("w > 0")
    return rows.groupBy("query", "doc").agg(F.floor(F.sum(F.col("w") * 1000 / (60 + F.col("rank"))) * 1000 + 0.5).cast("long").alias("score"))


@query("""SELECT term, cast(sum(n) AS BIGINT) AS weight FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term, 1 AS n FROM benchmark) t WHERE length(term) > 3 GROUP BY 1 ORDER BY weight DESC, term LIMIT 20""")
def sparse_token_sums(spark, sf):
    """Weights of sparse maps summed by token, the heaviest first."""
    terms = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda t: F.length(t) > 3)
    sparse = F.map_from_entries(F.transform(F.array_distinct(terms), lambda t: F.struct(t, F.size(F.filter(terms, lambda x: x == t)))))
    rows = read(spark, sf, "benchmark").select(F.explode(sparse).alias("term", "w"))
    return rows.groupBy("term").agg(F.sum("w").cast("long").alias("weight")).orderBy(F.desc("weight"), "term").limit(20)


@query("""WITH v AS (SELECT event_id, CASE WHEN user_id IS NULL THEN 'user_id: required' END AS a, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'event_type: not allowed' END AS b, CASE WHEN value < 0 OR value > 95 THEN 'value: out of range' END AS c, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'props.k: not a number' END AS d FROM events)
SELECT event_id, concat_ws('; ', a, b, c, d) AS errors FROM v WHERE concat_ws('; ', a, b, c, d) <> ''""")
def schema_violations(spark, sf):
    """Rows that break a schema, with all their errors by path."""
    v = F.col("value")
    rules = {"user_id": ("required", F.col("user_id").isNull()), "event_type": ("not allowed", ~F.col("event_type").isin("click", "view", "purchase")), "value": ("out of range", (v < 0) | (v > 95)), "props.k": ("not a number", F.get_json_object("props", "$.k").try_cast("long").isNull())}
    return C.violations(read(spark, sf, "events"), rules).select("event_id", "errors")


@query("""WITH e AS (SELECT event_id, props, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, k IS NOT NULL AND k <> '' AS truthy, k = '7' AS equals, contains(coalesce(k, ''), '1') AS holds FROM e""")
def json_assertions(spark, sf):
    """Assertions on JSON paths."""
    check = lambda kind, want=None: C.asserted("props", "$.k", kind, want)
    return read(spark, sf, "events").select("event_id", check("truthy").alias("truthy"), check("equals", "7").alias("equals"), check("contains", "1").alias("holds"))


@query("""WITH y AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 1000 + o_orderkey % 2000 END AS given, year(o_orderdate) AS own, o_custkey FROM orders), v AS (SELECT o_custkey, CASE WHEN given BETWEEN 2000 AND 2100 THEN given ELSE own END AS yr FROM y) SELECT o_custkey, array_to_string(list_sort(list_distinct(list(yr))), ',') AS years FROM v GROUP BY 1""")
def cohort_years(spark, sf):
    """Years of flagged items; an override only counts from 2000 to 2100."""
    given = F.when(F.col("o_orderkey") % 5 == 0, 1000 + F.col("o_orderkey") % 2000)
    yr = F.when(given.between(2000, 2100), given).otherwise(F.year("o_orderdate"))
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set(yr)), ",").alias("years"))


@query("""SELECT row_number() OVER (ORDER BY value NULLS FIRST, event_type, event_id) AS position, event_id FROM events""")
def nulls_first_order(spark, sf):
    """Missing values come before all others. Positions come from counts by value before a window over one value."""
    from sparkloom.operators.ranking import positions

    return positions(read(spark, sf, "events").select("event_id", "value", "event_type"), "value", ["event_type", "event_id"]).select("position", "event_id")


@query("""SELECT conv_id, role, string_agg(substr(text, 1, 10), '|' ORDER BY turn) AS quotes FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) t WHERE r <= CASE WHEN role = 'user' THEN 3 ELSE 2 END GROUP BY 1, 2""")
def capped_quotes(spark, sf):
    """The first three quotes of users and two of others: a report's cap by kind."""
    rows = K.ranked(read(spark, sf, "conversations"), ["conv_id", "role"], [F.asc("turn")], "r").filter(F.col("r") <= F.when(F.col("role") == "user", 3).otherwise(2))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("r", F.substring("text", 1, 10).alias("t")))), lambda x: x["t"])
    return rows.groupBy("conv_id", "role").agg(F.array_join(parts, "|").alias("quotes"))


@query("""WITH m AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations WHERE text IS NOT NULL GROUP BY 1), s AS (SELECT conv_id, texts, list_transform(texts, lambda x: substr(x, 1, 200)) AS cut FROM m), l AS (SELECT conv_id, octet_length(encode(array_to_string(texts, ' '))) AS whole, octet_length(encode(array_to_string(cut, ' '))) AS short, octet_length(encode(array_to_string(cut[1:2], ' '))) AS two FROM s)
SELECT conv_id, CASE WHEN whole <= 600 THEN 'whole' WHEN short <= 600 THEN 'cut' WHEN two <= 600 THEN 'two' ELSE 'none' END AS rung, CASE WHEN whole <= 600 THEN whole WHEN short <= 600 THEN short WHEN two <= 600 THEN two ELSE 0 END AS n_bytes FROM l""")
def byte_budget(spark, sf):
    """Rungs of a ladder: all texts, texts cut short, the first two of those; the first that fits a budget."""
    rows = read(spark, sf, "conversations").filter("text is not null").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    cut = F.transform("texts", lambda x: F.substring(x, 1, 200))
    return C.first_rung(rows, {"whole": F.col("texts"), "cut": cut, "two": F.slice(cut, 1, 2)}, 600).select("conv_id", "rung", "n_bytes")


@query("""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) = 0 THEN 0 ELSE cast(ceil(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) / 400) AS BIGINT) END AS n_chunks, lang AS first FROM documents""")
def token_chunks(spark, sf):
    """Chunks of 400 words of text without sections."""
    words = T.all_matches(F.col("text"), r"[^\x20\x09-\x0D]+")
    return read(spark, sf, "documents").select("doc_id", F.size(C.chunked(words, 400)).cast("long").alias("n_chunks"), F.col("lang").alias("first"))
