"""Text queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import postings as P
from sparkloom.plans import indexes
from sparkloom.plans.base import query, read

TERM = T.RETRIEVAL_TOKEN
WORDS = r"[\p{L}\p{N}]+"
FOLD = "translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
PADDED = f"' ' || array_to_string(regexp_extract_all({FOLD}, '{WORDS}'), ' ') || ' '"


@query(f"SELECT doc_id, source FROM documents WHERE {PADDED} LIKE '% the %' AND {PADDED} LIKE '% and %'")
def fts_match_and(spark, sf):
    return P.matching(indexes.words(spark, sf), ["the", "and"]).select(F.col("doc").alias("doc_id"), "source")


@query(f"SELECT doc_id, source FROM documents WHERE {PADDED} LIKE '% of the %'")
def fts_phrase(spark, sf):
    return P.matching(indexes.words(spark, sf), ["of", "the"], phrase=True).select(F.col("doc").alias("doc_id"), "source")


@query(f"SELECT source, count(*) AS n FROM documents WHERE {PADDED} LIKE '% license %' GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def fts_top_paths(spark, sf):
    return P.matching(indexes.words(spark, sf), ["license"]).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query(f"""SELECT item_id, count(DISTINCT t) AS n_terms, string_agg(DISTINCT t, ',' ORDER BY t) AS terms FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS t FROM benchmark) x WHERE length(t) >= 2 GROUP BY 1""")
def query_plan_terms(spark, sf):
    t = T.retrieval_tokens(F.col("text"))
    return read(spark, sf, "benchmark").select("item_id", F.size(t).cast("long").alias("n_terms"), F.array_join(F.sort_array(t), ",").alias("terms")).filter("n_terms > 0")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') AND regexp_matches(text, '[A-Za-z]{2,}') THEN 'mixed' WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM documents""")
def language_detect(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.query_language(F.col("text")).alias("language"))


@query("SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normal, sha1(trim(text, E' \\t\\n\\r\\f\\v')) AS digest FROM benchmark")
def query_normalise(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", T.normalise_query(F.col("text")).alias("normal"), T.trimmed_sha1(F.col("text")).alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) SELECT doc_id, count(*) AS n FROM (SELECT doc_id, p FROM l WHERE length(p) >= 80 GROUP BY doc_id, p HAVING count(*) > 1) t GROUP BY 1""")
def duplicate_text_docs(spark, sf):
    """Paragraphs of 80 characters and more that a document repeats."""
    long = F.filter(F.split("text", "\n"), lambda p: F.length(p) >= 80)
    counts = F.size(F.filter(F.array_distinct(long), lambda p: F.size(F.array_remove(long, p)) < F.size(long) - 1))
    return read(spark, sf, "documents").select("doc_id", counts.cast("long").alias("n")).filter("n > 0")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) > 6000 THEN 'long' END, CASE WHEN text NOT LIKE '%.%' THEN 'no_sentence' END, CASE WHEN regexp_matches(text, '[0-9a-f]{32,}') THEN 'token' END,
CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') THEN 'email' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents""")
def quality_flags(spark, sf):
    t = F.col("text")
    flags = F.array_compact(F.array(F.when(F.length(t) > 6000, "long"), F.when(~t.contains("."), "no_sentence"), F.when(t.rlike("[0-9a-f]{32,}"), "token"), F.when(t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "email")))
    return read(spark, sf, "documents").select("doc_id", F.array_join(flags, ",").alias("flags"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text || CASE WHEN lang <> 'en' THEN ' Password: pw' || doc_id || ' end' ELSE '' END, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '[0-9a-f]{32,}', '[token]', 'g'), '(?i)(password|passwd|pwd)\s*[=:]\s*[^\s]+', '\1=[secret]', 'g')) AS clean FROM documents""")
def redaction(spark, sf):
    """All three rules over all documents; some get a password beside those that have one."""
    planted = F.concat("text", F.when(F.col("lang") != "en", F.concat(F.lit(" Password: pw"), F.col("doc_id").cast("string"), F.lit(" end"))).otherwise(""))
    return read(spark, sf, "documents").select("doc_id", F.md5(T.redact(planted)).alias("clean"))


@query("""SELECT t AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣]+')) AS t FROM documents) x GROUP BY 1 ORDER BY n DESC, term LIMIT 50""")
def token_match_topn(spark, sf):
    return read(spark, sf, "documents").select(F.explode(T.feedback_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query("""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"#]*)"', 1)) AS link FROM pages) t GROUP BY 1, 2""")
def html_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"#]*)"'), F.lit(1))
    return read(spark, sf, "pages").select("page_id", F.explode(links).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_replace(regexp_replace(lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^a-z0-9가-힣 _-]', '', 'g'), ' +', '-', 'g') AS slug FROM pages""")
def heading_slugs(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.heading_slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("""WITH t AS (SELECT conv_id, turn, length(text) >= 20 AS a, text NOT LIKE '%?%' AS b, text NOT LIKE '%why%' AS c, len(list_distinct(regexp_extract_all(lower(text), '[0-9a-z_]+'))) >= 5 AS d FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, cast(a AS BIGINT) + cast(b AS BIGINT) + cast(c AS BIGINT) + cast(d AS BIGINT) AS signals, cast(a AS BIGINT) + cast(b AS BIGINT) + cast(c AS BIGINT) + cast(d AS BIGINT) >= 3 AS is_answer FROM t""")
def answer_scoring(spark, sf):
    t = F.col("text")
    distinct = F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[0-9a-z_]+"), F.lit(0))))
    signals = sum((c.cast("long") for c in (F.length(t) >= 20, ~t.contains("?"), ~t.contains("why"), distinct >= 5)), F.lit(0).cast("long"))
    return read(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", signals.alias("signals"), (signals >= 3).alias("is_answer"))
