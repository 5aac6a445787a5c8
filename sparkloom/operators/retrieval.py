"""Candidate generators. Each gives (query, doc, score, rank) for a set of queries at once.

Query sides are tables of terms or tags; joins on terms are equi joins whose side Spark broadcasts only
under its size threshold. Token sets are taken per document before the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vector as V
from sparkloom.operators.cells import close
from sparkloom.operators.ranking import top_k


def terms(df: DataFrame, key: str, text: Column, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), F.explode(T.retrieval_tokens(text)).alias("term"))


def lexical(queries: DataFrame, docs: DataFrame, fields: dict[str, int], k: int = 20) -> DataFrame:
    """Best k documents by the summed weights of fields that hold a query term. queries: (query, term);
    fields: column -> weight."""
    parts = None
    for name, weight in fields.items():
        own = terms(docs, "doc", F.col(name), "doc").withColumn("weight", F.lit(weight).cast("long"))
        parts = own if parts is None else parts.unionByName(own)
    hits = queries.join(parts, "term").groupBy("query", "doc").agg(F.sum("weight").alias("score"))
    return top_k(hits, ["query"], [F.desc("score"), F.asc("doc")], k)


def sparse(queries: DataFrame, docs: DataFrame, k: int = 100) -> DataFrame:
    """Dot product of term counts. queries: (query, term, weight); docs: (doc, term, weight)."""
    hits = queries.join(docs.withColumnRenamed("weight", "own"), "term").groupBy("query", "doc").agg(F.sum(F.col("weight") * F.col("own")).alias("score"), F.count("*").alias("n_terms"))
    return top_k(hits.filter("score > 0"), ["query"], [F.desc("score"), F.asc("doc")], k)


def dense(queries: DataFrame, docs: DataFrame, k: int = 100) -> DataFrame:
    """Best k by cosine over 0 (quantised). Every query meets every document, a block of queries at a time:
    the queries are a stated set, sent to the documents in rows of up to 1,024 vectors."""
    blocks = queries.withColumn("block", F.floor(F.col("query") / 1024)).groupBy("block").agg(F.collect_list(F.struct("query", "vector")).alias("queries"))
    pairs = docs.crossJoin(blocks.drop("block")).select("doc", F.col("vector").alias("own"), F.explode("queries").alias("q"))
    hits = pairs.select(F.col("q.query").alias("query"), "doc", V.quantised(V.cosine(F.col("q.vector"), F.col("own"))).alias("score"))
    return top_k(hits.filter("score > 0"), ["query"], [F.desc("score"), F.asc("doc")], k)


def by_tags(queries: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """Number of shared tags. queries: (query, tag); docs: (doc, tag)."""
    hits = queries.distinct().join(docs.distinct(), "tag").groupBy("query", "doc").agg(F.count("*").alias("score"))
    return top_k(hits, ["query"], [F.desc("score"), F.asc("doc")], k)


def overlap(queries: DataFrame, docs: DataFrame, percent: int = 34, least: int = 1, k: int = 10) -> DataFrame:
    """Share of the query's terms that a document has, in percent and rounded down; both (key, term)."""
    size = queries.groupBy("query").agg(F.countDistinct("term").alias("size"))
    hits = queries.distinct().join(docs.distinct(), "term").groupBy("query", "doc").agg(F.count("*").alias("shared")).join(size, "query")
    hits = hits.filter((F.col("shared") >= least) & (100 * F.col("shared") >= percent * F.col("size"))).withColumn("score", F.floor(100 * F.col("shared") / F.col("size")).cast("long"))
    return top_k(hits.select("query", "doc", "score"), ["query"], [F.desc("score"), F.asc("doc")], k)


def by_symptom(queries: DataFrame, symptoms: DataFrame, percent: int = 34, least: int = 1, k: int = 10) -> DataFrame:
    """Documents by the symptoms that a query shows. queries: (query, term); symptoms: (symptom, doc, terms), of which those
    count that share enough of their own terms with the query. The higher share comes first, then the larger one, then the
    symptom, then the document; a document counts once."""
    own = symptoms.filter(F.size("terms") > 0).select("symptom", F.size("terms").alias("size"), "terms").distinct()
    hits = queries.distinct().join(own.select("symptom", "size", F.explode("terms").alias("term")), "term").groupBy("query", "symptom", "size").agg(F.count("*").alias("shared"))
    hits = hits.filter((F.col("shared") >= least) & (100 * F.col("shared") >= percent * F.col("size"))).withColumn("share", F.col("shared") / F.col("size"))
    order = [F.desc("share"), F.desc("shared"), F.asc("symptom"), F.asc("doc")]
    # of a query's symptoms the first k are enough, as each has a document
    some = top_k(hits, ["query"], order[:3], k, "place").drop("place").join(symptoms.select("symptom", "doc").distinct(), "symptom")
    best = top_k(some, ["query", "doc"], order[:3], 1, "place").drop("place")
    return top_k(best, ["query"], order, k).select("query", "doc", V.quantised(F.col("share")).alias("score"), "shared", "rank")


def full_text(docs: DataFrame, words: list[str], phrase: bool = False) -> DataFrame:
    """Documents that hold all words, or the words next to each other, as whole folded tokens."""
    tokens = T.fts_tokens(F.col("text"))
    if phrase:
        padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        return docs.filter(padded.contains(" " + " ".join(words) + " "))
    found = docs
    for w in words:
        found = found.filter(F.array_contains(tokens, w))
    return found


def feedback_terms(pseudo: DataFrame, background: DataFrame, originals: DataFrame, k: int = 8, least: int = 2, smooth: float = 1e-6) -> DataFrame:
    """Expansion terms by tf * log(relative frequency ratio). pseudo: (query, term, weight) with weights as counts;
    background: (term, weight); originals: (query, term)."""
    tf = pseudo.groupBy("query", "term").agg(F.sum("weight").alias("tf"))
    tf = tf.withColumn("size", F.sum("tf").over(Window.partitionBy("query")))  # a few documents' terms a query
    corpus = background.groupBy("term").agg(F.sum("weight").alias("cf"))
    total = background.agg(F.sum("weight").alias("total"))
    rows = tf.filter(F.col("tf") >= least).join(corpus, "term", "left").crossJoin(F.broadcast(total)).join(originals.distinct(), ["query", "term"], "left_anti")
    p, q = F.col("tf") / F.col("size"), F.coalesce(F.col("cf"), F.lit(0)) / F.col("total")
    rows = rows.withColumn("score", V.quantised(p * F.ln((p + smooth) / (q + smooth))))
    return top_k(rows.filter("score > 0").select("query", "term", "tf", "score"), ["query"], [F.desc("score"), F.asc("term")], k)


def near_duplicates(vectors: DataFrame, threshold: float, planes: int = 0, bands: int = 1) -> DataFrame:
    """Pairs of one scope with cosine over a threshold. vectors: (doc, scope, vector). Without `planes` every pair of a scope
    is compared (exact), block by block as matrix products. With them, only pairs that fall on the same sides of `planes` random planes in one of `bands` draws: of pairs at cosine c, a share of
    1 - (1 - (1 - acos(c) / pi) ** planes) ** bands is found."""
    if not planes:
        return within_scopes(vectors, threshold)
    unit = vectors.select("doc", "scope", V.normalised(F.col("vector")).alias("v"))
    # Rademacher directions from hashes of (band, plane, place): the same everywhere, and nothing is sent
    side = lambda b, p: F.aggregate(F.transform("v", lambda x, i: F.when(F.xxhash64(F.lit(b), F.lit(p), i) >= 0, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x) >= 0
    signs = lambda b: F.concat(F.lit(f"{b}:"), *(F.when(side(b, p), "1").otherwise("0") for p in range(planes)))
    unit, key = unit.withColumn("cell", F.explode(F.array(*(signs(b) for b in range(bands))))), ["scope", "cell"]
    a = unit.select(*key, F.col("doc").alias("doc_a"), F.col("v").alias("va"))
    b = unit.select(*key, F.col("doc").alias("doc_b"), F.col("v").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    out = a.join(b, key).filter("doc_a < doc_b").withColumn("score", V.quantised(dot)).filter(F.col("score") >= int(threshold * 1_000_000))
    return out.select("doc_a", "doc_b", "scope", "score").distinct()


#: Vectors of a block at most, of which pairs of blocks are compared within a scope.
SCOPE_BLOCK = 4096


def within_scopes(vectors: DataFrame, threshold: float, block: int = SCOPE_BLOCK) -> DataFrame:
    """(doc_a, doc_b, scope, score) of all pairs of one scope, doc_a < doc_b. A scope's vectors are dealt into blocks of about
    `block`; pairs of blocks are compared as matrix products, each in one place, so a task holds two blocks whatever a scope's
    size, and a vector is sent once for each block of its scope. Vectors of other lengths, with nulls or without direction are near to nothing."""
    rows = vectors.filter(F.col("scope").isNotNull() & F.col("doc").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    rows = rows.select(F.col("doc").cast("long").alias("doc"), "scope", "vector", F.size("vector").alias("dim"))
    sizes = rows.groupBy("scope", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("n"), F.count("*").alias("size")).filter("size > 1").drop("size")
    own = F.pmod(F.xxhash64("doc"), F.col("n")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = rows.join(sizes, ["scope", "dim"]).withColumn("own", own).withColumn("at", F.explode(places)).select("scope", "dim", "at.i", "at.j", "doc", "own", "vector")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        scope, dim, i, j = key
        docs, own = table["doc"].to_numpy(), table["own"].to_numpy()
        v = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim.as_py())
        v = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
        a, b = np.flatnonzero(own == i.as_py()), np.flatnonzero(own == j.as_py())
        x, y, score = close(v[a], v[b], threshold)
        x, y = docs[a][x], docs[b][y]
        fit = x < y if i == j else x != y
        low, high = np.minimum(x, y)[fit], np.maximum(x, y)[fit]
        return pa.table({"doc_a": pa.array(low), "doc_b": pa.array(high), "scope": pa.repeat(scope, len(low)), "score": pa.array(score[fit])})

    kind = vectors.schema["scope"].dataType.simpleString()
    return dealt.groupBy("scope", "dim", "i", "j").applyInArrow(compare, f"doc_a long, doc_b long, scope {kind}, score long")
