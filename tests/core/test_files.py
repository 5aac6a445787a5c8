"""Readers, index builds, sinks and model hooks on small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import models
from sparkloom.operators import retrieval
from sparkloom.sources import files, logs

ITEM = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_api_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([[{"id": 1, "name": "x"}], [{"id": 2}, {"id": 3}]]))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 4, "name": "y"}]))
    assert sorted(r.id for r in files.api_pages(spark, str(tmp_path), ITEM).collect()) == [1, 2, 3, 4]


def test_strict_lines_fail(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": 1}\n')
    assert [r.id for r in files.strict_jsonl(spark, str(tmp_path / "t.jsonl"), ITEM).collect()] == [1]
    (tmp_path / "t.jsonl").write_text('{"id": 1}\nbroken\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.strict_jsonl(spark, str(tmp_path / "t.jsonl"), ITEM).collect()


def test_cohort_checks(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"query_count": 2, "queries": [{"id": 1}, {"id": 2}]}))
    assert files.cohort(spark, str(p), ITEM, "id").count() == 2
    for bad in ({"query_count": 3, "queries": [{"id": 1}, {"id": 2}]}, {"query_count": 2, "queries": [{"id": 1}, {"id": 1}]}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.cohort(spark, str(p), ITEM, "id")


def test_legacy_chunks(spark):
    rows = spark.createDataFrame([(2, '["a", "b"]'), (1, "no list"), (3, None)], "id long, anchors string")
    assert [(r.id, r.anchors) for r in files.legacy_chunks(rows).collect()] == [(1, []), (2, ["a", "b"]), (3, [])]


def test_junit(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<testsuite><testcase classname="A" name="ok"/><testcase classname="A" name="bad"><failure message="boom">trace</failure></testcase><testcase classname="B" name="err"><error>why</error></testcase></testsuite>')
    got = {r.name: (r.suite, r.passed, r.message) for r in files.junit(spark, str(tmp_path / "r.xml")).collect()}
    assert got == {"ok": ("A", True, None), "bad": ("A", False, "boom"), "err": ("B", False, "why")}


def test_markdown_links_and_lists(spark):
    text = "[a](x.md) and `[no](y.md)`\n```\n[no](z.md)\n```\n[b](w.md#part)\n"
    head = '---\ntitle: T\naliases: [one, "two"]\nsymptoms:\n  - first \\"x\\"\n  - second\n---\nbody'
    row = spark.createDataFrame([(text, head)], "t string, h string").select(files.markdown_links(F.col("t")).alias("l"), files.front_matter_lists(F.col("h")).alias("m"), files.front_matter_lists(F.col("t")).alias("n")).first()
    assert row.l == ["x.md", "w.md#part"] and row.n is None
    assert row.m == {"aliases": ["one", "two"], "symptoms": ['first "x"', "second"]}


def test_index_with_manifest(spark, tmp_path):
    path = str(tmp_path / "index")
    assert files.load_index(spark, path, {}) is None
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, h string")
    files.build_index(old, path, {"corpus": "v1", "kind": "lexical"})
    assert files.load_index(spark, path, {"corpus": "v1", "kind": "lexical"}).count() == 3
    with pytest.raises(ValueError, match="corpus"):
        files.load_index(spark, path, {"corpus": "v2", "kind": "lexical"})
    old.limit(1).write.mode("append").parquet(path + "/rows")
    with pytest.raises(ValueError, match="row_count"):
        files.load_index(spark, path, {"corpus": "v1"})
    fresh, index = files.updated_index(old, spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "id long, h string"), "id", "h")
    assert sorted((r.id, r.h) for r in fresh.collect()) == [(3, "x"), (4, "d")]
    assert sorted((r.id, r.h) for r in index.collect()) == [(2, "b"), (3, "x"), (4, "d")]
    assert files.updated_index(old, old, "id", "h")[0].count() == 0


def test_replace_and_run_log(spark, tmp_path):
    path = str(tmp_path / "state")
    for n in (1, 2):
        files.replaced(spark.createDataFrame([(n,)], "n long"), path)
        assert [r.n for r in spark.read.json(path).collect()] == [n]
    log = str(tmp_path / "log")
    files.run_logged(spark, log, "r1", lambda: 5)
    with pytest.raises(RuntimeError):
        files.run_logged(spark, log, "r2", lambda: (_ for _ in ()).throw(RuntimeError("lost")))
    got = sorted((r.run_id, r.state, r.n) for r in spark.read.json(log).select("run_id", "state", "n").collect())
    assert got == [("r1", "finished", 5), ("r1", "started", None), ("r2", "failed", None), ("r2", "started", None)]


def test_appended_logs_and_ties(spark, tmp_path):
    rows = spark.createDataFrame([("v1", "good", "r1"), ("v1", "odd", "r1"), ("v2", "good", "r2")], "schema_id string, signal string, repo string")
    logs.append(rows, [str(tmp_path / "all")])
    logs.append(rows, [str(tmp_path / "by")], ["repo"])
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.name.startswith("repo")) == ["repo=r1", "repo=r2"]
    assert logs.log_rows(spark, str(tmp_path / "all"), rows.schema, "v1", "signal", ["good", "bad"]).count() == 1
    old = spark.createDataFrame([(1, 1, "old")], "k long, v long, s string")
    new = spark.createDataFrame([(1, 1, "a"), (1, 1, "b")], "k long, v long, s string")
    assert {logs.upserted(old, new.repartition(n), ["k"], "v").first().s for n in (1, 3)} == {"b"}


def test_packet(spark):
    row = spark.createDataFrame([("T", ["a\nb", "c"], ["u"])], "t string, q array<string>, l array<string>").select(files.packet(F.col("t"), F.col("q"), F.col("l")).alias("p")).first()
    assert row.p == "## T\n\n> a\n> b\n\n> c\n\n- u"


def test_models(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, None), (3, "gamma")], "doc long, text string").repartition(2)
    got = {r.doc: r.e for r in df.select("doc", models.encoder(models.HashEncoder)(F.col("text")).alias("e")).collect()}
    assert got[1].sparse == {"alpha": 1.0, "beta": 2.0} and abs(sum(x * x for x in got[1].dense) - 1) < 1e-6 and got[2].sparse == {}
    hits = spark.createDataFrame([(1, 10, 1, "red", "blue"), (1, 11, 2, "red", "red x"), (1, 12, 3, "red", "red")], "query long, doc long, rank long, q string, p string")
    scored = hits.withColumn("model", models.reranker(models.OverlapReranker)(F.col("q"), F.col("p")))
    assert [(r.doc, r.final_rank) for r in models.reranked(scored, F.col("model"), 2).orderBy("final_rank").collect()] == [(10, 1), (11, 2), (12, 3)]
    cut = df.filter("doc = 1").select(models.morphemes(lambda: str.split)(F.col("text")).alias("m"), models.sparse_weights(F.lit("a"), {"a": 2.0}).alias("w"), models.sparse_weights(F.lit("z"), {"a": 2.0}).alias("none")).first()
    assert cut.m == ["alpha", "beta", "beta"] and (cut.w, cut.none) == (2.0, 0.0)
    found = models.searched(lambda q: q.select("query", F.lit(5).alias("doc"), F.lit(1.0).alias("score")), spark.createDataFrame([(1,), (2,)], "query long"), 1)
    assert sorted((r.query, r.doc, r.rank) for r in found.collect()) == [(1, 5, 1), (2, 5, 1)]

    def short(f):
        return f.filter(F.length("text") < 3).select("path", F.lit("too short").alias("message"))

    def untitled(f):
        return f.filter(~F.col("text").startswith("#")).select("path", F.lit("no title").alias("message"))

    notes = models.linted(spark.createDataFrame([("a", "# x"), ("b", "y")], "path string, text string"), [short, untitled])
    assert sorted((r.path, r.rule) for r in notes.collect()) == [("b", "short"), ("b", "untitled")]


def test_near_duplicates_by_planes_recall(spark):
    """Candidates by random planes against all pairs."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.lit(0).alias("scope"), F.col("embedding").alias("vector"))
    turned = F.transform("vector", lambda x, i: x.cast("double") + F.when(i % 7 == 0, 0.01).otherwise(0.0))
    every = rows.withColumn("vector", F.col("vector").cast("array<double>")).unionByName(rows.select((F.col("doc") + 100_000).alias("doc"), "scope", turned.alias("vector")))
    exact, near = (retrieval.near_duplicates(every, 0.92, **kw).select("doc_a", "doc_b").collect() for kw in ({}, {"planes": 8, "bands": 10}))
    exact, near = set(map(tuple, exact)), set(map(tuple, near))
    assert exact and near <= exact and len(near) >= 0.9 * len(exact)
