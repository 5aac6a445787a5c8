"""Operators on small hand-made tables, readers, and streams."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import text, vector
from sparkloom.operators import evaluation, history, ranking
from sparkloom.sources import logs
from sparkloom.streaming import events


def test_hangul_text(spark):
    df = spark.createDataFrame([("트랜잭션 isolation", 1), ("트랜잭션은 무엇", 2), ("plain words", 3), ("12 !", 4)], "t string, n int")
    got = {r.n: r for r in df.select("n", text.query_language(F.col("t")).alias("l"), text.retrieval_tokens(F.col("t")).alias("k")).collect()}
    assert [got[i].l for i in (1, 2, 3, 4)] == ["mixed", "ko", "en", "unknown"]
    assert got[1].k == ["트랜잭션", "isolation"] and got[4].k == ["12"]
    row = spark.createDataFrame([("déjà vu", "a b@c.de x", " Ab  Cd ")], "a string, b string, c string").select(text.fts_tokens(F.col("a")).alias("a"), text.redact(F.col("b")).alias("b"), text.normalise_query(F.col("c")).alias("c"), text.clip(F.col("c"), 4).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (["deja", "vu"], "a [email] x", "ab cd", "A...")


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>").select(*(vector.cosine(F.col("a"), F.col(c)).alias(f"to_{c}") for c in ("a", "b", "z", "s")), vector.normalised(F.col("z")).alias("n")).first()
    assert abs(row.to_a - 1) < 1e-9 and abs(row.to_b - 0.5**0.5) < 1e-9 and row.to_z == 0 and row.to_s == 0 and row.n == [0.0, 0.0]


def test_fusion_skips_weightless_sources(spark):
    df = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (1, 11, 1, "off")], "query long, doc long, rank long, source string")
    rows = ranking.rrf(df, {"a": 1.0, "b": 0.5, "off": 0.0}).collect()
    assert len(rows) == 1 and rows[0].sources == "a,b" and abs(rows[0].score - (1 / 61 + 0.5 / 62)) < 1e-9


def test_refusal_keeps_equal_scores(spark):
    df = spark.createDataFrame([(1, 10, 4, 1), (2, 11, 3, 1)], "query long, doc long, score long, rank long")
    assert {(r.query, r.doc) for r in ranking.refused(df, 4).collect()} == {(1, 10), (2, -1)}


def test_forbidden_never_drops_the_first(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query long, doc long, rank long")
    edges = spark.createDataFrame([(10, 10), (10, 12)], "doc long, other long")
    assert {r.doc for r in ranking.without_forbidden(hits, edges).collect()} == {10, 11}


def test_ndcg_of_the_ideal_order(spark):
    ranking_ = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 2, 1)], "query long, doc long, rank long")
    judged = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (2, 1, 3), (2, 2, -1)], "query long, doc long, grade int")
    got = {r.query: r for r in evaluation.metrics(ranking_, judged).collect()}
    assert got[1].ndcg == 1_000_000 and got[1].mrr == 1_000_000 and got[1].companion == 1_000_000
    assert got[2].hit == 0 and got[2].mrr == 0 and got[2].forbidden == 100_000


def test_changes_and_difference(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, "b"), (2, 1, None)], "k long, t long, v string")
    assert {(r.k, r.t) for r in history.changes(df, ["k"], [F.asc("t")], "v").collect()} == {(1, 1), (1, 3), (1, 4), (2, 1)}
    old, new = (spark.createDataFrame(x, "id long, h string") for x in ([(1, "a"), (2, "b"), (3, "c")], [(2, "b"), (3, "x"), (4, "d")]))
    assert {r.id: r.state for r in history.difference(old, new, "id", "h").collect()} == {1: "deleted", 2: "unchanged", 3: "modified", 4: "added"}


def test_logs(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"id": 1, "signal": "good"}\n\nnot json\n{"id": 2, "signal": "odd"}\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("signal", T.StringType())])
    assert [r.id for r in logs.jsonl(spark, str(p), schema, F.col("signal").isin("good", "bad")).collect()] == [1]
    assert logs.jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    for name, body in (("a", json.dumps([{"id": 1}, {"id": 2}])), ("b", json.dumps({"queries": [{"id": 1}, {"id": 2}]})), ("c", '{"id": 1}\n{"id": 2}\n')):
        (tmp_path / name).write_text(body)
        assert [r.id for r in logs.fixture(spark, str(tmp_path / name), schema).collect()] == [1, 2]
    rows = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "id long, v long, s string")
    new = spark.createDataFrame([(2, 2, "z"), (3, 1, "w")], "id long, v long, s string")
    assert {(r.id, r.s) for r in logs.upserted(rows, new, ["id"], "v").collect()} == {(1, "x"), (2, "z"), (3, "w")}


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ntitle: "T"\nlevel: null\n---\nintro\n## One\ntext\n```\n## no\n```\n## Two\nmore\n')
    got = sorted((r.section, r.title) for r in logs.markdown(spark, str(tmp_path)).collect())
    assert got == [(0, None), (1, "One"), (2, "Two")]
    row = spark.read.text(str(tmp_path / "a.md"), wholetext=True).select(logs.front_matter(F.col("value")).alias("m"), logs.front_matter(F.lit("none")).alias("n")).first()
    assert row.m == {"title": "T", "level": None} and row.n is None


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "open"), (1, "2024-01-01 00:00:00", 1, "open"), (2, "2024-01-01 00:10:00", 1, "close"), (3, "2024-01-01 02:00:00", 2, "open"), (4, "2024-01-05 02:00:00", 2, "close")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "to_timestamp(ts) ts", "user_id", "event_type", "0.0D value", "'{}' props")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = events.source(spark, str(tmp_path / "in"))
    assert events.drained(events.deduplicated(src), "once", str(tmp_path / "c1")).count() == 4
    pairs = events.drained(events.paired(src, "open", "close"), "pairs", str(tmp_path / "c2")).collect()
    assert [(r.user_id, r.opened, r.closed, r.waited) for r in pairs] == [(1, 1, 2, 600.0)]
    # a session is out once the watermark, an hour behind 5 January, has passed its end
    sessions = events.drained(events.sessions(src), "sess", str(tmp_path / "c3"), "append").collect()
    assert sorted((r.user_id, str(r.start), str(r.end), r.n) for r in sessions) == [(1, "2024-01-01 00:00:00", "2024-01-01 00:40:00", 3), (2, "2024-01-01 02:00:00", "2024-01-01 02:30:00", 1)]
    repeats = events.drained(events.repeats(src), "rep", str(tmp_path / "c4"), "complete").collect()
    # each event lies in seven windows of seven days that slide by a day; the repeated one counts twice in each
    assert sorted((r.user_id, r.event_type, r.n) for r in repeats) == sorted([(1, "open", 2)] * 7 + [(1, "close", 1)] * 7 + [(2, "open", 1)] * 7 + [(2, "close", 1)] * 7)


def test_profiles_are_rebuilt_for_users_with_news(spark, tmp_path):
    row = lambda i, u: (i, "2024-01-01 00:00:00", u, "open")
    write = lambda rows: spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "to_timestamp(ts) ts", "user_id", "event_type", "0.0D value", "'{}' props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    profile = lambda e: e.groupBy("user_id").agg(F.count("*").alias("n"))
    for rows in ([row(1, 1), row(2, 2)], [row(3, 1)]):
        write(rows)
        events.rebuilt(events.source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), profile)
    got = sorted((r.batch, r.user_id, r.n) for r in spark.read.parquet(str(tmp_path / "out/profiles")).collect())
    assert got == [(0, 1, 1), (0, 2, 1), (1, 1, 2)]
