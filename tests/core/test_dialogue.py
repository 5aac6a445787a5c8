"""Rules over prompts, profiles and runs on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from sparkloom.functions import corpus as C
from sparkloom.functions import dialogue as D
from sparkloom.operators import expansion, profile, reports, routing


def test_prompt_rules(spark):
    rows = [(1, "DI가 뭐야"), (2, "urban di_x"), (3, "사이클 2 step3 2단계"), (4, "그럼 IoC는?"), (5, "then why"), (6, "점수는 10점, 7 아님"), (7, "1234 5x")]
    t = F.col("t")
    df = spark.createDataFrame(rows, "i int, t string").select("i", D.mentioned(t, ["di"]).alias("di"), D.stage_numbers(t).alias("n"), D.is_follow_up(t).alias("f"), D.self_score(t).alias("s"), D.dataset_language(t).alias("l"), D.first_rule(t, D.INTENT_PATTERNS).alias("k"))
    got = {r.i: r for r in df.collect()}
    assert (got[1].di, got[2].di) == (1, 0) and got[3].n == ["2", "3"] and D.stage_variants is not None
    assert [got[i].f for i in (1, 4, 5)] == [False, True, True]
    assert (got[6].s, got[7].s) == (10, 5) and (got[1].l, got[2].l, got[7].l) == ("ko", "en", "en") and got[1].k == "definition"


def test_router_goes_by_rank_of_signals(spark):
    words = {"definition": ["what is"], "depth": ["vs"], "study": ["learn"], "domain": ["lock"], "learning": ["spring"], "coach": ["review my pr"], "tool": ["gradle"], "skip": ["no search"], "force_coach": ["coach mode"], "full": ["search deep"], "some": ["search"]}
    cases = [("no search: what is a lock", 0, 100), ("what is a lock", 1, 75), ("learn spring", 1, 72), ("lock vs latch", 2, 85), ("what is a lock vs a latch", 2, 80), ("gradle fails", 0, 85), ("review my pr", 3, 95), ("lunch", 0, 60), ("search lunch", 1, 100), ("search deep", 2, 100), ("gradle lock", 0, 40)]
    df = spark.createDataFrame([(p,) for p, *_ in cases], "p string")
    got = {r.p: r for r in routing.with_confidence(routing.routed(df, "p", words, F.lit(False), F.lit(False))).collect()}
    assert {p: (got[p].tier, got[p].confidence) for p, *_ in cases} == {p: (t, c) for p, t, c in cases}
    assert got["gradle lock"].fallback and not got["lunch"].fallback
    soft = routing.with_confidence(routing.routed(df.filter("p = 'what is a lock'"), "p", words, F.lit(True), F.lit(True))).first()
    assert (soft.tier, soft.promoted, soft.confidence) == (2, True, 70)
    assert routing.routed(df.filter("p = 'review my pr'"), "p", words, F.lit(True), F.lit(False)).first().mode == "blocked"


def test_answers_and_flags(spark):
    answer = "because it is internally ordered, for example in production a rollback of the lock takes time"
    row = spark.createDataFrame([(answer, ["lock", "Order"], ["a"], ["b"])], "t string, e array<string>, x array<string>, d array<string>")
    d = row.select(*(c.alias(n) for n, c in D.drill_dimensions(F.col("t"), F.col("e")).items()), D.quality_flags(F.col("t"), F.col("x"), F.col("d"), longest=50, header=True).alias("flags")).first()
    assert (d.accuracy, d.depth, d.practicality, d.completeness) == (2, 2, 2, 1)
    assert d.flags == ["citation_mismatch", "missing_rag_header", "overlong_answer"]


def test_profile_rules(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(1, i, day(i), t, 4, 0, 2, 1, f"c{i % 2}") for i, t in enumerate([5, 9, 2, 8, 3, 9], 1)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, total long, accuracy long, depth long, practicality long, completeness long, category string")
    v = profile.drill_view(df).first()
    assert (v.points, v.n, v.level, v.weak, v.low) == (31, 5, "L3", "depth", "c1")
    due = profile.earliest_due(df, F.lit("2024-01-09").cast("timestamp_ntz")).first()
    assert (due.event_id, due.due) == (2, day(5))
    c = spark.createDataFrame([("a/b", 1), ("a/b-c", 2), ("a/bc", 3), ("x/b-c", 4), ("a", 5)], "c string, i int")
    assert {r.i: r.d for r in c.select("i", profile.family_delta(F.col("c"), ["a/b"], ["a"]).alias("d")).collect()} == {1: -15, 2: -15, 3: 0, 4: 0, 5: 10}
    assert profile.both_ways(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "x string, y string")).groupBy("added").count().count() == 2


def test_expansion_keeps_four_different_forms(spark):
    df = spark.createDataFrame([(1, "p", ["h"], ["c"], ["R one", "r  ONE", "two", "three"], ["t"]), (2, "p", [], [], [], [])], "id long, prompt string, hints array<string>, context array<string>, rewrites array<string>, prf array<string>")
    got = {}
    for r in expansion.candidates(df, "id").orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.kind, r.text))
    assert got[1] == [("original", "p\n\nh"), ("follow_up", "Previous context: c\nCurrent question: p"), ("rewrite", "R one"), ("rewrite", "two")]
    assert got[2] == [("original", "p")]


def test_reports(spark):
    sweep = spark.createDataFrame([(1, 0, 0, 4), (2, 3, 1, 1), (3, 3, 1, 1), (4, 4, 6, 0)], "threshold long, tp long, fp long, fn long")
    assert {r.threshold: (r.f1, r.recommended) for r in reports.recommended(sweep).collect()} == {1: (0, False), 2: (750_000, True), 3: (750_000, False), 4: (571_428, False)}
    p = reports.interpolated(spark.createDataFrame([("a", float(i)) for i in (1, 2, 3, 4, 5)], "k string, v double"), "k", "v").first()
    assert (p.p50, p.p95, p.n) == (3.0, 4.8, 5)
    v = C.violations(spark.createDataFrame([(1, None), (2, "x")], "i int, s string"), {"s": ("required", F.col("s").isNull())}).collect()
    assert [(r.i, r.errors) for r in v] == [(1, "s: required")]
