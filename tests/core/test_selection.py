"""Sets of retrievers, and the choice among runs, against plain Python."""

import itertools
import random

import pytest

from sparkloom.operators import selection as S

RUN = "name string, gain long, mb long, p95 long"


def preferred(a, b, tolerance=20_000):
    """The comparator of two runs (name, gain, mb, p95): whether a comes first."""
    if abs(a[1] - b[1]) < tolerance:
        if a[2] != b[2]:
            return a[2] < b[2]
        if a[3] != b[3]:
            return a[3] < b[3]
        return a[1] > b[1] if a[1] != b[1] else a[0] < b[0]
    return a[1] > b[1]


def dominated(a, rows):
    return any(b[1] >= a[1] and b[2] <= a[2] and b[3] <= a[3] and (b[1] > a[1] or b[2] < a[2] or b[3] < a[3] or b[0] < a[0]) for b in rows if b != a)


def random_runs(seed, n, wide):
    rng = random.Random(seed)
    return [(f"r{i:04d}", rng.randrange(0, 400_000, 5_000), rng.randrange(wide), rng.randrange(wide)) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "wide"), [(1, 400, 30), (2, 60, 3), (3, 300, 2000), (4, 2, 2), (5, 1, 2)])
def test_preferences(spark, seed, n, wide):
    rows = random_runs(seed, n, wide)
    left = [a for a in rows if not dominated(a, rows)]
    wins = {a[0]: sum(preferred(a, b) for b in left if b != a) for a in left}
    order = sorted(wins, key=lambda x: (-wins[x], x))
    df = spark.createDataFrame([*rows, ("null", None, 1, 1)], RUN).repartition(7)
    got = S.preferences(df).orderBy("position").collect()
    assert [(r.name, r.wins) for r in got] == [(x, wins[x]) for x in order]


def test_dominance_is_preference():
    """Whatever is left out loses against what dominates it, on all pairs."""
    rows = random_runs(9, 120, 4)
    for a, b in itertools.permutations(rows, 2):
        if b[1] >= a[1] and b[2] <= a[2] and b[3] <= a[3] and (b[1:] != a[1:] or b[0] < a[0]):
            assert preferred(b, a)
        assert preferred(a, b) != preferred(b, a)


def test_no_candidates(spark):
    assert S.preferences(spark.createDataFrame([], RUN)).count() == 0
    assert S.best_run(spark.createDataFrame([], "name string, n int, gain long, failures long, p95 long")).count() == 0


def test_sets(spark):
    names = spark.createDataFrame([("b",), ("a",), ("c",), ("d",), ("a",)], "name string")
    assert sorted(r.run for r in S.modality_sets(names).collect()) == ["a", "a,b", "a,b,c,d", "a,c", "a,d", "b", "b,c", "b,d", "c", "c,d", "d"]
    assert [r.run for r in S.modality_sets(names.filter("name = 'a'")).collect()] == ["a"] and S.modality_sets(names.filter("name = 'z'")).count() == 0


def test_best_and_preferred(spark):
    runs = spark.createDataFrame([("b", 2, 9, 1, 5), ("a", 2, 9, 1, 5), ("c", 1, 9, 1, 5), ("d", 1, 9, 0, 99), ("e", 1, 8, 0, 1)], "name string, n int, gain long, failures long, p95 long")
    assert S.best_run(runs).first().name == "d" and S.best_run(runs.filter("name <> 'd'")).first().name == "c"
    wanted = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert S.preferred_run(runs, wanted("e")).first().name == "e" and S.preferred_run(runs, wanted("z")).first().name == "a"


def test_cutover(spark):
    buckets = [("old", "lang", "ko", 500_000), ("new", "lang", "ko", 480_000), ("old", "lang", "en", 1), ("new", "lang", "de", 5)]
    b = spark.createDataFrame(buckets, "run string, axis string, bucket string, gain long")
    runs = lambda new: spark.createDataFrame([("old", 10), ("new", new)], "name string, gain long")
    got = {r.bucket: r for r in S.cutover(b, runs(9), "old", "new").collect()}
    assert got["ko"].regressed and not got["en"].regressed and got["de"].delta is None and not got["ko"].passed
    assert S.cutover(b, runs(10), "old", "new").first().passed
    assert S.cutover(b.filter("bucket <> 'ko'"), runs(9), "old", "new").first().passed


def test_failure_classes(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query long, doc long, rank int")
    judged = spark.createDataFrame([(q, 10 * q) for q in range(1, 6)], "query long, doc long")
    kinds = spark.createDataFrame([(d, "x" if d < 100 else "y") for d in [10, 20, 30, 40, 50, 11, 12, 100]], "doc long, category string")
    new = hits([(1, 10, 1), (2, 100, 1), (2, 20, 2), (3, 11, 1), (3, 30, 4), (4, 12, 1)])
    old = hits([(1, 11, 1), (1, 10, 2), (2, 20, 1), (3, 30, 4), (4, 40, 20), (5, 50, 21)])
    got = {r.query: (r["class"], r.better) for r in S.failure_classes(new, old, judged, kinds).collect()}
    assert got == {1: ("pass_rank1", "new"), 2: ("top1_cross_category", "old"), 3: ("same_category_wrong_rank", "tie"), 4: ("primary_missing_top_k", "old"), 5: ("primary_missing_top_k", "tie")}


def test_fused_runs_and_gains(spark):
    hits = spark.createDataFrame([(1, "a", 7, 1), (1, "a", 8, 2), (1, "b", 8, 1), (2, "b", 9, 1)], "query long, name string, doc long, rank int")
    sets = S.modality_sets(hits.select("name"))
    ranking = S.fused_runs(hits, sets)
    got = {(r.query, r.run, r.doc): (r["rank"], r.candidates) for r in ranking.collect()}
    assert got[1, "a,b", 8] == (1, 2) and got[1, "a,b", 7] == (2, 2) and got[1, "a", 7] == (1, 2) and (2, "a", 9) not in got
    judged = spark.createDataFrame([(1, 7, 3), (1, 8, -1), (2, 9, 3), (3, 1, 1)], "query long, doc long, grade int")
    rows = {(r.query, r.run): (r.primary_ndcg, r.failed, r.forbidden) for r in S.primary_by_run(ranking, judged, ["a", "b", "a,b"]).collect()}
    assert rows[1, "a"] == (1_000_000, False, 1) and rows[1, "b"] == (0, True, 1) and rows[1, "a,b"] == (630_930, False, 1)
    assert rows[2, "a"] == (0, True, 0) and rows[2, "b"] == (1_000_000, False, 0) and len(rows) == 6
