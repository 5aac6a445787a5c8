"""Cells of vectors: recall of the approximate search, exactness of the others."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import vector as V
from sparkloom.operators import cells as C
from sparkloom.operators import retrieval as R
from sparkloom.plans import catalog, indexes


def vectors(seed=1, n=900, dim=12, groups=30):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    rows = middle[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dim))
    return [(int(i), [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]


def odd(dim=12):
    return [(5000, [0.0] * dim), (5001, None), (5002, []), (5003, [1.0] * (dim + 1)), (5004, [float("nan")] * dim), (5005, [None] * dim), (5006, [1e-3] * dim), (5007, [1e-3] * dim)]


def frame(spark, rows, key="doc"):
    return spark.createDataFrame(rows, f"{key} long, vector array<float>").repartition(3)


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    out = C.build(frame(spark, vectors() + odd()), path)
    spark.createDataFrame([tuple(out.values())], ", ".join(f"{k} string" for k in out)).write.json(f"{path}/manifest")
    return C.opened(spark, path)


def brute(rows, asked, k):
    fit = [(d, np.array(v)) for d, v in rows if v and len(v) == 12 and all(x is not None and x == x for x in v) and any(v)]
    ids, unit = np.array([d for d, _ in fit]), np.array([v / np.linalg.norm(v) for _, v in fit])
    out = []
    for q, v in asked:
        score = np.floor(unit @ (np.array(v) / np.linalg.norm(v)) * 1_000_000 + 0.5).astype(int)
        order = [i for i in np.lexsort((ids, -score)) if score[i] > 0][:k]
        out += [(q, int(ids[i]), int(score[i]), r + 1) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("slice_size", [C.SLICE, 7])
@pytest.mark.parametrize("k", [1, 10, 2000])
def test_exact(spark, cells, k, slice_size, monkeypatch):
    monkeypatch.setattr(C, "SLICE", slice_size)
    cells = C.Cells(cells.rows.withColumn("slice", F.pmod(F.xxhash64("doc"), cells.slices(F.col("cell"))).cast("int")), cells.centres, cells.sizes, cells.radii, cells.probes)
    rows = vectors() + odd()
    asked = vectors()[::90]
    got = C.exact_nearest(cells, frame(spark, asked + [(9000, None), (9001, [0.0] * 12), (9002, [1.0])], "query"), k).collect()
    assert sorted((r.query, r.doc, r.score, r["rank"]) for r in got) == brute(rows, asked, k)


def test_exact_search_leaves_far_cells(spark, cells):
    """Of clustered vectors most cells can't reach the k-th score."""
    asked = frame(spark, vectors()[::90], "query")
    own = C.unit_queries(cells, asked)
    least = C.nearest(cells, asked, 10).filter("rank = 10").select("query", (F.col("score") / 1e6).alias("least"))
    n = C.asked_cells(cells, own.join(least, "query"), 0).count()
    assert n < 0.5 * own.count() * len(cells.centres)


def test_recall_of_clustered_vectors(spark, cells):
    asked = vectors()[::50]
    want = {r[:2] for r in brute(vectors() + odd(), asked, 10)}
    found = C.nearest(cells, frame(spark, asked, "query"), 10)
    got = {(r.query, r.doc) for r in found.collect()}
    assert len(want & got) >= 0.9 * len(want) and cells.probes < len(cells.centres)
    assert len(want & {(r.query, r.doc) for r in C.nearest(cells, frame(spark, asked, "query"), 10, probes=len(cells.centres)).collect()}) == len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_given_vectors(spark, sf):
    sf = f"/root/testdata/{sf}"
    exact, near = ({(r.query, r.doc) for r in catalog.QUERIES[n](spark, sf).collect()} for n in ("dense_topk_every50", "dense_cells_every50"))
    assert len(exact & near) >= 0.9 * len(exact)
    assert {q for q, _ in near} == {r.query for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query")).collect()}
    assert sum(indexes.vectors(spark, sf).sizes) == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def pairs(rows, threshold):
    first = {}
    for d, v in rows:
        if v and len(v) == 12 and all(x is not None and x == x for x in v) and any(v):
            first[tuple(v)] = min(d, first.get(tuple(v), d))
    ids = sorted(first.values())
    own = {d: np.array(v) / np.linalg.norm(v) for v, d in first.items()}
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if np.floor(own[a] @ own[b] * 1_000_000 + 0.5) >= threshold * 1_000_000}


@pytest.mark.parametrize("threshold", [0.92, 0.99])
@pytest.mark.parametrize("centres", [1, 5, 40])
def test_near_pairs(spark, threshold, centres):
    rows = vectors() + odd() + [(7000 + d, v) for d, v in vectors()[:50]] + [(8000 + d, [2 * x for x in v]) for d, v in vectors()[:50]]
    got = C.near_pairs(frame(spark, rows), threshold, centres, block=64).collect()
    assert len({(r.doc_a, r.doc_b) for r in got}) == len(got)
    assert {(r.doc_a, r.doc_b) for r in got} == pairs(rows, threshold)


def test_copies_of_a_third(spark):
    """A third of all rows is one vector: it has one representative, and its members are told."""
    same = vectors()[0][1]
    rows = vectors()[1:200] + [(10_000 - i, same) for i in range(100)]
    df = frame(spark, rows)
    assert {(r.doc_a, r.doc_b) for r in C.near_pairs(df, 0.95, 4).collect()} == pairs(rows, 0.95)
    members = {r.doc: r.rep for r in C.representatives(df).collect()}
    assert len(members) == len(rows) and {members[10_000 - i] for i in range(100)} == {9901} and members[5] == 5


def test_nothing_is_near(spark, tmp_path):
    empty = frame(spark, [])
    assert C.near_pairs(empty, 0.9).count() == 0 == C.near_pairs(frame(spark, odd()[:3]), 0.9).count()
    out = C.build(empty, f"{tmp_path}/c")
    spark.createDataFrame([tuple(out.values())], ", ".join(f"{k} string" for k in out)).write.json(f"{tmp_path}/c/manifest")
    cells = C.opened(spark, f"{tmp_path}/c")
    assert C.exact_nearest(cells, frame(spark, vectors()[:3], "query"), 5).count() == 0


def test_means(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0])], "path string, vector array<float>")
    assert {r.path: r.vector for r in C.means(df).collect()} == {"a": [2.0, 4.0], "b": [5.0, 5.0]}


def flat_rows(n, dim=24, seed=5):
    """Vectors without structure, the last fifth near to the first."""
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x[-n // 5 :] = x[: len(x[-n // 5 :])] * 1.5 + 0.05
    return [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]


def test_unstructured_vectors_go_to_one_cell():
    """Centres that part nothing would send every vector to most cells; clustered vectors keep theirs."""
    limit = float(np.arccos(0.92))
    for rows, many in ((np.array([v for _, v in flat_rows(2000)]), True), (np.array([v for _, v in vectors(n=2000, dim=12, groups=8)]) * 1.0, False)):
        rows = rows / np.linalg.norm(rows, axis=1)[:, None]
        assert (C.visited(rows, C.fitted(rows, 8), limit) >= C.VISITS) is many


def test_near_pairs_without_structure(spark):
    rows = flat_rows(2500)
    got = [(r.doc_a, r.doc_b) for r in C.near_pairs(frame(spark, rows), 0.92).collect()]
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    x, y = np.nonzero(np.triu(np.floor(unit @ unit.T * 1_000_000 + 0.5) >= 920_000, 1))
    assert sorted(got) == sorted(zip(x.tolist(), y.tolist(), strict=True)) and len(got) > 400


def test_near_duplicates_by_blocks(spark):
    """Within scopes, whatever the blocks; a task gets two blocks, not a scope's pairs."""
    rows = [(d, d % 3 if d % 7 else None, v) for d, v in flat_rows(600) + [(5000, None), (5001, []), (5002, [1.0]), (5003, [0.0] * 24), (5004, [None] * 24)]]
    df = spark.createDataFrame(rows, "doc long, scope int, vector array<float>")
    fit = [(d, s, np.array(v) / np.linalg.norm(v)) for d, s, v in rows if s is not None and d < 5000]
    want = sorted((a, b, s) for a, s, v in fit for b, t, w in fit if a < b and s == t and np.floor(v @ w * 1_000_000 + 0.5) >= 920_000)
    for block in (50, 4096):
        assert sorted((r.doc_a, r.doc_b, r.scope) for r in R.within_scopes(df, 0.92, block).collect()) == want
    plan = R.near_duplicates(df, 0.92)._jdf.queryExecution().optimizedPlan().toString()
    assert len(want) > 30 and "doc_a" not in plan.split("FlatMapGroupsInArrow")[1].split("\n", 1)[1]


def test_norms_are_found_once(spark):
    """A norm within a lambda was found again for each element."""
    df = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: x.cast("float")).alias("v"))
    began = time.time()
    df.select(V.normalised(F.col("v")).alias("v")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 20


def test_near_duplicates_everywhere_as_its_sql(spark, tmp_path):
    """Pairs of equal vectors, of vectors of other lengths and of some with nulls are in the SQL's result."""
    duckdb = pytest.importorskip("duckdb")
    base = [v for _, v in vectors(3, 20, 6, 20)]
    rows = [(2 * i, i % 3, v) for i, v in enumerate(base)] + [(100 + 2 * i, 0, base[i]) for i in range(6)] + [(200 + 2 * i, 0, base[7]) for i in range(5)]
    rows += [(300, 0, base[0] + [0.01]), (302, 0, base[0] + [0.01]), (304, 0, base[1][:5]), (306, 0, [None] + base[2][1:]), (308, 0, None), (310, 0, []), (312, None, base[4]), (None, 0, base[5])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLE_SQL["near_duplicates_everywhere"]).fetchall())
    assert sorted((r.doc_a, r.doc_b) for r in catalog.QUERIES["near_duplicates_everywhere"](spark, str(tmp_path)).collect()) == want and len(want) > 40


@pytest.mark.parametrize("centres", [None, 1, 7])
def test_every_pair_of_large_classes(spark, centres):
    """Two classes of copies that are near to each other, of more ids than they have rows, and smaller ones."""
    one, other = vectors()[0][1], [x * 1.01 + 0.001 for x in vectors()[0][1]]
    rows = vectors()[:120] + odd() + [(9000 - i, one) for i in range(200)] + [(9500 - 2 * i, other) for i in range(150)] + [(7000 + d, v) for d, v in vectors()[:40]]
    fit = [(d, np.array(v)) for d, v in rows if v and not any(x is None or x != x for x in v) and any(v)]
    ids, unit = np.array([d for d, _ in fit]), np.array([np.pad(v, (0, 13 - len(v))) / np.linalg.norm(v) for _, v in fit])
    score = np.floor(unit @ unit.T * 1_000_000 + 0.5).astype(int)
    i, j = np.nonzero((score >= 920_000) & (ids[:, None] < ids[None, :]))
    got = C.near_pairs(frame(spark, rows), 0.92, centres, block=64, every=True).collect()
    assert sorted((r.doc_a, r.doc_b) for r in got) == sorted(zip(ids[i].tolist(), ids[j].tolist(), strict=True)) and len(got) > 60_000
    at = {d: n for n, d in enumerate(ids.tolist())}
    assert all(r.score == score[at[r.doc_a], at[r.doc_b]] for r in got)


def test_one_class_only(spark):
    got = C.near_pairs(frame(spark, [(d, [1.0, 2.0]) for d in (5, 3, 9)]), 0.92, every=True).collect()
    assert sorted((r.doc_a, r.doc_b, r.score) for r in got) == [(3, 5, 1_000_000), (3, 9, 1_000_000), (5, 9, 1_000_000)]


def test_scores_that_are_rounded_up(spark, monkeypatch):
    """0.91999955 is 920,000 millionths; the vectors lie in two cells, one on the border of both."""
    turn, half = np.arccos(0.91999955), 0.5
    monkeypatch.setattr(C, "fitted", lambda sample, n: np.array([[np.cos(half), -np.sin(half)], [np.cos(half), np.sin(half)]]))
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float(np.cos(turn)), float(np.sin(turn))])], "doc long, vector array<double>")
    assert [(r.doc_a, r.doc_b, r.score) for r in C.near_pairs(df, 0.92, 2).collect()] == [(1, 2, 920_000)]


def test_infinite_elements_are_left_out(spark):
    """A vector without direction takes no pair of others with it."""
    rows = vectors()[:200]
    got = C.near_pairs(frame(spark, rows + [(9000, [float("inf")] * 12)]), 0.92, 5).collect()
    assert {(r.doc_a, r.doc_b) for r in got} == pairs(rows, 0.92)
