"""Mixing: targets met, rates nonnegative, and the projection against a plain solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkloom.llm")
from sparkloom.llm import mixing as M  # noqa: E402
from sparkloom.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_targets_are_met(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, found = M.mix(docs, queries.domains(spark, SF, docs), queries.TARGETS)
    assert np.abs(found.reached - found.goal).max() < 2e-3 * found.total
    rows = out.collect()
    assert len(rows) == docs.count() and min(r.rate for r in rows) >= 0
    expected = np.array([sum(r.rate * r.tokens * r[f"p{i}"] for r in rows) for i in range(5)])
    assert np.allclose(expected, found.reached, rtol=1e-6)
    drawn = sum(r.copies * r.tokens for r in rows)
    assert abs(drawn - found.total) < 0.1 * found.total
    lang = out.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg("p_en" if "p_en" in out.columns else f"p{found.names.index('en')}").alias("p")).collect()
    assert {r.lang: r.p > 0.5 for r in lang} == {"en": True, "de": False, "fr": False, "es": False}


def plain(a, goal, tokens, floor, rounds=60000):
    """Projected gradient descent with the rates themselves."""
    r = np.ones(len(tokens))
    w = tokens / tokens.sum()
    for _ in range(rounds):
        r = np.maximum(floor, r - 1.0 * a @ ((r * w) @ a - goal))
    return (r * w) @ a


@pytest.mark.parametrize("floor,scale", [(0.0, 1.0), (1.0, 1.3), (0.0, 0.4)])
def test_against_plain_descent(spark, floor, scale):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = rng.integers(0, 900, 400)
    df = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)], "tokens long, p0 double, p1 double, p2 double")
    goals = {"a": 0.8, "b": 0.15, "c": 0.05}
    found = M.solve(df, ["a", "b", "c"], goals, floor, scale)
    want = plain(p, scale * np.array([0.8, 0.15, 0.05]), tokens.astype(float), floor)
    misfit = lambda x: ((x - scale * np.array([0.8, 0.15, 0.05])) ** 2).sum()
    assert misfit(found.reached / found.total) < misfit(want) * 1.05 + 1e-5


def test_floor_keeps_every_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("tokens", F.lit("clash"))
    out = M.mixed(docs, queries.domains(spark, "/root/testdata/sf0.001", docs), queries.TARGETS, floor=1.0, scale=1.3)
    assert out.columns == docs.columns
    assert out.select("doc_id").distinct().count() == docs.count()


def test_clashing_names_and_lacking_convergence(spark):
    df = spark.createDataFrame([(i, "a b c d", "x", "y", "z") for i in range(6)], "doc_id long, text string, __times string, draw string, text_ string")
    out = M.mixed(df, spark.createDataFrame([(1, "de"), (2, "en")], "doc_id long, domain string"), {"de": 1, "en": 1}, floor=1.0, scale=None)
    assert out.columns == df.columns and {(r["__times"], r.draw, r["text_"]) for r in out.collect()} == {("x", "y", "z")}
    rows = spark.createDataFrame([(10, 0.9, 0.1), (10, 0.2, 0.8)], "tokens long, p0 double, p1 double")
    with pytest.raises(RuntimeError, match="settle"):
        M.solve(rows, ["a", "b"], {"a": 0.9, "b": 0.1}, steps=2)


def test_scale_that_needs_no_dropping(spark):
    rows = spark.createDataFrame([(60, 1.0, 0.0), (40, 0.0, 1.0)], "tokens long, p0 double, p1 double")
    scale = M.reach(rows, ["a", "b"], {"a": 0.3, "b": 0.7})
    assert abs(scale - 2.0) < 1e-9
    found = M.solve(rows, ["a", "b"], {"a": 0.3, "b": 0.7}, 1.0, scale)
    assert found.residual < 1e-2 and found.steps.rates(np.array([[1.0, 0.0], [0.0, 1.0]]))[0].min() >= 1


def test_odd_rows(spark):
    rows = [(None, None, "en"), (1, "", "en"), (2, "a b c", "de"), (2, "a b c", "de"), (3, "x " * 50000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(2, "de"), (3, None), (None, "en"), (9, "en")], "doc_id long, domain string")
    out, _ = M.mix(df, marks, {"de": 1, "en": 1})
    got = out.collect()
    assert len(got) == 5 and all(r.rate >= 0 for r in got) and all(r.rate == 1 for r in got if not r.tokens)
    assert M.mix(df.limit(0), marks, {"de": 1, "en": 1})[0].count() == 0
    assert M.mixed(df.limit(0), marks, {"de": 1}).count() == 0
