"""The weak-label model and the scorer, on held-out labels and planted faults."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkloom.llm")
from sparkloom.llm import quality_classifier as C  # noqa: E402
from sparkloom.llm import text as T  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = C.fit(docs, labels.filter("doc_id % 2 = 0"))
    got = C.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    clean = got.filter("quality = 1 and toxic = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = got.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    toxic = got.filter("toxic = 1").join(docs.filter("lang = 'en'").select("doc_id"), "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean > 0.97 and junk < 0.2 and toxic < 0.1


def test_toxic_documents_of_all_languages_and_lengths(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = C.score(docs, C.fit(docs, labels)).join(labels, "doc_id").join(docs.select("doc_id", "text", "lang"), "doc_id").toPandas()
    short = got["text"].str.split().str.len() < 20
    toxic, clean = got["toxic"] == 1, (got["toxic"] == 0) & (got["quality"] == 1)
    assert (toxic & short).sum() == 6 and not got[toxic & short]["kept"].any()
    for _, some in got[toxic].groupby("lang"):
        assert some["kept"].mean() < 0.1
    assert got[clean & short]["kept"].mean() > 0.9
    assert got[~toxic & ~clean & short]["kept"].mean() < 0.5


def test_few_labels_among_many_rows_are_all_learned(spark):
    rng = np.random.default_rng(5)
    words = np.array([a + b + c for a in "bdfgklmn" for b in ("ari", "eno", "usi", "oba") for c in ("t", "ren", "s", "lo")])
    rows = [(i, " ".join(rng.choice(words, 30).tolist() + ["zorbul"] * 3 * (i < 600 and i % 10 == 1))) for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 1)) for i in range(400)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in C.score(docs, C.fit(docs, labels, sample=500)).collect()}
    assert np.mean([kept[i] for i in range(401, 600, 10)]) < 0.2
    assert np.mean([kept[i] for i in range(600, 20000)]) > 0.97


def test_held_out_recall_by_language(spark):
    """Annotations of three quarters of the rows; the rest is judged by the scorer alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = C.score(docs, C.fit(docs, labels.filter("doc_id % 4 <> 1"))).join(labels.filter("doc_id % 4 = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    toxic, junk = got["toxic"] == 1, (got["quality"] == 0) & (got["toxic"] == 0)
    for lang, some in got[toxic].groupby("lang"):
        assert some["kept"].mean() < 0.25, lang
    assert got[junk]["kept"].mean() < 0.1
    assert got[~toxic & ~junk]["kept"].mean() > 0.98


def test_odd_rows_and_equal_texts(spark):
    texts = [None, "", " ", "word", "a " * 50000, "You are an idiot and a moron " * 9, "plain text of some words that says nothing bad at all " * 3, "&&& *** " * 40]
    rows = [(i if i != 2 else None, t, 0.5, "clash", 1, 2) for i, t in enumerate(texts + texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, code string, annotator int, scored int")
    for labels in (None, spark.createDataFrame([(6, 1, 0), (6, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")):
        model = C.fit(df, labels)
        out = C.score(df, model).collect()
        assert len(out) == len(rows) and not any(r.kept for r in out if r.doc_id in (0, 1, 8, 9, 10))
        verdicts = {}
        for r, (_, t, *_) in zip(out, rows, strict=True):
            assert verdicts.setdefault(t, r.score) == r.score
        kept = C.keep_good(df, model)
        assert kept.columns == df.columns
        assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(str(r) for r, s in zip(df.select("doc_id", "text").collect(), out, strict=True) if s.kept)
    assert C.score(df.limit(0), C.fit(df.limit(0), None)).count() == 0


def test_weak_labels_recover_planted_accuracies():
    """Three classes, labellers of known accuracy that abstain on half of the rows, and no hint at which is good."""
    rng = np.random.default_rng(3)
    n, truth = 60000, rng.choice(3, 60000, p=[0.7, 0.2, 0.1])
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.85]
    votes = np.zeros((n, len(accuracy)), int)
    for j, a in enumerate(accuracy):
        said = np.where(rng.random(n) < a, truth, (truth + rng.integers(1, 3, n)) % 3) + 1
        votes[:, j] = np.where(rng.random(n) < 0.5, C.ABSTAIN, said)
    codes, counts = np.unique(C.code(votes), return_counts=True)
    prior, theta = C.weak_labels(C.decode(codes, len(accuracy)), counts.astype(float), partial=tuple(range(len(accuracy))))
    assert np.abs(prior - [0.7, 0.2, 0.1]).max() < 0.02
    for j, a in enumerate(accuracy):
        for c in range(3):
            assert abs(theta[j, c, c + 1] / theta[j, c, 1:].sum() - a) < 0.06
    guess = C.posterior(votes, prior, theta).argmax(1)
    assert (guess == truth).mean() > 0.9


def test_weak_labels_hear_single_votes_for_a_fault():
    """Heuristics that look for one fault each never agree, which the model takes as doubt; annotators decide."""
    rng = np.random.default_rng(4)
    n = 40000
    kind = rng.choice(5, n, p=[0.88, 0.03, 0.03, 0.03, 0.03])  # clean, and four kinds of junk
    votes = np.zeros((n, 5), int)
    for j in range(4):
        votes[:, 1 + j] = np.where((kind == j + 1) & (rng.random(n) < 0.9) | (rng.random(n) < 0.002), C.JUNK, C.ABSTAIN)
    votes[:, 0] = np.where(rng.random(n) < 0.2, np.where(kind > 0, C.JUNK, C.CLEAN), C.ABSTAIN)
    codes, counts = np.unique(C.code(votes), return_counts=True)
    pattern = C.decode(codes, 5)
    prior, theta = C.weak_labels(pattern[:, 1:], counts.astype(float), pattern[:, 0])
    junk = C.posterior(votes[:, 1:], prior, theta)[:, C.JUNK - 1]
    silent, heard = (votes[:, 1:] == C.ABSTAIN).all(1), (votes[:, 1:] == C.JUNK).any(1)
    assert junk[heard].min() > 0.3 and junk[silent].max() < 0.1 and prior[C.TOXIC - 1] < 1e-9
    for j in range(4):  # a heuristic is heard on a quarter of the junk, and hardly elsewhere
        assert 0.08 < theta[j, C.JUNK - 1, C.JUNK] < 0.3 and theta[j, 0, C.JUNK] < 0.02


def test_scorer_sees_single_documents_alike():
    texts = ["one two three " * 20, "four five", "", "six seventeen " * 100]
    import pyarrow as pa

    data, offs = T.column(pa.array(texts))
    w = np.random.default_rng(1).normal(size=(2, C.DIM + len(C.FAULTS) + 1))
    listed = np.zeros(0, np.uint64)
    model = C.Model(np.ones(3) / 3, np.ones((7, 3, 4)) / 4, listed, w)
    together = C.logits(model, data, offs, C.votes(data, offs, listed))
    for i, t in enumerate(texts):
        d, o = T.column(pa.array([t]))
        assert np.allclose(C.logits(model, d, o, C.votes(d, o, listed))[:, 0], together[:, i])


def test_posteriors_of_rows_without_annotation_train_the_scorer(spark):
    """Words that only unlabelled rows hold, all of them junk by a heuristic, are learned through the label model."""
    rng = np.random.default_rng(8)
    words = np.array([a + b + c for a in "bdfgklmn" for b in ("ari", "eno", "usi", "oba") for c in ("t", "ren", "s", "lo")])
    text = lambda *more: " ".join(rng.permutation([*rng.choice(words, 30), *more]))
    signs = lambda n: ["".join(rng.choice(list("#*$%&|<>"), 6)) for _ in range(n)]
    rows = [text(*signs(12 * (i % 5 == 0))) for i in range(400)]  # annotated, junk by symbols
    bad = [f"{a}uo{b}" for a in "hjpqrvwxyz" for b in ("mbat", "rth")]
    rows += [text(*bad[i % 2 :: 2] * (i % 5 == 0), *signs(12 * (i % 5 == 0))) for i in range(1000)]
    rows += [text(*bad) for _ in range(10)] + [text() for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in C.score(docs, C.fit(docs, labels)).collect()}
    assert not any(kept[i] for i in range(1400, 1410)) and np.mean([kept[i] for i in range(1410, 1460)]) > 0.9


def test_annotations_are_one_labeller_among_others():
    """Where independent labellers of known accuracy contradict an annotation, it is doubted; alone it is believed."""
    rng = np.random.default_rng(9)
    truth = rng.choice(2, 40000, p=[0.8, 0.2])
    votes = np.stack([np.where(rng.random(40000) < 0.95, truth, 1 - truth) + 1 for _ in range(4)], 1)
    mark = np.where(rng.random(40000) < 0.2, np.where(rng.random(40000) < 0.9995, truth, 1 - truth) + 1, C.ABSTAIN)
    codes, counts = np.unique(C.code(np.column_stack((votes, mark))), return_counts=True)
    every = C.decode(codes, 5)
    prior, theta = C.weak_labels(every[:, :4], counts.astype(float), every[:, 4])
    seen = np.array([[2, 2, 2, 2, 1], [1, 1, 1, 1, 2], [1, 1, 2, 2, 2], [1, 1, 2, 2, 1]])
    junk = C.posterior(seen, prior, theta)[:, C.JUNK - 1]
    assert junk[0] > 0.8 and junk[1] < 0.2 and junk[2] > 0.9 and junk[3] < 0.1
    assert 0.998 < theta[4, 1, 2] < 1
