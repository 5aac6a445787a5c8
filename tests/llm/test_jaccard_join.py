"""Components of the n-gram Jaccard join against all pairs in Python."""

import random
import re

import pytest

pytest.importorskip("sparkloom.llm")
from sparkloom.llm import jaccard_join as J  # noqa: E402
from sparkloom.llm.graph import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gram_set(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def classes(rows, n=3, percent=90):
    found = [(d, gram_set(t, n)) for d, t in rows]
    parent = {d: d for d, _ in found if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, (d, s) in enumerate(found):
        near = set().union(*(index.get(g, ()) for g in s)) if s else ()
        for j in near:
            e, u = found[j]
            both = len(s & u)
            if d is not None and e is not None and 100 * both >= percent * (len(s) + len(u) - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
        for g in s:
            index.setdefault(g, []).append(i)
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in found), key=str)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, owner string, component_id int").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_classes(df, **kw).collect()), key=str)
    assert got == classes(rows, kw.get("ngram", 3), kw.get("percent", 90))


def test_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, "one"), (6, "one two"), (7, "Two one"), (8, "one\ttwo"), (8, "one two"), (9, "w " * 40000), (10, "w " * 3), (11, "É a b c"), (12, "é a b c")])


def test_large_groups(spark, monkeypatch):
    """Many near copies of few texts, all with the same rare tokens, so that most go the wide way."""
    monkeypatch.setattr(J, "FEW", 3)
    monkeypatch.setattr(J, "FAN", 4)
    rng = random.Random(5)
    base = [[f"b{k}w{i}" for i in range(60)] for k in range(3)]
    rows = []
    for d in range(160):
        words = list(base[d % 3])
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(6)}"
        rows.append((d * 3 % 160 * 7, " ".join(words[: rng.randrange(50, 61)])))
    check(spark, rows)
    check(spark, rows, percent=80, ngram=5)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_classes(df).count() == 0


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((50, 30), (300, 280), (40, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1064)] + [(5000, 5000 + i) for i in range(1, 50)]
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        loops = {x for x, y in edges if x == y}
        real = {x for x, y in edges if x != y} | {y for x, y in edges if x != y}
        got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 3)], "x long, y long")).collect()}
        assert got == {x: root(x) for x in real} and not (loops - real) & got.keys()
