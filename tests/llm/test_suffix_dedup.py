"""Removal of repeated 50-byte strings against a dictionary of all of them."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("sparkloom.llm")
from sparkloom.llm import suffix_dedup as S  # noqa: E402

BIG = 1 << 62


def brute(rows, length=50):
    first = {}
    raws = [(BIG if d is None else d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            first[s] = min(first.get(s, BIG), d)
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((gone[1:] < gone[:-1]).sum())
        out.append((None if d == BIG else d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, payload string, block int").repartition(parts)
    got = S.suffix_dedup(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_small_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def planted(seed=3, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(6)]
    rows = []
    for d in range(n):
        parts = [rng.choice(passages)[rng.randrange(0, 5) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        rows.append((d * 37 % n, "".join(parts)))
    return rows + [(d + 1000, t) for d, t in rows[:20]] + [rows[5], (None, rows[7][1]), (None, None), (3000, ""), (3001, "z" * 49), (3002, "z" * 50), (3003, "z" * 60000), (3004, "y" * 51), (3005, "z" * 50)]


def test_planted(spark):
    check(spark, planted())


def test_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    check(spark, planted(8))


def test_empty(spark):
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_is_the_suffix_array(monkeypatch):
    rng = random.Random(1)
    for limit in (S.IN_MEMORY, 16):
        monkeypatch.setattr(S, "IN_MEMORY", limit)
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(1, 14))) for _ in range(40)]
        data = np.frombuffer(b"".join(strings), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        bwt, lcp, tags = S.index(data, offs, 3)
        every = sorted((tuple(b + 1 for b in s[i:]) + (0,), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or not x), min(len(a), len(b)))
        # equal suffixes of different strings are in the order of what they were inserted in; their set is what counts
        assert [int(x) for x in lcp] == [0] + [common(a[0], b[0]) for a, b in zip(every, every[1:], strict=False)]
        place = lambda t: next(s[t - o :] for s, o in zip(strings, offs, strict=False) if o <= t < o + len(s))
        assert [place(t) for t in tags if t >= 0] == [bytes(b - 1 for b in e[0][:-1]) for e in every if len(e[0]) > 3]
        assert sorted(bwt.tolist()) == sorted([0] * len(strings) + [b + 1 for s in strings for b in s])
