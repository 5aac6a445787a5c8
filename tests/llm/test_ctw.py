"""Context-tree weighting against a dictionary version, and the unigram base score."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("sparkloom.llm")
from sparkloom.llm import ctw, queries  # noqa: E402

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(t):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def base(rows):
    toks = [[*WORD.findall(lower(t)), None] for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, toks, strict=True) if not held(d) for w in ws)
    n = sum(c.values())
    z = n + 0.5 * (len(c) + 1)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / z) for w in ws)) for ws in toks]


def log_pe(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def weighted(rows):
    """Scores by the definition, a node at a time."""
    n = defaultdict(lambda: [0, 0])

    def steps(t):
        s = b"\0" * ctw.DEPTH + lower(t) + b"\xff"
        for i in range(ctw.DEPTH, len(s)):
            for k in range(8):
                yield (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1, s[i - ctw.DEPTH : i]

    for d, t in rows:
        if not held(d):
            for node, bit, ctx in steps(t):
                for depth in range(ctw.DEPTH + 1):
                    n[ctx[ctw.DEPTH - depth :], node][bit] += 1
    pw, lean = {}, {}
    for depth in range(ctw.DEPTH, -1, -1):
        below = defaultdict(float)
        for (ctx, node), v in pw.items():
            if len(ctx) == depth + 1:
                below[ctx[1:], node] += v
        for (ctx, node), (a, b) in list(n.items()):
            if len(ctx) == depth:
                pe = log_pe(a, b)
                if depth == ctw.DEPTH:
                    pw[ctx, node] = pe
                else:
                    lean[ctx, node] = pe - below[ctx, node]
                    pw[ctx, node] = math.log(0.5) + max(pe, below[ctx, node]) + math.log1p(math.exp(-abs(pe - below[ctx, node])))
    out = []
    for _, t in rows:
        total = 0.0
        for node, bit, ctx in steps(t):
            p = None
            for depth in range(ctw.DEPTH, -1, -1):
                c = n.get((ctx[ctw.DEPTH - depth :], node), (0, 0))
                kt = (c[bit] + 0.5) / (c[0] + c[1] + 1)
                w = 1 / (1 + math.exp(-max(-60, min(60, lean.get((ctx[ctw.DEPTH - depth :], node), 0.0)))))
                p = kt if depth == ctw.DEPTH else w * kt + (1 - w) * p
            total += math.log10(p)
        out.append(total)
    return out


ROWS = [(i, t) for i, t in enumerate([None, "", " ", "abab abab", "ABAB abab", "é 漢字 é", "a\0b", "the cat the cat the hat", "x" * 3000, "the cat the cat the hat", "zzz", "Q", "one two\tthree\n" * 30])] + [(None, "the null"), (7, "repeated id")]


def test_scores(spark):
    df = spark.createDataFrame([(d, t, "clash", 3) for d, t in ROWS], "doc_id long, text string, bucket string, score int").repartition(3)
    got = ctw.score(df).collect()
    want = sorted(zip(ROWS, base(ROWS), weighted(ROWS), strict=True), key=str)
    assert len(got) == len(want)
    left = list(got)
    for (d, t), (n, known, total, b), s in want:
        hit = next(r for r in left if r.doc_id == d and r.n_bytes == len((t or "").encode()) and abs(r.score - s) < 1e-3 * max(1, abs(s)))
        left.remove(hit)
        assert (hit.n_tokens, hit.n_known, hit.train_tokens, hit.held_out) == (n, known, total, held(d))
        assert abs(hit.base_score - b) < 1e-6 * max(1, abs(b))
    assert ctw.score(df.limit(0)).count() == 0


def test_base_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = dict(zip((d for d, _ in rows), base(rows), strict=True))
    got = queries.op10_ctw(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, b = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - b) < 1e-6 * abs(b)
    tested = [r for r in got if r.held_out]
    counts = Counter(b for d, t in rows if not held(d) for b in lower(t) + b"\xff")
    total = sum(counts.values())
    order0 = sum(-math.log2((counts[b] + 0.5) / (total + 128)) for d, t in rows if held(d) for b in lower(t) + b"\xff")
    assert tested and sum(-r.score for r in tested) / math.log10(2) < 0.75 * order0


def test_counts_beyond_four_bytes():
    """Totals of all documents have eight bytes; a block's count that four don't hold is an error."""
    many = np.array([5_000_000_000, 3], np.int64)
    rows = ctw.counted_rows(np.array([7, 9], np.uint64), many, ctw.COUNTED)
    look = ctw.Lookup(rows, np.zeros(0, ctw.ANSWER))
    assert rows["count"].tolist() == many.tolist() and abs(look.log_count[0] - np.log10(5_000_000_000.5)) < 1e-12
    with pytest.raises(OverflowError):
        ctw.counted_rows(np.array([7, 9], np.uint64), many, ctw.WORDS)
