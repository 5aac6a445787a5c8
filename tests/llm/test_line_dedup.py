"""Line dedup against all runs in Python."""

import random
import re

import pytest

pytest.importorskip("sparkloom.llm")
from sparkloom.llm import line_dedup as L  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def brute(rows, least=8):
    """Every run of every document, by content."""
    docs = []
    for d, t in rows:
        seq = [(i, x, len(WORD.findall(x))) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        docs.append((LAST if d is None else d, t, seq))
    first = {}
    for d, t, seq in docs:
        for a in range(len(seq)):
            for b in range(a + 1, min(len(seq), a + 40) + 1):
                k = tuple(x for _, x, _ in seq[a:b])
                first[k] = min(first.get(k, (LAST + 1, 0)), (d, a))
    out = []
    for d, t, seq in docs:
        gone = set()
        for a in range(len(seq)):
            for b in range(a + 1, min(len(seq), a + 40) + 1):
                if sum(n for *_, n in seq[a:b]) >= least and first[tuple(x for _, x, _ in seq[a:b])] < (d, a):
                    gone |= {i for i, *_ in seq[a:b]}
        text = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        out.append((None if d == LAST else d, text, len(gone)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, line int, gone string").repartition(3)
    out = L.line_dedup(df)
    assert out.columns == [*df.columns, "__removed"]
    assert sorted(((r.doc_id, r.text, r["__removed"]) for r in out.collect()), key=str) == brute(rows)


def test_small_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_short_lines(spark):
    rng = random.Random(4)
    pool = ["a", "b c", "d e f", "one two three four five six seven eight nine", "", "  ", "x y z w", "é ü", "tail"]
    rows = [(d * 7 % 60, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for d in range(60)]
    check(spark, [*rows, (None, None), (61, ""), (62, "\n\n"), rows[3], (None, "only last\n" + rows[5][1]), (63, "a b c d e f g h\n" * 200), (64, "w " * 50000), (65, "w " * 50000)])


def test_long_runs_against_a_plain_suffix_array(spark):
    """Runs of up to some hundred lines, nested, overlapping and cyclic; parts of hot lines, as shares are small here."""
    rng = random.Random(11)
    page = [f"line {i} of the page" for i in range(150)]
    texts = ["\n".join(page), "\n".join(page[10:140]), "\n".join(page[60:] + page[:60]), "\n".join(["tick tock"] * 130), "\n".join(["tick tock", "bong"] * 70)]
    for _ in range(25):
        a = rng.randrange(120)
        texts.append("\n".join([*(rng.choice(page) for _ in range(5)), *page[a : a + rng.randrange(1, 30)], rng.choice("abc")]))
    rows = [(i * 13 % 47, t) for i, t in enumerate(texts)]

    # the longest earlier copy of each suffix, from the sorted suffixes
    seqs = [((d, k), t.split("\n")[k:]) for d, t in rows for k in range(len(t.split("\n")))]
    order = sorted(range(len(seqs)), key=lambda i: (seqs[i][1], seqs[i][0]))
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    best = dict.fromkeys((s[0] for s in seqs), 0)
    for r, i in enumerate(order):
        for side in (order[r - 1 :: -1] if r else [], order[r + 1 :]):
            low = None
            for j, before in zip(side, [i, *side], strict=False):
                c = common(seqs[before][1], seqs[j][1])
                low = c if low is None else min(low, c)
                if not low:
                    break
                if seqs[j][0] < seqs[i][0]:
                    best[seqs[i][0]] = max(best[seqs[i][0]], low)
    want = {}
    for d, t in rows:
        lines = t.split("\n")
        gone = {j for k in range(len(lines)) for j in range(k, k + best[d, k]) if sum(len(x.split()) for x in lines[k : k + best[d, k]]) >= 8}
        want[d] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    got = {r.doc_id: r.text for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_clashing_names_pass_through(spark):
    names = ["doc", "variant", "home", "bucket", "origin", "payload", "kind", "hot", "block", "id", "__removed", "__doc", "__gone"]
    text = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(i, f"{text}\nown {i}", *(f"{n}{i}" for n in names)) for i in range(4)], ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    out = L.line_dedup(df)
    assert out.columns == [*df.columns, "__removed_"]
    for r in out.collect():
        assert r.text == (f"{text}\nown 0" if r.doc_id == 0 else f"own {r.doc_id}") and r["__removed_"] == (r.doc_id > 0)
        assert all(r[n] == f"{n}{r.doc_id}" for n in names)


def test_empty(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
