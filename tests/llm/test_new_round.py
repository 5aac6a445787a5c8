"""Ranked search, incremental aggregates and exact dedup against plain Python."""

import hashlib
import math
import random
import re
import zlib
from bisect import insort
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkloom.llm")
from sparkloom.llm import counted_tree, exact_dedup, queries, ranked_search  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t", "a", "a ", " a", "a  b", "a\tb", "a\n\nb", "x " * 30000, "é 漢字 😀", "É", "Word_2word 7", "a"]


def rows_of(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# exact duplicates


def copies(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for t, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def dedup(spark, rows, **more):
    df = rows_of(spark, [(d, t, "x", True) for d, t in rows], "doc_id long, text string, keep_id string, kept boolean")
    out = exact_dedup.exact_dedup(df, **more)
    assert out.columns == [*df.columns, "keep_id_", "group_size", "kept_", "text_sha256"]
    return sorted(((r.doc_id, r.keep_id_, r.group_size, r.kept_, r.text_sha256) for r in out.collect()), key=str)


def planted_copies():
    rng = random.Random(5)
    rows = [(i * 7 % 401, rng.choice(["hot  text", "hot text", "other", "a\x0bb", f"own {i}"])) for i in range(400)]
    return rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "hot text"), (None, "alone"), (None, "alone"), (5000, "twice"), (5000, "twice")]


def test_copies(spark):
    rows = planted_copies()
    assert dedup(spark, rows) == copies(rows)


@pytest.mark.parametrize("digest", [lambda c: F.length(c), lambda c: F.lit(1)], ids=["length", "one"])
def test_texts_that_share_a_hash_fall_apart(spark, digest):
    rows = planted_copies()
    assert dedup(spark, rows, digest=digest) == copies(rows)


def test_no_documents_no_copies(spark):
    assert dedup(spark, []) == []


# incremental aggregates


def histories(changes):
    """Recomputed from sorted lists, batch after batch."""
    groups = defaultdict(lambda: defaultdict(list))
    for g, batch, sign, value, item in changes:
        if batch is not None and sign is not None:
            groups[g][batch].append((sign, value, item))
    out = []
    for g, batches in groups.items():
        n, items, values, old = 0, Counter(), [], (0, 0, 0, None, None, None)
        for b in sorted(batches):
            for sign, value, item in sorted(batches[b], key=lambda c: -c[0]):
                n += sign
                items[item] += sign * (item is not None)
                if value is not None:
                    insort(values, value) if sign > 0 else values.remove(value)
            new = (n, sum(c > 0 for c in items.values()), sum(values), *((values[0], values[-1], values[len(values) // 2]) if values else (None,) * 3))
            if new != old:
                out.append((b, g, *(x for pair in zip(old, new, strict=True) for x in pair)))
            old = new
    return sorted(out, key=str)


def random_changes(seed=2, n=600, wide=5000):
    rng, out, live = random.Random(seed), [], []
    for b in range(8):
        for _ in range(n // 8):
            g, v = rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 7, rng.randrange(-wide, wide), rng.randrange(20)])
            live.append((g, v, rng.choice([None, "x", "y", f"t{rng.randrange(60)}"])))
            out.append((g, b, 1, live[-1][1], live[-1][2]))
        for _ in range(n // 20 if b < 7 else len(live)):
            g, v, t = live.pop(rng.randrange(len(live)))
            out.append((g, b, -1, v, t))
    return out


def kept_up(spark, changes, **more):
    df = rows_of(spark, [(*c, 1) for c in changes], "g string, batch int, sign int, value long, item string, n_rows int")
    out = counted_tree.maintain(df, ["g"], **more)
    names = ["batch", "g", *(f"{w}_{c}" for c in counted_tree.STATS for w in ("old", "new"))]
    assert out.columns == names
    return sorted((tuple(r[c] for c in names) for r in out.collect()), key=str)


@pytest.mark.parametrize("bits", [{}, {"leaf_bits": 2, "node_bits": 1}], ids=["usual", "narrow"])
def test_aggregates(spark, bits):
    changes = random_changes()
    assert kept_up(spark, changes, **bits) == histories(changes)


def test_odd_changes(spark):
    big = (1 << 63) - 1
    changes = [("a", 0, 1, big, "x"), ("a", 0, 1, -big, "x"), ("a", 1, -1, big, "x"), ("b", 3, 1, None, None), ("b", 3, 1, 5, None), ("b", 3, -1, 5, None), ("c", None, 1, 5, "z"), ("c", 2, None, 5, "z"), ("d", 0, 1, 4, "r"), ("d", 0, 1, 4, "r"), ("d", 5, -1, 4, "r"), ("e", 1, 1, 3, "q"), ("e", 2, -1, 3, "q"), ("e", 2, 1, 3, "q")]
    got = kept_up(spark, changes)
    assert got == histories(changes) and not [r for r in got if r[1] == "c"]
    assert kept_up(spark, []) == []


def test_a_value_leaves_once(spark):
    with pytest.raises(Exception, match="leaves more often"):
        kept_up(spark, [("a", 0, 1, 4, "x"), ("a", 1, -1, 4, "x"), ("a", 2, -1, 4, "x"), ("a", 2, 1, 9, "x")])


def test_block():
    rng, block, plain = random.Random(1), counted_tree.Block(), []
    for _ in range(2000):
        if plain and rng.random() < 0.45:
            v = plain.pop(rng.randrange(len(plain)))
            block.add(v, -1)
        else:
            v = rng.randrange(50)
            insort(plain, v)
            block.add(v, 1)
        assert sum(block.sizes) == len(plain) and block.keys == sorted(set(plain))
        if plain:
            p = rng.randrange(len(plain))
            assert block.select(p + 1)[0] == plain[p]
    with pytest.raises(IndexError):
        block.select(len(plain) + 1)


def test_group_columns_named_as_results(spark):
    df = spark.createDataFrame([("u", "v", 0, 1, 3, "i")], "batch string, new_total string, at int, sign int, value long, item string")
    out = counted_tree.maintain(df, ["batch", "new_total"], batch="at")
    assert {"batch_", "batch", "new_total", "new_total_"} <= set(out.columns)
    assert [(r.batch_, r.batch, r.new_total, r.new_total_) for r in out.collect()] == [(0, "u", "v", 3)]


def test_document_changes(spark):
    rows = [(i if i else None, f"t{i % 7}" if i % 5 else None, None if i % 4 == 0 else "s", "en", i * 3 if i % 6 else None) for i in range(200)]
    want = []
    for d, t, s, lang, n in rows:
        h = zlib.crc32(str(d if d is not None else "").encode())
        b, q = h % 20, h // 20 % 4
        up = None if n is None else n + q
        want += [c for c in ((s or "", b, 1, n), (s or "", b + q, -1, n), *([(s or "", b + q, 1, up)] if q % 3 == 0 else [])) if c[1] < 20]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = [(r.source, r.batch, r.sign, r.value) for r in queries.document_changes(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# ranked search


def ranked(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, Counter(words(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = []
    for i, ws in asked.items():
        scored = []
        for d, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in ws if w in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10, parts=3):
    df = rows_of(spark, [(d, t, "x") for d, t in docs], "doc_id long, text string, score string", parts)
    asked = rows_of(spark, [(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.ranked_search(df, asked, k).collect()), key=str)


def test_search_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert searched(spark, docs, items) == ranked(docs, items)


@pytest.mark.parametrize("k", [1, 3])
def test_search_ties_and_odd_texts(spark, k):
    rng = random.Random(4)
    docs = [(d, " ".join(rng.choice(["ab", "Cd", "éf", "gh9"]) for _ in range(rng.randrange(1, 5)))) for d in rng.sample(range(3000), 1500)]
    docs += [(4000 + i, t) for i, t in enumerate(ODD)] + docs[:40] + [(None, "ab Cd"), (None, None)]
    items = [(0, "AB cd"), (1, "éf ÉF"), (2, None), (3, "unknown"), (4, ""), (None, "gh9_ab"), (5, "ab"), (5, "gh9"), (6, "word 2word 7")]
    assert searched(spark, docs, items, k) == ranked(docs, items, k)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == [] == searched(spark, [(1, "a")], []) == searched(spark, [(1, "a")], [(1, "-")]) == searched(spark, [(1, None)], [(1, "a")])


def test_items_in_blocks_and_narrow_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 5)
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(n))
    docs, items = [(d, text(rng.randrange(30))) for d in range(300)], [(i, text(6)) for i in range(12)]
    assert searched(spark, docs, items, 4) == ranked(docs, items, 4)


def test_tree_opens_few_ranges():
    """Best first: of 1024 documents only the ranges on the way to the best are opened, and equal bounds are."""
    impacts = np.zeros((2, 1024), np.int32)
    impacts[0, 700], impacts[1, 701], impacts[:, 5] = 90, 80, 60
    tree, best, opened = ranked_search.Tree(impacts), ranked_search.Best(1), []
    grow = best.add
    best.add = lambda s, i: (opened.append(i), grow(s, i))
    tree.best_first(np.array([0, 1]), np.array([1, 1], np.int64), best, list(range(1024)))
    assert [(r[2], -r[0]) for r in best.rows] == [(5, 120)] and opened == [5]
    for level in tree.levels:
        assert (tree.levels[0].max(axis=1) == level.max(axis=1)).all()
    ties = np.zeros((1, 64), np.int32)
    ties[0, [3, 20, 40]] = 7
    best = ranked_search.Best(1)
    ranked_search.Tree(ties).best_first(np.array([0]), np.array([1], np.int64), best, [100 - i for i in range(64)])
    assert best.rows[0][2] == 60
