"""Many aliases in one pass against a regular expression for each."""

import random
import re
import time

import pytest

from sparkloom.operators import aliases as A

TEXTS = [(1, "Spring DI and di_x, BeanFactory."), (2, "의존성주입을 쓰는 SPRING"), (3, None), (4, ""), (5, "springs di"), (6, "a.b c++ C++x (C++)"), (7, "ÉCLAIR clair éclair"), (8, "K k K"), (9, "x " * 50_000 + "needle"), (10, "di"), (11, "DI")]
ALIASES = [("di", "DI"), ("di", "의존성주입"), ("spring", "spring"), ("bean", "bean"), ("bean", "BeanFactory"), ("cpp", "C++"), ("ab", "a.b"), ("e", "éclair"), ("c", "clair"), ("k", "k"), ("n", "Needle"), ("two", "Spring DI"), ("none", ""), ("none", None), ("same", "di"), ("part", "주입")]


def regexes(texts, aliases):
    out = {}
    for d, t in texts:
        for c, a in aliases:
            if a and (re.search(rf"(?ia)(?<![A-Za-z0-9_]){re.escape(a)}(?![A-Za-z0-9_])", t or "") if a.isascii() else a.lower() in (t or "").lower()):
                key = a.translate(A.TO_LOWER) if a.isascii() else a.lower()
                out.setdefault((d, c), set()).add(key)
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize("size", [A.BLOCK_CHARS, 40])
def test_mentions(spark, monkeypatch, size):
    monkeypatch.setattr(A, "BLOCK_CHARS", size)
    texts = spark.createDataFrame(TEXTS, "id long, text string").repartition(3)
    aliases = spark.createDataFrame(ALIASES, "concept string, alias string")
    found = A.mentioned(texts, aliases)
    assert found.columns == ["id", "text", "keys"] and found.count() == len(TEXTS)
    assert {(r.id, r.concept): r.n for r in A.by_concept(found, aliases, "id").collect()} == regexes(TEXTS, ALIASES)


def test_no_aliases_and_no_texts(spark):
    texts, none = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame([], "concept string, alias string")
    assert {tuple(r["keys"]) for r in A.mentioned(texts, none).collect()} == {()}
    assert A.mentioned(texts.limit(0), spark.createDataFrame(ALIASES, "concept string, alias string")).count() == 0


def test_random_aliases():
    rng = random.Random(2)
    piece = lambda n: "".join(rng.choice("abAB_ é주") for _ in range(n))
    texts, aliases = [(i, piece(60)) for i in range(60)], [(str(i), piece(rng.randrange(1, 4))) for i in range(80)]
    keys = sorted({a.translate(A.TO_LOWER) if a.isascii() else a.lower() for _, a in aliases})
    matcher = A.Matcher(keys)
    for i, t in texts:
        got = {keys[k] for k in matcher.found(t.translate(A.TO_LOWER), t.lower())}
        assert got == {a for a in keys if (i, a) in regexes([(i, t)], [(a, a)])}


def test_time_is_that_of_the_text():
    """Twenty thousand aliases take about as long as two hundred."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    text = " ".join(word() for _ in range(20_000))
    took = []
    for n in (200, 20_000):
        matcher = A.Matcher(sorted({word() for _ in range(n)}))
        began = time.process_time()
        for _ in range(5):
            matcher.found(text, text)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_plain_words_need_no_automaton():
    """Whole words are told by the longest runs of word characters; other keys still go through the automata."""
    keys = ["cat", "c_1", "a-b", "x+", "été", "tea"]
    m = A.Matcher(keys)
    assert len(m.words) == 2 and len(m.parts) == 1
    for text, want in (("a cat, c_1.", {0, 1}), ("cats c_12 _cat", set()), ("cat-tea éteté été", {0, 4, 5}), ("xa-b a-b x+ xx+", {2, 3}), ("écaté", {0}), ("", set())):
        assert m.found(text, text) == want, text
