"""Where models are plugged in: encoders, rerankers and tokenizers as iterator UDFs that load a model once for each
worker, with deterministic stand-ins for tests. A model is given by a function without arguments that makes it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENCODED = "struct<dense:array<float>,sparse:map<string,float>>"


class HashEncoder:
    """A stand-in: dense parts count hashed words, sparse ones are word counts."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def encode(self, texts: list[str]) -> list[dict]:
        import re
        import zlib
        from collections import Counter

        out = []
        for t in texts:
            words = re.findall(r"[0-9a-z가-힣]+", t.lower())
            dense = [0.0] * self.dim
            for w in words:
                dense[zlib.crc32(w.encode()) % self.dim] += 1.0
            norm = sum(x * x for x in dense) ** 0.5 or 1.0
            out.append({"dense": [x / norm for x in dense], "sparse": {k: float(v) for k, v in Counter(words).items()}})
        return out


class OverlapReranker:
    """A stand-in: the share of the query's words that a passage has."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = lambda t: set(t.lower().split())
        return [len(words(q) & words(p)) / max(1, len(words(q))) for q, p in pairs]


def encoder(factory: Callable[[], HashEncoder], batch: int = 64) -> Callable[[Column], Column]:
    """A column function from text to (dense, sparse)."""
    @F.pandas_udf(ENCODED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for texts in parts:
            made = []
            for a in range(0, len(texts), batch):
                made += model.encode([t or "" for t in texts.iloc[a : a + batch]])
            yield pd.DataFrame({"dense": [m["dense"] for m in made], "sparse": [m["sparse"] for m in made]})

    return run


def reranker(factory: Callable[[], OverlapReranker], chars: int = 512) -> Callable[[Column, Column], Column]:
    """A column function from query and passage (its first `chars` characters) to a score."""
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, p in parts:
            yield pd.Series(model.predict([(a or "", (b or "")[:chars]) for a, b in zip(q, p, strict=True)]), dtype=float)

    return run


def reranked(hits: DataFrame, score: Column, head: int = 20) -> DataFrame:
    """hits (query, doc, rank, and what `score` needs): the head by the model's and the given rank together, the tail as
    it is."""
    from sparkloom.operators.ranking import rank_fused

    return rank_fused(hits, score, head)


def morphemes(factory: Callable[[], Callable[[str], list[str]]]) -> Callable[[Column], Column]:
    """A column function of an optional morpheme tokenizer."""
    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = factory()
        for texts in parts:
            yield texts.map(lambda t: list(cut(t)) if t else [])

    return run


def sparse_weights(term: Column, weights: dict[str, float]) -> Column:
    """A tokenizer for sparse vectors as a lookup: the weight of a term, or 0."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), term), F.lit(0.0))


def searched(search: Callable[[DataFrame], DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """A search callback over a table of queries at once: (query, doc, score) in, the best k out."""
    from sparkloom.operators.ranking import top_k

    return top_k(search(queries), ["query"], [F.desc("score"), F.asc("doc")], k)


def linted(files: DataFrame, rules: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(path, rule, message) of all rules over a table of files; a rule is a function from files to (path, message)."""
    parts = [rule(files).select("path", F.lit(rule.__name__).alias("rule"), "message") for rule in rules]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
