"""Ranked lexical search: the k best documents of each item, by a tree of maxima over document ranges.

`index` reads each text once. A run of up to WIDTH documents becomes one row: their ids and lengths, the sorted distinct
terms, and for each term its documents and counts, packed. The index holds every term, is written as a table and can be
searched again. `search` takes items in blocks of about BLOCK_TERMS (item, term) pairs, which is all that is sent to the
tasks, whatever the number of items or documents.

Within a task, a run's postings of the terms asked for become impacts, the part of the score that a document alone
decides. Over them stands a tree for each term: the largest impact in each range of 1, 8, 64, ... documents. An item's
bound for a range is the sum of its terms' weighted maxima. The range of the highest bound is opened first; a document is
a range whose bound is its score. A search ends when the highest bound left is below the k-th score so far, so ranges of
an equal bound are still opened, as they may hold an equal score with a smaller id. The k best so far are carried from
run to run: most later runs end at their root. Tasks return k rows an item at most, which are merged in two steps.

Defined results: null and empty texts have no terms and are found by nothing; null ids come last among equal scores;
documents that repeat an id are ranked one by one; the rows of a repeated item_id are one item with the terms of all; a
null item_id is an item; items without a known term have no rows. Empty tables give none. Columns but the id and the text
are not read. Scores are exact 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X
from sparkloom.llm import text as T

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IN_TERM = np.ones(256, bool)
IN_TERM[0:0x30] = IN_TERM[0x3A:0x41] = IN_TERM[0x5B:0x61] = IN_TERM[0x7B:0x80] = False

WIDTH = 1024  # documents of a run; a number among them has two bytes
RUN_BYTES = 4_000_000  # of text in a run, or one document
CELLS = 4_000_000  # impacts in a tree: a run of very many terms is searched in narrower ranges
FAN = 8
BLOCK_TERMS = 16_384

INDEX = "ids array<bigint>, n_terms long, lengths binary, words binary, word_ends binary, starts binary, runs binary, counts binary"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text.cast("string"), UPPER, LOWER), F.lit(TERMS), F.lit(0))


def postings(ids: pa.Array, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    """One row of INDEX for a run of documents; those without a term are left out."""
    s, e = T.runs(IN_TERM[data], offs)
    doc = T.owner(np.searchsorted(s, offs))
    has = np.bincount(doc, minlength=len(offs) - 1)
    number = np.cumsum(has > 0) - 1
    ends = np.concatenate(([0], np.cumsum(e - s)))
    words = T.binary(T.LOWER[data[IN_TERM[data]]], ends).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = max(1, int((has > 0).sum()))
    keys, counts = np.unique(place[words.indices.to_numpy()] * n + number[doc], return_counts=True)
    sorted_words = words.dictionary.take(pa.array(order))
    blob, word_offs = T.column(sorted_words)
    starts = np.searchsorted(keys // n, np.arange(len(order) + 1))
    raw = lambda a, kind: pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([ids.filter(pa.array(has > 0)).to_pylist()], pa.list_(pa.int64())), pa.array([len(s)], pa.int64()), raw(has[has > 0], "<i8"), raw(blob, "u1"), raw(word_offs, "<i4"), raw(starts, "<i4"), raw(keys % n, "<u2"), raw(counts, "<u4")], names=[c.split(" ")[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of `docs`, a row for each run of documents, written in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.rebatched(batches, RUN_BYTES):
            data, offs = T.column(batch.column(1))
            for a, b, part, part_offs in T.chunks(data, offs, RUN_BYTES):
                for c in range(a, b, WIDTH):
                    d = min(b, c + WIDTH)
                    at = part_offs[c - a : d - a + 1]
                    yield postings(batch.column(0).slice(c, d - c), part[at[0] : at[-1]], at - at[0])

    X.tuned(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(X.trimmed(build), INDEX)
    return X.written(rows.filter("n_terms > 0"), "index")


class Tree:
    """The largest impact of each term over ranges of 1, FAN, FAN * FAN, ... documents."""

    def __init__(self, impacts: np.ndarray):
        self.levels = [impacts]
        while (below := self.levels[-1]).shape[1] > 1:
            short = -below.shape[1] % FAN
            padded = np.pad(below, ((0, 0), (0, short))) if short else below
            self.levels.append(padded.reshape(len(below), -1, FAN).max(axis=2))

    def best_first(self, rows: np.ndarray, weights: np.ndarray, held: Best, ids: list) -> None:
        """Put the documents that can be among the best into `held`, those of the highest bounds first."""
        top = len(self.levels) - 1
        heap = [(-int(weights @ self.levels[top][rows, 0].astype(np.int64)), top, 0)]
        while heap and -heap[0][0] >= held.least:
            bound, level, node = heapq.heappop(heap)
            if level == 0:
                held.add(-bound, ids[node])
                continue
            first = node * FAN
            below = weights @ self.levels[level - 1][rows, first : first + FAN].astype(np.int64)
            for i in np.flatnonzero(below >= held.least).tolist():
                heapq.heappush(heap, (-int(below[i]), level - 1, first + i))


class Best:
    """The k highest scores, the smaller id first among equals. `least`: what another score must reach."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def add(self, score: int, id_: int | None) -> None:
        self.rows.append((-score, id_ is None, id_))
        self.rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


@dataclass
class Corpus:
    """N: documents with a term; L: all their terms."""

    n_docs: int
    n_terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def impacts(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if 90 * int(lengths.max(initial=0)) * self.n_docs >= 1 << 63:
            lengths = lengths.astype(object)
        m = (10 + 90 * lengths * self.n_docs // self.n_terms).astype(np.int64)
        return 1_000_000_000 * counts.astype(np.int64) // (1000 * counts.astype(np.int64) + 8 * m)


def known(words: bytes, ends: bytes, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a run's words that are in `vocabulary`, and their numbers there."""
    offs = np.frombuffer(ends, "<i4")
    own = T.binary(np.frombuffer(words, np.uint8), offs)
    there = pc.index_in(own, value_set=vocabulary)
    hit = np.flatnonzero(~there.is_null().to_numpy(zero_copy_only=False))
    return hit, there.take(pa.array(hit)).to_numpy()


def frequencies(found: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """In how many documents each word of the vocabulary is; each task sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for words, ends, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hit, there = known(words, ends, vocabulary)
                df[there] += np.diff(np.frombuffer(starts, "<i4"))[hit]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in found.select("words", "word_ends", "starts").mapInArrow(X.trimmed(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def search_block(found: DataFrame, corpus: Corpus, asked: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's k best for each item of one block."""
    vocabulary = pa.array(sorted({w.encode() for _, ws in asked for w in ws}), pa.binary())
    weights = np.array([corpus.weight(int(df)) for df in frequencies(found, vocabulary)], np.int64)
    number = {w: i for i, w in enumerate(vocabulary.to_pylist())}
    items = [(item, np.array(sorted(number[w.encode()] for w in ws), np.int64)) for item, ws in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Best(k) for _ in items]
        for batch in batches:
            for ids, lengths, words, ends, starts, docs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hit, there = known(words, ends, vocabulary)
                if not len(hit):
                    continue
                starts, docs, counts, lengths = (np.frombuffer(x, d) for x, d in ((starts, "<i4"), (docs, "<u2"), (counts, "<u4"), (lengths, "<i8")))
                size = (starts[hit + 1] - starts[hit]).astype(np.int64)
                own = np.repeat(starts[hit] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                row, doc = np.repeat(np.arange(len(hit)), size), docs[own].astype(np.int64)
                impact = corpus.impacts(counts[own], lengths[doc])
                local = np.full(len(vocabulary), -1, np.int64)
                local[there] = np.arange(len(hit))
                width = max(FAN, min(WIDTH, CELLS // len(hit)))
                for a in range(0, len(ids), width):
                    inside = (doc >= a) & (doc < a + width)
                    cells = np.zeros((len(hit), min(width, len(ids) - a)), np.int32)
                    cells[row[inside], doc[inside] - a] = impact[inside]
                    tree = Tree(cells)
                    for (_, own_terms), best in zip(items, held, strict=True):
                        rows = local[own_terms]
                        if (rows >= 0).any():
                            tree.best_first(rows[rows >= 0], weights[own_terms[rows >= 0]], best, ids[a : a + width])
        rows = [(item, id_, -score) for (item, _), best in zip(items, held, strict=True) for score, _, id_ in best.rows]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id", "score"])

    return found.select("ids", "lengths", "words", "word_ends", "starts", "runs", "counts").mapInArrow(X.trimmed(run), "item_id long, doc_id long, score long")


def search(found: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item in an `index`."""
    spark = found.sparkSession
    pairs = items.select(F.col(key).cast("long").alias("item_id"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).distinct()
    asked = X.written(pairs.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.count(F.lit(1)).alias("n")), "items")
    total = found.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    corpus = Corpus(*map(int, total))
    n_blocks = -(-int(asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // BLOCK_TERMS)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for i in range(n_blocks if corpus.n_docs else 0):
        block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).select("item_id", "terms").collect()
        out = out.unionByName(search_block(found, corpus, [(r.item_id, r.terms) for r in block], k))
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*best)
    every = Window.partitionBy("item_id").orderBy(*best)
    near = out.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k).drop("rank")
    return near.withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    return search(index(docs), items, k=k)
