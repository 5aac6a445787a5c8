"""Language-model scoring by context-tree weighting.

A text is its UTF-8 bytes with A-Z lower-cased, an end symbol (255, which UTF-8 never uses) after them
and zeros before. Each byte is eight binary decisions; each decision has a node in the context tree of
0, 1, ... DEPTH preceding bytes. A node's counts of zeros and ones give the Krichevsky-Trofimov block
probability Pe; Pw = Pe at DEPTH and (Pe + product of the children's Pw) / 2 above. A decision's
probability mixes the estimates of all depths with the weights that these products give to the nodes
after all training texts: p(d) = (b KT(d) + p(d + 1)) / (b + 1) with b = Pe / product.

The counts cover all training documents. Each block of documents sends its distinct words and its
distinct strings of DEPTH + 1 bytes (grams) with their training counts; a bucket's task sums them and
answers each block. Grams of one 2-byte context meet in one bucket, so depths from 2 on are local to it;
depths 1 and 0 have at most 256 * 255 and 255 nodes and are summed on the driver. Nothing else is collected; the rest grows with the input.

The base score beside it: add-half unigram over words `[^\\x20\\x09-\\x0D]+` and one end token.

Defined cases: null or empty text scores its end symbol; a null key is a training row (its block is a
fixed one); equal texts get equal scores; with no training row every count is 0; an empty table gives
no rows; other columns are ignored. Texts are scored whole, in chunks of whole documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X
from sparkloom.llm import text as T

#: Bytes of the longest context: 2 to 6.
DEPTH = 5
END = 255
END_WORD = np.uint64(0x454E44)  # stands for the end token beside 64-bit word hashes
WORDS = np.dtype([("key", "<u8"), ("count", "<u4")])
GRAMS = np.dtype([("key", "<u8"), ("count", "<u4")])
#: Counts over all documents, which four bytes don't hold.
COUNTED = np.dtype([("key", "<u8"), ("count", "<u8")])
ANSWER = np.dtype([("key", "<u8"), ("log2p", "<f4")])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, n_bytes long, bits double"
_HALF = math.log(0.5)


def is_held_out(key: str) -> Column:
    """crc32 of the id as text modulo 5 is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5, by Stirling's series at x + 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    r = 1 / y
    r2 = r * r
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 / 1680))) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with the DEPTH before it, as bytes of a number, and their offsets by document."""
    n = len(offs) - 1
    at = offs + np.arange(n + 1) * (DEPTH + 1)
    line = np.zeros(at[-1] + DEPTH, np.uint64)
    line[np.arange(len(data)) + np.repeat(at[:-1] + DEPTH - offs[:-1], np.diff(offs))] = T.LOWER[data]
    line[at[1:] - 1] = END
    g = np.zeros(len(line) - DEPTH, np.uint64)
    for i in range(DEPTH + 1):
        g = (g << np.uint64(8)) | line[i : i + len(g)]
    # position i ends at line[i + DEPTH]; a document's symbols begin DEPTH after its begin
    keep = np.ones(len(g), bool)
    skip = (at[1:, None] - DEPTH + np.arange(DEPTH)).ravel()
    keep[skip[skip < len(g)]] = False
    return g[keep][: offs[-1] + n], offs + np.arange(n + 1)


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], counts[order]
    cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[cut], np.add.reduceat(c, cut)


def distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how many of each are in training rows."""
    parts = []
    for flag in (True, False):
        k = keys[train] if flag else keys[~train]
        k = np.sort(k)
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        parts.append((k[cut], (np.diff(np.append(cut, len(k))) if flag else np.zeros(len(cut))).astype(np.int64)))
    return tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def word_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = T.LOWER[data]
    s, e, before = T.words(low, offs)
    return T.span_hash(T.prefix_hash(low), s, e), before


def places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and each one's place among them."""
    order = np.argsort(ids, kind="stable")
    first = np.concatenate(([True], ids[order][1:] != ids[order][:-1])) if len(ids) else np.zeros(0, bool)
    at = np.empty(len(ids), np.int64)
    at[order] = np.cumsum(first) - 1
    return ids[order][first], at


class Tree:
    """The nodes of depths DEPTH to 2 of one bucket's grams."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.key = key.astype(np.int64)
        x, k = self.key & 255, np.arange(8)[:, None]
        node = (1 << k) | (x >> (8 - k))
        self.bit = (x >> (7 - k)) & 1
        ids, at = places((self.key >> 8 << 8 | node).ravel())
        self.at = at.reshape(8, -1)
        many = np.broadcast_to(count, self.bit.shape).ravel().astype(np.float64)
        ones = self.bit.ravel() == 1
        # from the deepest level up: counts, each node's parent, and how far Pe outweighs the children
        self.zeros = [np.bincount(at, many * ~ones, len(ids))]
        self.ones = [np.bincount(at, many * ones, len(ids))]
        self.up, self.lean = [], []
        self.log_pw = log_kt(self.zeros[0], self.ones[0])
        for depth in range(DEPTH - 1, 1, -1):
            ids, up = places(ids & ((1 << (8 * depth + 8)) - 1))
            zeros, ones_, below = (np.bincount(up, v, len(ids)) for v in (self.zeros[-1], self.ones[-1], self.log_pw))
            own = log_kt(zeros, ones_)
            self.up.append(up)
            self.zeros.append(zeros)
            self.ones.append(ones_)
            self.lean.append(own - below)
            self.log_pw = np.logaddexp(_HALF + own, _HALF + below)
        self.ids = ids

    def roots(self) -> tuple[np.ndarray, ...]:
        """(1-byte context and node, zeros, ones, sum of log Pw) for depth 1."""
        id1, up = places(self.ids & 0xFFFF)
        return id1, *(np.bincount(up, v, len(id1)) for v in (self.zeros[-1], self.ones[-1], self.log_pw))

    def log2p(self, top: dict[str, np.ndarray]) -> np.ndarray:
        """Of each gram's last byte, given the others."""
        total = np.zeros(len(self.key))
        for k in range(8):
            a, bit = self.at[k], self.bit[k] == 1
            kt = lambda z, o: (np.where(bit, o, z) + 0.5) / (z + o + 1)  # noqa: B023, E731
            p = kt(self.zeros[0][a], self.ones[0][a])
            levels = []
            for i, up in enumerate(self.up):
                a = up[a]
                levels.append((self.zeros[i + 1][a], self.ones[i + 1][a], self.lean[i][a]))
            a = self.ids[a] & 0xFFFF
            levels.append((top["zeros1"][a], top["ones1"][a], top["lean1"][a]))
            levels.append((top["zeros0"][a & 255], top["ones0"][a & 255], top["lean0"][a & 255]))
            for z, o, lean in levels:
                w = 1 / (1 + np.exp(-np.clip(lean, -60, 60)))
                p = w * kt(z, o) + (1 - w) * p
            total += np.log2(p)
        return total


def top_of(rows) -> dict[str, np.ndarray]:
    """Depths 1 and 0 from the sums by (context byte, node): arrays of 65,536 and 256."""
    zeros, ones, below = (np.zeros(1 << 16) for _ in range(3))
    for r in rows:
        zeros[r["node"]], ones[r["node"]], below[r["node"]] = r["zeros"], r["ones"], r["log_pw"]
    own = log_kt(zeros, ones)
    pw1 = np.logaddexp(_HALF + own, _HALF + below)
    pw1[zeros + ones == 0] = 0
    z0, o0, b0 = (v.reshape(256, 256).sum(0) for v in (zeros, ones, pw1))
    return {"zeros1": zeros, "ones1": ones, "lean1": own - below, "zeros0": z0, "ones0": o0, "lean0": log_kt(z0, o0) - b0}


def counted_rows(keys: np.ndarray, counts: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Packed rows; a count that its field doesn't hold is an error (of a block alone: more than 4 GB of one gram)."""
    if len(counts) and counts.max() > np.iinfo(dtype["count"]).max:
        raise OverflowError("a block's count has more than four bytes")
    rows = np.empty(len(keys), dtype)
    rows["key"], rows["count"] = keys, counts
    return rows


def merged(payloads: list[bytes], dtype: np.dtype) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    parts = [np.frombuffer(p, dtype) for p in payloads]
    return parts, *tally(np.concatenate([p["key"] for p in parts]), np.concatenate([p["count"] for p in parts]).astype(np.int64))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    n_blocks, n_buckets = X.partitions(spark), X.buckets(spark)
    held = F.coalesce(is_held_out(key) if held_out is None else held_out, F.lit(False))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), held.alias("held"))
    keys = X.one_key_a_partition(spark, n_blocks)
    assert len(keys) == n_blocks
    packed = X.blocks(docs, F.xxhash64("doc_id", "text"), n_blocks)
    parts = lambda: packed.repartition(n_blocks, "bucket")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {"w": [], "g": []}
        home = None
        for batch in batches:
            for b, p in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                home, rows = b, X.unblocked(p)
                data, offs = T.column(rows.column(1))
                train = ~rows.column(2).to_numpy(zero_copy_only=False)
                for a, z, d, o in T.chunks(data, offs):
                    h, before = word_keys(d, o)
                    mine = train[a:z]
                    own = np.repeat(mine, np.diff(before))
                    sums["w"].append(distinct(np.concatenate((h, np.full(z - a, END_WORD))), np.concatenate((own, mine))))
                    g, at = grams(d, o)
                    sums["g"].append(distinct(g, np.repeat(mine, np.diff(at))))
                    for v in sums.values():
                        if len(v) >= 12:
                            v[:] = [tally(np.concatenate([x[0] for x in v]), np.concatenate([x[1] for x in v]))]
        if home is None:
            return
        for kind, dtype in (("w", WORDS), ("g", GRAMS)):
            k, c = tally(np.concatenate([x[0] for x in sums[kind]]), np.concatenate([x[1] for x in sums[kind]]))
            rows = counted_rows(k, c, dtype)
            bucket = T.mix(k.astype(np.uint64) if kind == "w" else (k >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(n_buckets)
            yield X.packed(bucket.astype(np.int64) + (n_buckets if kind == "g" else 0), rows, home)

    asked = X.written(parts().mapInArrow(X.trimmed(ask), X.PACKED), "asked")
    word_rows, gram_rows = asked.filter(F.col("bucket") < n_buckets), asked.filter(F.col("bucket") >= n_buckets)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, origins, payloads in X.by_bucket(batches):
            own, k, c = merged(payloads, WORDS)
            out = []
            for p in own:
                out.append(counted_rows(p["key"], c[np.searchsorted(k, p["key"])], COUNTED).tobytes())
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array(origins, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(out, pa.binary()), pa.array([int(c.sum())] + [0] * (n - 1), pa.int64()), pa.array([int((c > 0).sum())] + [0] * (n - 1), pa.int64())], names=["bucket", "origin", "payload", "tokens", "types"])

    words = X.written(X.exchanged(word_rows, count_words, X.PACKED + ", tokens long, types long"), "words")
    totals = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, payloads in X.by_bucket(batches):
            _, k, c = merged(payloads, GRAMS)
            node, zeros, ones, log_pw = Tree(k, c).roots()
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(zeros), pa.array(ones), pa.array(log_pw)], names=["node", "zeros", "ones", "log_pw"])

    sums = X.exchanged(gram_rows, climb, "node long, zeros double, ones double, log_pw double").groupBy("node").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "log_pw")))
    top = spark.sparkContext.broadcast(top_of(sums.collect()))  # at most 256 * 255 rows

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, origins, payloads in X.by_bucket(batches):
            own, k, c = merged(payloads, GRAMS)
            p = Tree(k, c).log2p(top.value).astype("<f4")
            out = []
            for q in own:
                a = np.empty(len(q), ANSWER)
                a["key"], a["log2p"] = q["key"], p[np.searchsorted(k, q["key"])]
                out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(origins, pa.int32()), pa.array([-1] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["bucket", "origin", "payload"])

    answers = X.exchanged(gram_rows, answer, X.PACKED)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {-1: [], 0: []}
        look = None
        for batch in batches:
            for o, p in zip(batch.column("origin").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if o < 1:
                    held[o].append(p)
                    continue
                if look is None:
                    look = Lookup(np.frombuffer(b"".join(held[0]), COUNTED), np.frombuffer(b"".join(held[-1]), ANSWER))
                    held.clear()
                rows = X.unblocked(p)
                data, offs = T.column(rows.column(1))
                for a, z, d, at in T.chunks(data, offs):
                    yield look.rows(rows.column(0)[a:z], rows.column(2)[a:z], d, at)

    every = words.select("bucket", "origin", "payload").unionByName(answers).unionByName(packed)
    # answers sort before texts, and the texts stream through
    scored = every.repartition(n_blocks, "bucket").sortWithinPartitions("bucket", "origin").mapInArrow(X.trimmed(final), SCORES)
    scale = math.log10(totals["n"] + 0.5 * (totals["v"] + 1))
    bits = F.col("bits")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(totals["n"])).cast("long").alias("train_tokens"), (F.col("base_log") - scale * F.col("n_tokens")).alias("base_score"), (-bits * math.log10(2)).alias("score"), "n_bytes", (bits / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


class Table:
    """An open-addressing table from 64-bit keys to values; every key looked up must be in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys, self.values = keys, values
        left, at = np.arange(len(keys), dtype=np.int32), self.spot(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of those that want one place the last gets it
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.spot(keys)
        found = self.slot[at]
        left = np.flatnonzero(self.keys[found] != keys)
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found[left] = self.slot[at[left]]
            left = left[self.keys[found[left]] != keys[left]]
        return self.values[found]


class Lookup:
    """A block's answers."""

    def __init__(self, words: np.ndarray, answers: np.ndarray):
        order = np.argsort(words["key"])
        self.words, self.log_count = words["key"][order], np.log10(words["count"][order] + 0.5)
        self.known = words["count"][order] > 0
        self.table = Table(answers["key"].copy(), answers["log2p"].astype(np.float32))

    def rows(self, ids: pa.Array, held: pa.Array, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        h, before = word_keys(data, offs)
        at = np.searchsorted(self.words, h)
        end = int(np.searchsorted(self.words, END_WORD))
        n = np.diff(before)
        sums = np.concatenate(([0.0], np.cumsum(self.log_count[at])))
        base = np.array([self.log_count[at[a:b]].sum() for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]) + self.log_count[end] if len(n) else sums[:0]
        known = T.sums_by(self.known[at], before) + int(self.known[end])
        g, go = grams(data, offs)
        p = self.table.get(g)
        bits = -np.add.reduceat(p.astype(np.float64), go[:-1]) if len(n) else sums[:0]
        return pa.RecordBatch.from_arrays([ids, held, pa.array(n + 1), pa.array(known), pa.array(base), pa.array(np.diff(offs)), pa.array(bits)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_log", "n_bytes", "bits"])
