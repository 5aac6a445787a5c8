"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document's set holds the 64-bit hashes of its distinct word n-grams. All sets are ordered by one
global order, rare first: by the count of the n-gram's cell in a table of CELLS counters summed over the
whole corpus, then by hash (any common order gives the right pairs; the counts only make prefixes
selective, and the table is as large for any corpus). Two sets of similarity t and more share a token in
their first n - ceil(t n) + 1; those tokens are exchanged in packed rows. A token's owners become
candidates under the length and positional filters. Two filters then look at what lies behind the prefix: a bitmap of
the parities of a set's hashes, about one bit for each n-gram (bits that differ are at most as many as n-grams that
differ), and, where two sets meet, the suffix filter: the tokens of one set that halve it again and again cut both
sets into parts, and what the sizes of two parts differ by are n-grams that differ. Only then are the sets merged.

No token's owners are all paired. Tokens with few owners give their pairs; of the others each owner is
first paired with the owner of a similar size that has the fewest rarer tokens, the middle of the group.
Per document its pair with the fewest rarer tokens is verified, verified links give components, and only
candidates that lie in different components are verified in a second round, for frequent tokens by a join on token and size class. So no link between
different texts is lost that could change a component. A task sends a set that many documents have
once. Sets of documents without a candidate never leave their task.

Defined cases: null or empty text, or one without words, is an empty set, linked with nothing; with
fewer than n words the whole sequence is one n-gram; rows that repeat a doc_id are one node; a row
without doc_id is in no component; an empty table gives no rows; other columns are ignored. Only A-Z
are lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X
from sparkloom.llm import text as T
from sparkloom.llm.graph import components

NGRAM = 3
PERCENT = 90
CELL_BITS = 18
#: Owners up to which a token gives all its pairs at once.
FEW = 24
#: Width of a band of set sizes, as a logarithm.
BAND = 0.05
#: Sets compared with one other in one task.
FAN = 256
#: Parts that the suffix filter cuts a set into: five halvings.
PARTS = 32
TOKEN = np.dtype([("token", "<u8"), ("owner", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def sets(data: np.ndarray, offs: np.ndarray, ngram: int) -> Iterator[np.ndarray]:
    """Each document's n-gram hashes, ascending and distinct."""
    low = T.LOWER[data]
    s, e, before = T.words(low, offs)
    h = T.span_hash(T.prefix_hash(low), s, e)
    grams = T.window_hash(h, ngram)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= ngram:
            v = np.sort(grams[a : b - ngram + 1])
            yield v[np.concatenate(([True], v[1:] != v[:-1]))]
        elif b > a:
            yield T.mix(T.window_hash(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def need(n, percent: int):
    """ceil(percent / 100 * n)"""
    return (percent * n + 99) // 100


def overlap_needed(nx, ny, percent: int):
    """The least intersection with 100 * i >= percent * (nx + ny - i)."""
    return -(-(percent * (nx + ny)) // (100 + percent))


def cells(docs: DataFrame, ngram: int) -> np.ndarray:
    """Corpus counts by cell: CELLS numbers on the driver, whatever the size of the corpus."""
    part = 1 << (CELL_BITS - 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            data, offs = T.column(batch.column(1))
            for _, _, d, o in T.chunks(data, offs):
                got = list(sets(d, o, ngram))
                total += np.bincount((np.concatenate(got) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        if total.any():
            yield X.packed(np.arange(1 << CELL_BITS) // part, total.astype("<u4").view(np.dtype([("c", "<u4")])), 0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, payloads in X.by_bucket(batches):
            total = sum(np.frombuffer(p, "<u4").astype(np.int64) for p in payloads)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.minimum(total, (1 << 31) - 1).astype("<u4").tobytes()], pa.binary())], names=["bucket", "payload"])

    out = np.zeros(1 << CELL_BITS, np.uint64)
    for r in X.exchanged(docs.mapInArrow(X.trimmed(count), X.PACKED), add, "bucket int, payload binary").collect():
        out[r.bucket * part : (r.bucket + 1) * part] = np.frombuffer(r.payload, "<u4")
    return out


def tokens(docs: DataFrame, counts, ngram: int, percent: int, n_buckets: int) -> DataFrame:
    """PACKED prefix tokens; bucket -1 holds (doc_id, n, digest) and parities of every document instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, seen = np.minimum(counts.value, (1 << 20) - 1), set()
        for batch in batches:
            data, offs = T.column(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b, d, o in T.chunks(data, offs):
                out, meta, full, half = [], [], [], []
                for k, v in zip(ids[a:b], sets(d, o, ngram), strict=True):
                    digest = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
                    full.append(parities(v, parity_bits(len(v))))
                    half.append(full[-1][: len(full[-1]) // 2] ^ full[-1][len(full[-1]) // 2 :])
                    meta.append(len(v).to_bytes(8, "big") + digest)
                    if k is None or not len(v) or digest in seen:
                        continue
                    seen.add(digest)
                    key = np.sort((rare[(v >> np.uint64(64 - CELL_BITS)).astype(np.int64)] << np.uint64(44)) | (v >> np.uint64(20)))
                    p = len(v) - need(len(v), percent) + 1
                    rows = np.empty(p, TOKEN)
                    rows["token"], rows["owner"], rows["n"], rows["pos"] = key[:p], k, len(v), np.arange(p)
                    out.append(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, -1, np.int32)), pa.array(ids[a:b], pa.int64()), pa.array(meta, pa.binary()), lists(full), lists(half)], names=["bucket", "origin", "payload", "full", "half"])
                if out:
                    rows = np.concatenate(out)
                    got = X.packed((T.mix(rows["token"]) % np.uint64(n_buckets)).astype(np.int64), rows, 0)
                    hole = pa.nulls(got.num_rows, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*got.columns, hole, hole], names=["bucket", "origin", "payload", "full", "half"])

    return docs.mapInArrow(X.trimmed(run), X.PACKED + ", full array<long>, half array<long>")


def lists(rows: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(rows).view(np.int64)))


def parity_bits(n: int) -> int:
    """A power of two, at least n; sizes of two similar sets differ by a factor of two at most."""
    return max(256, 1 << max(0, n - 1).bit_length())


def parities(v: np.ndarray, bits: int) -> np.ndarray:
    """Bit i: is the number of hashes that are i modulo `bits` odd?"""
    odd = np.bincount((v & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def differ_at_least(u: np.ndarray, v: np.ndarray) -> int:
    """A lower bound of the tokens that are in one of two ascending sets alone: `u`'s tokens at PARTS - 1 even places
    cut both."""
    at = len(u) * np.arange(1, PARTS) // PARTS
    mine = np.diff(np.concatenate(([0], at, [len(u)])))
    other = np.diff(np.concatenate(([0], np.searchsorted(v, u[at]), [len(v)])))
    return int(np.abs(mine - other).sum())


CANDIDATES = "x long, y long, token long, n int, pos int"


def pair_up(percent: int):
    """Reduce step over prefix tokens: pairs (x, y, pos: rarer tokens of both), and (x, token, n, pos) of
    tokens with many owners."""

    def passes(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        nx, ny = rows["n"][i].astype(np.int64), rows["n"][j].astype(np.int64)  # nx <= ny by the sort
        room = 1 + np.minimum(nx - rows["pos"][i], ny - rows["pos"][j]) - 1
        return (rows["owner"][i] != rows["owner"][j]) & (nx >= need(ny, percent)) & (room >= overlap_needed(nx, ny, percent))

    def joined(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ends = np.sort(np.stack((rows["owner"][i], rows["owner"][j])), axis=0)
        return np.vstack((ends, rows["pos"][i].astype(np.int64) + rows["pos"][j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, payloads in X.by_bucket(batches):
            rows = np.frombuffer(b"".join(payloads), TOKEN)
            rows = rows[np.lexsort((rows["owner"], rows["n"], rows["token"]))]
            t = rows["token"]
            cut = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True])))
            size = np.diff(cut)
            many = np.repeat(size > FEW, size)
            few, pairs = rows[~many & np.repeat(size > 1, size)], []
            for d in range(1, FEW):
                i = np.flatnonzero(few["token"][d:] == few["token"][:-d]) if len(few) > d else np.zeros(0, np.int64)
                if not len(i):
                    break
                i = i[passes(few, i, i + d)]
                pairs.append(joined(few, i, i + d))
            for a, b in zip(cut[:-1][size > FEW].tolist(), cut[1:][size > FEW].tolist(), strict=True):
                g = rows[a:b]
                # the owner with the fewest rarer tokens is nearest to what the group has in common
                n, at = g["n"].astype(np.int64), np.arange(b - a)
                band = np.floor(np.log(n) / BAND).astype(np.int64)
                edge = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1], [True])))
                middle = np.array([y + np.argmin(g["pos"][y:z]) for y, z in zip(edge[:-1], edge[1:], strict=True)])
                own = np.searchsorted(edge, at, "right") - 1
                for near in (-1, 0, 1):
                    other = middle[np.clip(own + near, 0, len(middle) - 1)]
                    i, j = np.minimum(other, at), np.maximum(other, at)
                    ok = (i < j) & passes(g, i, j)
                    pairs.append(joined(g, i[ok], j[ok]))
            pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), np.int64)
            pairs = pairs[:, np.lexsort((pairs[2], pairs[1], pairs[0]))]
            if pairs.shape[1]:
                pairs = pairs[:, np.concatenate(([True], (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)))]
            g, k = rows[many], pairs.shape[1]
            hole = lambda kind, size: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((pairs[0], g["owner"]))), pa.concat_arrays([pa.array(pairs[1]), hole(pa.int64(), len(g))]), pa.concat_arrays([hole(pa.int64(), k), pa.array(g["token"].view(np.int64))]), pa.concat_arrays([hole(pa.int32(), k), pa.array(g["n"].astype(np.int32))]), pa.concat_arrays([pa.array(pairs[2].astype(np.int32)), pa.array(g["pos"].astype(np.int32))])], names=["x", "y", "token", "n", "pos"])

    return run


def verify(pairs: DataFrame, docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    bits = spark.sparkContext.broadcast(X.bloom(wanted))

    def own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(X.maybe_in(bits.value, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) & ~np.asarray(batch.column(0).is_null()))
            part = pa.Table.from_batches([batch]).filter(hit)
            data, offs = T.column(part.column(1))
            for a, b, d, o in T.chunks(data, offs):
                yield pa.RecordBatch.from_arrays([part.column(0).combine_chunks()[a:b], pa.array([v.tobytes() for v in sets(d, o, ngram)], pa.binary())], names=["owner", "grams"])

    held = X.written(docs.mapInArrow(X.trimmed(own_sets), "owner long, grams binary").filter("octet_length(grams) > 0"), "sets")
    fan = pairs.groupBy("x").agg(F.count("*").alias("m"))
    spread = pairs.join(fan, "x").withColumn("salt", F.pmod(F.xxhash64("y"), F.ceil(F.col("m") / FAN)).cast("int")).select("x", "y", "salt")
    left = spread.select("x", "salt").distinct().join(held, F.col("x") == F.col("owner")).select("x", "salt", F.lit(None).cast("long").alias("y"), "grams")
    right = spread.join(held, F.col("y") == F.col("owner")).select("x", "salt", "y", "grams")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, []
        for batch in batches:
            xs, ys = [], []
            for x, salt, y, g in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                v = np.frombuffer(g, np.uint64)
                if now != (x, salt):
                    now, mine = (x, salt), []
                if y is None:
                    mine.append(v)  # more than one where rows repeat a doc_id
                    continue
                for u in mine:
                    least = overlap_needed(len(u), len(v), percent)
                    if differ_at_least(u, v) > len(u) + len(v) - 2 * least:
                        continue
                    both = np.concatenate((u, v))
                    both.sort(kind="stable")
                    if int((both[1:] == both[:-1]).sum()) >= least:
                        xs.append(x)
                        ys.append(y)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    rows = left.unionByName(right).repartition(X.partitions(spark), "x", "salt").sortWithinPartitions("x", "salt", F.col("y").asc_nulls_first())
    return X.written(rows.mapInArrow(X.trimmed(compare), "x long, y long"), "links")


def jaccard_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("owner"), F.col(text).cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(cells(docs, ngram))
    sent = X.written(tokens(docs, counts, ngram, percent, X.buckets(spark)), "prefixes")
    meta = sent.filter("bucket = -1").select(F.col("origin").alias("doc_id"), F.conv(F.hex(F.substring("payload", 1, 8)), 16, 10).cast("long").alias("n_shingles"), F.substring("payload", 9, 16).alias("digest"), "full", "half")
    # a doc_id that stands for several sets has no one bitmap, and then none is held against it
    sole = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    shape = meta.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "full", "half").filter("node is not null and size > 0")
    shape = X.written(shape.groupBy("node").agg(sole("size"), sole("full"), sole("half")), "shapes")
    found = X.written(X.exchanged(sent.filter("bucket >= 0").select("bucket", "origin", "payload"), pair_up(percent), CANDIDATES), "candidates")
    pairs = found.filter("y is not null").groupBy("x", "y").agg(F.min("pos").alias("rarer"))
    wide = found.filter("y is null").select(F.col("x").alias("node"), "token", "n", "pos")

    pairs = X.written(pairs, "pairs")
    ends = pairs.select(F.col("x").alias("node"), F.col("y").alias("other"), "rarer").unionByName(pairs.select(F.col("y").alias("node"), F.col("x").alias("other"), "rarer"))
    nearest = ends.groupBy("node").agg(F.min(F.struct("rarer", "other")).alias("best")).select(F.least("node", "best.other").alias("x"), F.greatest("node", "best.other").alias("y")).distinct()
    nearest = X.written(plausible(nearest, shape, percent), "nearest")
    links = verify(nearest, docs, ngram, percent)
    same = meta.filter("n_shingles > 0 and doc_id is not null").select("digest", "doc_id")
    first = X.written(same.groupBy("digest").agg(F.min("doc_id").alias("first")), "first")  # a table, so that a digest of many copies can be split
    copies = X.written(same.join(first, "digest").filter("first < doc_id").select(F.col("first").alias("x"), F.col("doc_id").alias("y")).distinct(), "copies")
    part = X.written(components(links.unionByName(copies)), "components")

    rest = pairs.join(part.withColumnsRenamed({"node": "x", "component": "cx"}), "x", "left").join(part.withColumnsRenamed({"node": "y", "component": "cy"}), "y", "left")
    rest = rest.filter("coalesce(cx, x) <> coalesce(cy, y)").select("x", "y")
    # the nearest pairs have been verified, so that no pair is twice
    rest = plausible(rest, shape, percent).unionByName(across(wide, part, shape, percent)).distinct().join(nearest, ["x", "y"], "left_anti")
    more = verify(X.written(rest, "pairs"), docs, ngram, percent)
    part = components(part.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(more))
    out = meta.join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def apart(a: str, b: str) -> Column:
    """How many parities differ at least between two sets, from their columns full and half with a suffix;
    null where the bitmaps have no common size."""
    full, half = (lambda s: F.col(f"full_{s}")), (lambda s: F.col(f"half_{s}"))
    same = F.size(full(a)) == F.size(full(b))
    one = F.when(same | (F.size(full(a)) == F.size(half(b))), full(a)).when(F.size(half(a)) == F.size(full(b)), half(a))
    two = F.when(same | (F.size(half(a)) == F.size(full(b))), full(b)).when(F.size(full(a)) == F.size(half(b)), half(b))
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def near_enough(sizes: Column, percent: int) -> Column:
    """Whether two sets of this size together can be similar, by their parities."""
    return F.coalesce(apart("a", "b") * (100 + percent) <= (100 - percent) * sizes, F.lit(True))


def plausible(pairs: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that the bitmaps don't rule out."""
    held = lambda key, s: shape.select(F.col("node").alias(key), *(F.col(c).alias(f"{c}_{s}") for c in ("size", "full", "half")))
    out = pairs.select("x", "y").join(held("x", "a"), "x").join(held("y", "b"), "y")
    return out.filter(near_enough(F.col("size_a") + F.col("size_b"), percent)).select("x", "y")


def across(wide: DataFrame, part: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Candidates of tokens with many owners that lie in different components."""
    rows = wide.join(part, "node", "left").withColumn("c", F.coalesce("component", "node"))
    mixed = rows.groupBy("token").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b").select("token")
    step = max(float(np.log(100 / percent)), 1e-3) * 1.001  # a little wide, for rounding
    rows = rows.join(mixed, "token").withColumn("size_class", F.floor(F.log("n") / step)).select("token", "node", "n", "pos", "c", "size_class")
    rows = X.written(rows.join(shape.select("node", "full", "half"), "node"), "wide")
    a = rows.select("token", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "c", "full", "half")), F.explode(F.array(F.col("size_class"), F.col("size_class") + 1)).alias("size_class"))
    b = rows.select("token", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "c", "full", "half")), "size_class")
    total = F.col("n_a") + F.col("n_b")
    both = a.join(b, ["token", "size_class"]).filter("c_a <> c_b and n_a <= n_b and (n_a < n_b or node_a < node_b)").filter(100 * F.col("n_a") >= percent * F.col("n_b"))
    both = both.filter((100 + percent) * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= percent * total)
    both = both.filter(near_enough(total, percent))
    return both.select(F.least("node_a", "node_b").alias("x"), F.greatest("node_a", "node_b").alias("y"))
