"""Suffix-array dedup: column-wise construction over many short strings.

A byte goes when a 50-byte string that covers it also starts in a document with a smaller id. Every
50-byte string has an anchor, its least 26-byte substring by a hash, the same wherever the string
stands; so the strings of a document fall into units, runs of strings with one anchor. Anchors that
occur once in the corpus end the matter for their units. Units of the others are sent to their
anchor's bucket, each distinct one once a block with its least document.

There the collection is indexed column by column: each round puts one symbol of each unit, from the last
to the first, into the Burrows-Wheeler transform, finds the place of the grown suffix by the stable order
of the symbols seen so far, and brings the common prefixes of the new suffix and of its successor up to
date by the least common prefix between two occurrences of the symbol. The transform, the common
prefixes and the tags are read and rewritten sequentially in each round, in files beyond IN_MEMORY bytes.
Units of different anchors can't share a string, so collections are cut between anchors, and a distinct
unit that is alone with its anchor needs no index. Intervals of common prefixes of 50 and more hold the equal strings, and their least document decides.

Equal texts meet in one block, sent once by each task, and are indexed once: the copy with the least id
stands for all. Units of an anchor with more than HOT distinct ones are split into their 50-byte strings,
dealt by content, so that no passage which a large part of the corpus has lands in one task.

Defined cases: null text is empty; a text under 50 bytes loses nothing; rows that repeat a doc_id aren't
smaller than each other; a null doc_id counts as larger than any; an empty table gives no rows; other
columns are ignored. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X
from sparkloom.llm import text as T

LENGTH = 50
ANCHOR = 26
SPAN = LENGTH - ANCHOR + 1
HOT = 20_000
#: Units of one collection, about; those of one anchor are never parted.
COLLECTION = 4096
IN_MEMORY = 64 << 20
NO_ID = np.iinfo(np.int64).max
SEEN = np.dtype([("value", "<u4"), ("block", "<u2")])
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of a chunk: (first string's start, number of strings, 64-bit value of the anchor)."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = T.BYTE_VALUE[data]
    size = 1
    for grow in (1, 2, 4, 8, 10):  # 2, 4, 8, 16, 26
        m = len(h) - grow
        h = (h[:m] * np.uint64(pow(0x9E3779B97F4A7C15, grow, 1 << 64)) + h[grow:]) if grow == size else h[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[grow:] ^ (h[grow:] >> np.uint64(31)))
        size += grow
    assert size == ANCHOR and len(h) == n - ANCHOR + 1
    value = T.mix(h)
    bits = np.uint64(max(1, int(len(value)).bit_length()))
    key = (value >> bits << bits) | np.arange(len(value), dtype=np.uint64)
    least, size = key, 1
    for grow in (1, 2, 4, 8, 9):  # 2, 4, 8, 16, 25
        least = np.minimum(least[: len(least) - grow], least[grow:])
        size += grow
    assert size == SPAN
    starts = np.arange(n - LENGTH + 1)
    end = np.repeat(offs[1:], np.diff(offs))[: n - LENGTH + 1]
    inside = starts + LENGTH <= end
    starts = starts[inside]
    at = (least[: n - LENGTH + 1][inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    return starts[cut], np.diff(np.append(cut, len(at))), value[at[cut]]


class Column:
    """A sequentially rewritten array, in a file once it is large."""

    def __init__(self, dtype):
        self.dtype = np.dtype(dtype)
        self.file = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)  # noqa: SIM115

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.truncate()
        self.file.write(np.ascontiguousarray(values, self.dtype).data)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(bytearray(self.file.read()), self.dtype)

    def close(self) -> None:
        self.file.close()


def index(data: np.ndarray, offs: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform, common prefixes and tags of a collection of strings (none empty).

    tags[r] is the start in `data` of the r-th smallest suffix, for suffixes of `depth` symbols and more,
    else -1. Ends of strings sort before all symbols, in the strings' order.
    """
    n = len(offs) - 1
    length = np.diff(offs)
    kind = np.uint8 if data.max(initial=0) < 255 else np.int16
    symbol = data.astype(kind) + kind(1)
    files = Column(kind), Column(np.uint8), Column(np.int32)
    files[0].write(np.zeros(n))
    files[1].write(np.zeros(n))
    files[2].write(np.full(n, -1))
    live = np.arange(n)  # strings that still grow, and the place of their last suffix
    place = np.arange(n)
    for j in range(1, int(length.max(initial=0)) + 1):
        bwt, lcp = files[0].read(), files[1].read()
        more = length[live] >= j
        live, place = live[more], place[more]
        start = offs[live + 1] - j
        bwt[place] = symbol[start]
        order = np.argsort(bwt, kind="stable")
        ends = int((bwt == 0).sum())
        order = order[ends:]  # the r-th of these is followed, one symbol on, by new place n + r
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        new = rank[place].astype(np.int64)
        grown = len(order) + n
        fresh = np.zeros(grown, bool)
        fresh[new + n] = True
        old = ~fresh
        out = np.zeros(grown, np.uint8)
        out[old] = lcp
        touched = fresh.copy()
        touched[1:] |= fresh[:-1]
        r = np.flatnonzero(touched[n:])
        prev = np.where(r > 0, order[r - 1], 0)
        here = order[r]
        same = (r > 0) & (bwt[prev] == bwt[here])
        out[r[~same] + n] = 0
        a, b = prev[same] + 1, here[same] + 1
        if len(a):
            by = np.argsort(a, kind="stable")
            pairs = np.stack((a[by], b[by]), axis=1).ravel()
            least = np.minimum.reduceat(np.append(lcp, np.uint8(0)), pairs)[::2]
            out[r[same][by] + n] = np.minimum(least.astype(np.int64) + 1, 255)
        wide = np.zeros(grown, kind)
        wide[old] = bwt
        files[0].write(wide)
        files[1].write(out)
        tag = np.full(grown, -1, np.int32)
        if j > depth:
            tag[old] = files[2].read()
        if j >= depth:
            tag[new + n] = start
            files[2].write(tag)
        place = new + n
    result = tuple(f.read() for f in files)
    for f in files:
        f.close()
    return result if len(result[2]) == len(result[0]) else (*result[:2], np.full(len(result[0]), -1, np.int32))


def repeated(data: np.ndarray, offs: np.ndarray, docs: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each position: does the string of `depth` symbols that starts there also start in a string of
    the collection with a smaller document?"""
    out = np.zeros(len(data), bool)
    _, lcp, tags = index(data, offs, depth)
    group = np.cumsum(lcp < depth)
    at = np.flatnonzero(tags >= 0)
    if len(at):
        own = docs[np.searchsorted(offs, tags[at], "right") - 1]
        g = group[at]
        cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        least = np.minimum.reduceat(own, cut)
        out[tags[at]] = own > np.repeat(least, np.diff(np.append(cut, len(g))))
    return out


class Block:
    """The distinct texts of a block, with the ids of each."""

    def __init__(self):
        self.texts: dict[bytes, int] = {}
        self.parts: list[bytes] = []
        self.ids: list[list] = []

    def add(self, payload: bytes) -> None:
        rows = X.unblocked(payload)
        for ids, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            key = hashlib.blake2b(t, digest_size=16).digest()
            if key not in self.texts:
                self.texts[key] = len(self.parts)
                self.parts.append(t)
                self.ids.append([])
            self.ids[self.texts[key]] += [NO_ID if i is None else i for i in ids]

    def close(self) -> None:
        self.least = np.array([min(x) for x in self.ids], np.int64)
        self.offs = np.concatenate(([0], np.cumsum([len(p) for p in self.parts]))).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.parts), np.uint8)
        self.texts.clear()
        self.parts.clear()

    def units(self, known: np.ndarray, hot: np.ndarray, n_buckets: int) -> None:
        """Candidate units by content: start, strings, document, key, bucket, anchor."""
        found = []
        for a, _, d, o in T.chunks(self.data, self.offs):
            start, many, value = anchors(d, o)
            ident = identity(value, n_buckets)
            keep = member(ident, known)
            start, many, ident = start[keep], many[keep], ident[keep]
            split = member(ident, hot)
            one = np.repeat(start[split], many[split]) + within(many[split])
            start, ident = np.concatenate((start[~split], one)), np.concatenate((ident[~split], np.zeros(len(one), np.uint64)))
            many = np.concatenate((many[~split], np.ones(len(one), np.int64)))
            single = np.arange(len(start)) >= len(start) - len(one)
            key = T.span_hash(T.prefix_hash(d), start, start + many + LENGTH - 1)
            bucket = np.where(single, key % np.uint64(n_buckets), ident >> np.uint64(32)).astype(np.int64)
            # a string of its own must not be taken for a unit of one string
            key = np.where(single, key ^ np.uint64(1 << 63), key)
            anchor = np.where(single, key, ident).astype(np.uint32)
            found.append((start + self.offs[a], many, np.searchsorted(o, start, "right") - 1 + a, key, bucket, anchor))
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(6)]
        doc = self.least[cols[2].astype(np.int64)] if len(cols[2]) else np.zeros(0, np.int64)
        order = np.lexsort((doc, cols[3]))
        self.start, self.many, self.row, self.key, self.bucket, self.anchor = (c[order] for c in cols)
        self.doc = doc[order]
        self.head = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1]))) if len(order) else np.zeros(0, np.int64)


def identity(value: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and 32 further bits of an anchor. Two anchors that share them are only looked at in vain."""
    return ((value % np.uint64(n_buckets)) << np.uint64(32)) | (value >> np.uint64(32))


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def within(many: np.ndarray) -> np.ndarray:
    """0, 1, ... many[0] - 1, 0, 1, ..."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


#: A unit's content, least document, number of strings, and what of its anchor the bucket doesn't tell.
UNIT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("anchor", "<u4"), ("many", "u1")])
REPLY = np.dtype([("key", "<u8"), ("mask", "<u4")])


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """REMOVED of every row: what goes and what stays."""
    spark = docs.sparkSession
    n_blocks, n_buckets = X.partitions(spark), X.buckets(spark)
    if n_blocks >= 1 << 16:
        raise ValueError("a block's number has two bytes here")
    keys = np.array(X.one_key_a_partition(spark, n_blocks), np.int64)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), F.pmod(F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(n_blocks)).cast("int").alias("block"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors by bucket, once for each distinct text of a batch and its block."""
        for batch in X.rebatched(batches):
            words = batch.column(1).fill_null(b"").dictionary_encode()
            first = np.unique(words.indices.to_numpy(), return_index=True)[1]
            data, offs = T.column(words.dictionary)
            where = batch.column(2).to_numpy()[first]
            out = []
            for a, _, d, o in T.chunks(data, offs):
                start, _, value = anchors(d, o)
                row = np.searchsorted(o, start, "right") - 1 + a
                once = np.unique(T.mix(value + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), return_index=True)[1]
                ident = identity(value[once], n_buckets)
                rows = np.empty(len(once), SEEN)
                rows["value"], rows["block"] = ident & np.uint64(0xFFFFFFFF), where[row[once]]
                out.append(((ident >> np.uint64(32)).astype(np.int64), rows))
            if out:
                yield X.packed(np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), 0)

    def seen_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block its anchors that occur more than once; origin -2: those that are hot."""
        for b, _, payloads in X.by_bucket(batches):
            rows = np.frombuffer(b"".join(payloads), SEEN)
            v = np.sort(rows["value"])
            cut = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            size = np.diff(np.append(cut, len(v)))
            twice, hot = v[cut][size > 1], v[cut][size > HOT]
            rows = rows[member(rows["value"], twice)]
            for kind, part in ((-3, rows), (-2, rows[member(rows["value"], hot)])):
                part = np.unique(part)
                ident = (np.uint64(b) << np.uint64(32)) | part["value"].astype(np.uint64)
                got = X.packed(keys[part["block"].astype(np.int64)], ident.view(np.dtype([("v", "<u8")])), kind)
                if got.num_rows:
                    yield got

    known = X.written(X.exchanged(docs.mapInArrow(X.trimmed(ask), X.PACKED), seen_twice, X.PACKED), "anchors")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """PACKED texts by block, each distinct one of a batch once."""
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in X.rebatched(batches):
            words = batch.column(1).fill_null(b"").dictionary_encode()
            code, where = words.indices.to_numpy(), batch.column(2).to_numpy()
            order = np.lexsort((code, where))
            ids = batch.column(0).take(pa.array(order))
            code, where = code[order], where[order]
            cut = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True]))) if len(code) else np.zeros(1, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), ids)
            texts = words.dictionary.take(pa.array(code[cut[:-1]]))
            rows = pa.RecordBatch.from_arrays([lists, texts], names=["ids", "text"])
            home = where[cut[:-1]]
            edge = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True]))) if len(home) else np.zeros(1, np.int64)
            out = []
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in rows.slice(a, z - a).columns], schema=rows.schema))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys[home[edge[:-1]]], pa.int32()), pa.array(np.full(len(out), 1), pa.int64()), pa.array(out, pa.binary())], names=["bucket", "origin", "payload"])

    texts = docs.mapInArrow(X.trimmed(send), X.PACKED)

    def gather(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, Block, np.ndarray]:
        """A block's texts with their candidate units, and the replies to an earlier step."""
        block, got, home = Block(), {-3: [], -2: [], -1: []}, None
        for batch in batches:
            for b, o, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                home = b
                if o == 1:
                    block.add(p)
                else:
                    got[o].append(np.frombuffer(p, REPLY if o == -1 else np.uint64))
        if home is not None:
            block.close()
            known_, hot = (np.sort(np.concatenate(got[k])) if got[k] else np.zeros(0, np.uint64) for k in (-3, -2))
            block.units(known_, hot, n_buckets)
        return home, block, np.concatenate(got[-1]) if got[-1] else np.zeros(0, REPLY)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, b, _ = gather(batches)
        if home is None or not len(b.head):
            return
        at = b.head
        order = np.argsort(b.bucket[at], kind="stable")
        at = at[order]
        bucket, many = b.bucket[at], b.many[at]
        size = many + LENGTH - 1
        head = np.empty(len(at), UNIT)
        head["key"], head["doc"], head["anchor"], head["many"] = b.key[at], b.doc[at], b.anchor[at], many
        raw = b.data[np.repeat(b.start[at], size) + within(size)]
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        byte = np.concatenate(([0], np.cumsum(size)))
        out = [len(head[x:y]).to_bytes(4, "little") + head[x:y].tobytes() + raw[byte[x] : byte[y]].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int32()), pa.array(np.full(len(out), home), pa.int64()), pa.array(out, pa.binary())], names=["bucket", "origin", "payload"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index a bucket's units; reply to each block which strings of its units go."""
        for _, origins, payloads in X.by_bucket(batches):
            heads, raws = [], []
            for p in payloads:
                n = int.from_bytes(p[:4], "little")
                heads.append(np.frombuffer(p, UNIT, n, 4))
                raws.append(np.frombuffer(p, np.uint8, offset=4 + n * UNIT.itemsize))
            head, raw = np.concatenate(heads), np.concatenate(raws)
            offs = np.concatenate(([0], np.cumsum(head["many"].astype(np.int64) + LENGTH - 1)))
            order = np.lexsort((head["doc"], head["key"]))
            first = np.concatenate(([True], head["key"][order][1:] != head["key"][order][:-1]))
            slot = np.empty(len(head), np.int64)
            slot[order] = np.cumsum(first) - 1
            rep = order[first]  # each distinct unit once, with its least document
            mask = np.zeros(len(rep), np.int64)
            # a unit that is alone with its anchor shares no string; the others go in collections
            by = np.argsort(head["anchor"][rep], kind="stable")
            own = head["anchor"][rep][by]
            edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            by = by[np.repeat(np.diff(edge) > 1, np.diff(edge))]
            sizes = np.diff(edge)[np.diff(edge) > 1]
            ends = np.cumsum(sizes)
            at = 0
            while at < len(by):
                end = int(ends[min(np.searchsorted(ends, at + COLLECTION), len(ends) - 1)])
                part = by[at:end]
                at = end
                pick = rep[part]
                size = np.diff(offs)[pick]
                data = raw[np.repeat(offs[pick], size) + within(size)]
                inner = np.concatenate(([0], np.cumsum(size)))
                hit = np.flatnonzero(repeated(data, inner, head["doc"][pick].astype(np.int64)))
                np.bitwise_or.at(mask, part[np.searchsorted(inner, hit, "right") - 1], 1 << within(size)[hit])
            full = (1 << head["many"].astype(np.int64)) - 1
            own = np.where(head["doc"] > head["doc"][rep][slot], full, mask[slot])
            reply = np.empty(len(head), REPLY)
            reply["key"], reply["mask"] = head["key"], own
            at = 0
            homes, out = [], []
            for o, h in zip(origins, heads, strict=True):
                part = reply[at : at + len(h)]
                at += len(h)
                part = part[part["mask"] > 0]
                if len(part):
                    homes.append(o)
                    out.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int32()), pa.array([-1] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["bucket", "origin", "payload"])

    def at_home(*frames: DataFrame) -> DataFrame:
        every = texts
        for f in frames:
            every = every.unionByName(f)
        return every.repartition(n_blocks, "bucket").sortWithinPartitions("bucket", "origin")

    replies = X.written(X.exchanged(at_home(known).mapInArrow(X.trimmed(units), X.PACKED), decide, X.PACKED), "replies")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, b, reply = gather(batches)
        if home is None:
            return
        edge = np.zeros(len(b.data) + 1, np.int64)
        if len(b.key):
            order = np.argsort(reply["key"], kind="stable")
            rk, rm = reply["key"][order], reply["mask"][order].astype(np.int64)
            hit = member(b.key, rk)
            mask = np.zeros(len(b.key), np.int64)
            mask[hit] = rm[np.searchsorted(rk, b.key[hit])]
            least = np.repeat(b.doc[b.head], np.diff(np.append(b.head, len(b.key))))
            mask = np.where(b.doc > least, (1 << b.many.astype(np.int64)) - 1, mask)
            for i in range(SPAN):
                s = b.start[(mask >> i) & 1 == 1] + i
                np.add.at(edge, s, 1)
                np.add.at(edge, s + LENGTH, -1)
        gone = np.cumsum(edge)[:-1] > 0
        start, end = T.runs(gone, b.offs)
        before = np.searchsorted(start, b.offs)
        out: list[list] = [[] for _ in range(6)]

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
            for c in out:
                c.clear()
            return done

        nothing = hashlib.sha256(b"").hexdigest()
        for k in range(len(b.offs) - 1):
            a, z = b.offs[k], b.offs[k + 1]
            kept = b.data[a:z][~gone[a:z]]
            spans = [{"start": int(s - a), "end": int(e - a)} for s, e in zip(start[before[k] : before[k + 1]], end[before[k] : before[k + 1]], strict=True)]
            mine = (int(z - a), int(z - a) - len(kept), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans)
            copy = (int(z - a), int(z - a), 1, nothing, [{"start": 0, "end": int(z - a)}]) if z - a >= LENGTH else mine
            for i in b.ids[k]:
                for c, v in zip(out, (None if i == NO_ID else i, *(copy if i > b.least[k] else mine)), strict=True):
                    c.append(v)
            if len(out[0]) >= 4096:
                yield flush()
        yield flush()

    return at_home(known, replies).mapInArrow(X.trimmed(cut), REMOVED)
