"""Bounded-space online packing of tokenised documents into training windows.

Each task keeps a fixed number of open windows. A document's tokens and an end id are cut into full
windows and one remainder; the remainder goes into the open window that it fits best, and when it fits
none the fullest is emitted. What is open at a task's end (a fixed number of windows) is laid end to
end and cut at window ends again, so that one window at most stays partly filled; those of all tasks are
merged in a second step, whole windows into windows.

Defined cases: null or empty text is the end id alone; a document longer than a window is cut at
window ends; equal documents are packed one by one; an empty table gives no rows; other columns of
the input are not read. A window that isn't full at the very end is padded, which costs nothing where
its length is a power of two.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X

WINDOW = 2048
OPEN = 64
END_ID = 1
#: Tasks whose leftovers, a window each, are merged together.
MERGE = 1024
#: Bytes of segments and ids, with what a dictionary takes for each, that a task keeps in each of two halves.
CACHE_BYTES = 64_000_000
ENTRY_BYTES = 150
#: Text bytes that are coded together, and whose pieces are held before they are handed on.
SLICE_BYTES = 4_000_000

#: How a byte-level vocabulary writes a space (fixed value).
SPACE = "\u0120"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Segments(dict):
    """Ids of " " + key by the tokenizer, as little-endian 16-bit bytes.

    The pre-tokenizer always begins a new piece at a space that is followed by another kind of
    character, so a text's ids are those of its segments one after the other. Segments recur: the distinct ones of
    a slice of texts are looked up once, and their ids are kept, those used last for longest.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # segments hold no added token: texts that do are left to the tokenizer
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # so are texts with a space before white space or at the end, which may be one piece
        self.whole = re.compile("|".join([*added, r" (?:\s|$)"]))
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(SPACE)]] = True
        self.older: dict[str, bytes] = {}
        self.held = 0

    def together(self, keys: list[str]) -> list[bytes]:
        """The ids of each segment from one text of all: a segment has its only space in front, so its first id alone
        begins with one."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join([" " + k for k in keys])], add_special_tokens=False)[0].ids, "<u2")
        at = [*(2 * np.flatnonzero(self.begins[ids])).tolist(), 2 * len(ids)]
        if len(at) != len(keys) + 1:
            raise ValueError("this tokenizer does not begin a piece at every space: its texts can't be coded by segments")
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def looked_up(self, keys: list[str]) -> list[bytes]:
        out = list(map(self.get, keys))
        new = [i for i, ids in enumerate(out) if ids is None]
        asked = [keys[i] for i in new]
        found = list(map(self.older.get, asked))
        missing = [k for k, ids in zip(asked, found, strict=True) if ids is None]
        coded = iter(self.together(missing) if missing else ())
        found = [next(coded) if ids is None else ids for ids in found]
        for i, ids in zip(new, found, strict=True):
            out[i] = ids
        self.keep(asked, found)
        return out

    def forget(self) -> None:
        self.clear()
        self.older, self.held = {}, 0

    def keep(self, keys: list[str], found: list[bytes]) -> None:
        every = sum(map(len, keys)) + sum(map(len, found)) + ENTRY_BYTES * len(keys)
        if self.held + every <= CACHE_BYTES and max(map(len, keys), default=0) <= CACHE_BYTES // 64:
            self.update(zip(keys, found, strict=True))
            self.held += every
            return
        for key, ids in zip(keys, found, strict=True):
            size = len(key) + len(ids) + ENTRY_BYTES
            if size > CACHE_BYTES // 8:  # one very long word is not worth its place
                continue
            if self.held + size > CACHE_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
            self[key] = ids
            self.held += size

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if self.whole.search(t)]
        for i, ids in zip(whole, self.direct([texts[i] for i in whole]), strict=True):
            out[i] = np.frombuffer(ids, "<u2")
        cut = [i for i, ids in enumerate(out) if ids is None]
        if not cut:
            return out
        heads, rests = zip(*((head, rest if space else None) for head, space, rest in (texts[i].partition(" ") for i in cut)), strict=True)
        parts = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        known = self.looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        pool = np.frombuffer(b"".join(known), "<u2")
        length = np.array([len(k) // 2 for k in known], np.int64)
        start = np.cumsum(length) - length
        at = coded.indices.to_numpy()
        n = length[at]
        end = np.cumsum(n)
        tail = pool[np.repeat(start[at] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        ends = np.append(0, end)[np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy())]
        for i, head, a, b in zip(cut, self.direct(list(heads)), np.append(0, ends[:-1]), ends, strict=True):
            out[i] = np.append(np.frombuffer(head, "<u2"), tail[a:b])
        return out


_segments: dict[str, Segments] = {}


def segments(path: str) -> Segments:
    if path not in _segments:
        _segments[path] = Segments(path)
    return _segments[path]


class Windows:
    """At most `most` open windows; place() is best-fit."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int, item) -> list:
        """Put an item in; returns the items that are final now, with their window and offset."""
        out: list = []
        k = bisect.bisect_left(self.free, (length, -1))
        if k == len(self.free):
            if len(self.free) >= self.most:
                out += self.held.pop(self.free.pop(0)[1])
            w, room = self.new(), self.size
            self.held[w] = []
        else:
            room, w = self.free.pop(k)
        self.held[w].append((item, w, self.size - room))
        room -= length
        if room:
            bisect.insort(self.free, (room, w))
        else:
            out += self.held.pop(w)
        return out


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, open_windows: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """PIECES of all rows: where each run of a document's ids lies."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, part = segments(tokenizer_path), TaskContext.get().partitionId()
        open_ = Windows(window, open_windows, part << 36)
        for batch in batches:
            for part_of in slices(batch):
                done: list = []
                keys, texts = part_of.column(0).to_pylist(), [t or "" for t in part_of.column(1).to_pylist()]
                for k, found in zip(keys, vocabulary.ids(texts), strict=True):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    for a in range(0, len(ids), window):
                        piece = ids[a : a + window].copy()  # not a view, which would hold the whole document
                        done += open_.place(len(piece), (k, a, piece, len(ids)))
                yield rows(done, -1, 0)
        vocabulary.forget()
        last: list = []
        at, w = 0, open_.new()
        for k, a, piece, total in (x for items in open_.held.values() for x, _, _ in items):
            while len(piece):
                take = min(len(piece), window - at)
                last.append(((k, a, piece[:take], total), w, at))
                a, piece, at = a + take, piece[take:], at + take
                if at == window:
                    yield rows(last, -1, 0)
                    last, at, w = [], 0, open_.new()
        yield rows(last, part // MERGE, at)

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Runs of rows of about SLICE_BYTES of text, each of one row at least."""
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(size)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)

    def rows(items: list, group: int, used: int) -> pa.RecordBatch:
        flat = [(k, a, len(piece), zlib.crc32(piece.tobytes()), total, w, o, group, used) for (k, a, piece, total), w, o in items]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "merge_group", "used"]
        cols = list(zip(*flat, strict=True)) if flat else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best-fit decreasing of whole windows, a group at a time."""
        every = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if every is None or not every.num_rows:
            return
        pdf = every.to_pandas()
        for _, group in pdf.groupby("merge_group"):
            first = group.drop_duplicates("sequence_id").sort_values(["used", "sequence_id"], ascending=[False, True])
            free: list[tuple[int, int, int]] = []
            moved: dict[int, tuple[int, int]] = {}
            for w, used in zip(first["sequence_id"], first["used"], strict=True):
                k = bisect.bisect_left(free, (used, -1, -1))
                if k == len(free):
                    target, at = w, 0
                else:
                    room, target, at = free.pop(k)
                moved[w] = (target, at)
                if at + used < window:
                    bisect.insort(free, (window - at - used, target, at + used))
            group = group.assign(offset=group["offset"] + group["sequence_id"].map(lambda w: moved[w][1]), sequence_id=group["sequence_id"].map(lambda w: moved[w][0]))  # noqa: B023
            yield pa.RecordBatch.from_pandas(group, schema=every.schema, preserve_index=False)

    wide = PIECES + ", merge_group long, used long"
    pieces = X.written(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(X.trimmed(fill), wide), "pieces")
    spark = docs.sparkSession
    late = pieces.filter("merge_group >= 0").repartition(X.partitions(spark), "merge_group").mapInArrow(X.trimmed(merge), wide)
    return pieces.filter("merge_group < 0").unionByName(late).drop("merge_group", "used")
