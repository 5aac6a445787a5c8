"""Line dedup: a suffix array over line-ID sequences, and later copies of repeated line runs go.

A document is its sequence of lines that have a word; a line's id is its 64-bit hash. Documents are dealt to
blocks, and everything moves in packed rows between blocks and buckets:

1. Prefix doubling. A suffix's label is (id of its first line, place among the suffixes that begin with that
   line). A round sorts the pairs (label at i, label at i + h) and so refines labels of h lines to 2h, until a label is
   unique or its suffix has ended. Settled suffixes take no further part (but give their label to those before them).
   A block sends each distinct pair once, so that a run which many documents share is as cheap as any other.
2. Common prefixes. Neighbours in the order of labels are found in their bucket. Where the lines before both are
   equal too, their common prefix is one less than that of the suffixes one line up, so only the others are compared,
   line by line, in the block of the smaller neighbour; a label that settled in round k bounds the length.
3. Intervals. One pass over the order of labels with a stack of the common-prefix intervals still open gives each
   suffix its longest prefix that also starts earlier, in the order of doc_id and then of lines.

That is the longest repeated run that starts at this line and has an earlier copy. The lines of every such run with
MIN_WORDS words and more are deleted.

A line that a third of all documents have gives labels to many suffixes: beyond the average load of a bucket it is
cut into parts in the order of labels. What joins them (how many of a label come before, first and last neighbours,
open intervals) is a few numbers a part, and the parts are at most twice as many as buckets.

Defined cases: null text is empty and stays null; lines without a word are kept and do not part a run; rows that
repeat a doc_id with another text are ordered by the text's hash, rows that repeat both are one document and lose the
same lines; a null doc_id comes last; an empty table gives no rows; all other columns pass through, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X
from sparkloom.llm import text as T

MIN_WORDS = 8
LAST = (1 << 63) - 1
LINE = np.dtype([("doc", "<i8"), ("variant", "<i8"), ("id", "<u8"), ("line", "<u4"), ("words", "<u4")])
COUNTED = np.dtype([("id", "<u8"), ("n", "<u8")])
#: A suffix that a round needs: its row in the block, lines left, label, how many share it, how many its line.
STATE = np.dtype([("row", "<u4"), ("left", "<u4"), ("id", "<u8"), ("sub", "<u8"), ("size", "<u8"), ("total", "<u8"), ("active", "?")])
SETTLED = np.dtype([("row", "<u4"), ("sub", "<u8"), ("total", "<u8"), ("depth", "<u8")])
#: How many labels a round's key has, each of as many lines; those behind a document's end are zero, which sorts first.
REACH = 2
LABELS = [f"{c}{i}" for i in range(1, REACH) for c in ("id", "sub")]
KEY = np.dtype([("id", "<u8"), ("sub", "<u8"), *((c, "<u8") for c in LABELS), ("lines", "<u4"), ("n", "<u8"), ("total", "<u8")])
#: From the last to the first that matters.
ORDER = ["lines", *LABELS[::-1], "sub", "id"]
REFINED = np.dtype([("sub", "<u8"), ("size", "<u8")])
#: The least suffix of a label in a block.
SUFFIX = np.dtype([("id", "<u8"), ("sub", "<u8"), ("total", "<u8"), ("doc", "<i8"), ("variant", "<i8"), ("line", "<u4"), ("left", "<u4"), ("row", "<u4")])
NEIGHBOUR = np.dtype([("row", "<u4"), ("other_row", "<u4"), ("other_left", "<u4"), ("other_home", "<i4")])
RUN = np.dtype([("row", "<u4"), ("lines", "<u4"), ("chain", "<u4")])
COMMON = np.dtype([("id", "<u8"), ("sub", "<u8"), ("lcp", "<u4")])
GONE = np.dtype([("doc", "<i8"), ("variant", "<i8"), ("line", "<u4")])

# what a packed row holds, by its origin; answers to a block have the number of the bucket they come from
STATIC, LIVE, DONE, NEAR, COMPARE = -9, -8, -7, -6, -5
ROWS = X.PACKED + ", kind string, hot array<long>"
_NAMES = ["bucket", "origin", "payload", "kind", "hot"]
ENDLESS = 1 << 62
ROUNDS = 40


def packed_rows(bucket: np.ndarray, rows: np.ndarray, origin: int, kind: str) -> pa.RecordBatch:
    got = X.packed(bucket.astype(np.int64), rows, origin)
    n = got.num_rows
    return pa.RecordBatch.from_arrays([*got.columns, pa.array([kind] * n, pa.string()), pa.nulls(n, pa.list_(pa.int64()))], names=_NAMES)


def one_row(home: int, origin: int, payload: bytes, kind: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([origin], pa.int64()), pa.array([payload], pa.binary()), pa.array([kind], pa.string()), pa.nulls(1, pa.list_(pa.int64()))], names=_NAMES)


def note(row: list[int], kind: str = "note") -> pa.RecordBatch:
    """What the driver needs of a part of a hot line."""
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([kind], pa.string()), pa.array([row], pa.list_(pa.int64()))], names=_NAMES)


def named(f: Callable, name: str) -> Callable:
    """`f` under the name that plans show."""
    f.__name__ = name
    return f


def signed(v: np.ndarray) -> list[int]:
    return v.astype(np.uint64).view(np.int64).tolist()


def sequences(docs: DataFrame, n: int) -> DataFrame:
    """ROWS of LINE: each line with a word, sent to its document's block."""
    keys = np.array(X.one_key_a_partition(docs.sparkSession, n), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.rebatched(batches):
            data, offs = T.column(batch.column(3))
            doc, variant, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            out = []
            for a, _, d, o in T.chunks(data, offs):
                ls, le = T.runs(d != 10, o)
                s, _, _ = T.words(d, o)
                first, end = np.searchsorted(s, ls), np.searchsorted(s, le)
                full = end > first
                ls, le, first, end = ls[full], le[full], first[full], end[full]
                at = np.searchsorted(o, ls, "right") - 1
                breaks = np.concatenate(([0], np.cumsum(d == 10)))
                rows = np.empty(len(ls), LINE)
                rows["doc"], rows["variant"] = doc[a + at], variant[a + at]
                rows["id"] = T.span_hash(T.prefix_hash(d), ls, le)
                rows["line"], rows["words"] = breaks[ls] - breaks[o[at]], end - first
                out.append((keys[home[a + at]], rows))
            if out:
                yield packed_rows(np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), STATIC, "raw")

    return docs.select("doc", "variant", "home", "text").mapInArrow(X.trimmed(run), ROWS)


def starts(*cols: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted columns begins."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def sizes(cut: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(cut, n))


def within(many: np.ndarray) -> np.ndarray:
    """0, 1, ... many[0] - 1, 0, 1, ..."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def lines_left(rows: np.ndarray) -> np.ndarray:
    """Lines of the document from each one on, itself included."""
    new = starts(rows["doc"], rows["variant"])
    many = sizes(new, len(rows))
    return np.repeat(new + many, many) - np.arange(len(rows))


def shared(some: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The rows of documents with some row that is marked."""
    if not len(some):
        return some
    begin = np.concatenate(([0], np.flatnonzero(left[:-1] == 1) + 1))  # one line is left at an end
    return np.repeat(np.add.reduceat(some.astype(np.int64), begin) > 0, sizes(begin, len(some)))


class Dealer:
    """Which bucket a label goes to, and the parts of a line that has more than its share, in the order of labels."""

    def __init__(self, n_buckets: int, suffixes: int):
        self.n, self.share = n_buckets, max(1, -(-suffixes // n_buckets))

    def part(self, sub: np.ndarray, size, total: np.ndarray, id2: np.ndarray | None = None) -> np.ndarray:
        parts = np.minimum(self.n, -(-total.astype(np.int64) // self.share))
        at = sub.astype(np.float64)
        if id2 is not None:
            at = at + size.astype(np.float64) * (id2.astype(np.float64) / 2.0**64)
        return np.clip((at / np.maximum(total.astype(np.float64), 1) * parts).astype(np.int64), 0, np.maximum(parts - 1, 0))

    def bucket(self, id_: np.ndarray, part) -> np.ndarray:
        return ((id_ >> np.uint64(24)).astype(np.int64) + part) % self.n

    def part_in(self, bucket: int, id_: int) -> int:
        return (bucket - (id_ >> 24) % self.n) % self.n

    def hot(self, total: np.ndarray) -> np.ndarray:
        return total.astype(np.int64) > self.share


def asked(state: np.ndarray, k: int, deal: Dealer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct keys of round k by bucket, their buckets, the active rows, and each one's key."""
    at = np.flatnonzero(state["active"])
    s, h = state[at], REACH**k
    left = s["left"].astype(np.int64)
    rows = np.zeros(len(at), KEY)
    rows["id"], rows["sub"], rows["n"], rows["total"] = s["id"], s["sub"], 1, s["total"]
    rows["lines"] = np.minimum(left, REACH * h)  # of equal labels the shorter suffix comes first
    for i in range(1, REACH):
        inside = left > i * h
        other = state[at[inside] + i * h]
        rows[f"id{i}"][inside], rows[f"sub{i}"][inside] = other["id"], other["sub"]
    bucket = deal.bucket(rows["id"], deal.part(rows["sub"], s["size"], s["total"], rows["id1"]))
    order = np.lexsort((*(rows[c] for c in ORDER), bucket))
    r, b = rows[order], bucket[order]
    cut = starts(b, *(r[c] for c in ORDER))
    many = sizes(cut, len(r))
    place = np.empty(len(at), np.int64)
    place[order] = np.repeat(np.arange(len(cut)), many)
    keys = r[cut].copy()
    keys["n"] = many
    return keys, b[cut], at, place


class Block:
    """A block's rows of one step, by what they are."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.home, self.held = None, {}
        self.answers: list[bytes] = []
        for batch in batches:
            for b, o, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                self.home = b
                if o >= 0:
                    self.answers.append(p)  # they come by bucket
                else:
                    self.held.setdefault(o, []).append(p)

    def rows(self, origin: int, dtype: np.dtype) -> np.ndarray:
        return np.frombuffer(b"".join(self.held.get(origin, [])), dtype)

    def answered(self, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(self.answers), dtype)

    def labels(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines, and for those that recur their label's place, how many have the line, and a depth at which the label
        is unique; last, the lines left."""
        rows, own = self.rows(STATIC, LINE), self.rows(DONE, SETTLED)
        sub, total, depth = (np.zeros(len(rows), np.uint64) for _ in range(3))
        for c, name in ((sub, "sub"), (total, "total"), (depth, "depth")):
            c[own["row"]] = own[name]
        return rows, sub, total, depth, lines_left(rows)


def carries(notes: list[list[int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(line, part) -> (the label it begins with, how many of that label lie in earlier parts). A note: line, part,
    first label and its count, last label and its count."""
    out, now, last, run = {}, None, None, 0
    for id_, part, first, _, final, n_final in sorted(notes):
        if id_ != now:
            now, last, run = id_, None, 0
        before = run if last == first else 0
        if before:
            out[id_, part] = (first, before)
        run = (before if final == first else 0) + n_final
        last = final
    return out


class Suffixes:
    """One bucket's labels in order, with their common prefixes."""

    def __init__(self, rows: np.ndarray, common: np.ndarray):
        self.order = np.lexsort((rows["line"], rows["variant"], rows["doc"], rows["sub"], rows["id"]))
        self.rows = rows[self.order]
        self.cut = starts(self.rows["id"], self.rows["sub"])
        self.top = self.rows[self.cut]  # the least suffix of each label
        n = len(self.top)
        self.lcp = np.zeros(n, np.int64)
        id_, sub = (np.concatenate((self.top[c], common[c])) for c in ("id", "sub"))
        rank = np.lexsort((np.arange(len(id_)), sub, id_))
        same = np.flatnonzero((id_[rank][1:] == id_[rank][:-1]) & (sub[rank][1:] == sub[rank][:-1]))
        self.lcp[rank[same]] = common["lcp"][rank[same + 1] - n]
        self.groups = np.append(starts(self.top["id"]), n).tolist()
        self.ids = signed(self.top["id"][self.groups[:-1]])

    def places(self, extra: list[tuple]) -> tuple[list[int], Iterator[int]]:
        """Ranks in the order of documents and lines, of the labels and of other positions."""
        more = np.array([p for p, _ in extra], np.int64).reshape(-1, 3)
        cols = [np.concatenate((self.top[c].astype(np.int64), more[:, i])) for i, c in enumerate(("doc", "variant", "line"))]
        order = np.lexsort((cols[2], cols[1], cols[0]))
        new = np.zeros(len(order), np.int64)
        new[starts(*(c[order] for c in cols))] = 1
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank[: len(self.top)].tolist(), iter(rank[len(self.top) :].tolist())

    def longest(self, before: dict[int, list[tuple]], after: dict[int, list[tuple]]) -> np.ndarray:
        """For each label the longest common prefix of its least suffix with one of an earlier position. `before` (far to
        near) and `after` (near to far) have the intervals that reach this part of a line from others: a position, and
        its common prefix with this part's first or last label."""
        rank, more = self.places([e for i in self.ids for e in (*before.get(i, ()), *after.get(i, ()))])
        lcp, out = self.lcp.tolist(), [0] * len(rank)
        for i, a, z in zip(self.ids, self.groups[:-1], self.groups[1:], strict=True):
            if z - a == 1 and i not in before and i not in after:
                continue
            items, low = [], 0
            for _, v in before.get(i, ()):
                items.append((-1, next(more), low))
                low = v
            items.append((a, rank[a], low))
            items += [(j, rank[j], lcp[j]) for j in range(a + 1, z)]
            items += [(-1, next(more), v) for _, v in after.get(i, ())]
            items.append((-1, 0, 0))
            stack: list[tuple[int, int, int]] = []
            for j, p, now in items:
                while stack and p < stack[-1][1]:
                    k, _, low = stack.pop()
                    if k >= 0:
                        out[k] = max(low, now)
                    now = min(low, now)
                stack.append((j, p, now))
        return np.array(out, np.int64)


def stairs(items: list[tuple]) -> list[tuple]:
    """Of (position, common prefix with the one nearer), from near to far: those earlier than all nearer ones, with
    their common prefix up to the edge."""
    out, low = [], ENDLESS
    for p, v in items:
        low = min(low, v)
        if not low:
            break
        if not out or p < out[-1][0]:
            if out and out[-1][1] == low:
                out.pop()  # the earlier position does as well
            out.append((p, low))
    return out


def around(notes: list[dict]) -> tuple[dict, dict]:
    """The intervals that reach a part of a hot line, by (line, part): from before it (far to near), and from after it
    (near to far). A note: line, part, link (common prefix of the first label with the one before the part), low (the
    least within the part), and the stairs at its left and right end."""
    before, after = {}, {}
    by_line: dict[int, list[dict]] = {}
    for n in sorted(notes, key=lambda n: (n["id"], n["part"])):
        by_line.setdefault(n["id"], []).append(n)
    for id_, parts in by_line.items():
        seen: list[tuple] = []
        for n in parts:
            seen = stairs([(p, min(v, n["link"])) for p, v in seen])
            if seen:
                before[id_, n["part"]] = seen[::-1]
            seen = stairs([*steps(n["right"]), *[(p, min(v, n["low"])) for p, v in seen]])
        seen, link = [], 0
        for n in parts[::-1]:
            seen = stairs([(p, min(v, link)) for p, v in seen])
            if seen:
                after[id_, n["part"]] = seen
            seen, link = stairs([*steps(n["left"]), *[(p, min(v, n["low"])) for p, v in seen]]), n["link"]
    return before, after


def steps(flat: list[int]) -> list[tuple]:
    return [(tuple(flat[i : i + 3]), flat[i + 3]) for i in range(0, len(flat), 4)]


def gone_lines(docs: DataFrame, min_words: int, n: int) -> DataFrame:
    """PACKED rows of GONE by block, for `docs` of doc, variant, home and text."""
    n_buckets = X.buckets(docs.sparkSession)

    def at_home(*frames: DataFrame) -> DataFrame:
        every = frames[0]
        for f in frames[1:]:
            every = every.unionByName(f)
        return every.repartition(n, "bucket").sortWithinPartitions("bucket", "origin")

    step_ = lambda frame, f, schema=ROWS: frame.mapInArrow(X.trimmed(f), schema)
    of_kind = lambda frame, kind: frame.filter(F.col("kind") == kind)
    said = lambda frame: [r["hot"] for r in of_kind(frame, "note").select("hot").collect()]

    # how often each line occurs

    def first_ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Block(batches)
        if b.home is None:
            return
        rows = b.rows(STATIC, LINE)
        rows = rows[np.lexsort((rows["line"], rows["variant"], rows["doc"]))]
        rows = rows[starts(rows["doc"], rows["variant"], rows["line"])]  # rows that repeat id and text are one
        yield one_row(b.home, STATIC, rows.tobytes(), "static")
        yield note([len(rows)], "lines")
        ids, many = np.unique(rows["id"], return_counts=True)
        out = np.empty(len(ids), COUNTED)
        out["id"], out["n"] = ids, many
        yield packed_rows((ids >> np.uint64(24)).astype(np.int64) % n_buckets, out, b.home, "ask")

    def first_answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, origins, payloads in X.by_bucket(batches):
            parts = [np.frombuffer(p, COUNTED) for p in payloads]
            every = np.concatenate(parts)
            ids, at = np.unique(every["id"], return_inverse=True)
            total = np.bincount(at, every["n"], len(ids)).astype("<u8")[at]
            edge = np.cumsum([0, *map(len, parts)])
            for k, o in enumerate(origins):
                yield one_row(o, b, total[edge[k] : edge[k + 1]].tobytes(), "answer")

    start = X.written(step_(at_home(sequences(docs, n)), first_ask), "lines")
    deal = Dealer(n_buckets, of_kind(start, "lines").agg(F.coalesce(F.sum(F.col("hot")[0]), F.lit(0)).alias("n")).first()["n"])
    answers = X.written(X.exchanged(of_kind(start, "ask"), first_answer, ROWS), "totals")

    # prefix doubling

    def next_ask(home: int, state: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """What round k needs of a block: the documents with an active suffix, and its pairs."""
        state = state[shared(state["active"], state["left"])]
        if not len(state):
            return
        yield one_row(home, LIVE, state.tobytes(), "state")
        keys, bucket, _, _ = asked(state, k, deal)
        yield packed_rows(bucket, keys, home, "ask")

    def first_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Block(batches)
        if b.home is None:
            return
        rows = b.rows(STATIC, LINE)
        ids = np.unique(rows["id"])
        order = np.argsort((ids >> np.uint64(24)).astype(np.int64) % n_buckets, kind="stable")
        total = np.empty(len(ids), np.uint64)
        total[order] = b.answered("<u8")
        total = total[np.searchsorted(ids, rows["id"])]
        keep = shared(total > 1, lines_left(rows))  # no other document matters any more
        rows, total = rows[keep], total[keep]
        if len(rows):
            yield one_row(b.home, STATIC, rows.tobytes(), "static")
        state = np.empty(len(rows), STATE)
        state["row"], state["left"], state["id"], state["sub"] = np.arange(len(rows)), lines_left(rows), rows["id"], 0
        state["size"] = state["total"] = total
        state["active"] = total > 1
        yield from next_ask(b.home, state, 0)

    def refining(reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return named(lambda batches: refine(batches, reach), f"refine_{reach}")

    def refine(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
        """New labels of the keys, in the order of the question; notes on the parts of hot lines, and on what stays
        active: labels that several suffixes share which have not ended within `reach` lines."""
        for b, origins, payloads in X.by_bucket(batches):
            parts = [np.frombuffer(p, KEY) for p in payloads]
            every = np.concatenate(parts)
            order = np.lexsort([every[c] for c in ORDER])
            r = every[order]
            cut = starts(*(r[c] for c in ORDER))
            many, head = np.add.reduceat(r["n"].astype(np.int64), cut), r[cut]
            group = starts(head["id"], head["sub"])
            before = np.cumsum(many) - many
            new = head["sub"].astype(np.int64) + before - np.repeat(before[group], sizes(group, len(head)))
            out = np.empty(len(r), REFINED)
            out["sub"][order], out["size"][order] = np.repeat(new, sizes(cut, len(r))), np.repeat(many, sizes(cut, len(r)))
            edge = np.cumsum([0, *map(len, parts)])
            for k, o in enumerate(origins):
                yield one_row(o, b, out[edge[k] : edge[k + 1]].tobytes(), "answer")
            more = int(many[(many > 1) & (head["lines"] >= reach)].sum())
            if more:
                yield note([more], "active")
            label, count = head[group], np.add.reduceat(many, group)
            line = np.append(starts(label["id"]), len(label))
            for i in np.flatnonzero(deal.hot(label["total"][line[:-1]])).tolist():
                a, z = line[i], line[i + 1] - 1
                yield note([*signed(label["id"][a : a + 1]), deal.part_in(b, int(label["id"][a])), int(label["sub"][a]), int(count[a]), int(label["sub"][z]), int(count[z])])

    def refined(k: int, carried: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = Block(batches)
            if LIVE not in b.held:
                return
            state = b.rows(LIVE, STATE).copy()
            keys, _, at, place = asked(state, k, deal)
            got = b.answered(REFINED)[place]
            sub = got["sub"].copy()
            if carried:
                old = state[at]
                part = deal.part(old["sub"], old["size"], old["total"], keys["id1"][place])
                ids = old["id"].view(np.int64) if old["id"].flags.c_contiguous else np.ascontiguousarray(old["id"]).view(np.int64)
                for i in np.flatnonzero(deal.hot(old["total"])).tolist():
                    first, many = carried.get((int(ids[i]), int(part[i])), (-1, 0))
                    if first == int(old["sub"][i]):
                        sub[i] += np.uint64(many)
            state["sub"][at], state["size"][at] = sub, got["size"]
            state["active"][at] = (got["size"] > 1) & (state["left"][at] >= REACH ** (k + 1))
            quiet = state[at[~state["active"][at]]]
            if len(quiet):
                done_ = np.empty(len(quiet), SETTLED)
                done_["row"], done_["sub"], done_["total"], done_["depth"] = quiet["row"], quiet["sub"], quiet["total"], REACH ** (k + 1)
                yield one_row(b.home, DONE, done_.tobytes(), "done")
            yield from next_ask(b.home, state, k + 1)

        return named(run, f"refined_{k}")

    now = X.written(step_(at_home(of_kind(start, "static"), answers), first_state), "round")
    X.dropped(start, answers)
    rounds, static = [now], of_kind(now, "static")
    for k in range(ROUNDS):
        answers = X.written(X.exchanged(of_kind(now, "ask"), refining(REACH ** (k + 1)), ROWS), "labels")
        notes = answers.filter("kind in ('note', 'active')").select("kind", "hot").collect()
        now = X.written(step_(at_home(of_kind(now, "state"), of_kind(answers, "answer")), refined(k, carries([r["hot"] for r in notes if r["kind"] == "note"]))), "round")
        X.dropped(answers)
        rounds.append(now)
        if all(r["kind"] == "note" for r in notes):
            break
    else:
        raise RuntimeError("more doubling rounds than a document can have lines")
    done = [of_kind(r, "done") for r in rounds[1:]]

    # neighbours and common prefixes

    def least(rows: np.ndarray, sub: np.ndarray, total: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each label's first suffix in the block by bucket, their buckets, the rows that others share, and their labels."""
        at = np.flatnonzero(total > 1)
        bucket = deal.bucket(rows["id"][at], deal.part(sub[at], 0, total[at]))
        order = np.lexsort((at, sub[at], rows["id"][at], bucket))
        cut = starts(bucket[order], rows["id"][at][order], sub[at][order])
        place = np.empty(len(at), np.int64)
        place[order] = np.repeat(np.arange(len(cut)), sizes(cut, len(at)))
        one = at[order][cut]
        out = np.empty(len(one), SUFFIX)
        for c in ("id", "doc", "variant", "line"):
            out[c] = rows[c][one]
        out["sub"], out["total"], out["left"], out["row"] = sub[one], total[one], left[one], one
        return out, bucket[order][cut], at, place

    def both_kinds(bucket: np.ndarray, rows: np.ndarray, total: np.ndarray, origin: int) -> Iterator[pa.RecordBatch]:
        """Rows of hot lines apart from the others."""
        hot = deal.hot(total)
        for pick, kind in ((~hot, "cold"), (hot, "hot")):
            if pick.any():
                yield packed_rows(bucket[pick], rows[pick], origin, kind)

    def send_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Block(batches)
        if b.home is None:
            return
        rows, sub, total, _, left = b.labels()
        out, bucket, _, _ = least(rows, sub, total, left)
        yield from both_kinds(bucket, out, out["total"], b.home)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, origins, payloads in X.by_bucket(batches):
            parts = [np.frombuffer(p, SUFFIX) for p in payloads]
            home = np.repeat(np.array(origins, np.int64), [len(p) for p in parts])
            s = Suffixes(np.concatenate(parts), np.zeros(0, COMMON))
            top, where = s.top, home[s.order][s.cut]
            i = np.flatnonzero(top["id"][1:] == top["id"][:-1]) + 1
            out = np.empty(len(i), NEIGHBOUR)
            out["row"], out["other_row"], out["other_left"], out["other_home"] = top["row"][i], top["row"][i - 1], top["left"][i - 1], where[i - 1]
            if len(i):
                yield packed_rows(where[i], out, NEAR, "near")
            for g in np.flatnonzero(deal.hot(top["total"][s.groups[:-1]])).tolist():
                a, z = s.groups[g], s.groups[g + 1] - 1
                yield note([s.ids[g], deal.part_in(b, int(top["id"][a])), int(where[a]), int(top["row"][a]), int(where[z]), int(top["row"][z]), int(top["left"][z])])

    suffixes = X.written(step_(at_home(static, *done), send_suffixes), "suffixes")
    near = X.written(X.exchanged(suffixes, neighbours, ROWS), "neighbours")
    links: dict[int, list[tuple]] = {}
    past = (None, 0, 0, 0)
    for id_, _, home, row, home_z, row_z, left_z in sorted(said(near)):
        if past[0] == id_:
            links.setdefault(home, []).append((row, past[1], past[2], past[3]))
        past = (id_, row_z, left_z, home_z)

    def compare_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Send the lines from a suffix on to its neighbour's block, with the labels that take their common prefix
        from it: those of the next rows whose neighbours are the next rows too."""
        b = Block(batches)
        if b.home is None:
            return
        rows, sub, total, depth, left = b.labels()
        found, more = b.rows(NEAR, NEIGHBOUR), np.array(links.get(b.home, []), np.int64).reshape(-1, 4)
        own, row, rest, home = (np.concatenate((found[c].astype(np.int64), more[:, i])) for i, c in enumerate(("row", "other_row", "other_left", "other_home")))
        order = np.argsort(own, kind="stable")
        own, row, rest, home = own[order], row[order], rest[order], home[order]
        if not len(own):
            return
        chained = np.zeros(len(own), bool)
        chained[1:] = (np.diff(own) == 1) & (np.diff(row) == 1) & (home[1:] == home[:-1]) & (left[own[:-1]] > 1) & (rest[:-1] > 1)
        head = np.flatnonzero(~chained)
        chain = sizes(head, len(own))
        size = np.minimum(np.minimum(left[own[head]], rest[head]), np.maximum(depth[own[head]].astype(np.int64), chain))
        for to in np.unique(home[head]).tolist():
            pick = np.flatnonzero(home[head] == to)
            out = np.empty(len(pick), RUN)
            out["row"], out["lines"], out["chain"] = row[head[pick]], size[pick], chain[pick]
            ids = rows["id"][np.repeat(own[head[pick]], size[pick]) + within(size[pick])]
            at = np.repeat(own[head[pick]], chain[pick]) + within(chain[pick])
            keys = np.stack((rows["id"][at], sub[at], total[at]), axis=1)
            yield one_row(int(to), COMPARE, len(out).to_bytes(4, "little") + out.tobytes() + ids.tobytes() + keys.tobytes(), "run")

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compare line by line; the common prefixes go to their labels' buckets."""
        b = Block(batches)
        if COMPARE not in b.held:
            return
        ids = b.rows(STATIC, LINE)["id"]
        got = []
        for p in b.held[COMPARE]:
            runs = np.frombuffer(p, RUN, int.from_bytes(p[:4], "little"), 4)
            size, chain = runs["lines"].astype(np.int64), runs["chain"].astype(np.int64)
            theirs = np.frombuffer(p, "<u8", int(size.sum()), 4 + runs.nbytes)
            keys = np.frombuffer(p, "<u8", int(3 * chain.sum()), 4 + runs.nbytes + theirs.nbytes).reshape(-1, 3)
            step = within(size)
            differ = ids[np.repeat(runs["row"].astype(np.int64), size) + step] != theirs
            lcp = np.minimum.reduceat(np.where(differ, step, np.repeat(size, size)), np.cumsum(size) - size)
            out = np.empty(len(keys), COMMON)
            out["id"], out["sub"], out["lcp"] = keys[:, 0], keys[:, 1], np.maximum(np.repeat(lcp, chain) - within(chain), 0)
            got.append((out, keys[:, 2]))
        out, total = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        yield from both_kinds(deal.bucket(out["id"], deal.part(out["sub"], 0, total)), out, total, -1)

    runs = X.written(step_(at_home(static, *done, of_kind(near, "near")), compare_with), "runs")
    prefixes = X.written(step_(at_home(static, runs), common), "prefixes")
    X.dropped(runs, near)

    # intervals

    def gathered(origins: list[int], payloads: list[bytes]) -> tuple[Suffixes, list[int], list[int]]:
        shared = [np.frombuffer(p, COMMON) for o, p in zip(origins, payloads, strict=True) if o < 0]
        parts = [(o, np.frombuffer(p, SUFFIX)) for o, p in zip(origins, payloads, strict=True) if o >= 0]
        s = Suffixes(np.concatenate([np.zeros(0, SUFFIX), *(p for _, p in parts)]), np.concatenate([np.zeros(0, COMMON), *shared]))
        return s, [o for o, _ in parts], np.cumsum([0, *(len(p) for _, p in parts)]).tolist()

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The intervals of a hot line's part that are open at its ends."""
        flat = lambda found: [x for p, v in found for x in (*p, v)]
        for b, origins, payloads in X.by_bucket(batches):
            s, _, _ = gathered(origins, payloads)
            for i, a, z in zip(s.ids, s.groups[:-1], s.groups[1:], strict=True):
                at = list(zip(*(s.top[c][a:z].tolist() for c in ("doc", "variant", "line")), strict=True))
                inner = s.lcp[a + 1 : z].tolist()
                left = flat(stairs(list(zip(at, [ENDLESS, *inner], strict=True))))
                right = flat(stairs(list(zip(at[::-1], [ENDLESS, *inner[::-1]], strict=True))))
                yield note([i, deal.part_in(b, int(s.top["id"][a])), int(s.lcp[a]), min([ENDLESS, *inner]), len(left), *left, *right])

    def deciding(before: dict, after: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each suffix, in the order of the question, the length of its longest earlier copy. One that isn't
            its label's least has it whole."""
            for b, origins, payloads in X.by_bucket(batches):
                s, homes, edge = gathered(origins, payloads)
                part = {i: deal.part_in(b, i & ((1 << 64) - 1)) for i in s.ids}
                value = s.rows["left"].astype("<u4")
                value[s.cut] = s.longest(*({i: d[i, p] for i, p in part.items() if (i, p) in d} for d in (before, after)))
                out = np.empty(len(value), "<u4")
                out[s.order] = value
                for k, o in enumerate(homes):
                    yield one_row(o, b, out[edge[k] : edge[k + 1]].tobytes(), "answer")

        return named(run, "decide_between_parts" if before or after else "decide")

    every = lambda kind: of_kind(suffixes, kind).unionByName(of_kind(prefixes, kind))
    longest = X.exchanged(every("cold"), deciding({}, {}), ROWS)
    if of_kind(suffixes, "hot").limit(1).count():
        noted = said(X.exchanged(every("hot"), survey, ROWS))
        open_ = around([{"id": v[0], "part": v[1], "link": v[2], "low": v[3], "left": v[5 : 5 + v[4]], "right": v[5 + v[4] :]} for v in noted])
        # their answers come after all others
        longest = longest.unionByName(X.exchanged(every("hot"), deciding(*open_), ROWS).withColumn("origin", F.col("origin") + n_buckets))
    longest = X.written(longest, "longest")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Block(batches)
        if b.home is None:
            return
        rows, sub, total, _, left = b.labels()
        out, _, at, place = least(rows, sub, total, left)
        hot = deal.hot(out["total"])
        best = np.empty(len(out), np.int64)
        best[np.concatenate((np.flatnonzero(~hot), np.flatnonzero(hot)))] = b.answered("<u4")
        length = np.zeros(len(rows), np.int64)
        length[at] = np.where(at == out["row"][place], best[place], left[at])
        words = np.concatenate(([0], np.cumsum(rows["words"].astype(np.int64))))
        here = np.arange(len(rows))
        go = np.flatnonzero((length > 0) & (words[here + length] - words[here] >= min_words))
        edge = np.zeros(len(rows) + 1, np.int64)
        np.add.at(edge, go, 1)
        np.add.at(edge, go + length[go], -1)
        gone = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        got = np.empty(len(gone), GONE)
        for c in ("doc", "variant", "line"):
            got[c] = rows[c][gone]
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array([b.home], pa.int32()), pa.array([-1], pa.int64()), pa.array([got.tobytes()], pa.binary())], names=_NAMES[:3])

    out = X.written(step_(at_home(static, *done, longest), cut, X.PACKED), "gone")
    X.dropped(*rounds, suffixes, prefixes, longest)
    return out


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, removed: str = "__removed") -> DataFrame:
    """All columns of `docs` with the text that is left, and how many lines went, in a last column that is named
    `removed` or, where `docs` has one of that name, the same with underscores after it."""
    n = X.partitions(docs.sparkSession)
    names = docs.columns
    if dict(docs.dtypes)[text] != "string":
        docs = docs.withColumn(text, F.col(text).cast("string"))
    doc = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    variant = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    home = F.xxhash64(doc, variant)
    plain = docs.select(doc.alias("doc"), variant.alias("variant"), F.pmod(home, F.lit(n)).cast("int").alias("home"), F.col(text).alias("text"))
    gone = gone_lines(plain, min_words, n)

    # texts travel once, compressed, to the block that has their list
    texts = X.blocks(docs.select("*", doc.alias(X.unused(docs, "doc")), variant.alias(X.unused(docs, "variant"))), home, n)
    count, where = X.unused(docs, removed), names.index(text)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[int, int], set[int]] = {}
        for batch in batches:
            for o, p in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if o < 0:
                    g = np.frombuffer(p.as_py(), GONE)
                    c = starts(g["doc"], g["variant"])
                    for i, j in zip(c.tolist(), np.append(c[1:], len(g)).tolist(), strict=True):
                        lists[int(g["doc"][i]), int(g["variant"][i])] = set(g["line"][i:j].tolist())
                    continue
                rows = X.unblocked(p.as_py())
                drop = [lists.get(x) for x in zip(rows.column(len(names)).to_pylist(), rows.column(len(names) + 1).to_pylist(), strict=True)]
                cols = [rows.column(i) for i in range(len(names))]
                hit = [i for i, d in enumerate(drop) if d]
                if hit:
                    new = ["\n".join(x for k, x in enumerate(cols[where][i].as_py().split("\n")) if k not in drop[i]) for i in hit]
                    mask = np.zeros(rows.num_rows, bool)
                    mask[hit] = True
                    cols[where] = pc.replace_with_mask(cols[where], pa.array(mask), pa.array(new, cols[where].type))
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(d) if d else 0 for d in drop], pa.int32())], names=[*names, count])

    schema = docs.select("*", F.lit(0).alias(count)).schema
    return gone.unionByName(texts).repartition(n, "bucket").sortWithinPartitions("bucket", "origin").mapInArrow(X.trimmed(rest), schema)
