"""Aggregates of groups, kept up through batches of insertions and deletions.

`maintain` takes changes (group, batch, sign, value, item) and tells, after each batch, the groups whose number of rows,
of different items, or total, least, greatest or median value has changed.

The values of a group are the keys of a counted tree: a leaf holds the values of one range of 2**LEAF_BITS integers, a
node the ranges of 2**NODE_BITS children, each with the number of values below it. A block is a sorted list that
insertions and deletions find by bisection. Its changes come to one task in the order of their batches, between them the
positions that are asked for, and a position is passed to the child that holds it, level by level, until it is a value:
a positional select for the least, middle and greatest value of every group and batch at once. The height follows from
the least and greatest value of all, the only two figures that reach the driver.

Changes of the same group, value and batch are summed before they are shuffled, and a block gets at most as many rows as
it has children times batches. So a group of a third of all rows is no larger than any other: its rows are spread over
the blocks of its tree. Nothing is broadcast.

Different items are counted by their changes of presence: the changes of an item are summed by batch, and it counts from
the batch in which its number of rows rises above nought until it falls back.

Defined results: null group columns are a group of their own; null values count as rows only, null items are no item; a
change without batch or sign never happens; changes that cancel out in a batch show nowhere; several equal rows are told
apart by number only. A value that leaves more often than it came is an error. No changes give no rows. Other columns of
the input are left out; where a group column bears the name of a result, that result's name gets a `_` at its end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X

LEAF_BITS, NODE_BITS = 5, 5
STATS = ("n_rows", "n_distinct", "total", "least", "greatest", "median")
LEAST, MEDIAN, GREATEST = 0, 1, 2


class Block:
    """Sorted keys with the number of values at or below each."""

    def __init__(self):
        self.keys: list[int] = []
        self.sizes: list[int] = []

    def add(self, key: int, n: int) -> None:
        """n more of a key, or fewer; a key of which none is left goes."""
        i = bisect_left(self.keys, key)
        if i == len(self.keys) or self.keys[i] != key:
            self.keys.insert(i, key)
            self.sizes.insert(i, 0)
        self.sizes[i] += n
        if self.sizes[i] < 0:
            raise ValueError("a value leaves more often than it came")
        if not self.sizes[i]:
            del self.keys[i], self.sizes[i]

    def select(self, position: int) -> tuple[int, int]:
        """The key that holds the value at a position (from 1), and the position below that key."""
        for key, n in zip(self.keys, self.sizes, strict=True):
            if position <= n:
                return key, position
            position -= n
        raise IndexError("no value has this position")


def shifts(least: int, greatest: int, leaf_bits: int = LEAF_BITS, node_bits: int = NODE_BITS) -> list[int]:
    """By how many bits values are shifted to give a level's keys: the leaves' first, the root's children last."""
    out = [0]
    step = leaf_bits
    while out[-1] + step < 64 and least >> (out[-1] + step) != greatest >> (out[-1] + step):
        out.append(out[-1] + step)
        step = node_bits
    return out


def level(deltas: DataFrame, asked: DataFrame, groups: list[str]) -> DataFrame:
    """The positions `asked` (groups, node, batch, kind, position) of one level's blocks, passed on to their children:
    the same columns, with the child as node. `deltas`: groups, node, batch, key, n."""
    wide = len(groups)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, Block()
        for batch in batches:
            rows, nodes, positions = [], [], []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                where, (kind, key, n) = row[: wide + 1], row[wide + 2 :]
                if where != at:
                    at, block = where, Block()
                if kind < 0:
                    block.add(key, n)
                    continue
                child, position = block.select(n)
                rows.append(i)
                nodes.append(child)
                positions.append(position)
            took = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns[:wide], pa.array(nodes, pa.int64()), took.column(wide + 1), took.column(wide + 2), pa.array(positions, pa.int64())], names=[*groups, "node", "batch", "kind", "position"])

    n = X.partitions(deltas.sparkSession)
    both = deltas.select(*groups, "node", "batch", F.lit(-1).alias("kind"), "key", "n").unionByName(asked.select(*groups, "node", "batch", "kind", F.lit(None).cast("long").alias("key"), F.col("position").alias("n")))
    ordered = both.repartition(n, *groups, "node").sortWithinPartitions(*groups, "node", "batch", "kind", "key")
    return ordered.mapInArrow(X.trimmed(stream), asked.select(*groups, "node", "batch", "kind", "position").schema)


def maintain(changes: DataFrame, by: list[str], batch: str = "batch", sign: str = "sign", value: str = "value", item: str = "item", leaf_bits: int = LEAF_BITS, node_bits: int = NODE_BITS) -> DataFrame:
    """(batch, by, old and new of STATS) of each batch and group in which one of them changes. `sign` is 1 or -1, `value`
    a long, `item` anything that can be grouped."""
    groups = [f"g{i}" for i in range(len(by))]
    own = changes.select(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), F.col(batch).cast("int").alias("batch"), F.col(sign).cast("long").alias("n"), F.col(value).cast("long").alias("value"), F.col(item).alias("item")).filter("batch IS NOT NULL AND n IS NOT NULL")
    values = X.written(own.groupBy(*groups, "value", "batch").agg(F.sum("n").alias("n")).filter("n <> 0"), "values")

    # what each batch adds to counts and totals
    per_item = Window.partitionBy(*groups, "item").orderBy("batch")
    there = F.sum("n").over(per_item)
    presence = own.filter("item IS NOT NULL").groupBy(*groups, "item", "batch").agg(F.sum("n").alias("n")).select(*groups, "batch", ((there > 0).cast("long") - (there - F.col("n") > 0).cast("long")).alias("d"))
    counts = {"n_rows": F.col("n"), "n_values": F.when(F.col("value").isNotNull(), F.col("n")), "total": F.col("n") * F.col("value")}
    sums = values.groupBy(*groups, "batch").agg(*(F.coalesce(F.sum(e), F.lit(0)).alias(c) for c, e in counts.items()))
    items = presence.filter("d <> 0").groupBy(*groups, "batch").agg(F.sum("d").alias("n_distinct"))
    added = sums.unionByName(items, allowMissingColumns=True).groupBy(*groups, "batch").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*counts, "n_distinct")))
    per_group = Window.partitionBy(*groups).orderBy("batch")
    state = X.written(added.select(*groups, "batch", *(F.sum(c).over(per_group).alias(c) for c in (*counts, "n_distinct"))), "state")

    # the three positions of each state, from the root down
    n = F.col("n_values")
    places = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), p.alias("position")) for k, p in ((LEAST, F.lit(1).cast("long")), (MEDIAN, F.expr("n_values div 2") + 1), (GREATEST, n)))))
    asked = state.filter("n_values > 0").select(*groups, "batch", places.alias("at")).select(*groups, F.lit(0).cast("long").alias("node"), "batch", "at.kind", "at.position")
    ends = values.agg(F.min("value"), F.max("value")).first()
    keyed = values.filter("value IS NOT NULL")
    steps = shifts(*ends, leaf_bits, node_bits) if ends[0] is not None else []
    for i in reversed(range(len(steps))):
        node = F.shiftright("value", steps[i + 1]) if i + 1 < len(steps) else F.lit(0).cast("long")
        deltas = keyed.groupBy(*groups, node.alias("node"), F.shiftright("value", steps[i]).alias("key"), "batch").agg(F.sum("n").alias("n")).filter("n <> 0")
        asked = level(deltas, asked, groups)

    found = asked.select(*groups, "batch", *(F.when(F.col("kind") == k, F.col("node")).alias(c) for k, c in ((LEAST, "least"), (MEDIAN, "median"), (GREATEST, "greatest"))))
    after = state.unionByName(found, allowMissingColumns=True).groupBy(*groups, "batch").agg(*(F.max(c).alias(c) for c in STATS))
    old = lambda c: F.lag(c, 1, 0 if c in STATS[:3] else None).over(per_group)
    both = after.select("batch", *groups, *(e.alias(f"{when}_{c}") for c in STATS for when, e in (("old", old(c)), ("new", F.col(c)))))
    changed = both.filter(" OR ".join(f"NOT (old_{c} <=> new_{c})" for c in STATS))
    names = {c: X.unused(changes.select(*by), c) for c in ("batch", *(f"{when}_{c}" for c in STATS for when in ("old", "new")))}
    return changed.select(F.col("batch").alias(names["batch"]), *(F.col(g).alias(c) for g, c in zip(groups, by, strict=True)), *(F.col(c).alias(names[c]) for c in names if c != "batch"))
