"""Pending drills and their answers as a stateful stream: several drills a user, event-time order, timers.

Events may come late and in any order within the watermark. They wait in state until the watermark has passed them and are
then taken in the order of (ts, event_id), so the outcome does not depend on how the log was cut into batches. Each drill
that is offered ends once:

answered    by the first answer to that drill, less than the time to live and at most `turns` events of the user later
superseded  by a new offer of the same drill while it is open
expired     else, when its next event comes or a timer finds the time to live over

Defined cases: a repeated event (same ts and id) counts once; events later than the watermark are left out; an answer without
an open drill has no effect, but is a turn; a null drill is none (a turn too); rows without ts or user are left out. What the
watermark has not passed when the stream stops stays in state and has no row yet.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "user_id long, drill long, offered long, closed long, waited_ms long, outcome string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Drills(StatefulProcessor):
    """State of one user: events that wait, open drills, and turns so far with the one timer that is set. Each of the three
    is read and written as a whole, once a call: the state lies in another process, and an exchange costs as much as many events."""

    def __init__(self, ttl_ms: int, turns: int):
        self.ttl_us, self.turns = ttl_ms * 1000, turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event long, kind string, drill long")
        self.open = handle.getListState("open", "drill long, event long, at long, turn long")
        self.side = handle.getValueState("side", "n long, ms long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        new: list = []
        for part in rows:
            drills = (None if d != d or d is None else int(d) for d in part["drill"].tolist())
            new += zip(part["at"].tolist(), part["event_id"].tolist(), part["kind"].tolist(), drills, strict=True)
        if new:
            self.waiting.appendList(new)
            n, held = self.told()
            ms = min(e[0] for e in new) // 1000
            if held is None or ms < held:
                if held is not None:
                    self.handle.deleteTimer(held)
                self.handle.registerTimer(ms)
                self.side.update((n, ms))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        every = sorted({(at, event): (kind, drill) for at, event, kind, drill in self.waiting.get()}.items())
        after = next((i for i, e in enumerate(every) if e[0][0] // 1000 > now), len(every))
        before = {drill: (event, at, turn) for drill, event, at, turn in self.open.get()}
        drills, n = dict(before), self.told()[0]
        out = []
        for (at, event), (kind, drill) in every[:after]:
            n += 1
            if drill is None or kind not in ("offer", "answer"):
                continue
            held = drills.pop(drill, None)
            if held is not None:
                alive = at - held[1] < self.ttl_us and n - held[2] <= self.turns
                if alive and kind == "answer":
                    out.append((key[0], drill, held[0], event, (at - held[1]) // 1000, "answered"))
                else:
                    out.append((key[0], drill, held[0], None, None, "superseded" if alive else "expired"))
            if kind == "offer":
                drills[drill] = (event, at, n)
        for drill, held in sorted(drills.items()):
            if (held[1] + self.ttl_us) // 1000 <= now:
                out.append((key[0], drill, held[0], None, None, "expired"))
                del drills[drill]
        if after:
            self.rewritten(self.waiting, [(at, event, kind, drill) for (at, event), (kind, drill) in every[after:]])
        if drills != before:
            self.rewritten(self.open, [(drill, *held) for drill, held in drills.items()])
        ahead = [e[0][0] // 1000 for e in every[after : after + 1]] + [(h[1] + self.ttl_us) // 1000 for h in drills.values()]
        if ahead:  # one timer a user, at the first time at which there is something to do
            self.handle.registerTimer(min(ahead))
        self.side.update((n, min(ahead, default=None)))
        if out:
            table = pd.DataFrame(out, columns=["user_id", "drill", "offered", "closed", "waited_ms", "outcome"])
            yield table.astype({"closed": "Int64", "waited_ms": "Int64"})

    def told(self) -> tuple[int, int | None]:
        """Turns so far, and the timer that is set."""
        held = self.side.get()
        return (0, None) if held is None else (held[0], held[1])

    def rewritten(self, state, rows: list) -> None:
        state.put(rows) if rows else state.clear()

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, ttl_hours: float = 24.0, turns: int = 10, late: str = "1 hour") -> DataFrame:
    """How each offered drill ended. events: a stream of (event_id, ts, user_id, kind: offer, answer or other, drill)."""
    rows = events.filter("ts is not null and user_id is not null and event_id is not null")
    rows = rows.select("event_id", "ts", "user_id", "kind", F.col("drill").cast("long"), F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Drills(int(ttl_hours * 3_600_000), turns), OUTCOMES, "append", "EventTime")


def appended(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take in what is there now and write each batch's rows to `path`/batch=N, over those of a first try; going on later
    starts where this ended. Paths are relative to `path`, so the table can be moved."""

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKSDB)  # state with timers and maps needs it
    try:
        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
