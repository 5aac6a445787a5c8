"""Stateful streams against plain Python: outcomes of drills and profiles by deltas, whatever the batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import drills, profiles

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, kind string, drill long"


def plain(rows, ttl, turns, late):
    """Events up to the watermark in order, one open drill of a kind at a time."""
    last = max(r[1] for r in rows) - late
    open_, turn, out = {}, {}, []
    for event, ts, user, kind, drill in sorted(set(rows), key=lambda r: (r[2], r[1], r[0])):
        if ts > last:
            continue
        turn[user] = n = turn.get(user, 0) + 1
        if drill is None or kind == "other":
            continue
        held = open_.pop((user, drill), None)
        if held:
            alive = ts - held[1] < ttl and n - held[2] <= turns
            if alive and kind == "answer":
                out.append((user, drill, held[0], event, (ts - held[1]) // dt.timedelta(milliseconds=1), "answered"))
            else:
                out.append((user, drill, held[0], None, None, "superseded" if alive else "expired"))
        if kind == "offer":
            open_[user, drill] = (event, ts, n)
    return sorted(map(str, out + [(u, d, h[0], None, None, "expired") for (u, d), h in open_.items() if h[1] + ttl <= last]))


def run(spark, tmp_path, name, batches, **how):
    src, out, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        drills.appended(drills.outcomes(spark.readStream.schema(SCHEMA).parquet(src), **how), out, state)
    return sorted(str(tuple(r)) for r in spark.read.parquet(out).drop("batch").collect())


def at(hours):
    return START + dt.timedelta(hours=hours)


ROWS = [
    (1, at(0), 1, "offer", 7),
    (2, at(1), 1, "offer", 8),  # two open at a time
    (3, at(2), 1, "answer", 7),
    (3, at(2), 1, "answer", 7),  # repeated
    (4, at(3), 1, "answer", 7),  # nothing open
    (5, at(25), 1, "answer", 8),  # exactly the time to live: over
    (6, at(0), 2, "offer", 7),
    (7, at(1), 2, "offer", 7),
    (8, at(2), 2, "other", None),
    (9, at(3), 2, "other", 1),
    (10, at(4), 2, "other", 1),
    (11, at(5), 2, "answer", 7),  # four turns later
    (12, at(5), 3, "offer", 1),  # ended by a timer alone
    (13, at(6), 4, "offer", None),
    (14, at(6), 4, "answer", None),
    (15, at(39), 4, "offer", 2),  # still open at the end
    (16, at(40), 5, "other", None),
]


def test_drills_by_hand(spark, tmp_path):
    got = run(spark, tmp_path, "hand", [ROWS], turns=3)
    want = [(1, 7, 1, 3, 7_200_000, "answered"), (1, 8, 2, None, None, "expired"), (2, 7, 6, None, None, "superseded"), (2, 7, 7, None, None, "expired"), (3, 1, 12, None, None, "expired")]
    assert got == sorted(map(str, want)) == plain(ROWS, dt.timedelta(hours=24), 3, dt.timedelta(hours=1))


def test_drills_do_not_depend_on_batches(spark, tmp_path):
    """Three batches, late rows within the watermark, the stream stopped and resumed between them."""
    import random

    rng = random.Random(3)
    rows = [(i, START + dt.timedelta(minutes=rng.randrange(6000)), rng.randrange(4), rng.choice(["offer", "answer", "other"]), rng.choice([None, 1, 2, 3])) for i in range(240)]
    shuffled = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(115)))
    parts = [shuffled[:70] + shuffled[:9], shuffled[70:150], shuffled[150:]]
    got = run(spark, tmp_path, "cut", parts, turns=6, late="2 hours")
    assert got == plain(rows, dt.timedelta(hours=24), 6, dt.timedelta(hours=2)) and len(got) > 40


def test_events_behind_the_watermark_are_left_out(spark, tmp_path):
    rows = [(1, at(0), 1, "offer", 7), (2, at(10), 2, "other", None)]
    got = run(spark, tmp_path, "late", [rows, [(3, at(1), 1, "answer", 7)], [(4, at(48), 2, "other", None)]])
    assert got == [str((1, 7, 1, None, None, "expired"))]


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.mark.parametrize("hot", [False, True])
def test_profiles_by_deltas(spark, tmp_path, hot):
    """Equal to a rebuild after each batch; a batch changes the summaries of its own days only."""
    import random

    rng = random.Random(5)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    every, now = [], F.lit("2024-01-31").cast("date")
    for size in (400, 3, 60):
        new = [(len(every) + i, START + dt.timedelta(minutes=rng.randrange(40_000)), 1 if hot else rng.randrange(9), rng.choice("ab"), rng.choice([None, 1.25, 30.0, 44.5])) for i in range(size)]
        new += [(0, None, 1, "a", 1.0), (0, START, None, "a", 1.0)]  # neither counts
        every += new
        spark.createDataFrame(new, EVENTS).coalesce(1).write.mode("append").parquet(src)
        done = profiles.maintained(spark.readStream.schema(EVENTS).parquet(src), out, state)
        keys = {(u, k, t.date()) for _, t, u, k, _ in new if t and u is not None}
        assert sum(d["changed"] for d in done) == len(keys) and sum(d["read"] for d in done) == len(new)
        got = profiles.profile(profiles.days(spark, out), now)
        want = profiles.profile(profiles.summed(spark.createDataFrame(every, EVENTS)), now)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count()


def test_drills_exchange_state_a_few_times_a_call():
    """A user's events are put into state and taken out of it together, however many they are."""
    import pandas as pd

    from sparkloom.streaming.drills import Drills

    class State:
        calls = 0

        def __init__(self):
            self.rows = []

        def __getattr__(self, name):
            def call(*args):
                State.calls += 1
                if name in ("put", "update", "appendList", "clear"):
                    self.rows = (self.rows if name == "appendList" else []) + [*(args[0] if name in ("put", "appendList") else args)]
                return iter(self.rows) if name == "get" and self.many else (self.rows or [None])[-1]

            return call

    class Handle:
        def getListState(self, *args):
            return self.state(True)

        def getValueState(self, *args):
            return self.state(False)

        def state(self, many):
            out = State()
            out.many = many
            return out

        def registerTimer(self, ms):
            State.calls += 1

        deleteTimer = registerTimer

    class Times:
        def getCurrentWatermarkInMs(self):
            return 10_000_000

    found = []
    for n in (10, 1000):
        State.calls, own = 0, Drills(3_600_000, 10)
        own.init(Handle())
        rows = pd.DataFrame({"at": range(n), "event_id": range(n), "kind": ["offer", "answer"] * (n // 2), "drill": [1.0] * n})
        assert list(own.handleInputRows((7,), iter([rows]), Times())) == []
        out = pd.concat(own.handleExpiredTimer((7,), Times(), None))
        assert (out["outcome"] == "answered").sum() == n // 2
        found.append(State.calls)
    assert found[0] == found[1] < 12
