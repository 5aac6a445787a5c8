"""The bucketed table: merges on read, buckets that change alone, versions, and writes that are cut off."""

import glob
import os

import pytest

from sparkloom.sources import buckets as B

SCHEMA = "id long, name string, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(spark, table):
    return {r.id: (r.name, r.v) for r in B.rows_of(spark, table).collect()}


@pytest.fixture
def table(spark, tmp_path):
    return B.created(frame(spark, [(i, f"n{i}", 1) for i in range(1000)]), str(tmp_path / "t"), ["id"], "v", 16)


def files(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.root}/data/**/*.parquet", recursive=True)}


def test_an_upsert_writes_its_buckets_only(spark, table):
    before = files(table)
    new = B.upserted(table, frame(spark, [(5, "five", 2), (5, "older", 1), (2000, "new", 1)]))
    touched = new.changed()
    assert len(touched) <= 2 and {f: t for f, t in files(table).items() if f in before} == before
    want = {i: (f"n{i}", 1) for i in range(1000)} | {5: ("five", 2), 2000: ("new", 1)}
    assert state(spark, new) == want and state(spark, table) == {i: (f"n{i}", 1) for i in range(1000)}
    small = B.compacted(spark, new)
    assert not small.changed() and state(spark, small) == want
    rewritten = {f.split("__bucket=")[1].split("/")[0] for f in set(files(table)) - set(before)}
    assert rewritten == {str(b) for b in touched}
    kept = [f for b, _, f in small.parts if b not in touched]
    assert set(kept) <= {f for _, _, f in table.parts}


def test_deletions_and_later_rows(spark, table):
    a = B.deleted(table, spark.createDataFrame([(i,) for i in range(0, 1000, 2)], "id long"))
    b = B.upserted(a, frame(spark, [(4, "back", 0)]))
    assert set(state(spark, a)) == set(range(1, 1000, 2))
    assert state(spark, b)[4] == ("back", 0) and 6 not in state(spark, b)
    log = B.changes(spark, b, 1)
    assert log.filter("gone").count() == 500 and [(r.id, r.change) for r in log.filter("NOT gone").collect()] == [(4, 3)]
    assert B.changes(spark, b, 2).count() == 1 and B.upserted(b, frame(spark, [])).version == b.version


def test_versions_and_cut_off_writes(spark, table, monkeypatch):
    root = table.root
    b = B.upserted(table, frame(spark, [(1, "one", 2)]))
    assert B.opened(spark, root).version == 2 and state(spark, B.opened(spark, root, 1))[1] == ("n1", 1)
    with pytest.raises(RuntimeError, match="version 2 was written by another"):
        B.upserted(table, frame(spark, [(2, "two", 2)]))
    monkeypatch.setattr(B, "_publish", lambda *a: (_ for _ in ()).throw(OSError("cut off")))
    with pytest.raises(OSError, match="cut off"):
        B.upserted(b, frame(spark, [(3, "three", 2)]))
    found = B.opened(spark, root)
    assert found.version == 2 and state(spark, found) == state(spark, b) and state(spark, found)[3] == ("n3", 1)


def test_buckets_without_changes_are_not_shuffled(spark, table):
    plan = lambda t: B.rows_of(spark, t)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan(table) and "Exchange hashpartitioning(id" not in plan(table).replace("LocalTableScan", "")
    assert "Exchange hashpartitioning(id" in plan(B.upserted(table, frame(spark, [(1, "x", 3)])))


def test_null_keys_and_repeats(spark, tmp_path):
    t = B.created(frame(spark, [(None, "a", 1), (None, "b", 2), (1, "x", 1), (1, "y", 1)]), str(tmp_path / "n"), ["id"], "v", 4)
    assert state(spark, t) == {None: ("b", 2), 1: ("y", 1)}
    t = B.upserted(t, frame(spark, [(None, "c", None)]))
    assert state(spark, t) == {None: ("c", None), 1: ("y", 1)}
    assert B.rows_of(spark, B.deleted(t, spark.createDataFrame([(None,), (1,)], "id long"))).count() == 0
