"""The data source of paginated dumps: ranges of pages, and a stream that goes on from its offset."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import pages

SCHEMA = "id long, name string, size double"


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    pages.register(spark)


def put(root, n, text, name="part-0.txt"):
    os.makedirs(f"{root}/page={n}", exist_ok=True)
    with open(f"{root}/page={n}/{name}", "w") as f:
        f.write(text)


def items(n, size=5):
    return [{"id": 10 * n + i, "name": f"n{i}", "size": i / 2, "more": {"x": 1}} for i in range(size)]


def test_batch(spark, tmp_path):
    for n in range(1, 8):
        put(tmp_path, n, json.dumps(items(n)))
    put(tmp_path, 8, "[]")
    put(tmp_path, 9, json.dumps([[{"id": 900}], [{"id": 901, "name": None}], []]))
    put(tmp_path, 10, "", "_SUCCESS")
    put(tmp_path, 11, json.dumps(items(11)), "part-0.tmp")
    df = spark.read.format("pages").schema(SCHEMA).option("pagesPerPartition", "2").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted([*((r["id"], r["name"], r["size"]) for n in range(1, 8) for r in items(n)), (900, None, None), (901, None, None)], key=lambda r: r[0])
    assert df.filter("id < 20").select("name").distinct().count() == 5


def test_nothing_and_broken_pages(spark, tmp_path):
    read = lambda p: spark.read.format("pages").schema(SCHEMA).load(str(p))
    assert read(tmp_path / "none").count() == 0
    for text in ('{"id": 1}', "[1, 2]", "[{", '[{"id": "x"}]'):
        root = tmp_path / str(abs(hash(text)))
        put(root, 7, text)
        with pytest.raises(Exception, match="page 7"):
            read(root).collect()


def test_stream_goes_on_from_its_offset(spark, tmp_path):
    root, out, check = (str(tmp_path / x) for x in ("dump", "out", "check"))

    def drain(name):
        stream = spark.readStream.format("pages").schema(SCHEMA).option("pagesPerPartition", "2").load(root)
        q = stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r.id for r in spark.read.schema(SCHEMA).parquet(out).collect())

    for n in (1, 2, 3):
        put(root, n, json.dumps(items(n)))
    first = drain("a")
    assert first == [r["id"] for n in (1, 2, 3) for r in items(n)]
    assert drain("b") == first
    put(root, 4, json.dumps(items(4)))
    put(root, 6, json.dumps(items(6)))
    assert drain("c") == [r["id"] for n in (1, 2, 3, 4, 6) for r in items(n)]


def test_a_dump_comes_back(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") / 4).alias("size"))
    pages.dumped(rows, str(tmp_path), F.floor(F.col("id") / 30))
    assert sorted(os.listdir(tmp_path))[-4:] == ["page=1", "page=2", "page=3", "page=4"]
    got = spark.read.format("pages").schema(SCHEMA).load(str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
