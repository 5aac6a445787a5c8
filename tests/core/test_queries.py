"""Every query with SQL against DuckDB on the small tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")
from sparkloom.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    done = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in done.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == want


def test_vector_queries_grow_with_the_table(spark):
    for sf, n in (("sf0.001", 10), ("sf0.1", 40)):
        got = catalog.QUERIES["dense_topk_every50"](spark, f"/root/testdata/{sf}").select("query").distinct().collect()
        assert {r.query for r in got} == set(range(0, 50 * n, 50))


@pytest.mark.parametrize("name", ["rrf_doc_diversity", "rrf_fusion", "lexical_topk"])
def test_items_of_one_id_are_one_query(spark, tmp_path, name):
    """A term that several rows of an item have counts once."""
    words = "spring bean scope lock index queue hash map tree node".split()
    docs = [(i, " ".join(words[(i * k) % 10] for k in range(1, 3 + i % 5)) + "\n" + " ".join(words[(i + k * k) % 10] for k in range(i % 4)), f"s{i % 13}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "spring bean"), (1, "bean scope lock"), (2, "index lock"), (2, "index lock"), (3, "queue map")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    done = con.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in done.description]
    want = sorted(done.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == want and want
