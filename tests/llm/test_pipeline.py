"""The pipeline's stages one after the other, held against plain versions of each decision."""

import zlib

import numpy as np
import pytest

pytest.importorskip("sparkloom.llm")
import corpus_pipeline as P  # noqa: E402
from sparkloom.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out = [Q.table(spark, SF, "documents")]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [(df.columns, df.collect()) for df in out]


def test_columns(steps):
    assert all(set(c) == set(steps[0][0]) for c, _ in steps[:-1])
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]


def odd_documents(spark):
    long = "some words that make a clean document of its own with more than twenty words in all of it so that no rule minds " * 3
    rows = [(1, long + "first"), (2, None), (3, ""), (4, "  \n "), (5, long + "first"), (5, long + "first"), (None, long + "other"), (None, None), (6, "short"), (7, "word " * 60000)]
    return spark.createDataFrame([(d, t, "en" if i % 2 else None, f"s{i % 2}", None, "x", "y") for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, bucket string, __removed string")


def test_stages_bear_odd_rows_and_clashing_names(spark, tmp_path):
    docs = odd_documents(spark)
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert {(r.bucket, r["__removed"]) for r in docs.collect()} <= {("x", "y")}
    ids = [r.doc_id for r in docs.collect()]
    assert 1 in ids and not {2, 3, 4, 5} & set(ids)  # without words, or copies
    assert P.packing(spark, docs, SF).agg({"length": "sum"}).first()[0] > 0


def test_stages_bear_empty_tables(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_ids_are_taken_out_in_their_blocks(spark):
    from sparkloom.llm import exchange as X

    df = spark.createDataFrame([(i if i % 7 else None, f"t{i}", "b", 1.5) for i in range(50)], "doc_id long, text string, bucket string, id double").repartition(3)
    gone = spark.createDataFrame([(i,) for i in (1, 2, 3, 3, 49, 99, None)], "doc_id long")
    got = sorted((r.doc_id or -1, r.text, r.bucket, r.id) for r in X.without(df, gone).collect())
    assert got == sorted((r.doc_id or -1, r.text, r.bucket, r.id) for r in df.collect() if r.doc_id not in (1, 2, 3, 49))
    assert X.without(df.limit(0), gone).count() == 0 and X.without(df, gone.limit(0)).count() == 50


def test_classifier_keeps_clean_documents(spark, steps):
    labels = {r.doc_id: (r.quality, r.toxic) for r in Q.table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in steps[1][1]}
    clean = [d for d, v in labels.items() if v == (1, 0)]
    assert sum(d in kept for d in clean) > 0.95 * len(clean)


def test_lines_and_near_duplicates(steps):
    from test_jaccard_join import classes
    from test_line_dedup import brute

    want = {d: t for d, t, _ in brute([(r.doc_id, r.text) for r in steps[1][1]])}
    got = {r.doc_id: r.text for r in steps[2][1]}
    assert all(want[d] == t for d, t in got.items())
    assert all(not want[d].strip() for d in want.keys() - got.keys())
    found = classes([(r.doc_id, r.text) for r in steps[2][1]], 5, 80)
    assert {r.doc_id for r in steps[3][1]} == {d for d, _, c in found if c == d}


def test_mixing_drops_nothing(steps):
    before = {r.doc_id: r for r in steps[3][1]}
    assert {r.doc_id for r in steps[4][1]} == set(before) and all(before[r.doc_id] == r for r in steps[4][1])
    assert len(steps[4][1]) >= len(before)


def test_packing_holds_every_token(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    texts = {r.doc_id: r.text for r in steps[4][1]}
    total = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in steps[4][1])
    assert sum(p.length for p in steps[5][1]) == total
    for p in steps[5][1][::17]:
        ids = [*t.encode(texts[p.doc_id] or "", add_special_tokens=False).ids, 1]
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
