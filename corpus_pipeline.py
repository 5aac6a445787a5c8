"""The corpus pipeline: stages that each read documents and give documents, the last one packed pieces.

A document that a stage leaves without text is gone; one that had none before stays, for the classifier
to judge. Rates of the mixing stage are 1 at least, so it repeats documents and drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X
from sparkloom.llm import queries as Q
from sparkloom.llm.jaccard_join import jaccard_classes
from sparkloom.llm.line_dedup import line_dedup
from sparkloom.llm.mixing import mixed
from sparkloom.llm.packing import pack
from sparkloom.llm.quality_classifier import fit, keep_good

#: Near duplicates: word n-grams and the least similarity in percent.
NGRAM, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps: not those without words. Rows that repeat an id share its annotation."""
    return keep_good(docs, fit(docs, Q.table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated line runs; what is left blank by that goes. Null and empty texts, which lose
    nothing, stay; n_chars is counted anew where lines went."""
    out = line_dedup(docs)
    removed = F.col(out.columns[-1])
    out = out.filter((removed == 0) | (F.trim(F.regexp_replace("text", r"[\t-\r]", " ")) != ""))
    return out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones, that with the least id; a row without id stays."""
    classes = jaccard_classes(docs, ngram=NGRAM, percent=PERCENT)
    gone = classes.filter("component_id < doc_id").select("doc_id").distinct()
    return X.without(docs, gone, "doc_id")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights, none dropped: the mix is as large as that needs."""
    return mixed(docs, Q.domains(spark, sf_dir, docs), Q.TARGETS, floor=1.0, scale=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; an empty table gives none."""
    return pack(docs, Q.tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier and the tokenizer cannot be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others wrote, one after the other; a stage's table goes when the next is written."""
    docs = Q.table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    before = None
    for name, stage in first:
        docs = X.written(stage(spark, docs, sf_dir), name)
        if before is not None:
            X.dropped(before)
        before = docs
    return last(spark, docs, sf_dir)
