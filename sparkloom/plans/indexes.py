"""The inverted indexes of the documents, built once for each state of the table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import cells as C
from sparkloom.operators import postings as P
from sparkloom.plans.base import read
from sparkloom.sources.stored import stored

#: The lexical retriever's fields and ten times their weights (fixed values).
FIELD_WEIGHTS = {"title": 30, "section": 20, "aliases": 25, "body": 10}


def words(spark, sf) -> P.Index:
    """Whole words without diacritics, with their positions."""
    docs = read(spark, sf, "documents")
    build = lambda path: P.build(docs, path, "doc_id", {"text": P.whole_words(F.col("text"))}, ["source"], P.folded, True)
    return P.opened(spark, stored(docs, "words", "3", build), P.folded)


def fields(spark, sf) -> P.Index:
    """Retrieval terms of four fields. The first line is the title, the second the section, the next three are aliases
    (a term counts once in each), and the whole text is the body, whose terms are counted."""
    docs = read(spark, sf, "documents")
    build = lambda path: P.build(docs, path, "doc_id", list(FIELD_WEIGHTS), text=F.lower("text"), split=field_terms)
    return P.opened(spark, stored(docs, "fields", "3", build))


#: Retrieval tokens of two characters and more; what a shorter one would take can't begin another.
TOKEN = re.compile(T.RETRIEVAL_TOKEN.replace("]*|", "]+|").replace("[0-9]+", "[0-9]{2,}"))


def field_terms(text: str) -> list[list[str]]:
    """Terms of title, section, aliases and body of a lower-cased text."""
    lines = text.split("\n", 5)[:5]
    title, section, *aliases = [list(dict.fromkeys(TOKEN.findall(x))) for x in lines + [""] * (5 - len(lines))]
    return [title, section, [t for a in aliases for t in a], TOKEN.findall(text)]


def vectors(spark, sf) -> C.Cells:
    """The embeddings in cells."""
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return C.opened(spark, stored(rows, "cells", "1", lambda path: C.build(rows, path)))
