"""Which aliases a text mentions, for thousands of aliases at once.

An Aho-Corasick automaton of all aliases passes over each text once, so the time doesn't depend on their number; aliases
that are plain ASCII words are looked up among a text's words instead. An alias of
ASCII characters counts where it stands as a whole word, whatever its case (`[A-Za-z0-9_]` on neither side); any other as
a part of the lower-cased text. Aliases are sent to the tasks in blocks of at most BLOCK_CHARS characters, with a pass
for each block.

Defined results: null and empty texts mention nothing; empty and null aliases are never mentioned; an alias that repeats, or
that differs from another by its case only, stands for each of its concepts; aliases within other aliases are found too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_CHARS = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = frozenset("0123456789_" + LOWER)
TO_LOWER = str.maketrans(UPPER, LOWER)
WORDS = re.compile("[0-9_a-z]+")


class Matcher:
    """Plain words, and automata of ASCII keys with other characters and of parts of texts; each key stands for a number. A
    key of word characters stands as a whole word where it is a longest run of them, so it is looked up among these."""

    def __init__(self, keys: list[str]):
        self.plain, self.words, self.parts = {}, ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, k in enumerate(keys):
            if WORDS.fullmatch(k):
                self.plain[k] = i
                continue
            (self.words if k.isascii() else self.parts).add_word(k, (i, len(k)))
        for a in (self.words, self.parts):
            if len(a):
                a.make_automaton()

    def found(self, folded: str, lowered: str) -> set[int]:
        """Numbers of the keys in a text, given with A-Z in lower case, and in lower case throughout."""
        out = {self.plain[w] for w in self.plain.keys() & set(WORDS.findall(folded))} if self.plain else set()
        if len(self.words):
            for end, (i, n) in self.words.iter(folded):
                if i not in out and (end + 1 == len(folded) or folded[end + 1] not in WORD) and (end < n or folded[end - n] not in WORD):
                    out.add(i)
        if len(self.parts):
            out.update(i for _, (i, _) in self.parts.iter(lowered))
        return out


def blocks(aliases: DataFrame) -> Iterator[list[str]]:
    """Distinct keys of (alias), a block of bounded size at a time."""
    keys = aliases.filter("alias <> ''").select(F.when(F.col("alias").rlike(r"\A[\x00-\x7F]*\z"), F.translate("alias", UPPER, LOWER)).otherwise(F.lower("alias")).alias("key")).distinct()
    n = -(-int(keys.agg(F.coalesce(F.sum(F.length("key") + 16), F.lit(0))).first()[0]) // BLOCK_CHARS)
    for i in range(n):
        yield sorted(r.key for r in keys.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == i).collect())


def mentioned(texts: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """`texts` with a column `keys`: the aliases of (alias) that a text mentions, folded, sorted. See `by_concept`."""
    out = texts.withColumn("keys", F.array().cast("array<string>"))
    for keys in blocks(aliases):
        out = _passed(out, text, keys)
    return out.withColumn("keys", F.array_sort("keys"))


def _passed(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(keys)
        for batch in batches:
            folded, lowered = (batch.column(len(names) + i).to_pylist() for i in (0, 1))
            found = [sorted(keys[k] for k in matcher.found(f.encode().lower().decode(), low)) for f, low in zip(folded, lowered, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.list_(pa.string()))], names=[*names, "more"])

    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    schema = T.StructType([*texts.schema.fields, T.StructField("more", T.ArrayType(T.StringType()))])
    rows = texts.select("*", own.alias("folded"), F.lower(own).alias("lowered")).mapInArrow(run, schema)
    return rows.withColumn("keys", F.concat("keys", "more")).drop("more")


def by_concept(found: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, concept, n): the concepts of (concept, alias) that each text of `mentioned` mentions, with the number of
    different aliases."""
    keyed = aliases.filter("alias <> ''").select("concept", F.when(F.col("alias").rlike(r"\A[\x00-\x7F]*\z"), F.translate("alias", UPPER, LOWER)).otherwise(F.lower("alias")).alias("alias")).distinct()
    return found.select(key, F.explode("keys").alias("alias")).join(keyed, "alias").groupBy(key, "concept").agg(F.countDistinct("alias").alias("n"))
