"""Exact duplicates: rows of one 128-bit content hash, whose bytes are compared.

`exact_dedup` hashes each text after every run of `[\\x20\\x09-\\x0D]` has become one space. Rows of one hash are grouped
by hash and text together, so their bytes are compared where they meet, and texts that only share a hash fall apart.
Copies are combined before the shuffle: whatever the size of a group, a task sends one row of it. What a group is found
to be (smallest id, number of rows) goes back to the rows by hash and by one of 64 salts that their ids give, so a
group of a third of all rows is read by 64 tasks. Only built-in functions are used, and nothing reaches the driver.

Defined results: null text counts as empty and equals a text of no characters (a text of blanks alone is one space); a
null id counts for the size of its group and stays only if no row of the group has an id; rows that repeat the smallest
id of their group can't be told apart and stay alike; an empty table gives none. Columns of any name pass through; what
is added takes a longer name (`_` at the end) where the input has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X

BLANKS = r"[\x20\x09-\x0D]+"
SALTS = 64  # one bit of a long each


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """`docs` with keep_id, group_size, kept and text_sha256 (of the normalised text). `digest` finds the rows to be
    compared; any function of the text gives the same result."""
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int")
    sha = lambda c: F.unhex(F.sha2(c, 256))
    body = docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("body"), salt.alias("salt"))
    texts = body.withColumn("h", digest(F.col("body"))).groupBy("h", "body").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    # a class is found again by both digests; should two texts share both, the query ends instead of mixing them
    alone = F.when(F.count(F.lit(1)) == 1, F.max("size")).otherwise(F.raise_error(F.lit("two texts share their MD5 and SHA-256")).cast("long"))
    classes = texts.select("h", sha(F.col("body")).alias("sha"), "keep", "size", "salts").groupBy("h", "sha").agg(alone.alias("size"), F.min("keep").alias("keep"), F.max("salts").alias("salts"))
    here = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(F.col("salts"), s) == 1)
    spread = classes.withColumn("salt", F.explode(here)).select(F.struct("h", "sha", "salt").alias("at"), "keep", "size")
    added = [X.unused(docs, n) for n in ("keep_id", "group_size", "kept", "text_sha256")]
    tmp = [X.unused(docs, n) for n in ("__body", "__at")]
    rows = docs.withColumn(tmp[0], normalised(F.col(text)))
    rows = rows.withColumn(tmp[1], F.struct(digest(F.col(tmp[0])).alias("h"), sha(F.col(tmp[0])).alias("sha"), salt.alias("salt"))).drop(tmp[0])
    out = rows.alias("d").join(spread.alias("c"), F.col(f"d.{tmp[1]}") == F.col("c.at"))
    return out.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("c.keep").alias(added[0]), F.col("c.size").alias(added[1]), F.col(f"d.`{key}`").eqNullSafe(F.col("c.keep")).alias(added[2]), F.lower(F.hex(F.col(f"d.{tmp[1]}.sha"))).alias(added[3]))
