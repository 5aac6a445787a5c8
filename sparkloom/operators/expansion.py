"""Forms of one query: hints, follow-ups, rewrites and feedback terms, and the cache of rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hundredths that a kind of candidate weighs in the fusion of rankings.
WEIGHTS = {"original": 100, "follow_up": 90, "rewrite": 80, "hyde": 70, "prf": 50}


def candidates(prompts: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(key, kind, weight, text, position) of each prompt's forms, in this order and without repeats (whatever their
    case and blanks), `most` of them. prompts: key, prompt, and arrays hints, context, rewrites, prf."""
    some = lambda c: F.filter(c, lambda x: F.trim(x) != "")
    made = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.trim(text).alias("text"))
    original = F.when(F.size(some("hints")) > 0, F.concat(F.trim("prompt"), F.lit("\n\n"), F.array_join(some("hints"), "\n"))).otherwise(F.trim("prompt"))
    follow = F.concat(F.lit("Previous context: "), F.array_join(some("context"), " / "), F.lit("\nCurrent question: "), "prompt")
    fed = F.concat(F.col("prompt"), F.lit("\n\n"), F.array_join(some("prf"), " "))
    listed = F.concat(
        F.array(made("original", original)),
        F.when(F.size(some("context")) > 0, F.array(made("follow_up", follow))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")),
        F.transform(some("rewrites"), lambda x: made("rewrite", x)),
        F.when(F.size(some("prf")) > 0, F.array(made("prf", fed))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")),
    )
    plain = lambda x: F.lower(F.regexp_replace(F.trim(x["text"]), r"\s+", " "))
    keys = F.transform("c", plain)
    first = F.filter("c", lambda x, i: (plain(x) != "") & (F.array_position(keys, plain(x)) == i + 1))
    rows = prompts.select(key, listed.alias("c")).select(key, F.posexplode(F.slice(first, 1, most)).alias("i", "x"))
    weight = F.element_at(F.create_map(*(F.lit(v) for kv in WEIGHTS.items() for v in kv)), F.col("x.kind"))
    return rows.select(key, "x.kind", weight.alias("weight"), "x.text", (F.col("i") + 1).cast("long").alias("position"))


def cache_key(prompt: Column, mode: Column) -> Column:
    return F.sha1(F.concat(F.trim(prompt), F.lit("#"), mode).cast("binary"))


def cached(prompts: DataFrame, cache: DataFrame, valid: Column) -> DataFrame:
    """`prompts` (with key) with `hit` and the cached `rewrite`; entries that aren't valid count as absent."""
    found = cache.filter(valid).select("key", "rewrite", F.lit(True).alias("hit")).dropDuplicates(["key"])
    return prompts.join(found, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
