"""Snapshots, change history, incremental differences and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def changes(rows: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from the one before, the first included, with the previous value."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1
    out = rows.withColumn("previous", before).withColumn("__first", first)
    return out.filter(F.col("__first") | ~F.col("previous").eqNullSafe(F.col(value))).drop("__first")


def missing(known: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    return known.join(seen.select(*key), key, "left_anti")


def difference(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): added, modified, deleted or unchanged, by digests."""
    a, b = old.select(key, F.col(digest).alias("old")), new.select(key, F.col(digest).alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def threads(messages: DataFrame, key: str, turn: str, role: str) -> DataFrame:
    """Depth, role sequence and first role of each thread that has a reply."""
    ordered = F.sort_array(F.collect_list(F.struct(turn, role)))
    out = messages.groupBy(key).agg(F.count("*").alias("depth"), F.array_join(F.transform(ordered, lambda m: m[role]), "→").alias("roles"))
    return out.filter("depth > 1")
