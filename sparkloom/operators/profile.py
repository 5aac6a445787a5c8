"""Learner profiles: drill views, unified focus, triggers, confidence, and the scalar rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ceilings of the dimensions of a drill.
CEILINGS = {"accuracy": 4, "depth": 3, "practicality": 2, "completeness": 1}


def drill_view(drills: DataFrame, window: int = 5) -> DataFrame:
    """(user_id, points, n, level, weak, low) of each learner's last drills."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = drills.withColumn("back", back).filter(F.col("back") <= window)
    n = F.count("*")
    weak = F.concat_ws(",", *(F.when(10 * F.sum(d) < 6 * c * n, d) for d, c in CEILINGS.items()))
    # categories from the oldest on, each once
    low = F.sort_array(F.collect_list(F.when(F.col("total") < 6, F.struct((-F.col("back")).alias("at"), "category"))))
    out = last.groupBy("user_id").agg(F.sum("total").alias("points"), n.alias("n"), weak.alias("weak"), F.array_join(F.array_distinct(F.transform(low, lambda x: x["category"])), ",").alias("low"))
    p, k = F.col("points"), F.col("n")
    level = F.when(p >= 9 * k, "L5").when(p >= 7 * k, "L4").when(p >= 5 * k, "L3").when(p >= 3 * k, "L2").otherwise("L1")
    return out.select("user_id", "points", "n", level.alias("level"), "weak", "low")


def unified(points: DataFrame, view: DataFrame, most: int = 5) -> DataFrame:
    """(user_id, focus, empirical, theoretical) as comma-joined sorted lists. points: (user_id, point, repeated,
    dominant)."""
    own = points.groupBy("user_id").agg(F.collect_set(F.when(F.col("repeated"), F.col("point"))).alias("rep"), F.collect_set(F.when(F.col("dominant"), F.col("point"))).alias("dom"))
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    out = own.join(view.select("user_id", "weak", "low"), "user_id", "left")
    joined = lambda a: F.array_join(F.slice(F.sort_array(a), 1, most), ",")
    return out.select(
        "user_id",
        F.array_join(F.sort_array(F.array_intersect("rep", "dom")), ",").alias("focus"),
        joined(F.array_except("rep", parts("low"))).alias("empirical"),
        joined(F.array_except(parts("weak"), F.array_union("rep", "dom"))).alias("theoretical"),
    )


def earliest_due(drills: DataFrame, now: Column) -> DataFrame:
    """(user_id, event_id, due): of the drills that are due the one that has been longest."""
    days = F.when(F.col("total") % 3 == 0, 3).when(F.col("total") % 3 == 1, 7).otherwise(14)
    due = F.col("ts") + F.make_dt_interval(days=days)
    rows = drills.withColumn("due", due).filter(F.col("due") <= now)
    return rows.groupBy("user_id").agg(F.min(F.struct("due", "event_id")).alias("e")).select("user_id", "e.event_id", "e.due")


def trigger(pending: Column, assessment: Column, review: Column, follow_up: Column) -> Column:
    """The first trigger that applies; none while something is pending."""
    return F.when(pending, "none").when(assessment, "self_assessment").when(review, "review_drill").when(follow_up, "follow_up").otherwise("none")


def confidence(n: Column, mean: Column, high: float, low: float) -> Column:
    """From a count (4 and more high, 2 and more medium), a step up or down by the mean of drills."""
    base = F.when(n >= 4, 2).when(n >= 2, 1).otherwise(0) + F.when(mean >= high, 1).when(mean < low, -1).otherwise(0)
    return F.when(base >= 2, "high").when(base == 1, "medium").otherwise("low")


def live(expires: Column, issued: Column, now: Column, hours: int = 24) -> Column:
    return F.coalesce(expires, issued + F.expr(f"INTERVAL {hours} HOURS")) > now


def turns_left(ttl: Column) -> Column:
    """One turn less; null when none is left."""
    return F.when(ttl - 1 >= 0, ttl - 1)


def row_score(score: Column, distance: Column, rank: Column) -> Column:
    return F.coalesce(score, 1 / (1 + distance), 1 / rank)


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor zero, else zero."""
    return F.coalesce(*(F.nullif(v, F.lit(0.0)) for v in values), F.lit(0.0))


def clamped(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def overridden(defaults: dict, given: Column) -> Column:
    """A map of defaults under the entries that are given."""
    base = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k)), given)


def same_family(concept: Column, known: str) -> Column:
    """Equal, or of one category with one slug beginning the other up to a hyphen."""
    if "/" not in known:
        return concept == known
    category, slug = known.split("/", 1)
    own, rest = F.split_part(concept, F.lit("/"), F.lit(1)), F.split_part(concept, F.lit("/"), F.lit(2))
    near = concept.contains("/") & (own == category) & (rest.startswith(slug + "-") | F.startswith(F.lit(slug), F.concat(rest, F.lit("-"))))
    return (concept == known) | near


def family_delta(concept: Column, mastered: list[str], weak: list[str], down: int = -15, up: int = 10) -> Column:
    """Hundredths by which a candidate moves; what is mastered goes first."""
    any_of = lambda names: F.greatest(F.lit(False), *(same_family(concept, n) for n in names)) if names else F.lit(False)
    return F.when(any_of(mastered), down).when(any_of(weak), up).otherwise(0)


def not_migrated(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Each row once by its key, without those that are there already: running it again adds nothing."""
    return rows.dropDuplicates(key).join(done.select(*key), key, "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    """(x, y, added): edges and the reversed ones that were missing."""
    back = edges.select(F.col("y").alias("x"), F.col("x").alias("y")).join(edges, ["x", "y"], "left_anti")
    return edges.select("x", "y", F.lit(0).cast("long").alias("added")).unionByName(back.distinct().withColumn("added", F.lit(1).cast("long")))
