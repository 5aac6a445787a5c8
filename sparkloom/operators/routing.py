"""Which way a prompt goes: tiers by what its vocabulary speaks for, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.dialogue import mentioned

FALLBACK = 55


def routed(rows: DataFrame, prompt: str, vocabulary: dict[str, list[str]], missing: Column, repeated: Column) -> DataFrame:
    """`rows` with a count n_* of each part of the vocabulary, tier (0 none, 1 cheap, 2 full, 3 coaching), mode, forced,
    promoted and blocked. Overrides go first, on the raw prompt; then coaching, tools without a domain, depth, and
    definition or study, which a repeated concept promotes. `missing`: coaching lacks what it needs."""
    out = rows.withColumns({f"n_{k}": mentioned(F.col(prompt), ws) for k, ws in vocabulary.items()}).withColumn("n_known", F.col("n_domain") + F.col("n_learning"))
    has = lambda *names: sum((F.col(f"n_{n}") for n in names), F.lit(0)) > 0
    tool, deep, asks = has("tool") & ~has("known"), has("known") & has("depth"), has("known") & has("definition", "study")
    forced = has("skip", "force_coach", "full", "some")
    soft = ~forced & ~has("coach") & ~tool & ~deep & asks & repeated
    tier = F.when(has("skip"), 0).when(has("force_coach"), 3).when(has("full"), 2).when(has("some"), F.when(deep, 2).otherwise(1)).when(has("coach"), 3).when(tool, 0).when(deep, 2).when(soft, 2).when(asks, 1).otherwise(0)
    out = out.withColumns({"tier": tier.cast("long"), "forced": forced, "promoted": soft})
    out = out.withColumn("blocked", (F.col("tier") == 3) & missing)
    return out.withColumn("mode", F.when(F.col("blocked"), "blocked").when(F.col("tier") == 3, "coach-run").when(F.col("tier") == 2, "full").when(F.col("tier") == 1, "cheap").otherwise("none"))


def with_confidence(rows: DataFrame, threshold: int = FALLBACK) -> DataFrame:
    """confidence in hundredths, and whether it asks for a second opinion."""
    has = lambda *names: sum((F.col(f"n_{n}") for n in names), F.lit(0)) > 0
    tier, both = F.col("tier"), has("depth") & has("known")
    sure = (
        F.when(F.col("forced"), 100)
        .when((tier == 3) & F.col("blocked"), 60)
        .when((tier == 3) & has("coach"), 95)
        .when(tier == 3, 50)
        .when((tier == 2) & F.col("promoted"), 70)
        .when((tier == 2) & both, F.when(has("definition", "study", "coach", "tool"), 80).otherwise(85))
        .when(tier == 2, 55)
        .when((tier == 1) & has("definition") & has("known"), 75)
        .when((tier == 1) & has("study") & has("known"), 72)
        .when(tier == 1, 50)
        .when(has("tool") & ~has("known", "definition", "depth", "study"), 85)
        .when(~has("known", "definition", "depth", "study", "coach"), 60)
        .otherwise(40)
    )
    return rows.withColumn("confidence", sure.cast("long")).withColumn("fallback", F.col("confidence") < threshold)
