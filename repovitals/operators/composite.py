"""Signals made of other signals' tables: hotspots, trust breach, weighted indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggregates import global_rank, inclusive_percentile
from ..functions.scalars import above_floor, blend_weight, clamp01, magnitude, soft_gate


def weighted_present(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that aren't null; null when all are."""
    top = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) * w for c, w in parts))
    low = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts))
    return top / F.nullif(low, F.lit(0.0))


def quadrants(facts: DataFrame) -> DataFrame:
    """facts: (file, complexity, churn). Adds `quadrant` against both medians, strictly above counting as high."""
    mid = facts.agg(F.median("complexity").alias("mc"), F.median("churn").alias("mh"))
    hot, hard = F.col("churn") > F.col("mh"), F.col("complexity") > F.col("mc")
    name = F.when(hot & hard, "top-right").when(hard, "top-left").when(hot, "bottom-right").otherwise("bottom-left")
    return facts.join(F.broadcast(mid)).withColumn("quadrant", name).drop("mc", "mh")


def risks(facts: DataFrame, rank: bool = True) -> DataFrame:
    """facts: (file, complexity, churn, weighted, ownership, coverage, cochange), the last four null where unknown.

    Risk is the weighted mean of the factors a file has; absent is not zero. rank: by risk, then file."""
    churn = F.coalesce(magnitude("weighted", 2, 0.5), magnitude("churn", 2, 0.5))
    risk = weighted_present([(magnitude("complexity", 5, 0.5), 0.35), (churn, 0.25), (F.col("ownership"), 0.15), (F.col("coverage"), 0.15), (F.col("cochange"), 0.10)])
    gate = soft_gate("churn", 2, 0.5) * soft_gate("complexity", 5, 0.5)
    scored = facts.withColumn("risk", F.round(risk, 9)).withColumn("gate", F.round(gate, 9)).where("gate > 0")
    return global_rank(scored, "risk", "file", "rank") if rank else scored


def risk_score(ranked: DataFrame, top: int = 10) -> DataFrame:
    """(score): 1 - the mean of the largest positive risks; 1 without any."""
    first = ranked.where("risk > 0").orderBy(F.desc("risk"), "file").limit(top)
    return first.agg(F.round(1 - F.least(F.lit(1.0), F.coalesce(F.avg("risk"), F.lit(0.0))), 9).alias("score"))


def soft_score(facts: DataFrame) -> DataFrame:
    """(files, soft_pressure, legacy, soft, score) of the model without rich facts, for facts (file, complexity, churn)."""
    gated = facts.withColumn("tw", soft_gate("churn", 2, 0.5) * soft_gate("complexity", 5, 0.5)).where("tw > 0")
    gated = inclusive_percentile(inclusive_percentile(gated, "churn", "ph"), "complexity", "pc")
    part = F.col("tw") * above_floor("ph", 0.5) * above_floor("pc", 0.5) * F.sqrt(magnitude("churn", 2, 0.5) * magnitude("complexity", 5, 0.5))
    soft_set = quadrants(gated)
    legacy_set = quadrants(facts.where("churn >= 2 AND complexity >= 5"))
    share = lambda df, n: df.agg(F.coalesce(F.avg((F.col("quadrant") == "top-right").cast("int")), F.lit(0.0)).alias(n))
    pressure = gated.agg(F.count("*").alias("files"), F.coalesce(F.avg(part), F.lit(0.0)).alias("soft_pressure"))
    all_ = pressure.join(F.broadcast(share(soft_set, "s"))).join(F.broadcast(share(legacy_set, "l")))
    legacy = 1 - F.least(F.lit(1.0), F.greatest(1.5 * F.col("l"), F.col("soft_pressure")))
    soft = 1 - F.least(F.lit(1.0), F.col("s") + 2 * F.col("soft_pressure"))
    b = blend_weight("files")
    nine = lambda c, n: F.round(c, 9).alias(n)
    return all_.select("files", nine(F.col("soft_pressure"), "soft_pressure"), nine(legacy, "legacy"), nine(soft, "soft"), nine(legacy * (1 - b) + soft * b, "score"))


def trust_breach(facts: DataFrame, top: int = 10) -> DataFrame:
    """facts: (file, parser, unsafe, violations, drift). Weights .35 .30 .25 .10; score 1 - the mean of the worst files."""
    breach = weighted_present([(clamp01("parser"), 0.35), (clamp01("unsafe"), 0.30), (clamp01(F.col("violations") / 3), 0.25), (clamp01(F.col("drift") / 5), 0.10)])
    worst = facts.withColumn("b", F.round(breach, 9)).where("b > 0").orderBy(F.desc("b"), "file").limit(top)
    return worst.agg(F.count("*").alias("files"), F.round(1 - F.coalesce(F.avg("b"), F.lit(0.0)), 9).alias("score"))


#: Weights of the theory index.
THEORY = {"domain": 0.20, "contracts": 0.15, "feedback": 0.14, "coverage": 0.10, "parsers": 0.14, "errors": 0.09, "properties": 0.10, "ai_churn": 0.08}


def theory_index(factors: DataFrame, least: float = 0.25) -> DataFrame:
    """factors: one row with a pressure or null in each column of THEORY. (score, available, applicability)."""
    have = reduce(lambda a, b: a + b, (F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in THEORY.items()))
    index = weighted_present([(F.col(k), w) for k, w in THEORY.items()])
    return factors.select(F.round(F.when(have >= least, 1 - index).otherwise(1.0), 9).alias("score"), F.round(have, 9).alias("available"), F.when(have >= least, "applicable").otherwise("insufficient_evidence").alias("applicability"))


def composite(facts: DataFrame, inputs: dict[str, tuple[Column, float, bool]], name: str = "score") -> DataFrame:
    """A user's composite: input -> (normalised value, weight, required). A missing required input makes it neutral (1)."""
    missing = reduce(lambda a, b: a | b, (c.isNull() for c, _, needed in inputs.values() if needed), F.lit(False))
    value = 1 - weighted_present([(clamp01(c), w) for c, w, _ in inputs.values()])
    return facts.withColumn(name, F.when(missing, 1.0).otherwise(F.coalesce(value, F.lit(1.0)))).withColumn(f"{name}_missing_required", missing)
