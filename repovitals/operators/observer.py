"""Scores of an observation: categories, readiness, minimum, gates.

Rows are results of signals: (category, signal_id, score, tier, weight, confidence, grp, applicability, authority, provider)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggregates import p_norm
from ..functions.scalars import clamp01, round12


@dataclass(frozen=True)
class Config:
    p: float = 4
    warn: float = 0.4
    poison: float = 0.75
    gate_cap: float = 0.2
    green: float = 0.15
    red: float = 0.4
    top: int = 10


def evidence(results: DataFrame) -> DataFrame:
    """Results that count, with `pressure` and `effective`: providers and results that don't apply are left out."""
    pressure = clamp01(1 - F.col("score")) * F.col("confidence")
    return results.where("applicability = 'applicable' AND NOT provider").withColumn("pressure", pressure).withColumn("effective", 1 - F.col("pressure"))


def ramp(most: Column, config: Config = Config()) -> Column:
    span = config.poison - config.warn
    rise = clamp01((most - config.warn) / span) if span > 0 else F.when(most >= config.poison, 1.0).otherwise(0.0)
    return rise * most


def group_mean(results: DataFrame) -> DataFrame:
    """(category, mean): the weighted mean of a category, or, with both languages present, the mean of its groups' means."""
    part = evidence(results).groupBy("category", "grp").agg((F.sum(F.col("weight") * F.col("effective")) / F.sum("weight")).alias("m"), F.sum(F.col("weight") * F.col("effective")).alias("s"), F.sum("weight").alias("w"))
    languages = F.count_distinct(F.when(F.col("grp").isin("typescript", "rust"), F.col("grp")))
    return part.groupBy("category").agg(F.when(languages > 1, F.avg("m")).otherwise(F.sum("s") / F.sum("w")).alias("mean"))


def categories(results: DataFrame, config: Config = Config()) -> DataFrame:
    """(category, signals, mean, pnorm, poison, score) of every category that has results; 1 without evidence."""
    some = evidence(results)
    sums = some.groupBy("category").agg(F.count("*").alias("signals"), p_norm(F.col("pressure"), F.col("weight"), config.p).alias("pnorm"), F.coalesce(F.max(F.when(F.col("authority"), F.col("pressure"))), F.lit(0.0)).alias("m"))
    every = results.select("category").distinct().join(sums, "category", "left").join(group_mean(results), "category", "left")
    local = F.coalesce(ramp(F.col("m"), config), F.lit(0.0))
    score = F.least(F.coalesce("mean", F.lit(1.0)), 1 - clamp01(F.greatest(F.coalesce("pnorm", F.lit(0.0)), local)))
    return every.select("category", F.coalesce("signals", F.lit(0)).alias("signals"), F.round(F.coalesce("mean", F.lit(1.0)), 9).alias("mean"), F.round(F.coalesce("pnorm", F.lit(0.0)), 9).alias("pnorm"), F.round(local, 9).alias("poison"), F.round(round12(score), 9).alias("score"))


def weighted_mean(scores: DataFrame) -> DataFrame:
    """(weighted_mean): category scores weighed by how many signals apply; 1 without any."""
    return scores.agg(F.round(F.coalesce(F.sum(F.col("score") * F.col("signals")) / F.nullif(F.sum("signals"), F.lit(0)), F.lit(1.0)), 9).alias("weighted_mean"))


def readiness(results: DataFrame, gate_failed: bool = False, config: Config = Config()) -> DataFrame:
    """(pressure, score, pnorm, poison, status, dominant, margin), in one aggregation over all results."""
    ok = (F.col("applicability") == "applicable") & ~F.col("provider")
    own = F.when(ok, clamp01(1 - F.col("score")) * F.col("confidence"))
    weight = F.when(ok, F.col("weight"))
    sums = results.agg(p_norm(own, weight, config.p).alias("pnorm"), F.coalesce(F.max(F.when(F.col("authority"), own)), F.lit(0.0)).alias("m"), F.count(F.when(F.col("applicability") == "failed", 1)).alias("failed"), F.count(own).alias("n"))
    gate = F.lit(1 - config.gate_cap if gate_failed else 0.0)
    poison = ramp(F.col("m"), config)
    pressure = round12(clamp01(F.greatest(F.col("pnorm"), poison, gate)))
    status = F.when(gate > 0, "blocked").when(F.col("failed") > 0, "failed").when(F.col("n") == 0, "unknown").when(pressure < config.green, "green").when(pressure >= config.red, "red").otherwise("yellow")
    dominant = F.when((gate > 0) & (gate >= poison) & (gate >= F.col("pnorm")), "hard_gate").when((poison > 0) & (poison >= F.col("pnorm")), "local_poison").otherwise("pnorm")
    green, red = config.green - pressure, config.red - pressure
    margin = F.when(F.abs(green) <= F.abs(red), green).otherwise(red)
    six = lambda c, n: F.round(c, 9).alias(n)
    return sums.select(six(pressure, "pressure"), six(round12(1 - pressure), "score"), six(F.col("pnorm"), "pnorm"), six(poison, "poison"), status.alias("status"), dominant.alias("dominant"), six(margin, "margin"))


def top_pressures(results: DataFrame, n: int = 10) -> DataFrame:
    """The n results that press most: weighted, then raw, then by id."""
    some = evidence(results).withColumn("raw", clamp01(1 - F.col("score")))
    return some.select("signal_id", F.round("pressure", 9).alias("pressure"), F.round("raw", 9).alias("raw")).orderBy(F.desc("pressure"), F.desc("raw"), "signal_id").limit(n)


def minimum_dimension(results: DataFrame, order: list[str]) -> DataFrame:
    """The lowest result; ties by the order of categories, then id."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("category")), F.lit(0))
    return evidence(results).agg(F.min_by(F.struct("category", "signal_id", "score"), F.struct("score", place.alias("o"), F.col("signal_id").alias("i"))).alias("m")).select("m.category", "m.signal_id", "m.score").where("signal_id IS NOT NULL")


def hard_gate(findings: DataFrame, gated: list[str]) -> DataFrame:
    """(signal_id, violations, status) of gated signals: any block fails, whatever its weight."""
    return findings.where(F.col("signal_id").isin(gated)).groupBy("signal_id").agg(F.count(F.when(F.col("severity") == "block", 1)).alias("violations")).withColumn("status", F.when(F.col("violations") > 0, "fail").otherwise("pass"))


#: Severities, the gravest first.
SEVERITIES = ["block", "warn", "info"]


def top_diagnostics(findings: DataFrame, n: int = 10) -> DataFrame:
    """The n gravest findings of each signal (signal_id, severity, file, line, ...), then by place; `rank` from 1."""
    grave = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    order = W.partitionBy("signal_id").orderBy(grave, "file", F.col("line").asc_nulls_first(), "hash")
    return findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def severity_ceiling(findings: DataFrame, may_block: Column) -> DataFrame:
    """Blocks that may not gate become warnings and say so."""
    lowered = (F.col("severity") == "block") & ~may_block
    return findings.withColumn("message", F.when(lowered, F.concat("message", F.lit(" (downgraded from block)"))).otherwise(F.col("message"))).withColumn("severity", F.when(lowered, "warn").otherwise(F.col("severity")))


#: What results of a tier and kind may do.
CEILINGS = [
    (1.0, "compound", ["trend", "review-routing", "dashboard"]),
    (1.5, "compound", ["trend", "review-routing", "dashboard"]),
    (2.0, "compound", ["trend"]),
    (1.0, "structural", ["hard-gate"]),
    (2.0, "structural", ["hard-gate"]),
    (1.0, "legibility", ["soft-warning", "trend"]),
    (2.0, "legibility", ["soft-warning", "trend"]),
    (3.0, "legibility", ["soft-warning"]),
]


def ceiling(tier: Column, kind: Column) -> Column:
    out = F.array().cast("array<string>")
    for t, k, allowed in CEILINGS:
        out = F.when((tier == t) & (kind == k), F.array(*map(F.lit, allowed))).otherwise(out)
    return out


def ranked(df: DataFrame, by: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.orderBy(*by)))
