"""Signals that count and weigh findings: one row of the table for each, one function for all.

Facts are (kind, boundary, n) counts over a tree, with denominators (files, functions, lines, total) beside them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp01, saturating


@dataclass(frozen=True)
class Finding:
    """formula: what the weighted count becomes; weights: of kinds (`others` for the rest); at: the formula's constants."""

    formula: str
    weights: dict[str, float] = field(default_factory=dict)
    boundary: float = 1.0
    at: tuple[float, ...] = ()
    others: float = 1.0


#: Formulas, weights of kinds and thresholds of the finding signals.
SIGNALS = {
    "TS-CC-01": Finding("saturating", {"log-only-handler": 0}, at=(5,)),
    "TS-CC-02": Finding("saturating", at=(5,)),
    "TS-BP-01": Finding("saturating", at=(3,)),
    "TS-LD-08": Finding("saturating", at=(10,)),
    "TS-SEC-02": Finding("saturating", at=(5,)),
    "TS-SEC-01": Finding("capability", {"eval": 1, "function-constructor": 1, "dynamic-import": 0, "shell-process": 0, "raw-sql": 0, "filesystem": 0, "network": 0, "crypto": 0}, at=(0.5,)),
    "TS-LD-07": Finding("density", {"parameter": 3, "return": 3, "property": 2.5, "type-alias": 2.5, "variable": 2, "assertion": 2, "heritage": 2, "unknown": 1}, 2, (10, 48)),
    "TS-LD-09": Finding("density", {"broad-throw": 2.5, "catch-without-narrowing": 3, "opaque-promise-api": 4, "promise-catch-collapse": 3, "effect-unknown-exception": 4, "effect-error-collapse": 3.5}, 2, (18, 36)),
    "TS-SL-05": Finding("share"),
    "TS-SL-06": Finding("share"),
    "TS-AB-03": Finding("share"),
    "TS-AB-05": Finding("share"),
    "TS-LD-03": Finding("share"),
    "TS-LD-04": Finding("share"),
    "TS-AD-01": Finding("share"),
    "RS-AB-01": Finding("share"),
    "RS-AB-03": Finding("share"),
    "RS-AB-04": Finding("share"),
    "RS-LD-03": Finding("share"),
    "RS-AD-02": Finding("double-share"),
    "RS-LD-02": Finding("double-share"),
    "RS-LD-05": Finding("double-share"),
    "RS-SL-04": Finding("capped", at=(25, 0.8)),
    "RS-SL-03": Finding("unwrap", at=(0.05, 0.001, 0.5)),
    "RS-RP-02": Finding("capped", at=(10_000, 1.0)),
    "RS-SL-02": Finding("zero-or-count", {"missing": 1, "expired": 1}, at=(25,), others=0.0),
}


def weighed(facts: DataFrame, signal: str) -> DataFrame:
    """facts: (kind, boundary boolean, n). One row (weighted, boundary_weighted, n, warned)."""
    s = SIGNALS[signal]
    w = F.lit(float(s.others))
    for kind, weight in s.weights.items():
        w = F.when(F.col("kind") == kind, float(weight)).otherwise(w)
    full = w * F.when(F.coalesce("boundary", F.lit(False)), float(s.boundary)).otherwise(1.0) * F.col("n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return facts.agg(zero(F.sum(full)).alias("weighted"), zero(F.sum(F.when(F.col("boundary"), full))).alias("boundary_weighted"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(w > 0, F.col("n"))), F.lit(0)).alias("warned"))


def formula(signal: str, size: Column) -> Column:
    """The score of a row of weighed(); size: files, total checked or thousands of lines, as the formula wants."""
    s, w, n = SIGNALS[signal], F.col("weighted"), F.col("n")
    share = F.coalesce(w / F.nullif(size, F.lit(0)), F.lit(0.0))
    match s.formula:
        case "saturating":
            return saturating(w / s.at[0])
        case "capability":
            d = F.coalesce((n - F.col("warned")) / F.nullif(size, F.lit(0)), F.lit(0.0))
            return saturating(w) * (1 - s.at[0] * d / (1 + d))
        case "density":
            return saturating(F.greatest(F.coalesce(w / F.nullif(size, F.lit(0)), F.lit(0.0)) / s.at[0], F.col("boundary_weighted") / s.at[1]))
        case "share":
            return clamp01(1 - share)
        case "double-share":
            return 1 - F.least(F.lit(1.0), 2 * share)
        case "capped":
            return 1 - F.least(F.lit(s.at[1]), w / s.at[0])
        case "unwrap":
            return 1 - F.least(F.lit(s.at[2]), s.at[0] * size + s.at[1] * w)
        case "zero-or-count":
            return F.when(F.col("warned") > 0, 0.0).otherwise(1 - F.least(F.lit(1.0), n / s.at[0]))
    raise ValueError(s.formula)


def score(facts: DataFrame, signal: str, size: float) -> DataFrame:
    return weighed(facts, signal).select(F.lit(signal).alias("signal_id"), "n", F.round("weighted", 6).alias("weighted"), F.round(formula(signal, F.lit(float(size))), 9).alias("score"))


def score_all(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(signal_id, n, weighted, score) of every signal of SIGNALS that has a row in sizes, in one aggregation.

    counts: (signal_id, kind, boundary, n); sizes: (signal_id, size). Weights are a small table that facts join by kind."""
    spark = counts.sparkSession
    weights = [(i, k, float(w)) for i, s in SIGNALS.items() for k, w in s.weights.items()]
    shapes = [(i, s.formula, float(s.boundary), [float(x) for x in s.at], float(s.others)) for i, s in SIGNALS.items()]
    by_kind = spark.createDataFrame(weights, "signal_id string, kind string, w double")
    shape = spark.createDataFrame(shapes, "signal_id string, formula string, b double, at array<double>, others double")
    met = counts.join(F.broadcast(by_kind), ["signal_id", "kind"], "left").join(F.broadcast(shape.select("signal_id", "b", "others")), "signal_id")
    w = F.coalesce("w", "others")
    inside = F.coalesce("boundary", F.lit(False))
    full = w * F.when(inside, F.col("b")).otherwise(1.0) * F.col("n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = met.groupBy("signal_id").agg(F.sum(full).alias("weighted"), F.sum(F.when(inside, full)).alias("bw"), F.sum("n").alias("n"), F.sum(F.when(w > 0, F.col("n"))).alias("warned"))
    every = shape.join(F.broadcast(sizes), "signal_id").join(sums, "signal_id", "left")
    row = every.select("signal_id", "formula", "at", F.col("size").cast("double").alias("size"), *(zero(F.col(c).cast("double")).alias(c) for c in ("weighted", "bw", "n", "warned")))
    x, size, at = F.col("weighted"), F.col("size"), lambda i: F.get(F.col("at"), F.lit(i))
    share = F.coalesce(x / F.nullif("size", F.lit(0.0)), F.lit(0.0))
    d = F.coalesce((F.col("n") - F.col("warned")) / F.nullif("size", F.lit(0.0)), F.lit(0.0))
    by = {
        "saturating": saturating(x / at(0)),
        "capability": saturating(x) * (1 - at(0) * d / (1 + d)),
        "density": saturating(F.greatest(share / at(0), F.col("bw") / at(1))),
        "share": clamp01(1 - share),
        "double-share": 1 - F.least(F.lit(1.0), 2 * share),
        "capped": 1 - F.least(at(1), x / at(0)),
        "unwrap": 1 - F.least(at(2), at(0) * size + at(1) * x),
        "zero-or-count": F.when(F.col("warned") > 0, 0.0).otherwise(1 - F.least(F.lit(1.0), F.col("n") / at(0))),
    }
    score_ = F.coalesce(*(F.when(F.col("formula") == k, v) for k, v in by.items()))
    return row.select("signal_id", F.col("n").cast("long").alias("n"), F.round("weighted", 6).alias("weighted"), F.round(score_, 9).alias("score"))


def complexity_score(functions: DataFrame, least: int = 20) -> DataFrame:
    """functions: (complexity). Pressure: the larger of min(1, 2 share above) and how far the worst is above."""
    over = F.count(F.when(F.col("complexity") > least, 1))
    worst = F.max("complexity")
    pressure = F.greatest(F.least(F.lit(1.0), 2 * over / F.count("*")), F.greatest(F.lit(0.0), (worst - least) / worst))
    return functions.agg(F.count("*").alias("functions"), over.alias("over"), worst.alias("worst"), F.round(1 - F.coalesce(pressure, F.lit(0.0)), 9).alias("score"))


def size_score(functions: DataFrame, files: DataFrame, function_loc: int = 50, file_loc: int = 300) -> DataFrame:
    """functions, files: (loc). Pressure: the largest of the outliers' doubled share and both worst excesses."""
    sums = lambda df, limit, p: df.agg(F.count("*").alias(f"{p}n"), F.count(F.when(F.col("loc") > limit, 1)).alias(f"{p}o"), F.coalesce(F.max("loc"), F.lit(0)).alias(f"{p}m"))
    row = sums(functions, function_loc, "u").join(F.broadcast(sums(files, file_loc, "f")))
    far = lambda m, limit: F.greatest(F.lit(0.0), F.coalesce((F.col(m) - limit) / F.nullif(m, F.lit(0)), F.lit(0.0)))
    ratio = F.least(F.lit(1.0), F.coalesce(2 * (F.col("uo") + F.col("fo")) / F.nullif(F.col("un") + F.col("fn"), F.lit(0)), F.lit(0.0)))
    return row.select(F.col("uo").alias("function_outliers"), F.col("fo").alias("file_outliers"), F.round(1 - F.greatest(ratio, far("um", function_loc), far("fm", file_loc)), 9).alias("score"))


def surface_score(exports: DataFrame, least: int = 50) -> DataFrame:
    """exports: (file, weight). 1 - .5 log10(largest surface / least)."""
    by_file = exports.groupBy("file").agg(F.sum("weight").alias("w"))
    return by_file.agg(F.round(F.max("w"), 6).alias("largest"), F.round(clamp01(1 - F.greatest(F.lit(0.0), 0.5 * F.log10(F.max("w") / least))), 9).alias("score"))


def coupling_score(modules: DataFrame) -> DataFrame:
    """modules: (module, ext). Excess over max(1, average, p95), as a share of modules."""
    from ..functions.aggregates import distribution

    d = distribution(modules, "ext").select(F.greatest(F.lit(1.0), "avg", "p95").alias("t"))
    over = F.sum(F.when(F.col("ext") > F.col("t"), (F.col("ext") - F.col("t")) / F.col("t")))
    return modules.join(F.broadcast(d)).agg(F.count("*").alias("modules"), F.round(F.max("t"), 9).alias("threshold"), F.round(clamp01(1 - F.coalesce(over / F.count("*"), F.lit(0.0))), 9).alias("score"))


def unused_score(exports: DataFrame) -> DataFrame:
    """exports: (reach, weight): unused counts whole, internal-only half, framework-consumed isn't counted at all."""
    counted = exports.where("reach <> 'framework-consumed'")
    bad = F.when(F.col("reach") == "unused", F.col("weight")).when(F.col("reach") == "internal-only", 0.5 * F.col("weight")).otherwise(0.0)
    return counted.agg(F.count("*").alias("exports"), F.round(clamp01(1 - F.coalesce(F.sum(bad) / F.sum("weight"), F.lit(0.0))), 9).alias("score"))


def pr_size_penalty(lines: Column, small: int = 100, medium: int = 300, large: int = 500) -> Column:
    """0 up to the small budget, then in a straight line to .2 at the medium one, .4 at the large one and .6 two hundred lines on."""
    share = lambda a, b: F.lit(1.0) if b <= a else (lines - a) / (b - a)
    return F.when(lines <= small, 0.0).when(lines <= medium, 0.2 * share(small, medium)).when(lines <= large, 0.2 + 0.2 * share(medium, large)).otherwise(F.least(F.lit(0.6), 0.4 + (lines - large) / 1000))


def pr_size_score(lines: Column, boundary: Column, package: Column) -> Column:
    """What changed lines cost, and new boundary and package edges."""
    return F.greatest(F.lit(0.0), 1 - pr_size_penalty(lines) - 0.2 * boundary - 0.1 * package)


def implementation_score(interfaces: DataFrame, least: int = 5) -> DataFrame:
    """interfaces: (interface, impls). Single implementations, and those without any, damped on little evidence."""
    n, one, none = F.count("*"), F.count(F.when(F.col("impls") == 1, 1)), F.count(F.when(F.col("impls") == 0, 1))
    e = F.least(F.lit(1.0), n / least)
    pressure = F.greatest(F.least(F.lit(1.0), one / n / 0.5) * e, F.least(F.lit(1.0), none / n) * 0.25 * e)
    return interfaces.agg(n.alias("interfaces"), one.alias("single"), none.alias("dead"), F.round(1 - F.coalesce(pressure, F.lit(0.0)), 9).alias("score"))


def annotation_score(facts: DataFrame) -> DataFrame:
    """facts: (params, params_annotated, returns, returns_annotated) of boundary functions; parameters weigh 4, returns 1."""
    top, low = 4 * F.sum("params_annotated") + F.sum("returns_annotated"), 4 * F.sum("params") + F.sum("returns")
    return facts.agg(F.round(F.coalesce(top / F.nullif(low, F.lit(0)), F.lit(1.0)), 9).alias("score"))


def freshness_score(contracts: DataFrame, most: float = 8) -> DataFrame:
    """contracts: (state): missing-provenance 2, stale 5, missing 4, orphan 3; 1 / (1 + sum / most)."""
    w = F.when(F.col("state") == "stale", 5).when(F.col("state") == "missing", 4).when(F.col("state") == "orphan", 3).when(F.col("state") == "missing-provenance", 2).otherwise(0)
    return contracts.agg(F.coalesce(F.sum(w), F.lit(0)).alias("weighted"), F.round(saturating(F.coalesce(F.sum(w), F.lit(0)) / most), 9).alias("score"))


def contract_states(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected: (artifact, source_hash); actual: (artifact, built_from). The state of every artifact of either."""
    met = expected.withColumn("e", F.lit(True)).join(actual.withColumn("a", F.lit(True)), "artifact", "full")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "orphan").when(F.col("built_from").isNull(), "missing-provenance").when(F.col("built_from") != F.col("source_hash"), "stale").otherwise("fresh")
    return met.select("artifact", state.alias("state"))
