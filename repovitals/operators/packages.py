"""Dependencies: duplicate versions, declared against used, cargo trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_versions(locked: DataFrame) -> DataFrame:
    """(name, versions, direct, weight) of names locked at several versions. locked: (name, version, direct)."""
    by_name = locked.groupBy("name").agg(F.count_distinct("version").alias("versions"), F.count_distinct(F.when(F.col("direct"), F.col("version"))).alias("direct"))
    weight = F.when(F.col("direct") > 0, 2 + 0.15 * F.col("direct")).otherwise(0.35 + 0.03 * F.col("versions"))
    return by_name.where("versions > 1").withColumn("weight", F.round(weight, 9))


def duplicate_score(locked: DataFrame) -> DataFrame:
    found = duplicate_versions(locked).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"), F.count("*").alias("duplicates"))
    names = locked.agg(F.count_distinct("name").alias("packages"))
    return found.join(F.broadcast(names)).select("packages", "duplicates", F.round(1 - F.least(F.lit(1.0), F.coalesce(F.col("w") / F.nullif("packages", F.lit(0)), F.lit(0.0))), 9).alias("score"))


def health(declared: DataFrame, used: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """(owner, name, problem, weight): missing (used, not declared), transitive (the same, but a declared package brings it),
    unused (declared, not used), dev-in-prod.

    declared: (owner, name, dev); used: (owner, name[, usage, private]); reached: (owner, name) of what declared packages
    bring. One full join of both, so each pair is shuffled once. A pair used in several ways weighs as its heaviest."""
    d = declared.groupBy("owner", "name").agg(F.min("dev").alias("dev"))
    usage = F.col("usage") if "usage" in used.columns else F.lit("runtime")
    private = F.col("private") if "private" in used.columns else F.lit(False)
    u = used.withColumn("__w", missing_weight(usage, private)).groupBy("owner", "name").agg(F.max("__w").alias("__w"))
    met = d.join(u, ["owner", "name"], "full")
    brought = F.lit(False)
    if reached is not None:
        met = met.join(reached.select("owner", "name").distinct().withColumn("__r", F.lit(True)), ["owner", "name"], "left")
        brought = F.coalesce("__r", F.lit(False))
    problem = F.when(F.col("dev").isNull() & brought, "transitive").when(F.col("dev").isNull(), "missing").when(F.col("__w").isNull(), "unused").when(F.col("dev"), "dev-in-prod")
    return met.withColumn("problem", problem).where("problem IS NOT NULL").select("owner", "name", "problem", F.coalesce("__w", F.lit(1.0)).alias("weight"))


def missing_weight(usage: Column, private: Column) -> Column:
    """How much a missing dependency weighs, by how it is used (tooling, dynamic, type-only, runtime) and whether its owner is private."""
    return F.when(usage == "tooling", 0.2).when(usage == "dynamic", 0.45).when(usage == "type-only", 0.2).when(F.coalesce(private, F.lit(False)), 0.45).otherwise(1.0)


def health_score(problems: DataFrame, packages: int, bearing: int | None = None) -> DataFrame:
    """(missing, unused, transitive, dev_in_prod, score) of problems (problem[, weight]). bearing: packages that have dependencies."""
    n = lambda p: F.count(F.when(F.col("problem") == p, 1))
    weight = F.col("weight") if "weight" in problems.columns else F.lit(1.0)
    missing = F.coalesce(F.sum(F.when(F.col("problem") == "missing", weight)), F.lit(0.0))
    penalty = missing / max(1, packages - 1 if bearing is None else bearing) * 1.25 + n("unused") / (50 * max(1, packages)) + (n("transitive") + n("dev-in-prod")) / (20 * max(1, packages))
    return problems.agg(n("missing").alias("missing"), n("unused").alias("unused"), n("transitive").alias("transitive"), n("dev-in-prod").alias("dev_in_prod"), F.round(1 - F.least(F.lit(1.0), penalty), 9).alias("score"))


def cargo_tree_score(packages: DataFrame) -> DataFrame:
    """packages: one row (pkgs, duplicates, depth, unused). Capped pressures, at least .15."""
    p, lit = F.col, F.lit
    pressure = F.least(lit(0.45), 2 * p("duplicates") / F.greatest(lit(50), p("pkgs"))) + F.least(lit(0.25), 0.05 * F.greatest(lit(0), p("depth") - 9)) + F.least(lit(0.25), F.greatest(lit(0), p("pkgs") - 5) / 1200) + F.least(lit(0.2), 0.04 * p("unused"))
    return packages.select(F.round(F.greatest(lit(0.15), 1 - pressure), 9).alias("score"))


def cargo_tree(crates: DataFrame, edges: DataFrame) -> DataFrame:
    """(pkgs, duplicates, depth, unused) of crates (name, version[, used]) and their edges (src, dst): what cargo_tree_score() takes."""
    from .graph import depths

    used = F.col("used") if "used" in crates.columns else F.lit(True)
    twice = crates.groupBy("name").agg(F.count_distinct("version").alias("v")).agg(F.count(F.when(F.col("v") > 1, 1)).alias("duplicates"))
    sums = crates.agg(F.count("*").alias("pkgs"), F.count(F.when(~used, 1)).alias("unused"))
    deep = depths(edges).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    return sums.join(F.broadcast(twice)).join(F.broadcast(deep)).select("pkgs", "duplicates", "depth", "unused")
