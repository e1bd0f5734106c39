"""Score formulas of the signals that need no operator of their own, as columns over counted facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp01, saturating


def _n(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _cap(most: float, x: Column) -> Column:
    return F.least(F.lit(most), x)


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def evidence(n, least: float) -> Column:
    return _cap(1.0, _n(n) / least)


def visibility_score(modules: DataFrame, warn: float = 0.35, cap: float = 0.3) -> DataFrame:
    """modules: (public, items). 1 - cap * the larger of the share of modules over `warn` and their mean excess."""
    share = _share(_n("public"), _n("items"))
    over = F.avg((share > warn).cast("int"))
    excess = F.avg(F.when(share > warn, (share - warn) / (1 - warn)).otherwise(0.0))
    return modules.agg(F.round(1 - cap * F.coalesce(F.greatest(over, excess), F.lit(0.0)), 9).alias("score"))


def crate_cycle_score(cycles, largest) -> Column:
    return clamp01(1 - _cap(1.0, 0.15 * _n(cycles)) - F.when(_n(cycles) > 0, _cap(0.5, 0.1 * F.greatest(F.lit(0.0), _n(largest) - 2))).otherwise(0.0))


def trait_coupling_score(concerns, impls, least: float = 10) -> Column:
    return clamp01(1 - _n(concerns) / F.greatest(F.lit(least), _n(impls)))


def feature_score(most, spread, sites, least: float = 8) -> Column:
    return clamp01(1 - _cap(0.4, F.greatest(F.lit(0.0), _n(most) - least) / least) - _cap(0.3, _n(spread) / 40) - _cap(0.3, _n(sites) / 40))


def rust_hub_score(hubs, modules, pressure) -> Column:
    return clamp01(1 - _cap(0.6, 2 * _share(_n(hubs), _n(modules))) - _cap(0.4, _share(_n(pressure), 10 * _n(modules))))


def chain_share_score(long_chains, chains, least: float = 5) -> Column:
    """Trait-object chains and boundary parsers: the bad share, damped on little evidence."""
    return clamp01(1 - _share(_n(long_chains), _n(chains)) * evidence(chains, least))


def unsafe_score(spreading, functions, sites, broken) -> Column:
    return F.when(_n(broken) > 0, 0.0).otherwise(clamp01(1 - F.greatest(_share(_n(spreading), _n(functions)), _cap(1.0, _share(_n(sites), _n(functions))))))


def error_granularity_score(granular, collapsed, floor: float = 0.5) -> Column:
    """All collapsed alike is a convention, and no lower than the floor."""
    total = _n(granular) + _n(collapsed)
    return F.when(total == 0, 1.0).when(_n(granular) == 0, floor).otherwise(_n(granular) / F.nullif(total, F.lit(0.0)))


def rust_hotspot_score(facts: DataFrame, churn: int = 2, complexity: int = 5, floor: float = 0.2) -> DataFrame:
    """facts: (churn, complexity). Mean over hot files of min(1, sqrt of both over their least), at least the floor."""
    hot = facts.where((F.col("churn") >= churn) & (F.col("complexity") >= complexity))
    files = facts.agg(F.count("*").alias("files"))
    p = hot.agg(F.coalesce(F.sum(_cap(1.0, F.sqrt(F.col("churn") / churn * (F.col("complexity") / complexity)))), F.lit(0.0)).alias("p"))
    return p.join(F.broadcast(files)).select(F.round(F.greatest(F.lit(floor), 1 - _share(F.col("p"), _n("files"))), 9).alias("score"))


def rust_clone_score(members, groups) -> Column:
    return 1 - _cap(0.5, _cap(0.35, _n(members) / 200) + _cap(0.15, _n(groups) / 250))


def rust_pr_score(lines, edges) -> Column:
    return clamp01(1 - _cap(0.6, _n(lines) / 1000) - 0.15 * _n(edges))


def suppression_score(expired, missing, justified, languages) -> Column:
    """Null with one language: the signal compares several."""
    return F.when(_n(languages) >= 2, clamp01(1 - (4 * _n(expired) + _n(missing) + 0.25 * _n(justified)) / 100))


def dependency_delta_score(boundary, package, crate) -> Column:
    return clamp01(1 - (0.2 * _n(boundary) + 0.1 * _n(package) + 0.15 * _n(crate)))


def construction_score(findings, most: float = 8) -> Column:
    return saturating(_n(findings) / most)


def reexport_score(depth, free: float = 3, scale: float = 3) -> Column:
    return clamp01(1 - F.greatest(F.lit(0.0), _n(depth) - free) / scale)


def unfinished_score(stubs, budget, capped) -> Column:
    """Unfinished bodies against the clean budget; kinds that cap it leave at most .8."""
    s = clamp01(1 - _share(_n(stubs), _n(budget)))
    return F.when(_n(capped) > 0, F.least(F.lit(0.8), s)).otherwise(s)


def unsafe_spread_score(spread: DataFrame, seeds: DataFrame, functions: DataFrame) -> DataFrame:
    """(functions, spreading, sites, score) of the functions that unsafe seeds (node) reach (node), among all (node[, safe_only]).

    A seed in a module that says it is safe only makes the score 0."""
    broken = F.col("safe_only") if "safe_only" in functions.columns else F.lit(False)
    marked = functions.join(spread.withColumn("__s", F.lit(True)), "node", "left").join(seeds.select("node").distinct().withColumn("__u", F.lit(True)), "node", "left")
    n = lambda c: F.count(F.when(c, 1))
    sums = marked.agg(F.count("*").alias("functions"), n(F.col("__s")).alias("spreading"), n(F.col("__u")).alias("sites"), n(F.col("__u") & broken).alias("broken"))
    return sums.withColumn("score", F.round(unsafe_score("spreading", "functions", "sites", "broken"), 9)).drop("broken")


#: Script names that show a class of machine feedback.
FEEDBACK = {"build": "(^|:)build", "typecheck": "type-?check|tsc", "test": "(^|:)test", "coverage": "cover", "lint": "lint|clippy", "format": "fmt|format"}


def feedback_classes(scripts: DataFrame) -> DataFrame:
    """scripts: (name). (class, present) of every class."""
    name = F.col("name")
    one = scripts.agg(*(F.coalesce(F.bool_or(name.rlike(p)), F.lit(False)).alias(k) for k, p in FEEDBACK.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("class"), F.col(k).alias("present")) for k in FEEDBACK))).alias("x")).select("x.*")
