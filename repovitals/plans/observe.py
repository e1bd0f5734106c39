"""One observation of all built-in signals that the warehouse has facts for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import materialised
from ..operators import builtin
from ..operators.registry import Vector
from ..sources import adapters as a
from . import history, observations
from .base import ORACLES, query

#: Settings that suit the warehouse's facts, and weights other than 1.
VECTOR = Vector(
    weight={"TS-LD-01": 1.5, "TS-SEC-01": 0.5},
    config={"TS-DE-02": {"fan_in": 3, "fan_out": 3}, "TS-DE-04": {"packages": 100_000}, "TS-LD-02": {"function_loc": 100, "file_loc": 9000}},
)
#: Signals whose score is a query of its own.
OWN = {
    "SHARED-02": "silo_score", "TS-AD-02": "cycle_score", "TS-DE-01": "type_coupling", "TS-DE-02": "hub_score", "TS-DE-03": "propagation_cost", "TS-DE-04": "package_health_score", "TS-DE-05": "duplicate_version_score",
    "TS-AB-01": "export_surface", "TS-AB-02": "unused_exports", "TS-AB-04": "interface_implementations", "TS-LD-01": "complexity_score", "TS-LD-02": "size_distribution", "TS-RP-01": "hotspots_score",
}


def facts(spark, d):
    """The facts the warehouse's tables stand for, by name. Touches, which five signals read, are joined and written once."""
    counts, sizes = observations._counts(spark, d)
    files = a.files(spark, d)
    lines = a.table(spark, d, "lineitem")
    health = lines.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("name"), (F.col("l_returnflag") == "A").alias("dev"), "l_returnflag")
    used = health.where("l_returnflag IN ('R', 'N')").select("owner", "name", F.when(F.col("l_returnflag") == "R", "type-only").otherwise("runtime").alias("usage"))
    calls = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    reach = F.when(F.col("p_size") % 7 == 0, "framework-consumed").when(F.col("n").isNull(), "unused").when(F.col("n") < 25, "internal-only").otherwise("cross-boundary")
    impls = a.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("impls"))
    return {
        "touches": materialised(a.touches(spark, d), "touches"), "commits": a.commits(spark, d), "files": files, "file_sizes": files.groupBy("package").agg(F.sum("loc").alias("loc")), "edges": a.edges(spark, d), "counts": counts, "sizes": sizes,
        "lock": history._lock(spark, d), "declared": health.where("l_returnflag IN ('A', 'N')"), "used": used,
        "modules": lines.groupBy(F.col("l_suppkey").alias("module")).agg(F.count_distinct("l_partkey").alias("ext")), "exports": lines.select(F.col("l_suppkey").alias("file"), F.col("l_quantity").alias("weight")),
        "export_reach": a.table(spark, d, "part").join(calls, "p_partkey", "left").select(reach.alias("reach"), (1.0 + F.col("p_size") % 3).alias("weight")),
        "interfaces": a.table(spark, d, "customer").select("c_custkey").join(impls, "c_custkey", "left").select(F.coalesce("impls", F.lit(0)).alias("impls")),
    }


def _sql() -> str:
    about = {builtin.short(name): (name, tier, category, kind, evidence) for name, tier, category, kind, evidence in builtin.CATALOG}
    weight = {k: v for k, v in VECTOR.weight.items()}
    rows = []
    for own, (name, tier, category, kind, evidence) in about.items():
        if own in OWN or own in builtin.findings.SIGNALS:
            confidence = {1.0: 1.0, 1.5: 0.95, 2.0: 0.85}[tier]
            grp = {"TS": "typescript", "RS": "rust"}.get(own[:2], "shared")
            authority = kind == "structural" and tier == 1.0 and evidence in ("deterministic-ast", "manifest-fact")
            rows.append(f"('{own}', '{name}', '{category}', {tier}, {weight.get(own, 1.0)}, {confidence}, '{grp}', {str(authority).lower()})")
    transitive = ORACLES["package_health_score"].replace("AND r THEN", "AND false THEN")  # the observation is not told what packages bring
    scores = [f"SELECT '{own}' AS s, score::DOUBLE AS score, {'applicability' if own == 'SHARED-02' else chr(39) + 'applicable' + chr(39)} AS applicability FROM ({transitive if own == 'TS-DE-04' else ORACLES[name]}) q" for own, name in OWN.items()]
    scores.append(f"SELECT signal_id, score, 'applicable' FROM ({ORACLES['finding_signals']}) q")
    return f"""WITH meta(s, signal_id, category, tier, weight, confidence, grp, authority) AS (VALUES {', '.join(rows)}), sc AS ({' UNION ALL '.join(scores)}),
signal_results AS (SELECT category, signal_id, coalesce(score, 1) AS score, weight::DOUBLE AS weight, confidence::DOUBLE AS confidence, grp, applicability, authority, false AS provider FROM sc JOIN meta USING (s)), {observations.EV}, {observations.READY},
wm AS (SELECT round(coalesce(sum(score * signals) / sum(signals), 1), 9)::DOUBLE AS x FROM cat), mn AS (SELECT signal_id, score FROM ev ORDER BY score, list_position({list(dict.fromkeys(x[2] for x in builtin.CATALOG))}, category), signal_id LIMIT 1)
SELECT 'category' AS what, category AS name, score FROM cat UNION ALL SELECT 'readiness', CASE WHEN p < 0.15 THEN 'green' WHEN p >= 0.4 THEN 'red' ELSE 'yellow' END, round(1 - p, 9)::DOUBLE FROM r3 UNION ALL SELECT 'weighted_mean', 'all', x FROM wm UNION ALL SELECT 'minimum', signal_id, score FROM mn UNION ALL SELECT 'signal', signal_id, score FROM signal_results"""


@query(_sql())
def observe_all(spark, d):
    """Every signal's score, the categories', the weighted mean, readiness and the lowest signal: (what, name, score)."""
    seen = builtin.observe(facts(spark, d), None, VECTOR)
    row = lambda df, what, name, score: df.select(F.lit(what).alias("what"), F.col(name).alias("name") if isinstance(name, str) else name.alias("name"), F.col(score).alias("score"))
    parts = [row(seen["results"], "signal", "signal_id", "score"), row(seen["categories"], "category", "category", "score"), row(seen["readiness"], "readiness", "status", "score"), row(seen["weighted_mean"], "weighted_mean", F.lit("all"), "weighted_mean"), row(seen["minimum"], "minimum", "signal_id", "score")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
