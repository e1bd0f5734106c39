"""The built-in signals: what each needs, how it is scored, and one observation of all of them.

Facts are tables by name; a signal whose facts are not given doesn't apply. Finding signals are scored together, in one
aggregation over all of them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col
from . import clones, composite, findings, graph, history, observer, packages, signals, text
from .registry import Batch, Registry, Signal, Vector, results, run

Facts = dict[str, DataFrame]

#: Id, tier, category, kind and class of evidence of every built-in signal.
CATALOG = [
    ("SHARED-CHURN-01-recent-churn", 1.0, "review-pain", "legibility", "historical-fact"),
    ("SHARED-CHURN-02-recency-weighted-churn", 1.0, "review-pain", "legibility", "historical-fact"),
    ("SHARED-COCHANGE-01-logical-coupling", 1.0, "architectural-drift", "legibility", "historical-fact"),
    ("SHARED-02-bus-factor", 1.5, "review-pain", "legibility", "historical-fact"),
    ("SHARED-03-churn-rate", 1.5, "review-pain", "legibility", "historical-fact"),
    ("SHARED-05-suppression-governance", 1.5, "generated-slop", "compound", "mixed"),
    ("SHARED-06-pr-dependency-delta", 1.5, "review-pain", "compound", "mixed"),
    ("SHARED-07-machine-feedback-coverage", 1.0, "review-pain", "legibility", "manifest-fact"),
    ("SHARED-09-contract-freshness", 2.0, "review-pain", "legibility", "reference-backed"),
    ("SHARED-10-domain-construction-control", 2.0, "abstraction-bloat", "legibility", "reference-backed"),
    ("SHARED-11-theory-encoding-index", 1.5, "architectural-drift", "compound", "mixed"),
    ("SHARED-COV-01-coverage-facts", 2.0, "review-pain", "legibility", "reference-backed"),
    ("TS-AD-01-boundary-violations", 2.0, "architectural-drift", "structural", "reference-backed"),
    ("TS-AD-02-circular-dependencies", 1.0, "architectural-drift", "structural", "deterministic-ast"),
    ("TS-AD-03-reexport-depth", 1.0, "architectural-drift", "structural", "deterministic-ast"),
    ("TS-AD-04-boundary-parser-coverage", 2.0, "architectural-drift", "structural", "heuristic-pattern"),
    ("TS-AD-05-boundary-trust-breach", 1.5, "architectural-drift", "compound", "mixed"),
    ("TS-DE-01-type-level-coupling", 1.0, "dependency-entropy", "legibility", "statistical"),
    ("TS-DE-02-fan-in-fan-out", 1.0, "dependency-entropy", "structural", "deterministic-ast"),
    ("TS-DE-03-propagation-cost", 1.0, "dependency-entropy", "structural", "deterministic-ast"),
    ("TS-DE-04-package-dependency-health", 1.0, "dependency-entropy", "structural", "manifest-fact"),
    ("TS-DE-05-duplicate-dependency-versions", 1.0, "dependency-entropy", "structural", "manifest-fact"),
    ("TS-AB-01-public-export-surface", 1.0, "abstraction-bloat", "legibility", "statistical"),
    ("TS-AB-02-unused-exports", 1.0, "abstraction-bloat", "structural", "deterministic-ast"),
    ("TS-AB-03-type-indirection-depth", 1.0, "abstraction-bloat", "legibility", "statistical"),
    ("TS-AB-04-interface-implementation-ratio", 1.0, "abstraction-bloat", "legibility", "statistical"),
    ("TS-AB-05-generic-proliferation", 1.0, "abstraction-bloat", "legibility", "statistical"),
    ("TS-LD-01-cyclomatic-complexity", 1.0, "legibility-decay", "legibility", "statistical"),
    ("TS-LD-02-function-size-distribution", 1.0, "legibility-decay", "legibility", "statistical"),
    ("TS-LD-03-nesting-depth", 1.0, "legibility-decay", "legibility", "deterministic-ast"),
    ("TS-LD-04-naming-conventions", 2.0, "legibility-decay", "legibility", "reference-backed"),
    ("TS-LD-05-domain-term-consistency", 2.0, "legibility-decay", "legibility", "reference-backed"),
    ("TS-LD-06-annotation-coverage", 1.0, "legibility-decay", "legibility", "statistical"),
    ("TS-LD-07-unsafe-type-erosion", 1.0, "legibility-decay", "legibility", "deterministic-ast"),
    ("TS-LD-08-exhaustiveness-erosion", 1.0, "legibility-decay", "legibility", "deterministic-ast"),
    ("TS-LD-09-error-channel-opacity", 1.0, "legibility-decay", "legibility", "mixed"),
    ("TS-SL-01-duplication", 1.0, "generated-slop", "legibility", "statistical"),
    ("TS-SL-02-inconsistent-clones", 1.5, "generated-slop", "compound", "mixed"),
    ("TS-SL-03-suppressions", 1.0, "generated-slop", "structural", "deterministic-ast"),
    ("TS-SL-04-unfinished-implementations", 1.0, "generated-slop", "structural", "mixed"),
    ("TS-SL-05-phantom-tests", 2.0, "generated-slop", "structural", "heuristic-pattern"),
    ("TS-SL-06-confidence-claim-mismatch", 2.0, "generated-slop", "structural", "heuristic-pattern"),
    ("TS-RP-01-hotspots", 1.5, "review-pain", "compound", "mixed"),
    ("TS-RP-02-pr-size", 1.0, "review-pain", "structural", "historical-fact"),
    ("TS-CC-01-async-failure-control", 2.0, "concurrency-safety", "structural", "heuristic-pattern"),
    ("TS-CC-02-unbounded-concurrency", 2.0, "concurrency-safety", "structural", "heuristic-pattern"),
    ("TS-BP-01-public-api-signature-diff", 1.0, "behavior-preservation", "structural", "deterministic-ast"),
    ("TS-SEC-01-dangerous-capability-surface", 1.0, "security-risk", "structural", "deterministic-ast"),
    ("TS-SEC-02-untrusted-boundary-sinks", 2.0, "security-risk", "structural", "heuristic-pattern"),
    ("RS-AD-01-visibility-surface", 1.0, "architectural-drift", "structural", "statistical"),
    ("RS-AD-02-crate-boundaries", 2.0, "architectural-drift", "structural", "reference-backed"),
    ("RS-AD-03-circular-crate-dependencies", 1.0, "architectural-drift", "structural", "manifest-fact"),
    ("RS-DE-01-trait-coupling", 1.0, "dependency-entropy", "structural", "mixed"),
    ("RS-DE-02-dependency-tree", 1.0, "dependency-entropy", "structural", "manifest-fact"),
    ("RS-DE-03-feature-flags", 1.0, "dependency-entropy", "structural", "manifest-fact"),
    ("RS-DE-04-fan-in-fan-out", 1.0, "dependency-entropy", "structural", "deterministic-ast"),
    ("RS-AB-01-unused-public-items", 1.0, "abstraction-bloat", "structural", "deterministic-ast"),
    ("RS-AB-02-trait-object-depth", 1.0, "abstraction-bloat", "legibility", "deterministic-ast"),
    ("RS-AB-03-generic-proliferation", 1.0, "abstraction-bloat", "legibility", "statistical"),
    ("RS-AB-04-derive-density", 1.0, "abstraction-bloat", "legibility", "statistical"),
    ("RS-LD-01-unsafe-code", 1.0, "legibility-decay", "legibility", "deterministic-ast"),
    ("RS-LD-02-lifetime-complexity", 1.0, "legibility-decay", "legibility", "statistical"),
    ("RS-LD-03-match-catch-all", 1.0, "legibility-decay", "legibility", "deterministic-ast"),
    ("RS-LD-04-error-granularity", 1.0, "legibility-decay", "legibility", "statistical"),
    ("RS-LD-05-cyclomatic-complexity", 1.0, "legibility-decay", "legibility", "statistical"),
    ("RS-LD-06-domain-term-consistency", 2.0, "legibility-decay", "legibility", "reference-backed"),
    ("RS-SL-01-duplication", 1.0, "generated-slop", "legibility", "statistical"),
    ("RS-SL-02-suppressions", 1.0, "generated-slop", "structural", "deterministic-ast"),
    ("RS-SL-03-unwrap-expect", 1.0, "generated-slop", "legibility", "statistical"),
    ("RS-SL-04-clone-abuse", 2.0, "generated-slop", "legibility", "heuristic-pattern"),
    ("RS-RP-01-hotspots", 1.5, "review-pain", "compound", "mixed"),
    ("RS-RP-02-compile-time", 1.0, "review-pain", "structural", "manifest-fact"),
    ("RS-RP-03-pr-size", 1.0, "review-pain", "structural", "historical-fact"),
]
#: Classes of evidence that may gate; those that may poison; signals that only feed others.
GATING = ("deterministic-ast", "manifest-fact", "reference-backed")
POISON = ("deterministic-ast", "manifest-fact")
PROVIDERS = ("SHARED-CHURN-01", "SHARED-CHURN-02", "SHARED-COCHANGE-01", "SHARED-COV-01")


def short(name: str) -> str:
    """The id without its title: TS-SL-01 of TS-SL-01-duplication."""
    parts = name.split("-")
    number = next(i for i, p in enumerate(parts) if p.isdigit())
    return "-".join(parts[: number + 1])


def _row(name: str, formula: Callable[..., Any]) -> Callable:
    """Scores the one row of the facts of that name by a formula over its columns."""

    def compute(facts: Facts, config: dict, given: Facts) -> DataFrame:
        return facts[name].select(F.round(formula(col), 9).alias("score"))

    return compute


def _hotspots(facts: Facts, config: dict, given: Facts) -> DataFrame:
    churn = given["SHARED-CHURN-02"].select("file", F.col("touch_count").alias("churn"), "weighted")
    files = facts["files"].select("file", "complexity").join(churn, "file")
    if "touches" in facts:
        own = facts["touches"].groupBy("file").agg(F.when(F.count_distinct("author") == 1, 0.45).otherwise(0.0).alias("ownership"))
        files = files.join(own, "file", "left")
    else:
        files = files.withColumn("ownership", F.lit(None).cast("double"))
    if "SHARED-COCHANGE-01" in given:
        ends = given["SHARED-COCHANGE-01"].select(F.explode(F.array("left_file", "right_file")).alias("file"), F.greatest("confidence", "support").alias("c"))
        files = files.join(ends.groupBy("file").agg(F.max("c").alias("cochange")), "file", "left")
    else:
        files = files.withColumn("cochange", F.lit(None).cast("double"))
    return composite.risk_score(composite.risks(files.withColumn("coverage", F.lit(None).cast("double")), rank=False))


def _suppressions(facts: Facts, config: dict, given: Facts) -> DataFrame:
    files = facts["files"].count() if "files" in facts else 0
    return text.suppression_score(facts["bypasses"], files)


def _clone_groups(facts: Facts) -> DataFrame:
    return clones.impact(clones.united(facts["clones"]))


#: What computes a signal: the facts it needs, the signals it needs, those it takes if they are there, and the function.
COMPUTE: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], Callable]] = {
    "SHARED-CHURN-01": (("touches", "commits"), (), (), lambda f, c, i: history.recent_churn(f["touches"], f["commits"])),
    "SHARED-CHURN-02": (("touches", "commits"), (), (), lambda f, c, i: history.weighted_churn(f["touches"], f["commits"])),
    "SHARED-COCHANGE-01": (("touches",), (), (), lambda f, c, i: history.cochange_pairs(f["touches"])),
    "SHARED-02": (("touches", "files"), (), (), lambda f, c, i: history.silo_score(history.bus_factor(f["touches"], f["files"]), history.in_window(f["touches"], 180).agg(F.count_distinct("author").alias("n")))),
    "SHARED-03": (("survival",), (), (), lambda f, c, i: history.churn_penalty(f["survival"])),
    "SHARED-05": (("suppressions",), (), (), _row("suppressions", lambda c: signals.suppression_score(c("expired"), c("missing"), c("justified"), c("languages")))),
    "SHARED-06": (("new_edges",), (), (), _row("new_edges", lambda c: signals.dependency_delta_score(c("boundary"), c("package"), c("crate")))),
    "SHARED-07": (("scripts",), (), (), lambda f, c, i: signals.feedback_classes(f["scripts"]).agg(F.count(F.when(F.col("present"), 1)).alias("present"), F.lit(1.0).alias("score"))),
    "SHARED-09": (("contracts",), (), (), lambda f, c, i: findings.freshness_score(f["contracts"])),
    "SHARED-10": (("construction",), (), (), _row("construction", lambda c: signals.construction_score(c("findings")))),
    "SHARED-11": (("theory",), (), (), lambda f, c, i: composite.theory_index(f["theory"])),
    "SHARED-COV-01": (("coverage",), (), (), lambda f, c, i: f["coverage"]),
    "TS-AD-02": (("edges",), (), (), lambda f, c, i: graph.cycle_score(graph.cycles(f["edges"]))),
    "TS-AD-03": (("reexports",), (), (), lambda f, c, i: graph.chain_score(f["reexports"])),
    "TS-AD-04": (("parsers",), (), (), _row("parsers", lambda c: signals.chain_share_score(c("unparsed"), c("functions")))),
    "TS-AD-05": (("trust",), (), (), lambda f, c, i: composite.trust_breach(f["trust"])),
    "TS-DE-01": (("modules",), (), (), lambda f, c, i: findings.coupling_score(f["modules"])),
    "TS-DE-02": (("edges",), (), (), lambda f, c, i: graph.hub_score(f["edges"], c["fan_in"], c["fan_out"])),
    "TS-DE-03": (("edges",), (), (), lambda f, c, i: graph.propagation_cost(f["edges"])),
    "TS-DE-04": (("declared", "used"), (), (), lambda f, c, i: packages.health_score(packages.health(f["declared"], f["used"]), c["packages"])),
    "TS-DE-05": (("lock",), (), (), lambda f, c, i: packages.duplicate_score(f["lock"])),
    "TS-AB-01": (("exports",), (), (), lambda f, c, i: findings.surface_score(f["exports"])),
    "TS-AB-02": (("export_reach",), (), (), lambda f, c, i: findings.unused_score(f["export_reach"])),
    "TS-AB-04": (("interfaces",), (), (), lambda f, c, i: findings.implementation_score(f["interfaces"])),
    "TS-LD-01": (("files",), (), (), lambda f, c, i: findings.complexity_score(f["files"], c["max_complexity"])),
    "TS-LD-02": (("files", "file_sizes"), (), (), lambda f, c, i: findings.size_score(f["files"], f["file_sizes"], c["function_loc"], c["file_loc"])),
    "TS-LD-04": (("identifiers", "conventions"), (), (), lambda f, c, i: text.naming_score(f["identifiers"], f["conventions"])),
    "TS-LD-05": (("terms", "glossary"), (), (), lambda f, c, i: text.term_score(text.term_classes(f["terms"], f["glossary"]))),
    "TS-LD-06": (("annotations",), (), (), lambda f, c, i: findings.annotation_score(f["annotations"])),
    "TS-SL-01": (("clones",), (), (), lambda f, c, i: clones.score(_clone_groups(f), c["budget"])),
    "TS-SL-02": (("clones", "head"), ("TS-SL-01",), (), lambda f, c, i: clones.divergence_score(clones.inconsistent(clones.structural(f["clones"]), f["head"]), clones.limited(clones.structural(f["clones"])))),
    "TS-SL-03": (("bypasses",), (), (), _suppressions),
    "TS-SL-04": (("stubs",), (), (), _row("stubs", lambda c: signals.unfinished_score(c("stubs"), c("budget"), c("capped")))),
    "TS-RP-01": (("files",), ("SHARED-CHURN-02",), ("SHARED-COCHANGE-01",), _hotspots),
    "TS-RP-02": (("diff",), (), (), _row("diff", lambda c: findings.pr_size_score(c("lines"), c("boundary"), c("package")))),
    "RS-AD-01": (("visibility",), (), (), lambda f, c, i: signals.visibility_score(f["visibility"])),
    "RS-AD-03": (("crate_edges",), (), (), lambda f, c, i: graph.cycle_score(graph.cycles(f["crate_edges"])).select(F.round(signals.crate_cycle_score("cycles", "largest"), 9).alias("score"))),
    "RS-DE-01": (("trait_impls",), (), (), _row("trait_impls", lambda c: signals.trait_coupling_score(c("concerns"), c("impls")))),
    "RS-DE-02": (("crate_edges", "crates"), (), (), lambda f, c, i: packages.cargo_tree_score(packages.cargo_tree(f["crates"], f["crate_edges"]))),
    "RS-DE-03": (("features",), (), (), _row("features", lambda c: signals.feature_score(c("most"), c("spread"), c("sites")))),
    "RS-DE-04": (("rust_edges",), (), (), lambda f, c, i: graph.hub_score(f["rust_edges"]).select(F.round(signals.rust_hub_score("hubs", "modules", F.lit(0)), 9).alias("score"))),
    "RS-AB-02": (("trait_chains",), (), (), _row("trait_chains", lambda c: signals.chain_share_score(c("long"), c("chains")))),
    "RS-LD-01": (("unsafe_seeds", "calls", "functions"), (), (), lambda f, c, i: signals.unsafe_spread_score(graph.spread(f["unsafe_seeds"], f["calls"]), f["unsafe_seeds"], f["functions"])),
    "RS-LD-04": (("errors",), (), (), _row("errors", lambda c: signals.error_granularity_score(c("granular"), c("collapsed")))),
    "RS-LD-06": (("rust_terms", "glossary"), (), (), lambda f, c, i: text.term_score(text.term_classes(f["rust_terms"], f["glossary"]))),
    "RS-SL-01": (("rust_clones",), (), (), _row("rust_clones", lambda c: signals.rust_clone_score(c("members"), c("groups")))),
    "RS-RP-01": (("rust_files",), (), (), lambda f, c, i: signals.rust_hotspot_score(f["rust_files"])),
    "RS-RP-03": (("rust_diff",), (), (), _row("rust_diff", lambda c: signals.rust_pr_score(c("lines"), c("edges")))),
}
#: Settings of signals and their defaults.
DEFAULTS: dict[str, dict[str, Any]] = {
    "TS-DE-02": {"fan_in": 10, "fan_out": 5},
    "TS-DE-04": {"packages": 2},
    "TS-LD-01": {"max_complexity": 20},
    "TS-LD-02": {"function_loc": 50, "file_loc": 300},
    "TS-SL-01": {"budget": 1000.0, "min_tokens": 12},
    "TS-SL-02": {"max_groups_analyzed": 8},
    "TS-SL-04": {"hard_gate_production": False},
    "TS-RP-01": {"min_churn": 2, "min_complexity": 5, "threshold_softness": 0.5},
}


def _finding(name: str) -> Callable:
    def compute(facts: Facts, config: dict, given: Facts) -> Batch:
        return Batch("findings", lambda: findings.score_all(facts["counts"], facts["sizes"]), name)

    return compute


def registry() -> Registry:
    """All built-in signals, each with its short id as an alias."""
    out = []
    for name, tier, category, kind, evidence in CATALOG:
        own = short(name)
        if own in findings.SIGNALS:
            needs, inputs, optional, compute = ("counts", "sizes"), (), (), _finding(own)
        elif own in COMPUTE:
            needs, inputs, optional, compute = COMPUTE[own]
        else:
            continue
        aliases = (own,) if own != name else ()
        out.append(Signal(name, category, tier, kind, compute, inputs, optional, aliases, own in PROVIDERS, DEFAULTS.get(own, {}), evidence, needs))
    return Registry(out)


def observe(facts: Facts, found: DataFrame | None = None, vector: Vector | None = None, known: Registry | None = None, config: observer.Config = observer.Config()) -> dict[str, DataFrame]:
    """One observation: results, categories, weighted_mean, readiness, minimum, gate.

    found: diagnostics (signal_id, severity) for the gate. The gate is read before readiness is planned: one small query."""
    known = known or registry()
    scored = results(known, run(known, facts, vector), vector)
    gated = [i for i, s in known.by_id.items() if s.gates]
    gate = observer.hard_gate(found, [n for i in gated for n in (i, *known.by_id[i].aliases)]) if found is not None else None
    failed = gate is not None and not gate.where("status = 'fail'").isEmpty()
    categories = observer.categories(scored, config)
    out = {"results": scored, "categories": categories, "weighted_mean": observer.weighted_mean(categories), "readiness": observer.readiness(scored, failed, config)}
    out["minimum"] = observer.minimum_dimension(scored, [*dict.fromkeys(s.category for s in known.by_id.values())])
    if gate is not None:
        out["gate"] = gate
    return out
