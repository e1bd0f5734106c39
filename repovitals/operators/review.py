"""Comparing observations and planning reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["signal_id", "hash"]


def baseline(findings: DataFrame) -> DataFrame:
    """One row for each violation: the smallest (file, line) of a key."""
    return findings.groupBy(*KEY).agg(F.min(F.struct("file", "line")).alias("m")).select(*KEY, "m.file", "m.line")


def compare(base: DataFrame, current: DataFrame) -> DataFrame:
    """(signal_id, hash, state): tolerated (in both), new, or paid. One full join."""
    a = base.select(*KEY).distinct().withColumn("b", F.lit(True))
    b = current.select(*KEY).distinct().withColumn("c", F.lit(True))
    state = F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "paid").otherwise("tolerated")
    return a.join(b, KEY, "full").select(*KEY, state.alias("state"))


def ratchet(base: DataFrame, current: DataFrame) -> DataFrame:
    """(new, paid, tolerated, verdict): any new violation fails."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    return compare(base, current).agg(n("new").alias("new"), n("paid").alias("paid"), n("tolerated").alias("tolerated"), F.when(n("new") > 0, "fail").otherwise("pass").alias("verdict"))


def assess_ci(base: DataFrame | None, current: DataFrame, base_config: str | None = None, current_config: str | None = None) -> DataFrame:
    """(mode, new, paid, tolerated, status): no baseline fails, and so does one observed under another configuration.

    base: None where there is no baseline; base_config: None where the baseline doesn't tell."""
    spark = current.sparkSession
    for mode, stops in (("missing-baseline", base is None), ("observer-config-mismatch", base_config is not None and base_config != current_config)):
        if stops:
            return spark.sql(f"SELECT '{mode}' AS mode, 0L AS new, 0L AS paid, 0L AS tolerated, 'fail' AS status")
    return ratchet(base, current).select(F.lit("ratcheted").alias("mode"), "new", "paid", "tolerated", F.col("verdict").alias("status"))


def introduced(base: DataFrame, head: DataFrame) -> DataFrame:
    return head.join(base.select(*KEY).distinct(), KEY, "left_anti")


def resolved(base: DataFrame, head: DataFrame) -> DataFrame:
    return introduced(head, base)


def diff(base: DataFrame, head: DataFrame, scores: DataFrame) -> DataFrame:
    """Findings of either side that the other lacks, with `change`: introduced, resolved or projection-churn.

    base, head: findings with signal_id, hash, in_scope; scores: (signal_id, before, after). Churn is what a signal now
    shows instead of what it showed before: introduced outside the changed scope, where the signal has findings that
    are gone and its score did not get worse."""
    new, gone = introduced(base, head), resolved(base, head)
    steady = scores.where(F.col("after") + 1e-9 >= F.col("before")).select("signal_id")
    moved = gone.select("signal_id").distinct().join(steady, "signal_id", "left_semi").withColumn("__moved", F.lit(True))
    churn = F.coalesce(F.col("__moved") & ~F.col("in_scope"), F.lit(False))
    changed = new.join(moved, "signal_id", "left").withColumn("change", F.when(churn, "projection-churn").otherwise("introduced")).drop("__moved")
    return changed.unionByName(gone.withColumn("change", F.lit("resolved")))


#: Categories whose findings are routed for trust.
TRUST = ["security-risk", "concurrency-safety", "behavior-preservation"]


def decide_gate(new: DataFrame, changed_only: bool = False) -> DataFrame:
    """(introduced, routed, trust, status) of introduced findings (category, tier, kind, ceiling, severity, in_scope).

    block: a block of a tier-1 structural signal that may gate, in scope or not; else route where findings are routed
    (those in scope, with changed_only), first for trust; else pass."""
    blocking = (F.col("severity") == "block") & (F.col("tier") == 1) & (F.col("kind") == "structural") & F.array_contains("ceiling", "hard-gate")
    routed = F.col("in_scope") if changed_only else F.lit(True)
    n = lambda c: F.count(F.when(c, 1))
    trust = routed & F.col("category").isin(TRUST)
    status = F.when(n(blocking) > 0, "block").when(n(routed) > 0, "route").otherwise("pass")
    return new.agg(F.count("*").alias("introduced"), n(routed).alias("routed"), n(trust).alias("trust"), status.alias("status"))


def diff_gate(new: DataFrame, may_gate: list[str]) -> DataFrame:
    """(introduced, verdict): block on a new block of a gating signal, else route on any finding, else pass."""
    blocks = F.count(F.when((F.col("severity") == "block") & F.col("signal_id").isin(may_gate), 1))
    return new.agg(F.count("*").alias("introduced"), F.when(blocks > 0, "block").when(F.count("*") > 0, "route").otherwise("pass").alias("verdict"))


def deltas(base: DataFrame, head: DataFrame, key: str = "signal_id") -> DataFrame:
    """(key, before, after, delta, relative) of scores (key, score) of two observations."""
    met = base.select(key, F.col("score").alias("before")).join(head.select(key, F.col("score").alias("after")), key, "full")
    return met.select(key, F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), F.round(F.col("after") - F.col("before"), 9).alias("delta"), F.round((F.col("after") - F.col("before")) / F.nullif("before", F.lit(0.0)), 9).alias("relative"))


def in_scope(findings: DataFrame, hunks: DataFrame, width: int = 64) -> DataFrame:
    """Findings (file, line, ...) inside a hunk (file, new_start, new_lines), or of a changed file when line is null.

    A range join by blocks of lines: hunks are listed under each block they touch, findings under theirs."""
    last = F.col("new_start") + F.col("new_lines") - 1
    blocks = hunks.where("new_lines > 0").select("file", "new_start", last.alias("last"), F.explode(F.sequence((F.col("new_start") / width).cast("int"), (last / width).cast("int"))).alias("block"))
    placed = findings.withColumn("block", (F.col("line") / width).cast("int"))
    b = blocks.alias("b")
    inside = placed.alias("f").join(b, (F.col("f.file") == F.col("b.file")) & (F.col("f.block") == F.col("b.block")) & (F.col("f.line") >= F.col("b.new_start")) & (F.col("f.line") <= F.col("b.last")), "left_semi")
    whole = placed.where("line IS NULL").join(hunks.select("file").distinct(), "file", "left_semi").select(*placed.columns)
    return inside.unionByName(whole).drop("block")


def triggers(signals: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, reviewer): patterns (id, signal_id, below, change_ratio_above, reviewer) that a signal's score
    (signal_id, score, relative) sets off."""
    met = signals.join(patterns, "signal_id")
    return met.where((F.col("score") < F.col("below")) | (F.abs("relative") >= F.col("change_ratio_above"))).select(F.col("id").alias("pattern_id"), "signal_id", "reviewer").distinct()


def imports_match(imports: DataFrame, specifiers: DataFrame) -> DataFrame:
    """imports: (specifier); specifiers: (pattern): equal, or under a pattern that ends in /*. Two equi-joins."""
    plain = specifiers.where(~F.col("pattern").endswith("/*"))
    open_ = specifiers.where(F.col("pattern").endswith("/*")).select("pattern", F.expr("substring(pattern, 1, length(pattern) - 2)").alias("root"))
    parts = F.split("specifier", "/")
    roots = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    exact = imports.join(plain, F.col("specifier") == F.col("pattern")).select("specifier", "pattern")
    under = imports.select("specifier", F.explode(roots).alias("root")).join(open_, "root").select("specifier", "pattern")
    return exact.unionByName(under).distinct()


#: What stands at the end of a context that was cut.
CUT = "context truncated to fit the plan's budget"
#: Priorities, the most urgent last.
PRIORITIES = ["informational", "required", "block"]


def merge_requests(requests: DataFrame, budget: int = 4096) -> DataFrame:
    """requests: (reviewer, nth, priority, reason, context array<string>). One row a reviewer: (reviewer, priority, reason, context, cut).

    In order of nth: the most urgent priority, different neighbouring reasons joined, and the contexts' different items
    up to the first that doesn't fit the budget of bytes; where one doesn't, a note stands last."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    asked = F.array_sort(F.collect_list(F.struct("nth", rank.alias("rank"), "priority", "reason", "context")))
    by = requests.groupBy("reviewer").agg(asked.alias("r"))
    join = lambda a, r: F.when(a.isNull(), r["reason"]).when(F.element_at(F.split(a, "; "), -1) == r["reason"], a).otherwise(F.concat(a, F.lit("; "), r["reason"]))
    reason = F.aggregate("r", F.lit(None).cast("string"), join)
    items = F.array_distinct(F.flatten(F.transform("r", lambda r: F.coalesce(r["context"], F.array().cast("array<string>")))))
    start = F.struct(F.lit(2).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def take(a, item):
        size = a["n"] + F.octet_length(item) + 3  # quotes and a comma, as in a JSON list
        over = a["full"] | (size > budget)
        return F.when(over, F.struct(a["n"].alias("n"), F.lit(True).alias("full"), a["kept"].alias("kept"))).otherwise(F.struct(size.alias("n"), F.lit(False).alias("full"), F.array_append(a["kept"], item).alias("kept")))

    top = F.array_max(F.transform("r", lambda r: F.struct(r["rank"].alias("rank"), r["priority"].alias("priority"))))
    fit = by.select("reviewer", top["priority"].alias("priority"), reason.alias("reason"), F.aggregate(items, start, take).alias("fit"))
    context = F.when(F.col("fit.full"), F.array_append("fit.kept", F.lit(CUT))).otherwise(F.col("fit.kept"))
    return fit.select("reviewer", "priority", "reason", context.alias("context"), F.col("fit.full").alias("cut"))


def override_patterns(built_in: DataFrame, custom: DataFrame) -> DataFrame:
    """Patterns by id; a custom one replaces the built-in of its id."""
    return custom.unionByName(built_in.join(custom.select("id"), "id", "left_anti"))


def _clamped(weight):
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(2.0), weight)), 2)


def _weights(evidence: DataFrame, prior: DataFrame | None, factor: float) -> DataFrame:
    """evidence: (signal, signed, magnitude). weight: the prior plus factor times signed / magnitude, in 0..2; support: that share."""
    own = evidence.withColumn("prior", F.lit(1.0)) if prior is None else evidence.join(prior, "signal", "left").withColumn("prior", F.coalesce("prior", F.lit(1.0)))
    share = F.coalesce(F.col("signed") / F.nullif("magnitude", F.lit(0.0)), F.lit(0.0))
    return own.select("signal", F.round("signed", 4).alias("signed"), F.round("magnitude", 4).alias("magnitude"), F.round(share, 3).alias("support"), _clamped(F.col("prior") + factor * share).alias("weight"))


def _counted(samples: DataFrame) -> DataFrame:
    """(signal, kept, score, confidence, n): how many samples have each score; one without a signal scores 0 there."""
    kept = samples.withColumn("kept", F.col("outcome") == "accepted")
    own = kept.groupBy("signal", "kept", "score", "confidence").agg(F.count("*").alias("n"))
    every = kept.select("id", "kept", "confidence").distinct().groupBy("kept", "confidence").agg(F.count("*").alias("all"))
    each = samples.select("signal").distinct().withColumn("__k", F.lit(1)).join(every.withColumn("__k", F.lit(1)), "__k").drop("__k")  # signals by levels of confidence
    have = own.groupBy("signal", "kept", "confidence").agg(F.sum("n").alias("have"))
    lacking = each.join(have, ["signal", "kept", "confidence"], "left").withColumn("n", F.col("all") - F.coalesce("have", F.lit(0))).where("n > 0")
    return own.unionByName(lacking.select("signal", "kept", F.lit(0.0).alias("score"), "confidence", "n")).groupBy("signal", "kept", "score", "confidence").agg(F.sum("n").alias("n"))


def pairwise_preference(samples: DataFrame, prior: DataFrame | None = None, ignore: float = 0.05) -> DataFrame:
    """(signal, signed, magnitude, support, weight) over samples (id, outcome, confidence, signal, score) and a prior (signal, prior).

    Every accepted sample is held against every other one, weighed by the product of their confidences; what isn't
    accepted is rejected. Scores are counted first, and distinct (score, confidence) values meet."""
    counts = _counted(samples)
    of = lambda kept, p: counts.where(F.col("kept") == kept).select("signal", *(F.col(c).alias(p + c) for c in ("score", "confidence", "n")))
    met = of(True, "a").join(of(False, "r"), "signal").withColumn("d", F.col("ascore") - F.col("rscore")).where(F.abs("d") >= ignore)
    c = F.col("aconfidence") * F.col("rconfidence") * F.col("an") * F.col("rn")
    sums = met.groupBy("signal").agg(F.sum(F.col("d") * c).alias("signed"), F.sum(F.abs("d") * c).alias("magnitude"))
    zero = lambda x: F.coalesce(x, F.lit(0.0)).alias(x)
    return _weights(samples.select("signal").distinct().join(sums, "signal", "left").select("signal", zero("signed"), zero("magnitude")), prior, 0.6)


def frequency_preference(samples: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(signal, signed, magnitude, support, weight): the difference of the mean score times confidence by outcome."""
    n = lambda kept: F.sum(F.when(F.col("kept") == kept, F.col("n")))
    total = lambda kept: F.sum(F.when(F.col("kept") == kept, F.col("score") * F.col("confidence") * F.col("n")))
    mean = lambda kept: F.coalesce(total(kept) / n(kept), F.lit(0.0))
    d = _counted(samples).groupBy("signal").agg((mean(True) - mean(False)).alias("signed"))
    return _weights(d.withColumn("magnitude", F.abs("signed")), prior, 0.45)


def prior_adjusted_preference(samples: DataFrame, prior: DataFrame | None = None, full: int = 24) -> DataFrame:
    """(signal, support, weight): pairwise weights, which replace the prior's as samples grow to `full`."""
    some = samples.agg(F.least(F.lit(1.0), F.count_distinct("id") / full).alias("share"))
    own = pairwise_preference(samples, prior)
    own = own.withColumn("prior", F.lit(1.0)) if prior is None else own.join(prior, "signal", "left").withColumn("prior", F.coalesce("prior", F.lit(1.0)))
    return own.join(F.broadcast(some)).select("signal", "support", _clamped(F.col("prior") + (F.col("weight") - F.col("prior")) * F.col("share")).alias("weight"))


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
