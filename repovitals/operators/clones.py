"""Clone groups of functions and their weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def groups(candidates: DataFrame, by: str, kind: str, distinct: str | None = None, least_tokens: int = 12) -> DataFrame:
    """(kind, hash, members, tokens, representative): rows (id, tokens, ...) that share a hash, two and more.

    distinct: only groups with two and more values of that column (structural groups of different text)."""
    sums = [F.count("*").alias("members"), F.max("tokens").alias("tokens"), F.min("id").alias("representative")]
    if distinct:
        sums.append(F.count_distinct(distinct).alias("__d"))
    out = candidates.where(F.col("tokens") >= least_tokens).groupBy(F.col(by).alias("hash")).agg(*sums).where("members > 1")
    if distinct:
        out = out.where("__d > 1").drop("__d")
    return out.select(F.lit(kind).alias("kind"), "hash", "members", "tokens", "representative")


def structural(candidates: DataFrame) -> DataFrame:
    """Members as inconsistent() takes them, of candidates (id, structural, exact, tokens, changed_at, ...)."""
    return candidates.withColumn("hash", F.col("structural")).withColumn("text_hash", F.col("exact"))


def united(candidates: DataFrame, least_tokens: int = 12) -> DataFrame:
    """Groups of both kinds: exact ones, and structural ones whose texts differ. candidates: (id, exact, structural, tokens)."""
    return groups(candidates, "exact", "exact", None, least_tokens).unionByName(groups(candidates, "structural", "structural", "exact", least_tokens))


def impact(found: DataFrame, whole_tree: bool = True) -> DataFrame:
    """Adds `impact`: how much a group of clones weighs."""
    extra, tokens = (F.col("members") - 1).cast("double"), F.col("tokens").cast("double")
    bound = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    pressure = F.when(F.lit(whole_tree) & (tokens < 50), 0.5 * F.log2(F.col("members").cast("double"))).otherwise(extra)
    exact = F.when(F.lit(whole_tree) & (tokens < 20), 0.0).otherwise(pressure * 1.2 * bound(tokens / 30, 0.3, 3.0))
    structural = F.when(tokens < 30, 0.0).otherwise(extra * F.least(F.lit(0.35), (tokens - 30) / 120)) if whole_tree else extra * bound(tokens / 60, 0.1, 1.5)
    return found.withColumn("impact", F.round(F.when(F.col("kind") == "exact", exact).otherwise(structural), 9))


def score(found: DataFrame, budget: float) -> DataFrame:
    """(penalty, score): 1 - penalty / max(80, .12 budget)."""
    return found.agg(F.round(F.coalesce(F.sum("impact"), F.lit(0.0)), 6).alias("penalty")).withColumn("score", F.round(1 - F.least(F.lit(1.0), F.col("penalty") / max(80.0, 0.12 * budget)), 9))


def ordered(found: DataFrame) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("impact"), F.desc("members"), F.desc("tokens"), "kind", "representative", "hash")))


def inconsistent(members: DataFrame, head, recent_days: int = 30, least_tokens: int = 30, least: float = 0.5, most_groups: int = 8, most_members: int = 16) -> DataFrame:
    """(hash, members, variants, recent, divergence, confidence): structural groups whose texts differ and some changed lately.

    members: (hash, id, text_hash, tokens, changed_at[, changed_in, file, name]). Divergence is the variants beyond the first
    by the members beyond the first. Like the metric it serves, this looks at the most_groups largest groups (tokens, then
    members) and at most_members of each, by id; limited() tells whether that left anything out, which caps the score.
    Medium confidence: the members' last changes are one, or all have one name and file name in folders of their own."""
    big = members.where(F.col("tokens") >= least_tokens)
    sizes = big.groupBy("hash").agg(F.count("*").alias("all"), F.max("tokens").alias("t")).where(F.col("all") > 1)
    first = sizes.orderBy(F.desc("t"), F.desc("all"), "hash").limit(most_groups)
    nth = big.join(F.broadcast(first), "hash").withColumn("m", F.row_number().over(W.partitionBy("hash").orderBy("id"))).where(F.col("m") <= most_members)
    lately = F.count(F.when(F.col("changed_at") > head - F.expr(f"INTERVAL {recent_days} DAYS"), 1))
    one_change = (F.count_distinct("changed_in") <= 1) if "changed_in" in members.columns else F.lit(False)
    family = F.lit(False)
    if {"file", "name"} <= set(members.columns):
        base, folder = F.element_at(F.split("file", "/"), -1), F.regexp_replace("file", "/?[^/]*$", "")
        family = (F.count("*") >= 3) & (F.count_distinct(base) == 1) & (F.count_distinct("name") == 1) & (F.count_distinct(folder) == F.count("*"))
    sums = nth.groupBy("hash").agg(F.count("*").alias("members"), F.count_distinct("text_hash").alias("variants"), lately.alias("recent"), F.when(one_change | family, "medium").otherwise("high").alias("confidence"))
    divergence = F.round((F.col("variants") - 1) / (F.col("members") - 1), 9)
    return sums.withColumn("divergence", divergence).where((F.col("members") > 1) & (F.col("recent") > 0) & (F.col("divergence") >= least)).select("hash", "members", "variants", "recent", "divergence", "confidence")


def limited(members: DataFrame, least_tokens: int = 30, most_groups: int = 8, most_members: int = 16) -> DataFrame:
    """(limit_hit, cap): whether inconsistent() looked at less than all groups and members, and what its score is capped at then."""
    sizes = members.where(F.col("tokens") >= least_tokens).groupBy("hash").agg(F.count("*").alias("all")).where(F.col("all") > 1)
    hit = (F.count("*") > most_groups) | (F.coalesce(F.max("all"), F.lit(0)) > most_members)
    return sizes.agg(hit.alias("limit_hit"), F.when(hit, 0.95).otherwise(1.0).alias("cap"))


def divergence_score(found: DataFrame, limit: DataFrame, actionable: float = 0.75) -> DataFrame:
    """(score) of inconsistent() and limited(): what groups above `actionable` cost, by their confidence, under the limit's cap."""
    bad = found.where(F.col("divergence") > actionable)

    def penalty(kind: str, most: float, scale: float, breadth: float, weight: float) -> Column:
        own = F.col("confidence") == kind
        worst = F.coalesce((F.max(F.when(own, F.col("divergence"))) - actionable) / (1 - actionable), F.lit(0.0))
        return worst * most + F.least(F.lit(breadth), F.log2(weight * F.count(F.when(own, 1)) + 1) * scale)

    both = penalty("high", 0.25, 0.12, 0.30, 1.0) + penalty("medium", 0.04, 0.03, 0.06, 0.5)
    cost = bad.agg(F.least(F.lit(0.75), both).alias("cost"))
    return cost.join(F.broadcast(limit)).select(F.round(F.greatest(F.lit(0.0), F.least("cap", 1 - F.col("cost"))), 9).alias("score"))


def nested(groups_: DataFrame) -> DataFrame:
    """(hash) of groups all of whose members (hash, file, start, end) lie inside members of one other group of as many members or more."""
    outer = groups_.select(F.col("hash").alias("outer"), "file", F.col("start").alias("s"), F.col("end").alias("e"))
    inside = groups_.join(outer, "file").where("hash <> outer AND s <= start AND end <= e AND (e - s) > (end - start)")
    covered = inside.groupBy("hash", "outer").agg(F.count_distinct("file", "start", "end").alias("n"))
    every = groups_.groupBy("hash").agg(F.count_distinct("file", "start", "end").alias("all"))
    return covered.join(every, "hash").where("n = all").select("hash").distinct()
