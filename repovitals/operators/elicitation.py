"""Learning what a user prefers: quizzes of pairs, proposals from edits, suggestions of what to set up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _clamped(weight):
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(2.0), weight)), 2)


def _prior(signals: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Adds `before`: the weight a signal has in the prior (signal, prior), else 1."""
    if prior is None:
        return signals.withColumn("before", F.lit(1.0))
    return signals.join(prior, "signal", "left").withColumn("before", F.coalesce("prior", F.lit(1.0))).drop("prior")


def item_deltas(items: DataFrame) -> DataFrame:
    """(item, signal, delta) of quiz items (item, side, signal, score): what side a scores above side b; a score left out is 0."""
    return items.groupBy("item", "signal").agg((F.sum(F.when(F.col("side") == "a", F.col("score")).otherwise(-F.col("score")))).alias("delta"))


def inference(deltas: DataFrame, responses: DataFrame) -> DataFrame:
    """(signal, seen, evidence, magnitude) of item_deltas() and responses (item, answer a, b, equal or skip)."""
    answered = responses.where("answer <> 'skip'").join(deltas, "item")
    side = F.when(F.col("answer") == "a", F.col("delta")).when(F.col("answer") == "b", -F.col("delta")).otherwise(0.0)
    return answered.groupBy("signal").agg(F.count("*").alias("seen"), F.round(F.sum(side), 9).alias("evidence"), F.round(F.sum(F.abs("delta")), 9).alias("magnitude"))


def information_gain(deltas: DataFrame, responses: DataFrame) -> DataFrame:
    """(item, gain) of items without a response: how much is unsure about the signals that an item tells apart."""
    known = inference(deltas, responses).select("signal", "seen", F.when(F.col("magnitude") > 0, F.least(F.lit(1.0), F.abs(F.col("evidence") / F.nullif("magnitude", F.lit(0.0))))).alias("certainty"))
    seen, certainty = F.coalesce("seen", F.lit(0)), F.coalesce("certainty", F.lit(0.0))
    gain = F.abs("delta") * (1 / (1 + seen) + (1 - certainty)) + F.when(seen == 0, 0.25).otherwise(0.0)
    left = deltas.join(responses.select("item").distinct(), "item", "left_anti")
    return left.join(known, "signal", "left").groupBy("item").agg(F.round(F.sum(gain), 4).alias("gain"))


def next_item(deltas: DataFrame, responses: DataFrame) -> DataFrame:
    """(item, gain): the item to ask next, the smallest of equal ones; none when all are answered."""
    return information_gain(deltas, responses).orderBy(F.desc("gain"), "item").limit(1)


def quiz_weights(found: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(signal, before, weight) of signals whose weight inference() moves by .05 and more."""
    share = F.coalesce(F.col("evidence") / F.nullif("magnitude", F.lit(0.0)), F.lit(0.0))
    moved = _prior(found, prior).withColumn("weight", _clamped(F.col("before") + share * F.least(F.lit(1.0), F.col("seen") / 3) * 0.5))
    return moved.where(F.abs(F.col("weight") - F.col("before")) >= 0.05).select("signal", "before", "weight")


def passive_proposal(before: DataFrame, after: DataFrame, prior: DataFrame | None = None, least: float = 0.2, bump: float = 0.25, top: int = 3) -> DataFrame:
    """(signal, previous, current, before, weight): the signals (signal, score) that edits improved most, and the weight to propose."""
    met = before.select("signal", F.col("score").alias("previous")).join(after.select("signal", F.col("score").alias("current")), "signal").withColumn("d", F.col("current") - F.col("previous"))
    raised = _prior(met.where(F.col("d") >= least), prior).withColumn("weight", _clamped(F.col("before") + F.least(F.lit(bump), F.col("d") * 0.5)))
    wanted = raised.where(F.abs(F.col("weight") - F.col("before")) >= 0.05).select("signal", F.round("previous", 2).alias("previous"), F.round("current", 2).alias("current"), F.round("before", 2).alias("before"), "weight")
    return wanted.orderBy(F.desc(F.col("current") - F.col("previous")), "signal").limit(top)


#: What can be missing in a repository, and what to do then.
SETUP = {
    "vector": "apply a preset, so that the repository owns its weights",
    "conventions": "extract and confirm naming conventions",
    "glossary": "extract and confirm the glossary",
    "baseline": "set a baseline, so that old violations are tolerated and new ones fail",
    "project-modules": "declare the modules of the detected frameworks",
}


def suggestions(present: DataFrame) -> DataFrame:
    """(part, state, suggestion) of every part of SETUP that is missing or a draft in present (part, state canonical or draft)."""
    parts = present.sparkSession.createDataFrame(sorted(SETUP.items()), "part string, suggestion string")
    told = parts.join(present, "part", "left").withColumn("state", F.coalesce("state", F.lit("missing")))
    return told.where("state <> 'canonical'").select("part", "state", "suggestion")
