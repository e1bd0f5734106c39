"""History of observations: compaction, trends, levels, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import iso_week_key, micros, week_end

DAY = 86_400


def append(store: DataFrame, new: DataFrame) -> DataFrame:
    """New observations whose sha the store doesn't have, nor any of its weekly aggregates (commit_shas)."""
    fresh = new.dropDuplicates(["sha"]).join(store.select("sha"), "sha", "left_anti")
    inside = store.where(F.size("commit_shas") > 0).select(F.explode("commit_shas").alias("sha"))
    return fresh.join(inside, "sha", "left_anti")


def between(store: DataFrame, first, last) -> DataFrame:
    return store.where((F.col("ts") >= F.lit(first).cast("timestamp")) & (F.col("ts") <= F.lit(last).cast("timestamp")))


def at_sha(store: DataFrame, sha: str) -> DataFrame:
    return store.where((F.col("sha") == sha) | F.array_contains("commit_shas", sha))


def weekly(rows: DataFrame, days: int = 90) -> DataFrame:
    """(category, week, source, ts, score, samples): rows older than `days` before the latest as weekly means, weighed
    by samples; the others as they are. rows: (ts, category, score, samples)."""
    head = rows.agg(F.max("ts").alias("head"))
    aged = rows.join(F.broadcast(head)).withColumn("old", F.col("ts") < F.col("head") - F.expr(f"INTERVAL {days} DAYS"))
    means = aged.where("old").groupBy("category", iso_week_key("ts").alias("week")).agg(F.max(week_end("ts")).alias("ts"), F.round(F.sum(F.col("score") * F.col("samples")) / F.sum("samples"), 9).alias("score"), F.sum("samples").alias("samples"))
    recent = aged.where("NOT old").select("category", iso_week_key("ts").alias("week"), F.lit("raw").alias("source"), "ts", F.round("score", 9).alias("score"), "samples")
    return means.select("category", "week", F.lit("weekly-average").alias("source"), "ts", "score", "samples").unionByName(recent)


#: Statuses and bands, the worst last.
STATUSES = ["unknown", "green", "yellow", "red", "failed", "blocked"]
BANDS = ["green", "yellow", "red"]


def _worst(column: str, order: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, order)), F.max(F.array_position(F.array(*map(F.lit, order)), F.col(column))).cast("int"))


def compact(entries: DataFrame, days: int = 90) -> DataFrame:
    """The store with entries older than `days` before the latest merged by week; a week's aggregate takes part in later runs.

    entries: (sha, ts, source, weighted_mean, hard_gate_status, readiness, pressure, pnorm, local_max, status, band, samples,
    commit_shas). An aggregate has the means weighed by samples, any failed gate, the worst status and band, the largest local
    pressure and all commits; it stands at the week's end. Entries that arrive late are merged into their week's aggregate."""
    head = entries.agg(F.max("ts").alias("head"))
    aged = entries.join(F.broadcast(head)).withColumn("old", F.col("ts") < F.col("head") - F.expr(f"INTERVAL {days} DAYS")).drop("head")
    w = F.col("samples")
    mean = lambda c: F.round(F.sum(F.col(c) * w) / F.sum(w), 9).alias(c)
    shas = F.coalesce("commit_shas", F.array("sha"))
    gate = F.when(F.bool_or(F.col("hard_gate_status") == "fail"), "fail").otherwise("pass").alias("hard_gate_status")
    merged = aged.where("old").groupBy(iso_week_key("ts").alias("week")).agg(
        F.max(week_end("ts")).alias("ts"), mean("weighted_mean"), gate, mean("readiness"), mean("pressure"), mean("pnorm"), F.max("local_max").alias("local_max"),
        _worst("status", STATUSES).alias("status"), _worst("band", BANDS).alias("band"), F.sum(w).alias("samples"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(shas)))).alias("commit_shas"))
    weeks = merged.select(F.concat(F.lit("aggregate:"), "week").alias("sha"), "ts", F.lit("weekly-average").alias("source"), *[c for c in merged.columns if c not in ("week", "ts")])
    return weeks.unionByName(aged.where("NOT old").select(*weeks.columns))


def slopes(rows: DataFrame, days: int = 14) -> DataFrame:
    """(category, n, slope): least-squares slope a day over the last `days`; null with one point or one instant."""
    head = rows.agg(F.max("ts").alias("head"))
    recent = rows.join(F.broadcast(head)).where(F.col("ts") >= F.col("head") - F.expr(f"INTERVAL {days} DAYS"))
    x = (micros("ts") - micros("head")) / (DAY * 1e6)
    return recent.groupBy("category").agg(F.count("*").alias("n"), F.round(F.regr_slope("score", x), 9).alias("slope"))


def level(score: Column, slope: Column, green: float = 0.85, red: float = 0.6, fall: float = -0.1 / 14) -> Column:
    return F.when(score < red, "red").when((score < green) | (F.coalesce(slope, F.lit(0.0)) <= fall), "yellow").otherwise("green")


def backpressure(rows: DataFrame, days: int = 14) -> DataFrame:
    """(category, latest, slope, level) of categories with two observations and more in the window."""
    last = rows.groupBy("category").agg(F.max_by("score", F.struct("ts", "sha")).alias("latest"))
    out = slopes(rows, days).where("n >= 2").join(last, "category")
    return out.select("category", F.round("latest", 9).alias("latest"), "slope", level(F.col("latest"), F.col("slope")).alias("level"))


def overall_level(categories: DataFrame, latest: DataFrame, suspicion: str = "low", least: float = 0.4) -> DataFrame:
    """(level): the worst of the categories' levels (level) and of the readiness of the latest observation.

    latest: one row (hard_gate_status, minimum, readiness_status). A failed gate, a minimum below `least` or high
    suspicion is red; elevated suspicion turns green to yellow; no category with a level is unavailable."""
    order = F.array(*map(F.lit, BANDS))
    worst = categories.agg(F.max(F.array_position(order, F.col("level"))).alias("worst"))
    status = F.col("readiness_status")
    ready = F.when(status.isin("red", "blocked", "failed"), 3).when(status == "yellow", 2).otherwise(1)
    found = F.greatest(F.col("worst"), ready)
    red = (F.col("hard_gate_status") == "fail") | (F.col("minimum") < least) | F.lit(suspicion == "high")
    lifted = F.when(F.lit(suspicion == "elevated") & (found == 1), 2).otherwise(found)
    level_ = F.when(F.col("worst").isNull(), "unavailable").when(F.coalesce(red, F.lit(False)), "red").otherwise(F.element_at(order, lifted.cast("int")))
    return latest.join(F.broadcast(worst)).select(level_.alias("level"))


def trend(rows: DataFrame, days: int = 14) -> DataFrame:
    """(category, ts, score, slope, level) at each row, of the rows up to it in its window; later rows of the same
    instant are not in it. rows: (category, ts, sha, score).

    A window over all rows up to this one sums what regression needs; of the same sums at the last row before the
    window, taken off, the window's own remain. Both ends are places in the order, so any number may share an instant."""
    order = W.partitionBy("category").orderBy("ts", "sha")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.first("ts").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    based = rows.select("category", "ts", "sha", "score", ((micros("ts") - micros(first)) / (DAY * 1e6)).alias("x"), F.row_number().over(order).alias("nth"))
    # Rows that left the window: those before it by time, which rank below every row of the window.
    left = F.count("*").over(W.partitionBy("category").orderBy(micros("ts")).rangeBetween(W.unboundedPreceding, -days * DAY * 1_000_000 - 1))
    sums = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("score"), "sxy": F.col("x") * F.col("score"), "sxx": F.col("x") * F.col("x")}
    summed = based.withColumn("gone", left).withColumns({k: F.sum(v).over(upto) for k, v in sums.items()})
    before = summed.select(F.col("category").alias("c"), F.col("nth").alias("at"), *(F.col(k).alias(f"b_{k}") for k in sums))
    met = summed.join(before, (F.col("category") == F.col("c")) & (F.col("gone") == F.col("at")), "left")
    own = {k: F.col(k) - F.coalesce(f"b_{k}", F.lit(0.0)) for k in sums}
    spread = own["n"] * own["sxx"] - own["sx"] * own["sx"]
    slope = F.when(spread > 1e-9, (own["n"] * own["sxy"] - own["sx"] * own["sy"]) / spread)
    out = met.withColumn("slope", F.round(slope, 9))
    return out.withColumn("level", level(F.col("score"), F.col("slope"))).select("category", "sha", "ts", F.round("score", 9).alias("score"), "slope", "level")


def slot_of(ts: Column, period_days: int = 7) -> Column:
    """Number of the rotation period that a time lies in."""
    return F.floor(micros(ts) / (period_days * DAY * 1_000_000)).cast("long")


def hidden_signals(ids: DataFrame, ratio: float = 0.2) -> DataFrame:
    """(id): of ids (id, slot) the first max(1, n ratio) by sha1(slot:id); none of two and fewer."""
    digest = F.sha1(F.concat_ws(":", F.col("slot").cast("string"), F.col("id")))
    ranked = ids.distinct().withColumn("r", F.row_number().over(W.orderBy(digest))).withColumn("n", F.count("*").over(W.partitionBy()))
    return ranked.where((F.col("n") > 2) & (F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio)))).select("id")


def holdout(ids: DataFrame, slot: int, ratio: float = 0.2) -> DataFrame:
    """(id): the first max(1, n ratio) ids by sha1(slot:id); none of two and fewer."""
    digest = F.sha1(F.concat_ws(":", F.lit(str(slot)), F.col("id")))
    ranked = ids.select("id").distinct().withColumn("r", F.row_number().over(W.orderBy(digest))).withColumn("n", F.count("*").over(W.partitionBy()))
    return ranked.where((F.col("n") > 2) & (F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio)))).select("id")


def goodhart(entries: DataFrame, ratio: float = 0.2, period_days: int = 7, window_days: int = 14, gap: float = 0.08, excess: float = 0.12, least: int = 4) -> DataFrame:
    """(visible_score, hidden_score, gap, visible_trend, hidden_trend, velocity, points, suspicion) of entries (sha, ts, id, score).

    The latest entry's signals are split into hidden ones, which rotate every period, and visible ones. gap: visible less
    hidden mean of the latest entry; trends: means of the last less those of the first entry of the window. Suspicion is
    elevated where the gap exceeds its limit, or, with enough points, the visible trend exceeds the hidden one's by more
    than `excess`; high where both do."""
    order = F.struct("ts", "sha")
    head = entries.agg(F.max(order).alias("last"))
    latest = entries.join(F.broadcast(head), (entries["ts"] == F.col("last.ts")) & (entries["sha"] == F.col("last.sha")))
    ids = latest.select("id", slot_of(F.col("ts"), period_days).alias("slot"))
    hidden = hidden_signals(ids, ratio).withColumn("hidden", F.lit(True))
    sides = ids.select("id").distinct().join(hidden, "id", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    window = entries.join(F.broadcast(head)).where(F.col("ts") >= F.col("last.ts") - F.expr(f"INTERVAL {window_days} DAYS"))
    ends = window.agg(F.min(order).alias("first"), F.max(order).alias("final"), F.count_distinct("sha").alias("points"))
    marked = window.select("sha", "ts", "id", "score").join(sides, "id").join(F.broadcast(ends))
    at = lambda end, side: F.avg(F.when((F.col("sha") == F.col(f"{end}.sha")) & (F.col("ts") == F.col(f"{end}.ts")) & (F.col("hidden") == side), F.col("score")))
    means = marked.groupBy("points").agg(at("final", False).alias("v"), at("final", True).alias("h"), at("first", False).alias("v0"), at("first", True).alias("h0"))
    many = F.col("points") >= 2
    moved = lambda a, b: F.when(many, F.coalesce(F.col(a) - F.col(b), F.lit(0.0))).otherwise(0.0)
    told = means.withColumn("g", F.col("v") - F.col("h")).withColumn("vt", moved("v", "v0")).withColumn("ht", moved("h", "h0")).withColumn("velocity", F.col("vt") - F.col("ht"))
    wide, fast = F.coalesce(F.col("g") > gap, F.lit(False)), (F.col("points") >= least) & (F.col("velocity") > excess)
    suspicion = F.when(wide & fast, "high").when(wide | fast, "elevated").otherwise("low")
    nine = lambda c, n: F.round(c, 9).alias(n)
    return told.select(nine("v", "visible_score"), nine("h", "hidden_score"), nine("g", "gap"), nine("vt", "visible_trend"), nine("ht", "hidden_trend"), nine("velocity", "velocity"), "points", suspicion.alias("suspicion"))


def culprits(points: DataFrame, n: int = 5) -> DataFrame:
    """(series, idx, drop, rank): the steepest falls of each series (series, idx, score), earliest first among equals."""
    drop = F.round(F.lag("score").over(W.partitionBy("series").orderBy("idx")) - F.col("score"), 9)
    falls = points.withColumn("drop", drop).where("drop > 0")
    return falls.withColumn("rank", F.row_number().over(W.partitionBy("series").orderBy(F.desc("drop"), "idx"))).where(F.col("rank") <= n).select("series", "idx", "drop", "rank")


def drift(points: DataFrame) -> DataFrame:
    """(series, anchor, deficit): shortfall below the running maximum in the last segment, charged to the latest fall."""
    order = W.partitionBy("series").orderBy("idx")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = points.withColumn("rm", F.max("score").over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("reset", F.col("rm").isNull() | (F.col("score") >= F.col("rm")))
    marked = marked.withColumn("seg", F.sum(F.col("reset").cast("int")).over(upto)).withColumn("anchor", F.last(F.when(F.lag("score").over(order) > F.col("score"), F.col("idx")), True).over(upto))
    last = marked.withColumn("top", F.max("seg").over(W.partitionBy("series"))).where("seg = top AND NOT reset")
    return last.groupBy("series", "anchor").agg(F.round(F.sum(F.col("rm") - F.col("score")), 9).alias("deficit"))


def first_crossing(points: DataFrame, below: float) -> DataFrame:
    """(series, idx, score, before): the first point under a threshold and the score before it."""
    seen = points.withColumn("before", F.lag("score").over(W.partitionBy("series").orderBy("idx"))).where(F.col("score") < below)
    return seen.groupBy("series").agg(F.min(F.struct("idx", "score", "before")).alias("m")).select("series", "m.idx", F.round("m.score", 9).alias("score"), F.round("m.before", 9).alias("before"))


def trajectory(points: DataFrame) -> DataFrame:
    """(series, low, high, final, drift, levels)."""
    return points.groupBy("series").agg(F.round(F.min("score"), 9).alias("low"), F.round(F.max("score"), 9).alias("high"), F.round(F.max_by("score", "idx"), 9).alias("final"), F.round(F.max("score") - F.max_by("score", "idx"), 9).alias("drift"), F.count_distinct(F.round("score", 6)).alias("levels"))


def even_sample(points: DataFrame, n: int = 17) -> DataFrame:
    """Points at n evenly spaced places of 0..last, ends included."""
    last = points.agg(F.max("idx").alias("last"))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(i * F.col("last") / (n - 1)).cast("long")))
    return points.join(F.broadcast(last.select(F.explode(places).alias("idx"))), "idx", "left_semi")


def adaptive_indexes(score_of, size: int, seeds: int = 17, delta: float = 0.08, gap: int = 64, cap: int = 1025) -> list[int]:
    """Places to score of 0..size-1: even seeds, then middles of stretches that are long or whose ends differ.

    score_of takes a list of places and returns their scores: one query for each round, not for each place."""
    if size <= 0:
        return []
    known = dict.fromkeys(sorted({round(i * (size - 1) / max(1, seeds - 1)) for i in range(min(seeds, size))}))
    known |= dict(zip(known, score_of(list(known)), strict=True))
    while len(known) < cap:
        places = sorted(known)
        wanted = [(a + b) // 2 for a, b in zip(places, places[1:], strict=False) if b - a > 1 and (b - a > gap or abs(known[a] - known[b]) >= delta)]
        if not wanted:
            break
        wanted = wanted[: cap - len(known)]
        known |= dict(zip(wanted, score_of(wanted), strict=True))
    return sorted(known)
