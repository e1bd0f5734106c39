"""Queries over observations, reviews, graphs and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import micros, spaced_hash, token_count
from ..operators import elicitation, graph, observer, review, signals, text, timeseries
from ..operators import findings as fnd
from ..sources import adapters as a
from .base import query

ORDER = ["view", "click", "purchase", "signup", "error"]
EV = """ev AS (SELECT *, greatest(0, least(1, 1 - score)) * confidence AS pr, 1 - greatest(0, least(1, 1 - score)) * confidence AS ef FROM signal_results WHERE applicability = 'applicable' AND NOT provider),
gm AS (SELECT category, CASE WHEN count(DISTINCT grp) > 1 THEN avg(m) ELSE sum(s) / sum(w) END AS mean FROM (SELECT category, grp, sum(weight * ef) / sum(weight) AS m, sum(weight * ef) AS s, sum(weight) AS w FROM ev GROUP BY ALL) GROUP BY category),
pn AS (SELECT category, count(*) AS signals, pow(sum(weight * pow(pr, 4)) / sum(weight), 0.25) AS pnorm, coalesce(max(pr) FILTER (authority), 0) AS m FROM ev GROUP BY category),
cs AS (SELECT category, coalesce(signals, 0) AS signals, coalesce(mean, 1) AS mean, coalesce(pnorm, 0) AS pnorm, coalesce(greatest(0, least(1, (m - 0.4) / 0.35)) * m, 0) AS poison FROM (SELECT DISTINCT category FROM signal_results) LEFT JOIN pn USING (category) LEFT JOIN gm USING (category)),
cat AS (SELECT category, signals, round(mean, 9)::DOUBLE AS mean, round(pnorm, 9)::DOUBLE AS pnorm, round(poison, 9)::DOUBLE AS poison, round(round(least(mean, 1 - greatest(0, least(1, greatest(pnorm, poison)))), 12), 9)::DOUBLE AS score FROM cs)"""


@query(f"WITH {EV} SELECT * FROM cat", "signal_results")
def category_score(spark, d):
    return observer.categories(a.signal_results(spark, d))


@query(f"WITH {EV} SELECT category, pnorm, poison FROM cat", "signal_results")
def category_pressure_pnorm(spark, d):
    return observer.categories(a.signal_results(spark, d)).select("category", "pnorm", "poison")


@query(f"WITH {EV} SELECT category, round(mean, 9)::DOUBLE AS mean FROM gm", "signal_results")
def language_group_mean(spark, d):
    return observer.group_mean(a.signal_results(spark, d)).select("category", F.round("mean", 9).alias("mean"))


@query(f"WITH {EV} SELECT round(coalesce(sum(score * signals) / sum(signals), 1), 9)::DOUBLE AS weighted_mean FROM cat", "signal_results")
def weighted_mean(spark, d):
    return observer.weighted_mean(observer.categories(a.signal_results(spark, d)))


READY = """rd AS (SELECT pow(sum(weight * pow(pr, 4)) / sum(weight), 0.25) AS pn, coalesce(max(pr) FILTER (authority), 0) AS m FROM ev), r2 AS (SELECT pn, greatest(0, least(1, (m - 0.4) / 0.35)) * m AS po FROM rd), r3 AS (SELECT *, round(greatest(0, least(1, greatest(pn, po))), 12) AS p FROM r2)"""


@query(f"""WITH {EV}, {READY} SELECT round(p, 9)::DOUBLE AS pressure, round(1 - p, 9)::DOUBLE AS score, round(pn, 9)::DOUBLE AS pnorm, round(po, 9)::DOUBLE AS poison,
CASE WHEN (SELECT count(*) FROM signal_results WHERE applicability = 'failed') > 0 THEN 'failed' WHEN p < 0.15 THEN 'green' WHEN p >= 0.4 THEN 'red' ELSE 'yellow' END AS status, CASE WHEN po > 0 AND po >= pn THEN 'local_poison' ELSE 'pnorm' END AS dominant,
round(CASE WHEN abs(0.15 - p) <= abs(0.4 - p) THEN 0.15 - p ELSE 0.4 - p END, 9)::DOUBLE AS margin FROM r3""", "signal_results")
def readiness(spark, d):
    return observer.readiness(a.signal_results(spark, d))


@query(f"WITH {EV} SELECT signal_id, round(pr, 9)::DOUBLE AS pressure, round(greatest(0, least(1, 1 - score)), 9)::DOUBLE AS raw FROM ev ORDER BY pressure DESC, raw DESC, signal_id LIMIT 10", "signal_results")
def top_pressures(spark, d):
    return observer.top_pressures(a.signal_results(spark, d))


@query(f"WITH {EV} SELECT category, signal_id, score FROM ev ORDER BY score, coalesce(list_position({ORDER}, category), 0), signal_id LIMIT 1", "signal_results")
def minimum_dimension(spark, d):
    return observer.minimum_dimension(a.signal_results(spark, d), ORDER)


@query("SELECT signal_id, count(*) FILTER (severity = 'block') AS violations, CASE WHEN count(*) FILTER (severity = 'block') > 0 THEN 'fail' ELSE 'pass' END AS status FROM findings WHERE signal_id IN ('S-A', 'S-N') GROUP BY 1", "findings")
def hard_gate(spark, d):
    return observer.hard_gate(a.findings(spark, d), ["S-A", "S-N"])


@query("SELECT severity, count(*) AS n, count(*) FILTER (message LIKE '%downgraded%') AS lowered FROM (SELECT CASE WHEN severity = 'block' AND signal_id <> 'S-A' THEN 'warn' ELSE severity END AS severity, CASE WHEN severity = 'block' AND signal_id <> 'S-A' THEN 'x (downgraded from block)' ELSE 'x' END AS message FROM findings) GROUP BY 1", "findings")
def severity_ceiling(spark, d):
    f = a.findings(spark, d).withColumn("message", F.lit("x"))
    return observer.severity_ceiling(f, F.col("signal_id") == "S-A").groupBy("severity").agg(F.count("*").alias("n"), F.count(F.when(F.col("message").contains("downgraded"), 1)).alias("lowered"))


# Time series.


def _daily(spark, d):
    return a.observations(spark, d)


@query("""WITH h AS (SELECT max(ts) AS h FROM observations), r AS (SELECT *, ts < h - INTERVAL 10 DAY AS old, year(date_trunc('week', ts))::VARCHAR || '-W' || lpad(week(date_trunc('week', ts))::VARCHAR, 2, '0') AS week, 1 + signal % 3 AS samples FROM observations, h)
SELECT category, week, 'weekly-average' AS source, max(date_trunc('week', ts) + INTERVAL 7 DAY - INTERVAL 1 MILLISECOND) AS ts, round(sum(score * samples) / sum(samples), 9)::DOUBLE AS score, sum(samples)::BIGINT AS samples FROM r WHERE old GROUP BY category, week
UNION ALL SELECT category, week, 'raw', ts, round(score, 9)::DOUBLE, samples::BIGINT FROM r WHERE NOT old""", "observations")
def weekly_compaction(spark, d):
    return timeseries.weekly(_daily(spark, d).withColumn("samples", (1 + F.col("signal") % 3).cast("long")), 10)


SL = "sl AS (SELECT category, count(*) AS n, round(regr_slope(score, (epoch_us(ts) - epoch_us(h)) / 86400e6), 9)::DOUBLE AS slope FROM observations, (SELECT max(ts) AS h FROM observations) WHERE ts >= h - INTERVAL 14 DAY GROUP BY category)"


@query(f"WITH {SL} SELECT * FROM sl", "observations")
def trajectory_slope(spark, d):
    return timeseries.slopes(_daily(spark, d))


LEVEL = "CASE WHEN {s} < 0.6 THEN 'red' WHEN {s} < 0.85 OR coalesce(slope, 0) <= -0.1 / 14 THEN 'yellow' ELSE 'green' END"


@query(f"WITH {SL}, l AS (SELECT category, arg_max(score, (ts, sha)) AS latest FROM observations GROUP BY 1) SELECT category, round(latest, 9)::DOUBLE AS latest, slope, {LEVEL.format(s='latest')} AS level FROM sl JOIN l USING (category) WHERE n >= 2", "observations")
def backpressure_levels(spark, d):
    return timeseries.backpressure(_daily(spark, d))


DAILY = "dy AS (SELECT category, date_trunc('hour', ts) AS ts, min(sha) AS sha, avg(score) AS score FROM observations GROUP BY 1, 2)"


@query(f"""WITH {DAILY}, x AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY category)) / 86400e6 AS x FROM dy), s0 AS (SELECT category, sha, ts, score, round(regr_slope(score, x) OVER (PARTITION BY category ORDER BY ts RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND CURRENT ROW), 9)::DOUBLE AS sn FROM x), s AS (SELECT * EXCLUDE sn, CASE WHEN isnan(sn) THEN NULL ELSE sn END AS slope FROM s0)
SELECT category, sha, ts, round(score, 9)::DOUBLE AS score, slope, {LEVEL.format(s='score')} AS level FROM s""", "observations")
def backpressure_trend(spark, d):
    hourly = _daily(spark, d).groupBy("category", F.date_trunc("hour", "ts").alias("ts")).agg(F.min("sha").alias("sha"), F.avg("score").alias("score"))
    return timeseries.trend(hourly)


HOURLY = """en AS (SELECT strftime(date_trunc('hour', ts), '%Y%m%d%H') AS sha, date_trunc('hour', ts) AS ts, signal::VARCHAR AS id, avg(score) AS score FROM observations GROUP BY 1, 2, 3), hd AS (SELECT max(ts) AS h FROM en), slot AS (SELECT floor(epoch_us(h) / (7 * 86400e6))::BIGINT::VARCHAR AS slot, h FROM hd),
hid AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY sha1(slot || ':' || id)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT id, slot FROM en, slot WHERE ts = h)) WHERE n > 2 AND r <= greatest(1, floor(n * 0.2)))"""


def _hourly(spark, d):
    hour = F.date_trunc("hour", "ts")
    return _daily(spark, d).groupBy(F.date_format(hour, "yyyyMMddHH").alias("sha"), hour.alias("ts"), F.col("signal").cast("string").alias("id")).agg(F.avg("score").alias("score"))


@query(f"WITH {HOURLY} SELECT id FROM hid", "observations")
def holdout_selection(spark, d):
    entries = _hourly(spark, d)
    head = entries.agg(F.max("ts").alias("h"))
    return timeseries.hidden_signals(entries.join(F.broadcast(head), F.col("ts") == F.col("h")).select("id", timeseries.slot_of(F.col("ts")).alias("slot")))


@query(f"""WITH {HOURLY}, ids AS (SELECT DISTINCT id, id IN (SELECT id FROM hid) AS hidden FROM en, hd WHERE ts = h), w AS (SELECT en.* FROM en, hd WHERE ts >= h - INTERVAL 14 DAY), b AS (SELECT min(ts) AS f, max(ts) AS l, count(DISTINCT sha) AS points FROM w),
m AS (SELECT points, avg(score) FILTER (ts = l AND NOT hidden) AS v, avg(score) FILTER (ts = l AND hidden) AS hs, avg(score) FILTER (ts = f AND NOT hidden) AS v0, avg(score) FILTER (ts = f AND hidden) AS h0 FROM w JOIN ids USING (id), b GROUP BY points),
t AS (SELECT *, v - hs AS g, CASE WHEN points >= 2 THEN coalesce(v - v0, 0) ELSE 0 END AS vt, CASE WHEN points >= 2 THEN coalesce(hs - h0, 0) ELSE 0 END AS ht FROM m)
SELECT round(v, 9)::DOUBLE AS visible_score, round(hs, 9)::DOUBLE AS hidden_score, round(g, 9)::DOUBLE AS gap, round(vt, 9)::DOUBLE AS visible_trend, round(ht, 9)::DOUBLE AS hidden_trend, round(vt - ht, 9)::DOUBLE AS velocity, points,
CASE WHEN coalesce(g > 0.08, false) AND points >= 4 AND vt - ht > 0.12 THEN 'high' WHEN coalesce(g > 0.08, false) OR (points >= 4 AND vt - ht > 0.12) THEN 'elevated' ELSE 'low' END AS suspicion FROM t""", "observations")
def goodhart_assessment(spark, d):
    return timeseries.goodhart(_hourly(spark, d))


@query(f"WITH {SL}, l AS (SELECT category, arg_max(score, (ts, sha)) AS latest FROM observations GROUP BY 1), lv AS (SELECT {LEVEL.format(s='latest')} AS level, latest FROM sl JOIN l USING (category) WHERE n >= 2) SELECT CASE WHEN count(*) = 0 THEN 'unavailable' WHEN min(latest) < 0.4 THEN 'red' ELSE ['green', 'yellow', 'red'][greatest(2, max(list_position(['green', 'yellow', 'red'], level)))] END AS level FROM lv", "observations")
def backpressure_overall(spark, d):
    levels = timeseries.backpressure(_daily(spark, d))
    latest = levels.agg(F.lit("pass").alias("hard_gate_status"), F.min("latest").alias("minimum"), F.lit("yellow").alias("readiness_status"))
    return timeseries.overall_level(levels, latest)


ENTRIES = """en AS (SELECT sha::VARCHAR AS sha, ts, score, CASE WHEN score < 0.6 THEN 'red' WHEN score < 0.85 THEN 'yellow' ELSE 'green' END AS status FROM observations), h AS (SELECT max(ts) AS h FROM en), o AS (SELECT *, ts < h - INTERVAL 10 DAY AS old, year(date_trunc('week', ts))::VARCHAR || '-W' || lpad(week(date_trunc('week', ts))::VARCHAR, 2, '0') AS week FROM en, h)"""


@query(f"""WITH {ENTRIES} SELECT 'aggregate:' || week AS sha, max(date_trunc('week', ts) + INTERVAL 7 DAY - INTERVAL 1 MILLISECOND) AS ts, 'weekly-average' AS source, round(avg(score), 9)::DOUBLE AS weighted_mean, CASE WHEN bool_or(score < 0.05) THEN 'fail' ELSE 'pass' END AS hard_gate_status, round(avg(1 - score), 9)::DOUBLE AS pressure, max(1 - score) AS local_max,
['green', 'yellow', 'red'][max(list_position(['green', 'yellow', 'red'], status))] AS status, count(*)::BIGINT AS samples, count(DISTINCT sha)::INT AS shas FROM o WHERE old GROUP BY week
UNION ALL SELECT sha, ts, 'raw', score, CASE WHEN score < 0.05 THEN 'fail' ELSE 'pass' END, 1 - score, 1 - score, status, 1, 0 FROM o WHERE NOT old""", "observations")
def compacted_entries(spark, d):
    status = F.when(F.col("score") < 0.6, "red").when(F.col("score") < 0.85, "yellow").otherwise("green")
    entries = _daily(spark, d).select(
        F.col("sha").cast("string").alias("sha"), "ts", F.lit("raw").alias("source"), F.col("score").alias("weighted_mean"), F.when(F.col("score") < 0.05, "fail").otherwise("pass").alias("hard_gate_status"), F.col("score").alias("readiness"),
        (1 - F.col("score")).alias("pressure"), (1 - F.col("score")).alias("pnorm"), (1 - F.col("score")).alias("local_max"), status.alias("status"), status.alias("band"), F.lit(1).cast("long").alias("samples"), F.lit(None).cast("array<string>").alias("commit_shas"))
    out = timeseries.compact(entries, 10)
    return out.select("sha", "ts", "source", "weighted_mean", "hard_gate_status", "pressure", "local_max", "status", "samples", F.coalesce(F.size("commit_shas"), F.lit(0)).alias("shas")).withColumn("shas", F.greatest(F.lit(0), "shas"))


@query("SELECT sha, ts, category FROM observations WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'", "observations")
def observations_between(spark, d):
    return timeseries.between(_daily(spark, d), "2024-01-10 00:00:00", "2024-01-12 00:00:00").select("sha", "ts", "category")


CURVE = "curve AS (SELECT category AS series, (epoch_us(date_trunc('hour', ts)) // 3600000000)::BIGINT AS idx, round(avg(score), 6) AS score FROM observations GROUP BY 1, 2)"


def _curve(spark, d):
    return _daily(spark, d).groupBy(F.col("category").alias("series"), F.floor(micros("ts") / 3_600_000_000).alias("idx")).agg(F.round(F.avg("score"), 6).alias("score"))


@query(f"WITH {CURVE} SELECT series, idx, \"drop\", r::INT AS \"rank\" FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY \"drop\" DESC, idx) AS r FROM (SELECT series, idx, round(lag(score) OVER (PARTITION BY series ORDER BY idx) - score, 9)::DOUBLE AS \"drop\" FROM curve) WHERE \"drop\" > 0) WHERE r <= 5", "observations")
def bisect_culprits(spark, d):
    return timeseries.culprits(_curve(spark, d))


@query(f"""WITH {CURVE}, c1 AS (SELECT *, max(score) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rm, lag(score) OVER (PARTITION BY series ORDER BY idx) AS lg FROM curve), c2 AS (SELECT *, rm IS NULL OR score >= rm AS rs FROM c1), c3 AS (SELECT *, sum(rs::INT) OVER (PARTITION BY series ORDER BY idx) AS seg, max(CASE WHEN lg > score THEN idx END) OVER (PARTITION BY series ORDER BY idx) AS anchor FROM c2)
SELECT series, anchor, round(sum(rm - score), 9)::DOUBLE AS deficit FROM c3 c WHERE NOT rs AND seg = (SELECT max(seg) FROM c3 x WHERE x.series = c.series) GROUP BY 1, 2""", "observations")
def bisect_drift(spark, d):
    return timeseries.drift(_curve(spark, d))


@query(f"WITH {CURVE} SELECT series, idx, round(score, 9)::DOUBLE AS score, round(before, 9)::DOUBLE AS before FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY idx) AS r FROM (SELECT *, lag(score) OVER (PARTITION BY series ORDER BY idx) AS before FROM curve) WHERE score < 0.85) WHERE r = 1", "observations")
def first_crossing(spark, d):
    return timeseries.first_crossing(_curve(spark, d), 0.85)


@query(f"WITH {CURVE} SELECT series, round(min(score), 9)::DOUBLE AS low, round(max(score), 9)::DOUBLE AS high, round(arg_max(score, idx), 9)::DOUBLE AS final, round(max(score) - arg_max(score, idx), 9)::DOUBLE AS drift, count(DISTINCT round(score, 6)) AS levels FROM curve GROUP BY 1", "observations")
def trajectory_summary(spark, d):
    return timeseries.trajectory(_curve(spark, d))


@query("WITH p AS (SELECT o_orderkey AS idx, o_totalprice AS score FROM orders), k AS (SELECT DISTINCT round(i * (SELECT max(idx) FROM p) / 16)::BIGINT AS idx FROM range(17) t(i)) SELECT * FROM p WHERE idx IN (SELECT idx FROM k)")
def bisect_even_sample(spark, d):
    return timeseries.even_sample(a.table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("score")))


# Reviews.

BASE = "bs AS (SELECT DISTINCT signal_id, hash FROM findings WHERE baseline), hd AS (SELECT DISTINCT signal_id, hash FROM findings WHERE NOT baseline)"


def _sides(spark, d):
    f = a.findings(spark, d)
    return f.where("baseline"), f.where("NOT baseline")


@query(f"WITH {BASE} SELECT signal_id, hash, CASE WHEN b IS NULL THEN 'new' WHEN c IS NULL THEN 'paid' ELSE 'tolerated' END AS state FROM (SELECT *, true AS b FROM bs) x FULL JOIN (SELECT *, true AS c FROM hd) y USING (signal_id, hash)", "findings")
def baseline_compare(spark, d):
    return review.compare(*_sides(spark, d))


@query(f"WITH {BASE}, k AS (SELECT (SELECT count(*) FROM hd ANTI JOIN bs USING (signal_id, hash)) AS n, (SELECT count(*) FROM bs ANTI JOIN hd USING (signal_id, hash)) AS p, (SELECT count(*) FROM bs SEMI JOIN hd USING (signal_id, hash)) AS t) SELECT n AS \"new\", p AS paid, t AS tolerated, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM k", "findings")
def baseline_ratchet(spark, d):
    return review.ratchet(*_sides(spark, d))


@query("SELECT DISTINCT ON (signal_id, hash) signal_id, hash, file, line FROM findings WHERE baseline ORDER BY signal_id, hash, file, line", "findings")
def baseline_set(spark, d):
    return review.baseline(_sides(spark, d)[0])


@query(f"WITH {BASE} SELECT signal_id, severity, count(*) AS n FROM findings f WHERE NOT baseline AND NOT EXISTS (SELECT 1 FROM bs WHERE bs.signal_id = f.signal_id AND bs.hash = f.hash) GROUP BY 1, 2", "findings")
def diff_diagnostics(spark, d):
    return review.introduced(*_sides(spark, d)).groupBy("signal_id", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {BASE}, n AS (SELECT * FROM findings f WHERE NOT baseline AND NOT EXISTS (SELECT 1 FROM bs WHERE bs.signal_id = f.signal_id AND bs.hash = f.hash)) SELECT count(*) AS introduced, CASE WHEN count(*) FILTER (severity = 'block' AND signal_id = 'S-N') > 0 THEN 'block' WHEN count(*) > 0 THEN 'route' ELSE 'pass' END AS verdict FROM n", "findings")
def diff_gate(spark, d):
    return review.diff_gate(review.introduced(*_sides(spark, d)), ["S-N"])


SIDES = "bf AS (SELECT signal_id, hash, severity, line <= 3 AS in_scope FROM findings WHERE baseline), hf AS (SELECT signal_id, hash, severity, line <= 3 AS in_scope FROM findings WHERE NOT baseline), nw AS (SELECT * FROM hf f WHERE NOT EXISTS (SELECT 1 FROM bf WHERE bf.signal_id = f.signal_id AND bf.hash = f.hash)), gn AS (SELECT * FROM bf f WHERE NOT EXISTS (SELECT 1 FROM hf WHERE hf.signal_id = f.signal_id AND hf.hash = f.hash))"


def _scoped(spark, d):
    f = a.findings(spark, d).withColumn("in_scope", F.col("line") <= 3)
    return f.where("baseline").drop("baseline"), f.where("NOT baseline").drop("baseline")


@query(f"WITH {SIDES}, sc(signal_id, ok) AS (VALUES ('S-A', true), ('S-N', false), ('S-R', true)), ch AS (SELECT signal_id, CASE WHEN NOT in_scope AND ok AND signal_id IN (SELECT signal_id FROM gn) THEN 'projection-churn' ELSE 'introduced' END AS change FROM nw JOIN sc USING (signal_id) UNION ALL SELECT signal_id, 'resolved' FROM gn) SELECT signal_id, change, count(*) AS n FROM ch GROUP BY 1, 2", "findings")
def score_diff(spark, d):
    scores = spark.createDataFrame([("S-A", 0.5, 0.5), ("S-N", 0.6, 0.4), ("S-R", 0.2, 0.9)], "signal_id string, before double, after double")
    return review.diff(*_scoped(spark, d), scores).groupBy("signal_id", "change").agg(F.count("*").alias("n"))


GATED = "(SELECT count(*) FROM nw) AS introduced, (SELECT count(*) FROM nw WHERE in_scope) AS routed, (SELECT count(*) FROM nw WHERE in_scope AND signal_id = 'S-R') AS trust"


@query(f"WITH {SIDES} SELECT {GATED}, CASE WHEN (SELECT count(*) FROM nw WHERE severity = 'block' AND signal_id = 'S-A') > 0 THEN 'block' WHEN (SELECT count(*) FROM nw WHERE in_scope) > 0 THEN 'route' ELSE 'pass' END AS status", "findings")
def score_diff_gate(spark, d):
    signal = F.col("signal_id")
    new = review.introduced(*_scoped(spark, d)).select(
        F.when(signal == "S-R", "security-risk").otherwise("review-pain").alias("category"), F.when(signal == "S-A", 1.0).otherwise(2.0).alias("tier"), F.lit("structural").alias("kind"), F.array(F.lit("hard-gate")).alias("ceiling"), "severity", "in_scope")
    return review.decide_gate(new, changed_only=True)


@query(f"WITH {BASE}, k AS (SELECT (SELECT count(*) FROM hd ANTI JOIN bs USING (signal_id, hash)) AS n, (SELECT count(*) FROM bs ANTI JOIN hd USING (signal_id, hash)) AS p, (SELECT count(*) FROM bs SEMI JOIN hd USING (signal_id, hash)) AS t) SELECT 'ratcheted' AS mode, n AS \"new\", p AS paid, t AS tolerated, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status FROM k UNION ALL SELECT 'missing-baseline', 0, 0, 0, 'fail' UNION ALL SELECT 'observer-config-mismatch', 0, 0, 0, 'fail'", "findings")
def score_ci(spark, d):
    base, head = _sides(spark, d)
    return review.assess_ci(base, head, "c1", "c1").unionByName(review.assess_ci(None, head)).unionByName(review.assess_ci(base, head, "c1", "c2"))


HALVES = "ha AS (SELECT category || '/' || signal::VARCHAR AS signal_id, round(avg(score) FILTER (ts < TIMESTAMP '2024-01-16'), 9) AS x, round(avg(score) FILTER (ts >= TIMESTAMP '2024-01-16'), 9) AS y FROM observations GROUP BY 1)"


def _halves(spark, d):
    o = a.observations(spark, d).withColumn("signal_id", F.concat_ws("/", "category", F.col("signal").cast("string")))
    cut = F.lit("2024-01-16").cast("timestamp")
    side = lambda c: o.where(c).groupBy("signal_id").agg(F.round(F.avg("score"), 9).alias("score"))
    return side(F.col("ts") < cut), side(F.col("ts") >= cut)


@query(f"WITH {HALVES} SELECT signal_id, x::DOUBLE AS before, y::DOUBLE AS after, round(y - x, 9)::DOUBLE AS delta, round((y - x) / nullif(x, 0), 9)::DOUBLE AS relative FROM ha", "observations")
def signal_deltas(spark, d):
    return review.deltas(*_halves(spark, d))


@query(f"WITH {HALVES}, p AS (SELECT * FROM (VALUES ('r1', 'click/1', 0.99, 0.5, 'lead'), ('r2', 'view/7', 0.2, 0.01, 'owner'), ('r3', 'error/3', 0.1, 9.0, 'lead')) t(id, signal_id, below, ratio, reviewer)) SELECT DISTINCT id AS pattern_id, signal_id, reviewer FROM ha JOIN p USING (signal_id) WHERE y < below OR abs((y - x) / nullif(x, 0)) >= ratio", "observations")
def routing_triggers(spark, d):
    patterns = spark.createDataFrame([("r1", "click/1", 0.99, 0.5, "lead"), ("r2", "view/7", 0.2, 0.01, "owner"), ("r3", "error/3", 0.1, 9.0, "lead")], "id string, signal_id string, below double, change_ratio_above double, reviewer string")
    return review.triggers(review.deltas(*_halves(spark, d)).withColumnRenamed("after", "score"), patterns)


@query("""WITH r AS (SELECT o_orderpriority AS reviewer, c_mktsegment AS reason, min(o_orderkey) AS nth, max(o_orderstatus) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), p AS (SELECT *, CASE WHEN reason < 'F' THEN 2 ELSE 1 END AS pr, reason || '/' || s AS item FROM r),
x AS (SELECT *, 2 + sum(octet_length(item::BLOB) + 3) OVER (PARTITION BY reviewer ORDER BY nth) AS upto FROM p)
SELECT reviewer, ['informational', 'required', 'block'][max(pr)] AS priority, string_agg(reason, '; ' ORDER BY nth) AS reason, array_to_string(list_concat(coalesce(list(item ORDER BY nth) FILTER (upto <= 50), []), CASE WHEN max(upto) > 50 THEN ['context truncated to fit the plan''s budget'] ELSE [] END), '|') AS context, max(upto) > 50 AS cut FROM x GROUP BY reviewer""")
def review_plan_merge(spark, d):
    o = a.table(spark, d, "orders").join(a.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    asked = o.groupBy(F.col("o_orderpriority").alias("reviewer"), F.col("c_mktsegment").alias("reason")).agg(F.min("o_orderkey").alias("nth"), F.max("o_orderstatus").alias("s"))
    asked = asked.select("reviewer", "nth", F.when(F.col("reason") < "F", "required").otherwise("informational").alias("priority"), "reason", F.array(F.concat_ws("/", "reason", "s")).alias("context"))
    return review.merge_requests(asked, 50).withColumn("context", F.array_join("context", "|"))


@query("SELECT p_partkey AS id, p_brand AS globs, 'custom' AS origin FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, p_type, 'built-in' FROM part WHERE p_size <= 40")
def pattern_overrides(spark, d):
    p = a.table(spark, d, "part")
    built_in = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("globs"), F.lit("built-in").alias("origin"))
    return review.override_patterns(built_in, p.where("p_size > 40").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("globs"), F.lit("custom").alias("origin")))


HUNKS = "hk AS (SELECT p_partkey AS file, p_size % 5 + 1 AS new_start, p_size % 3 AS new_lines FROM part)"


@query(f"WITH {HUNKS} SELECT signal_id, count(*) AS n, sum(file)::BIGINT AS checksum FROM findings f WHERE EXISTS (SELECT 1 FROM hk WHERE hk.file = f.file AND line BETWEEN new_start AND new_start + new_lines - 1) GROUP BY 1", "findings")
def changed_scope_findings(spark, d):
    hunks = a.table(spark, d, "part").select(F.col("p_partkey").alias("file"), (F.col("p_size") % 5 + 1).alias("new_start"), (F.col("p_size") % 3).alias("new_lines"))
    return review.in_scope(a.findings(spark, d), hunks).groupBy("signal_id").agg(F.count("*").alias("n"), F.sum("file").alias("checksum"))


SAMPLES = "sm AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS outcome, (0.5 + (n_chars % 3) * 0.25)::DOUBLE AS confidence, unnest(['length', 'words']) AS signal, unnest([round(least(1, n_chars / 5000), 4), round(least(1, len(regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+')) / 1000), 3)])::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def _samples(spark, d):
    scores = F.array(F.struct(F.lit("length").alias("signal"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000), 4).alias("score")), F.struct(F.lit("words").alias("signal"), F.round(F.least(F.lit(1.0), token_count("text") / 1000), 3).alias("score")))
    both = a.table(spark, d, "documents").join(a.table(spark, d, "labels"), "doc_id")
    return both.select(F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("outcome"), (0.5 + F.col("n_chars") % 3 * 0.25).alias("confidence"), F.col("doc_id").alias("id"), F.explode(scores).alias("s")).select("id", "outcome", "confidence", "s.signal", "s.score")


PW = "p AS (SELECT x.signal, x.score - y.score AS d, x.confidence * y.confidence AS c FROM sm x JOIN sm y ON x.signal = y.signal AND x.outcome = 'accepted' AND y.outcome = 'rejected' WHERE abs(x.score - y.score) >= 0.05), e AS (SELECT signal, sum(d * c) AS s, sum(abs(d) * c) AS m FROM p GROUP BY 1)"


@query(f"WITH {SAMPLES}, {PW} SELECT signal, round(s, 4)::DOUBLE AS signed, round(m, 4)::DOUBLE AS magnitude, round(s / m, 3)::DOUBLE AS support, round(greatest(0, least(2, 1 + 0.6 * s / m)), 2)::DOUBLE AS weight FROM e")
def revealed_preference_pairwise(spark, d):
    return review.pairwise_preference(_samples(spark, d))


@query(f"WITH {SAMPLES}, e AS (SELECT signal, avg(score * confidence) FILTER (outcome = 'accepted') - avg(score * confidence) FILTER (outcome = 'rejected') AS s FROM sm GROUP BY 1) SELECT signal, round(s, 4)::DOUBLE AS signed, round(abs(s), 4)::DOUBLE AS magnitude, sign(s)::DOUBLE AS support, round(greatest(0, least(2, 1 + 0.45 * sign(s))), 2)::DOUBLE AS weight FROM e")
def revealed_preference_frequency(spark, d):
    return review.frequency_preference(_samples(spark, d))


@query(f"WITH {SAMPLES}, {PW}, w AS (SELECT signal, round(s / m, 3)::DOUBLE AS support, round(greatest(0, least(2, CASE signal WHEN 'length' THEN 0.5 ELSE 1 END + 0.6 * s / m)), 2) AS w, CASE signal WHEN 'length' THEN 0.5 ELSE 1 END AS p FROM e), n AS (SELECT least(1, count(DISTINCT doc_id) / 1000) AS b FROM sm) SELECT signal, support, round(greatest(0, least(2, p + (w - p) * b)), 2)::DOUBLE AS weight FROM w, n")
def revealed_preference_prior(spark, d):
    prior = spark.createDataFrame([("length", 0.5)], "signal string, prior double")
    return review.prior_adjusted_preference(_samples(spark, d), prior, full=1000)


#: A quiz made of parts: an item for each brand, the sides by even and odd size, a signal for each type.
QUIZ = "dl AS (SELECT p_brand AS item, p_type AS signal, round(sum(CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END * round(p_retailprice / 2000, 3)), 9) AS delta FROM part GROUP BY 1, 2), rs AS (SELECT p_brand AS item, CASE min(p_size) % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'equal' ELSE 'skip' END AS answer FROM part GROUP BY 1 HAVING max(p_retailprice) % 7 < 4), ir AS (SELECT signal, count(*) AS seen, round(sum(CASE answer WHEN 'a' THEN delta WHEN 'b' THEN -delta ELSE 0 END), 9)::DOUBLE AS evidence, round(sum(abs(delta)), 9)::DOUBLE AS magnitude FROM rs JOIN dl USING (item) WHERE answer <> 'skip' GROUP BY 1)"


def _quiz(spark, d):
    p = a.table(spark, d, "part")
    items = p.select(F.col("p_brand").alias("item"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("side"), F.col("p_type").alias("signal"), F.round(F.col("p_retailprice") / 2000, 3).alias("score"))
    deltas = elicitation.item_deltas(items).withColumn("delta", F.round("delta", 9))
    least = F.min("p_size") % 4
    answer = F.when(least == 0, "a").when(least == 1, "b").when(least == 2, "equal").otherwise("skip")
    asked = p.groupBy(F.col("p_brand").alias("item")).agg(answer.alias("answer"), F.max("p_retailprice").alias("m")).where("m % 7 < 4").select("item", "answer")
    return deltas, asked


@query(f"WITH {QUIZ} SELECT * FROM ir")
def quiz_inference(spark, d):
    return elicitation.inference(*_quiz(spark, d))


@query(f"WITH {QUIZ}, g AS (SELECT item, round(sum(abs(delta) * (1 / (1 + coalesce(seen, 0)) + 1 - coalesce(least(1, abs(evidence / magnitude)), 0)) + CASE WHEN seen IS NULL THEN 0.25 ELSE 0 END), 4)::DOUBLE AS gain FROM dl LEFT JOIN ir USING (signal) WHERE item NOT IN (SELECT item FROM rs) GROUP BY 1) SELECT * FROM g ORDER BY gain DESC, item LIMIT 1")
def quiz_next_item(spark, d):
    return elicitation.next_item(*_quiz(spark, d))


@query(f"WITH {QUIZ}, w AS (SELECT signal, 1.0::DOUBLE AS before, round(greatest(0, least(2, 1 + evidence / magnitude * least(1, seen / 3) * 0.5)), 2)::DOUBLE AS weight FROM ir) SELECT * FROM w WHERE abs(weight - before) >= 0.05")
def quiz_weights(spark, d):
    return elicitation.quiz_weights(elicitation.inference(*_quiz(spark, d)))


@query(f"WITH {HALVES}, k AS (SELECT signal_id AS signal, x AS p, y AS c, round(least(2, 1 + least(0.25, (y - x) * 0.5)), 2) AS w FROM ha WHERE y - x >= 0.02) SELECT signal, round(p, 2)::DOUBLE AS previous, round(c, 2)::DOUBLE AS current, 1.0::DOUBLE AS before, w::DOUBLE AS weight FROM k WHERE abs(w - 1) >= 0.05 ORDER BY round(c, 2) - round(p, 2) DESC, signal LIMIT 3", "observations")
def passive_proposal(spark, d):
    before, after = (x.withColumnRenamed("signal_id", "signal") for x in _halves(spark, d))
    return elicitation.passive_proposal(before, after, least=0.02)


# Graphs.

FANS = "fn AS (SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node)"
PATHS = "paths(src, dst) AS (SELECT src, dst FROM edges UNION SELECT p.src, e.dst FROM paths p JOIN edges e ON p.dst = e.src), nd AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"
COMP = "cp AS (SELECT node, least(node, coalesce((SELECT min(p.dst) FROM paths p JOIN paths q ON p.src = q.dst AND p.dst = q.src WHERE p.src = node), node)) AS component FROM nd), cz AS (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM cp)"


@query(f"WITH {FANS} SELECT * FROM fn", "edges")
def fan_in_out(spark, d):
    return graph.fans(a.edges(spark, d))


@query(f"WITH {FANS} SELECT * FROM fn WHERE fan_in >= 3 AND fan_out >= 3", "edges")
def hubs(spark, d):
    return graph.hubs(a.edges(spark, d), 3, 3)


@query(f"WITH {FANS} SELECT count(*) AS modules, count(*) FILTER (fan_in >= 3 AND fan_out >= 3) AS hubs, round(greatest(0, 1 - coalesce(3 * count(*) FILTER (fan_in >= 3 AND fan_out >= 3) / count(*), 0)), 9)::DOUBLE AS score FROM fn", "edges")
def hub_score(spark, d):
    return graph.hub_score(a.edges(spark, d), 3, 3)


@query(f"WITH {PATHS} SELECT node, (SELECT count(*) FROM paths WHERE src = node AND dst <> node) AS reach, (SELECT count(*) FROM paths WHERE dst = node AND src <> node) AS reverse_reach FROM nd", "edges")
def reach_counts(spark, d):
    return graph.reach(a.edges(spark, d))


@query(f"WITH {PATHS}, r AS (SELECT count(*) AS r FROM paths WHERE src <> dst), n AS (SELECT count(*) AS n FROM nd) SELECT n AS modules, round(coalesce(r / (n * n), 0), 9)::DOUBLE AS cost, round(1 - greatest(0, least(1, (coalesce(r / (n * n), 0) - 0.3) / 0.4)), 9)::DOUBLE AS score FROM r, n", "edges")
def propagation_cost(spark, d):
    return graph.propagation_cost(a.edges(spark, d))


@query(f"WITH {PATHS}, {COMP} SELECT * FROM cz", "edges")
def scc_components(spark, d):
    return graph.strong_components(a.edges(spark, d))


CYC = f"{PATHS}, {COMP}, inn AS (SELECT e.src, e.dst, x.component, x.size, count(*) OVER (PARTITION BY e.src) AS fan FROM edges e JOIN cz x ON x.node = e.src JOIN cz y ON y.node = e.dst WHERE x.component = y.component AND (x.size > 1 OR e.src = e.dst)), cy AS (SELECT DISTINCT ON (component) component, size, src AS break_src, dst AS break_dst FROM inn ORDER BY component, fan, src, dst)"


@query(f"WITH {CYC} SELECT * FROM cy", "edges")
def cycle_min_break_edge(spark, d):
    return graph.cycles(a.edges(spark, d))


@query(f"WITH {CYC} SELECT count(*) AS cycles, coalesce(max(size), 0) AS largest, round(CASE WHEN count(*) = 0 THEN 1 ELSE greatest(0.05, 1 - least(0.45, 0.05 * count(*)) - least(0.5, 0.05 * log2(greatest(1, coalesce(max(size), 0))))) END, 9)::DOUBLE AS score FROM cy", "edges")
def cycle_score(spark, d):
    return graph.cycle_score(graph.cycles(a.edges(spark, d)))


@query()
def reexport_depths(spark, d):
    """Longest chains over components; SQL has no end to its recursion on cycles. A unit test holds it against plain search."""
    return graph.depths(a.edges(spark, d))


@query("WITH sp(node) AS (SELECT DISTINCT src FROM edges WHERE weight >= 5 UNION SELECT e.src FROM sp JOIN edges e ON e.dst = node) SELECT node FROM sp", "edges")
def unsafe_propagation(spark, d):
    e = a.edges(spark, d)
    return graph.spread(e.where("weight >= 5").select(F.col("src").alias("node")), e)


@query()
def reach_sketch(spark, d):
    """Estimated reach; SQL engines' sketches differ. A unit test holds it against exact reach."""
    return graph.sketches(a.edges(spark, d))


# Text.

#: Words of whole texts, in lower case: runs of letters and digits with a letter.
TERMS = "tm AS (SELECT doc_id AS file, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents), t AS (SELECT * FROM tm WHERE regexp_matches(term, '[a-z]'))"


def _terms(spark, d):
    docs = a.table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.lower("text").alias("name"))
    return text.terms(docs).select("file", "term")


@query(f"WITH {TERMS} SELECT term, count(*) AS frequency, count(DISTINCT file) AS files FROM t GROUP BY term HAVING count(*) >= 3")
def glossary_terms(spark, d):
    return text.glossary(_terms(spark, d), 3)


PEERS = "pe AS (SELECT DISTINCT p_name AS term, p_brand AS peer FROM part), fr AS (SELECT p_name AS term, count(*) AS n FROM part GROUP BY 1), ps AS (SELECT term, count(*) AS s FROM pe GROUP BY 1)"


@query(f"WITH {PEERS}, b AS (SELECT x.term AS a, y.term AS b, count(*) AS i FROM pe x JOIN pe y ON x.peer = y.peer AND x.term < y.term GROUP BY 1, 2) SELECT a, b, round(i / (p.s + q.s - i), 9)::DOUBLE AS jaccard FROM b JOIN ps p ON p.term = a JOIN ps q ON q.term = b JOIN fr f ON f.term = a JOIN fr g ON g.term = b WHERE i / (p.s + q.s - i) >= 0.75 AND least(f.n, g.n) / greatest(f.n, g.n) >= 0.5")
def glossary_synonyms(spark, d):
    p = a.table(spark, d, "part").select(F.col("p_name").alias("term"), F.col("p_brand").alias("peer"))
    return text.synonyms(p, p.groupBy("term").agg(F.count("*").alias("n")))


@query(f"""WITH {TERMS}, f AS (SELECT term, count(*) AS n FROM t GROUP BY term), kn AS (SELECT term AS known FROM f WHERE n >= 10 AND len(term) >= 4), un AS (SELECT term FROM f WHERE term NOT IN (SELECT known FROM kn)),
ku AS (SELECT known, unnest(list_distinct(list_append([known[:i] || known[i + 2:] FOR i IN range(0, len(known))], known))) AS k FROM kn), uu AS (SELECT term, unnest(list_distinct(list_append([term[:i] || term[i + 2:] FOR i IN range(0, len(term))], term))) AS k FROM un)
SELECT DISTINCT term, known FROM uu JOIN ku USING (k) WHERE levenshtein(term, known) <= 1""")
def term_conflicts(spark, d):
    counts = _terms(spark, d).groupBy("term").agg(F.count("*").alias("n"))
    return text.near_misses(counts, counts.where("n >= 10 AND length(term) >= 4").select(F.col("term").alias("known")))


NAMES = "c AS (SELECT p_type AS kind, CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '-') ELSE split_part(p_name, ' ', 1) END AS name FROM part), k AS (SELECT kind, CASE WHEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'camelCase' WHEN regexp_matches(name, '^[A-Z][A-Z0-9_]*$') THEN 'UPPER_SNAKE_CASE' WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(name, '^[a-z][a-z0-9_]*$') THEN 'snake_case' WHEN regexp_matches(name, '^[a-z][a-z0-9-]*$') THEN 'kebab-case' END AS convention FROM c), md AS (SELECT DISTINCT ON (kind) kind, convention, n FROM (SELECT kind, convention, count(*) AS n FROM k WHERE convention IS NOT NULL GROUP BY ALL) ORDER BY kind, n DESC, convention)"


def _names(spark, d):
    name = F.when(F.col("p_size") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).when(F.col("p_size") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.split("p_name", " ")[0])
    return a.table(spark, d, "part").select(F.col("p_type").alias("kind"), name.alias("name"))


@query(f"WITH {NAMES} SELECT * FROM md")
def naming_convention_mode(spark, d):
    return text.conventions(_names(spark, d))


@query("WITH m(convention, p) AS (VALUES ('camelCase', '^[a-z][a-zA-Z0-9]*$'), ('UPPER_SNAKE_CASE', '^[A-Z][A-Z0-9_]*$'), ('PascalCase', '^[A-Z][a-zA-Z0-9]*$'), ('snake_case', '^[a-z][a-z0-9_]*$'), ('kebab-case', '^[a-z][a-z0-9-]*$')), " + NAMES + " SELECT count(*) AS total, count(*) FILTER (NOT regexp_matches(name, p)) AS violations, round(1 - count(*) FILTER (NOT regexp_matches(name, p)) / count(*), 9)::DOUBLE AS score FROM c JOIN md USING (kind) JOIN m USING (convention)")
def naming_score(spark, d):
    names = _names(spark, d)
    return text.naming_score(names, text.conventions(names))


ALLOW = "al AS (SELECT CASE p_size % 5 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '2023-01-01' WHEN 2 THEN 'never' ELSE '2024-01-01' END AS until, p_partkey FROM part WHERE p_size % 7 <> 0)"


def _allow(spark, d):
    part = F.col("p_size") % 5
    until = F.when(part == 0, "2024-05-01").when(part == 1, "2023-01-01").when(part == 2, "never").otherwise("2024-01-01")
    mark = F.when(F.col("p_size") % 7 == 0, "x(); // repo-allow T-").otherwise("  // repo-allow T-")
    line = F.concat(mark, F.col("p_partkey").cast("string"), F.lit(" until:"), until, F.lit(" because it must  "))
    return text.bypasses(a.table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.lit(1).alias("line_no"), line.alias("line")), "2024-01-01 00:00:00")


@query(f"WITH {ALLOW} SELECT p_partkey AS file, 'T-' || p_partkey::VARCHAR AS ticket, until, 'because it must' AS reason, until NOT IN ('2024-05-01', '2024-01-01') AS expired FROM al")
def bypass_expiry(spark, d):
    return _allow(spark, d).select("file", "ticket", "until", "reason", "expired")


@query(f"WITH {ALLOW}, k AS (SELECT count(*) FILTER (until NOT IN ('2024-05-01', '2024-01-01')) AS e, count(*) FILTER (until IN ('2024-05-01', '2024-01-01')) AS j FROM al) SELECT e AS expired, 0::BIGINT AS missing, j AS justified, round(1 - least(1, (4 * e + 0.25 * j) / 100000), 9)::DOUBLE AS score FROM k")
def suppression_governance(spark, d):
    return text.suppression_score(_allow(spark, d), 400_000)


@query("SELECT p_brand AS package, sha256(trim(regexp_replace(p_name || '  ' || p_type, '\\s+', ' ', 'g'))) AS hash, count(*) AS n FROM part GROUP BY 1, 2")
def diagnostic_hash(spark, d):
    return a.table(spark, d, "part").groupBy(F.col("p_brand").alias("package"), spaced_hash(F.concat("p_name", F.lit("  "), "p_type")).alias("hash")).agg(F.count("*").alias("n"))


URL = "up AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


@query(f"WITH {URL} SELECT page_id FROM up WHERE regexp_matches(path, '^[^/]*\\.example\\.com/.*$') OR regexp_matches(path, '^.*/en/[^/]*$')")
def glob_filter(spark, d):
    from ..functions.scalars import glob_match

    pages = a.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return pages.where(glob_match("path", ["*.example.com/**", "**/en/*"])).select("page_id")


@query(f"WITH {URL}, pk AS (SELECT DISTINCT regexp_extract(path, '^[^/]+') AS root FROM up UNION SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/?#]+') FROM up WHERE page_id % 2 = 0), m AS (SELECT page_id::VARCHAR AS id, path, root FROM up JOIN pk ON path = root OR starts_with(path, root || '/')) SELECT path, arg_max(root, len(root)) AS package FROM m GROUP BY path")
def path_owner_longest_prefix(spark, d):
    p = a.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    roots = p.select(F.regexp_extract("path", "^[^/]+", 0).alias("root")).unionByName(p.where("page_id % 2 = 0").select(F.regexp_extract("path", "^[^/]+/[^/?#]+", 0).alias("root"))).distinct()
    return text.owners(p.select("path").distinct(), roots.select("root", F.col("root").alias("package")))


@query("SELECT p_brand AS file, count(*) FILTER (p_size > 10) AS covered, count(*) AS total, round(count(*) FILTER (p_size > 10) / count(*), 9)::DOUBLE AS pct FROM part GROUP BY 1")
def coverage_summary(spark, d):
    from ..sources.coverage import read_lcov, summary

    p = a.table(spark, d, "part")
    record = F.concat(F.lit("SF:"), "file", F.lit("\n"), F.array_join("das", "\n"), F.lit("\nend_of_record"))
    das = p.groupBy(F.col("p_brand").alias("file")).agg(F.array_sort(F.collect_list(F.concat(F.lit("DA:"), F.col("p_partkey").cast("string"), F.lit(","), F.when(F.col("p_size") > 10, "1").otherwise("0")))).alias("das"))
    return summary(read_lcov(das.select(record.alias("value")))).select("file", F.col("lines.covered").alias("covered"), F.col("lines.total").alias("total"), F.round("lines.pct", 9).alias("pct"))


#: Kinds of each finding signal, dealt to line items by supplier; a kind without a weight of its own weighs 1.
KINDS = ["log-only-handler eval parameter broad-throw missing", "function-constructor return catch-without-narrowing expired", "dynamic-import property opaque-promise-api justified", "shell-process type-alias promise-catch-collapse other", "raw-sql variable effect-unknown-exception other"]
SIZES = {"density": 30_000.0, "capability": 200.0, "unwrap": 3.0}


def _counts(spark, d):
    """(signal_id, kind, boundary, n) and (signal_id, size): line items as findings, five kinds a signal by supplier, boundary by flag."""
    items = a.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).cast("int").alias("k"), (F.col("l_returnflag") == "R").alias("boundary")).agg(F.count("*").alias("n"))
    named = []
    for signal, s in fnd.SIGNALS.items():
        for k, words in enumerate(KINDS):
            named.append((signal, k, next((w for w in words.split() if w in s.weights), "other-kind")))
    kinds = spark.createDataFrame(named, "signal_id string, k int, kind string")
    sizes = spark.createDataFrame([(i, SIZES.get(s.formula, 200_000.0)) for i, s in fnd.SIGNALS.items()], "signal_id string, size double")
    return items.join(F.broadcast(kinds), "k").select("signal_id", "kind", "boundary", "n"), sizes


#: Each signal's formula, its constants, what a boundary counts, its size and the weights of the five kinds, written out.
WEIGHED = """wt(signal_id, f, a1, a2, a3, bf, z, w) AS (VALUES
('TS-CC-01', 'saturating', 5, 0, 0, 1, 200000, [0, 1, 1, 1, 1]), ('TS-CC-02', 'saturating', 5, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('TS-BP-01', 'saturating', 3, 0, 0, 1, 200000, [1, 1, 1, 1, 1]),
('TS-LD-08', 'saturating', 10, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('TS-SEC-02', 'saturating', 5, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('TS-SEC-01', 'capability', 0.5, 0, 0, 1, 200, [1, 1, 0, 0, 0]),
('TS-LD-07', 'density', 10, 48, 0, 2, 30000, [3, 3, 2.5, 2.5, 2]), ('TS-LD-09', 'density', 18, 36, 0, 2, 30000, [2.5, 3, 4, 3, 4]),
('TS-SL-05', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('TS-SL-06', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('TS-AB-03', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]),
('TS-AB-05', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('TS-LD-03', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('TS-LD-04', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]),
('TS-AD-01', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('RS-AB-01', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('RS-AB-03', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]),
('RS-AB-04', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('RS-LD-03', 'share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]),
('RS-AD-02', 'double-share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('RS-LD-02', 'double-share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]), ('RS-LD-05', 'double-share', 0, 0, 0, 1, 200000, [1, 1, 1, 1, 1]),
('RS-SL-04', 'capped', 25, 0.8, 0, 1, 200000, [1, 1, 1, 1, 1]), ('RS-RP-02', 'capped', 10000, 1, 0, 1, 200000, [1, 1, 1, 1, 1]), ('RS-SL-03', 'unwrap', 0.05, 0.001, 0.5, 1, 3, [1, 1, 1, 1, 1]),
('RS-SL-02', 'zero-or-count', 25, 0, 0, 1, 200000, [1, 1, 0, 0, 0])),
ks AS (SELECT l_suppkey % 5 AS k, l_returnflag = 'R' AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
sw AS (SELECT signal_id, f, a1::DOUBLE AS a1, a2::DOUBLE AS a2, a3::DOUBLE AS a3, z::DOUBLE AS z, sum(w[k + 1]::DOUBLE * CASE WHEN b THEN bf ELSE 1 END * n)::DOUBLE AS x, coalesce(sum(w[k + 1]::DOUBLE * bf * n) FILTER (b), 0)::DOUBLE AS bw, sum(n)::DOUBLE AS n, coalesce(sum(n) FILTER (w[k + 1] > 0), 0)::DOUBLE AS wn FROM wt, ks GROUP BY ALL),
fs AS (SELECT signal_id, n::BIGINT AS n, round(x, 6)::DOUBLE AS weighted, round(CASE f WHEN 'saturating' THEN 1 / (1 + x / a1) WHEN 'capability' THEN 1 / (1 + x) * (1 - a1 * ((n - wn) / z) / (1 + (n - wn) / z)) WHEN 'density' THEN 1 / (1 + greatest(x / z / a1, bw / a2)) WHEN 'share' THEN greatest(0, least(1, 1 - x / z))
WHEN 'double-share' THEN 1 - least(1, 2 * x / z) WHEN 'capped' THEN 1 - least(a2, x / a1) WHEN 'unwrap' THEN 1 - least(a3, a1 * z + a2 * x) ELSE CASE WHEN wn > 0 THEN 0 ELSE 1 - least(1, n / a1) END END, 9)::DOUBLE AS score FROM sw)"""


@query(f"WITH {WEIGHED} SELECT * FROM fs")
def finding_signals(spark, d):
    return fnd.score_all(*_counts(spark, d))


FACTS = """f AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (p_size > 45)::DOUBLE AS a, count(*) FILTER (p_size > 48)::DOUBLE AS b, max(p_size)::DOUBLE AS m, count(DISTINCT p_brand)::DOUBLE AS g, count(*) FILTER (p_size < 1)::DOUBLE AS z FROM part)"""


@query(f"""WITH {FACTS} SELECT round(greatest(0, least(1, 1 - least(1, 0.15 * g / 25) - least(0.5, 0.1 * greatest(0, g / 5 - 2)))), 9)::DOUBLE AS crate_cycles, round(greatest(0, least(1, 1 - b / greatest(10, n))), 9)::DOUBLE AS trait_coupling,
round(greatest(0, least(1, 1 - least(0.4, greatest(0, g - 8) / 8) - least(0.3, g / 40) - least(0.3, 3 / 40))), 9)::DOUBLE AS features, round(greatest(0, least(1, 1 - least(0.6, 2 * b / n) - least(0.4, a / (10 * n)))), 9)::DOUBLE AS rust_hubs,
round(greatest(0, least(1, 1 - a / n * least(1, n / 5))), 9)::DOUBLE AS chain_share, round(CASE WHEN z > 0 THEN 0 ELSE greatest(0, least(1, 1 - greatest(a / n, least(1, b / n)))) END, 9)::DOUBLE AS unsafe_code, round(a / (a + b), 9)::DOUBLE AS error_granularity,
round(1 - least(0.5, least(0.35, a / 200) + least(0.15, g / 250)), 9)::DOUBLE AS rust_clones, round(greatest(0, least(1, 1 - least(0.6, n / 1000) - 0.15 * z)), 9)::DOUBLE AS rust_pr, round(greatest(0, least(1, 1 - (4 * z + g + 0.25 * 40) / 100)), 9)::DOUBLE AS suppressions,
round(greatest(0, least(1, 1 - (0.2 * z + 0.1 * 2 + 0.15 * 3))), 9)::DOUBLE AS dependency_delta, round(1 / (1 + g / 8), 9)::DOUBLE AS construction, round(greatest(0, least(1, 1 - greatest(0, m / 10 - 3) / 3)), 9)::DOUBLE AS reexport, round(least(0.8, greatest(0, least(1, 1 - b / n))), 9)::DOUBLE AS unfinished FROM f""")
def signal_formulas(spark, d):
    size = F.col("p_size")
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    f = a.table(spark, d, "part").agg(F.count("*").cast("double").alias("n"), n(size > 45).alias("a"), n(size > 48).alias("b"), F.max(size).cast("double").alias("m"), F.count_distinct("p_brand").cast("double").alias("g"), n(size < 1).alias("z"))
    g, lit = F.col("g"), F.lit
    scores = {
        "crate_cycles": signals.crate_cycle_score(g / 25, g / 5), "trait_coupling": signals.trait_coupling_score("b", "n"), "features": signals.feature_score("g", "g", lit(3)), "rust_hubs": signals.rust_hub_score("b", "n", "a"),
        "chain_share": signals.chain_share_score("a", "n"), "unsafe_code": signals.unsafe_score("a", "n", "b", "z"), "error_granularity": signals.error_granularity_score("a", "b"), "rust_clones": signals.rust_clone_score("a", "g"),
        "rust_pr": signals.rust_pr_score("n", "z"), "suppressions": signals.suppression_score("z", "g", lit(40), lit(2)), "dependency_delta": signals.dependency_delta_score("z", lit(2), lit(3)), "construction": signals.construction_score("g"),
        "reexport": signals.reexport_score(F.col("m") / 10), "unfinished": signals.unfinished_score("b", "n", lit(1)),
    }
    return f.select(*(F.round(c, 9).alias(k) for k, c in scores.items()))


@query("WITH m AS (SELECT p_brand, count(*) FILTER (p_size > 30) / count(*) AS s FROM part GROUP BY 1) SELECT round(1 - 0.3 * greatest(avg((s > 0.35)::INT), avg(CASE WHEN s > 0.35 THEN (s - 0.35) / 0.65 ELSE 0 END)), 9)::DOUBLE AS score FROM m")
def visibility_surface(spark, d):
    return signals.visibility_score(a.table(spark, d, "part").groupBy("p_brand").agg(F.count(F.when(F.col("p_size") > 30, 1)).alias("public"), F.count("*").alias("items")))


@query("WITH c AS (SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS churn FROM lineitem GROUP BY 1), f AS (SELECT churn, p_size AS complexity FROM part JOIN c ON file = p_partkey) SELECT round(greatest(0.2, 1 - (SELECT coalesce(sum(least(1, sqrt(churn / 28 * (complexity / 45)))), 0) FROM f WHERE churn >= 28 AND complexity >= 45) / (SELECT count(*) FROM f)), 9)::DOUBLE AS score")
def rust_hotspots(spark, d):
    churn = a.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("churn"))
    return signals.rust_hotspot_score(a.table(spark, d, "part").join(churn, "p_partkey").select("churn", F.col("p_size").alias("complexity")), 28, 45)
