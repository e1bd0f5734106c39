"""Queries over commit history and the ranks made of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggregates import distribution, inclusive_percentile
from ..functions.scalars import e_fold, source_hash, token_count, violation_share
from ..operators import clones, composite, findings, history, observer, packages
from ..sources import adapters as a
from .base import query

LATEST = "head AS (SELECT max(committed_at) AS h FROM commits), latest AS (SELECT sha, h FROM commits, head WHERE committed_at >= h - INTERVAL 90 DAY ORDER BY committed_at DESC, sha LIMIT 500)"


def _latest(spark, d):
    """Touches of the commits that churn looks at, cut to them in the scan of line items."""
    return a.touches(spark, d, history.latest_commits(a.commits(spark, d), 90, 500))


@query(f"WITH {LATEST} SELECT file, count(*) AS touch_count, (SELECT count(*) FROM latest) >= 500 AS sampled FROM touches JOIN latest USING (sha) GROUP BY file", "commits", "touches")
def churn_recent(spark, d):
    return history.recent_churn(_latest(spark, d), a.commits(spark, d))


@query(f"WITH {LATEST} SELECT file, count(*) AS touch_count, round(sum(pow(0.5, (epoch_us(h) - epoch_us(committed_at)) / 86400e6 / 14)), 9) AS weighted, max(committed_at) AS last_touched_at FROM touches JOIN latest USING (sha) GROUP BY file", "commits", "touches")
def churn_weighted(spark, d):
    return history.weighted_churn(_latest(spark, d), a.commits(spark, d))


@query("""WITH n AS (SELECT file, count(*) AS n FROM touches GROUP BY file), t AS (SELECT count(DISTINCT sha) AS c FROM touches),
p AS (SELECT x.file AS l, y.file AS r, count(*) AS k, max(x.committed_at) AS m FROM touches x JOIN touches y ON x.sha = y.sha AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT l AS left_file, r AS right_file, k AS co_change_count, a.n AS left_touch_count, b.n AS right_touch_count, round(k / c, 12) AS support, round(k / greatest(a.n, b.n), 12) AS confidence, m AS last_co_changed_at FROM p JOIN n a ON a.file = l JOIN n b ON b.file = r, t""", "touches")
def cochange_pairs(spark, d):
    return history.cochange_pairs(a.touches(spark, d))


BUS = """w AS (SELECT * FROM touches WHERE committed_at >= (SELECT max(committed_at) FROM touches) - INTERVAL 180 DAY), ac AS (SELECT file, author, count(*) AS n FROM w GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS r, sum(n) OVER (PARTITION BY file) AS t, count(*) OVER (PARTITION BY file) AS b FROM ac),
bus AS (SELECT file, loc, b AS bus_factor, author AS primary_author, round(n / t, 12) AS primary_share, b = 1 AS siloed FROM rk JOIN files USING (file) WHERE r = 1 AND loc >= 50)"""


@query(f"WITH {BUS} SELECT * FROM bus", "touches", "files")
def bus_factor(spark, d):
    return history.bus_factor(a.touches(spark, d), a.files(spark, d))


@query(f"""WITH {BUS}, s AS (SELECT sum(loc) AS t, sum(loc) FILTER (siloed) AS l, count(*) FILTER (siloed) AS k FROM bus), ra AS (SELECT count(DISTINCT author) AS n FROM w)
SELECT round(1 - least(0.35, coalesce(0.45 * l / t, 0)), 12)::DOUBLE AS score, CASE WHEN t IS NULL THEN 'insufficient_evidence' WHEN n < 2 THEN 'not_applicable' ELSE 'applicable' END AS applicability, k AS siloed_files, coalesce(t, 0)::BIGINT AS touched_loc FROM s, ra""", "touches", "files")
def silo_score(spark, d):
    t = a.touches(spark, d)
    return history.silo_score(history.bus_factor(t, a.files(spark, d)), history.in_window(t, 180).agg(F.count_distinct("author").alias("n")))


@query("SELECT file, author, n, round(n / sum(n) OVER (PARTITION BY file), 12) AS share FROM (SELECT file, author, count(*) AS n FROM touches GROUP BY ALL)", "touches")
def author_touch_share(spark, d):
    return history.author_share(a.touches(spark, d))


@query("SELECT file, sum(added) AS added FROM touches, (SELECT max(committed_at) AS h FROM touches) WHERE (epoch_us(h) - epoch_us(committed_at)) / 86400e6 BETWEEN 14 AND 28 GROUP BY file", "touches")
def added_lines_window(spark, d):
    return history.added_in_window(a.touches(spark, d))


#: Line survival: the lines of a source's even documents, against those of its odd ones.
LINES = """lines AS (SELECT source AS file, doc_id, rtrim(unnest(string_split(text, chr(10))), ' ') AS text FROM documents), ad AS (SELECT file, text, count(*) AS a FROM lines WHERE doc_id % 2 = 0 AND trim(text, ' ') <> '' GROUP BY ALL),
hd AS (SELECT file, text, count(*) AS h FROM lines WHERE doc_id % 2 = 1 AND trim(text, ' ') <> '' GROUP BY ALL), sv AS (SELECT file, sum(a)::BIGINT AS introduced, sum(least(a, coalesce(h, 0)))::BIGINT AS survived FROM ad LEFT JOIN hd USING (file, text) GROUP BY file)"""


def _lines(spark, d):
    text = a.table(spark, d, "documents").select(F.col("source").alias("file"), "doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return text.where("doc_id % 2 = 0"), text.where("doc_id % 2 = 1")


@query(f"WITH {LINES} SELECT * FROM sv")
def churn_rate_exact(spark, d):
    return history.exact_survival(*_lines(spark, d))


@query(f"WITH {LINES} SELECT round(1 - least(1, coalesce(sum((introduced - survived) / introduced / 0.3), 0)), 9)::DOUBLE AS score FROM sv")
def churn_rate_score(spark, d):
    return history.churn_penalty(history.exact_survival(*_lines(spark, d)))


@query()
def line_survival_fuzzy(spark, d):
    """All lines of a role's messages as the lines of a file; order decides, so no SQL. Checked by a unit test."""
    text = a.table(spark, d, "conversations").select(F.concat_ws("/", "role", F.col("conv_id").cast("string")).alias("file"), "turn", F.posexplode(F.split("text", "\n", -1)).alias("nth", "text"))
    lines = lambda of: text.where(of).select("file", (F.col("turn").cast("long") * (1 << 32) + F.col("nth")).alias("seq"), "text")
    return history.fuzzy_survival(lines("turn % 4 < 2"), lines("turn % 4 >= 2"))


@query("""WITH v AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT max(v) AS "max", max(v) FILTER (i = floor(0.95 * (n - 1))) AS p95, round(avg(v), 6) AS "avg", round(sum(v), 2) AS "sum", count(*) AS n FROM v""")
def distribution_summary(spark, d):
    return distribution(a.table(spark, d, "lineitem"), "l_extendedprice").select("max", "p95", F.round("avg", 6).alias("avg"), F.round("sum", 2).alias("sum"), "n")


@query("""WITH v AS (SELECT package, complexity::DOUBLE AS v, row_number() OVER (PARTITION BY package ORDER BY complexity) - 1 AS i, count(*) OVER (PARTITION BY package) AS n FROM files)
SELECT package, max(v) AS "max", max(v) FILTER (i = floor(0.95 * (n - 1))) AS p95, round(avg(v), 9) AS "avg", sum(v) AS "sum", count(*) AS n FROM v GROUP BY package""", "files")
def complexity_by_package(spark, d):
    return distribution(a.files(spark, d), "complexity", ["package"]).select("package", "max", "p95", F.round("avg", 9).alias("avg"), "sum", "n")


HOT = f"""{LATEST}, churn AS (SELECT file, count(*) AS churn, sum(pow(0.5, (epoch_us(h) - epoch_us(committed_at)) / 86400e6 / 14)) AS weighted FROM touches JOIN latest USING (sha) GROUP BY file), hs AS (SELECT file, complexity, churn, weighted FROM files JOIN churn USING (file))"""


def _hot(spark, d):
    churn = history.weighted_churn(_latest(spark, d), a.commits(spark, d)).select("file", F.col("touch_count").alias("churn"), "weighted")
    return a.files(spark, d).select("file", "complexity").join(churn, "file")


@query(f"""WITH {HOT}, m AS (SELECT median(complexity) AS mc, median(churn) AS mh FROM hs)
SELECT file, complexity, churn, CASE WHEN churn > mh AND complexity > mc THEN 'top-right' WHEN complexity > mc THEN 'top-left' WHEN churn > mh THEN 'bottom-right' ELSE 'bottom-left' END AS quadrant FROM hs, m""", "commits", "touches", "files")
def hotspots_quadrant(spark, d):
    return composite.quadrants(_hot(spark, d).select("file", "complexity", "churn"))


def _gate(v, least):
    low, high = least * 0.5, least * 1.5
    t = f"greatest(0, least(1, ({v} - {low}) / ({high} - {low})))"
    return f"({t} * {t} * (3 - 2 * {t}))"


def _magnitude(v, least):
    return f"greatest(0, least(1, ({v} - {least * 0.5}) / ({8 * least} - {least * 0.5})))"


RISK = f"""{HOT}, own AS (SELECT file, CASE WHEN count(DISTINCT author) = 1 THEN 0.45 ELSE 0 END AS ownership FROM touches GROUP BY file),
pr AS (SELECT file, max(greatest(confidence, support)) AS cochange FROM (SELECT unnest([l, r]) AS file, k / greatest(a.n, b.n) AS confidence, k / c AS support FROM (SELECT x.file AS l, y.file AS r, count(*) AS k FROM touches x JOIN touches y ON x.sha = y.sha AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 2) JOIN (SELECT file, count(*) AS n FROM touches GROUP BY file) a ON a.file = l JOIN (SELECT file, count(*) AS n FROM touches GROUP BY file) b ON b.file = r, (SELECT count(DISTINCT sha) AS c FROM touches)) GROUP BY file),
rk AS (SELECT hs.file, complexity, churn, round((0.35 * {_magnitude('complexity', 5)} + 0.25 * {_magnitude('weighted', 2)} + 0.15 * coalesce(ownership, 0) + 0.10 * coalesce(round(cochange, 12), 0)) / (0.6 + CASE WHEN ownership IS NULL THEN 0 ELSE 0.15 END + CASE WHEN cochange IS NULL THEN 0 ELSE 0.10 END), 9) AS risk, round({_gate('churn', 2)} * {_gate('complexity', 5)}, 9) AS gate FROM hs LEFT JOIN own USING (file) LEFT JOIN pr ON pr.file = hs.file)"""


def _risks(spark, d):
    t = a.touches(spark, d)
    own = t.groupBy("file").agg(F.when(F.count_distinct("author") == 1, 0.45).otherwise(0.0).alias("ownership"))
    pairs = history.cochange_pairs(t).select(F.explode(F.array("left_file", "right_file")).alias("file"), F.greatest("confidence", "support").alias("c")).groupBy("file").agg(F.max("c").alias("cochange"))
    facts = _hot(spark, d).join(own, "file", "left").join(pairs, "file", "left").withColumn("coverage", F.lit(None).cast("double"))
    return composite.risks(facts)


@query(f"WITH {RISK} SELECT file, complexity, churn, risk::DOUBLE AS risk, gate::DOUBLE AS gate, row_number() OVER (ORDER BY risk DESC, file)::INT AS \"rank\" FROM rk WHERE gate > 0", "commits", "touches", "files")
def hotspots_risk(spark, d):
    return _risks(spark, d).select("file", "complexity", "churn", "risk", "gate", "rank")


@query(f"WITH {RISK} SELECT round(1 - least(1, coalesce(avg(risk), 0)), 9)::DOUBLE AS score FROM (SELECT risk FROM rk WHERE gate > 0 AND risk > 0 ORDER BY risk DESC, file LIMIT 10)", "commits", "touches", "files")
def hotspots_score(spark, d):
    return composite.risk_score(_risks(spark, d))


@query(f"""WITH {HOT}, g AS (SELECT *, {_gate('churn', 2)} * {_gate('complexity', 5)} AS tw FROM hs), g2 AS (SELECT *, CASE WHEN count(*) OVER () <= 1 THEN 1.0 ELSE (count(*) OVER (ORDER BY churn RANGE UNBOUNDED PRECEDING) - 1) / (count(*) OVER () - 1) END AS ph, CASE WHEN count(*) OVER () <= 1 THEN 1.0 ELSE (count(*) OVER (ORDER BY complexity RANGE UNBOUNDED PRECEDING) - 1) / (count(*) OVER () - 1) END AS pc FROM g WHERE tw > 0),
sp AS (SELECT count(*) AS files, coalesce(avg(tw * greatest(0, least(1, (ph - 0.5) / 0.5)) * greatest(0, least(1, (pc - 0.5) / 0.5)) * sqrt({_magnitude('churn', 2)} * {_magnitude('complexity', 5)})), 0) AS p FROM g2),
s AS (SELECT coalesce(avg((churn > (SELECT median(churn) FROM g2) AND complexity > (SELECT median(complexity) FROM g2))::INT), 0) AS s FROM g2),
lg AS (SELECT * FROM hs WHERE churn >= 2 AND complexity >= 5), l AS (SELECT coalesce(avg((churn > (SELECT median(churn) FROM lg) AND complexity > (SELECT median(complexity) FROM lg))::INT), 0) AS l FROM lg),
z AS (SELECT files, p, 1 - least(1, greatest(1.5 * l, p)) AS legacy, 1 - least(1, s + 2 * p) AS soft, greatest(0, least(1, (12 - files) / 6)) AS b FROM sp, s, l)
SELECT files, round(p, 9)::DOUBLE AS soft_pressure, round(legacy, 9)::DOUBLE AS legacy, round(soft, 9)::DOUBLE AS soft, round(legacy * (1 - b) + soft * b, 9)::DOUBLE AS score FROM z""", "commits", "touches", "files")
def hotspot_soft_pressure(spark, d):
    return composite.soft_score(_hot(spark, d).select("file", "complexity", "churn"))


@query(f"WITH {HOT} SELECT file, churn, round(CASE WHEN count(*) OVER () <= 1 THEN 1.0 ELSE (count(*) OVER (ORDER BY churn RANGE UNBOUNDED PRECEDING) - 1) / (count(*) OVER () - 1) END, 9)::DOUBLE AS percentile FROM hs", "commits", "touches", "files")
def churn_percentile(spark, d):
    return inclusive_percentile(_hot(spark, d).select("file", "churn"), "churn", "percentile").select("file", "churn", F.round("percentile", 9).alias("percentile"))


CLONES = """c AS (SELECT doc_id AS id, substr(sha256(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]', '', 'g')), 1, 16) AS exact, len(regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+')) AS tokens FROM documents),
cg AS (SELECT 'exact' AS kind, exact AS hash, count(*) AS members, max(tokens)::INT AS tokens, min(id) AS representative FROM c WHERE tokens >= 12 GROUP BY exact HAVING count(*) > 1),
ci AS (SELECT *, round(CASE WHEN tokens < 20 THEN 0 WHEN tokens < 50 THEN 0.5 * log2(members) ELSE members - 1 END * 1.2 * greatest(0.3, least(3.0, tokens / 30)), 9)::DOUBLE AS impact FROM cg)"""


def _clones(spark, d):
    return clones.groups(a.table(spark, d, "documents").select(F.col("doc_id").alias("id"), source_hash("text").alias("exact"), token_count("text").alias("tokens")), "exact", "exact")


@query(f"WITH {CLONES} SELECT * FROM cg")
def clone_groups_exact(spark, d):
    return _clones(spark, d)


@query(f"WITH {CLONES} SELECT * FROM ci")
def clone_impact(spark, d):
    return clones.impact(_clones(spark, d))


@query(f"WITH {CLONES} SELECT round(coalesce(sum(impact), 0), 6) AS penalty, round(1 - least(1, round(coalesce(sum(impact), 0), 6) / 120), 9)::DOUBLE AS score FROM ci")
def clone_score(spark, d):
    return clones.score(clones.impact(_clones(spark, d)), 1000)


#: Structural: runs of letters are one class, all else stays; whole texts.
STRUCT = """m AS (SELECT doc_id AS id, md5(regexp_replace(text, '[A-Za-z]+', 'w', 'g')) AS hash, md5(text) AS text_hash, n_chars AS tokens, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (n_chars % 60)::INT AS changed_at FROM documents),
sz AS (SELECT hash, count(*) AS a, max(tokens) AS t FROM m WHERE tokens >= 30 GROUP BY hash HAVING count(*) > 1), tp AS (SELECT * FROM sz ORDER BY t DESC, a DESC, hash LIMIT 8),
nt AS (SELECT m.*, row_number() OVER (PARTITION BY hash ORDER BY id) AS r FROM m JOIN tp USING (hash) WHERE tokens >= 30),
gs AS (SELECT hash, count(*) AS members, count(DISTINCT text_hash) AS variants, count(*) FILTER (changed_at > TIMESTAMP '2024-02-29' - INTERVAL 30 DAY) AS recent FROM nt WHERE r <= 16 GROUP BY hash),
ic AS (SELECT hash, members, variants, recent, round((variants - 1) / (members - 1), 9)::DOUBLE AS divergence, 'high' AS confidence FROM gs WHERE members > 1 AND recent > 0 AND (variants - 1) / (members - 1) >= 0.5)"""


def _structural(spark, d):
    text = F.col("text")
    docs = a.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.regexp_replace(text, "[A-Za-z]+", "w")).alias("structural"), F.md5(text).alias("exact"), F.col("n_chars").alias("tokens"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("n_chars") % 60).cast("int"))).alias("changed_at"))
    return clones.structural(docs)


def _head():
    return F.lit("2024-02-29").cast("timestamp")


@query(f"WITH {STRUCT} SELECT * FROM ic")
def inconsistent_clones(spark, d):
    return clones.inconsistent(_structural(spark, d), _head())


@query(f"""WITH {STRUCT}, bad AS (SELECT * FROM ic WHERE divergence > 0.75), lm AS (SELECT CASE WHEN count(*) > 8 OR max(a) > 16 THEN 0.95 ELSE 1.0 END AS cap FROM sz),
c AS (SELECT least(0.75, coalesce((max(divergence) - 0.75) / 0.25, 0) * 0.25 + least(0.3, log2(count(*) + 1) * 0.12)) AS cost FROM bad)
SELECT round(greatest(0, least(cap, 1 - cost)), 9)::DOUBLE AS score FROM c, lm""")
def clone_divergence_score(spark, d):
    members = _structural(spark, d)
    return clones.divergence_score(clones.inconsistent(members, _head()), clones.limited(members))


SG = "sg AS (SELECT 'structural' AS kind, hash, count(*) AS members, max(tokens) AS tokens, min(id) AS representative FROM m WHERE tokens >= 12 GROUP BY hash HAVING count(*) > 1 AND count(DISTINCT text_hash) > 1)"


@query(f"WITH {STRUCT}, {SG} SELECT * FROM sg")
def structural_clone_hash(spark, d):
    return clones.groups(_structural(spark, d), "hash", "structural", "text_hash")


@query(f"WITH {STRUCT}, {SG} SELECT * FROM sg UNION ALL SELECT 'exact', text_hash, count(*), max(tokens), min(id) FROM m WHERE tokens >= 12 GROUP BY text_hash HAVING count(*) > 1")
def clone_groups_united(spark, d):
    return clones.united(_structural(spark, d))


@query(f"WITH {STRUCT}, {SG}, g AS (SELECT * FROM sg UNION ALL SELECT 'exact', text_hash, count(*), max(tokens), min(id) FROM m WHERE tokens >= 12 GROUP BY text_hash HAVING count(*) > 1), i AS (SELECT *, round(CASE WHEN kind = 'exact' THEN CASE WHEN tokens < 20 THEN 0 ELSE CASE WHEN tokens < 50 THEN 0.5 * log2(members) ELSE members - 1 END * 1.2 * greatest(0.3, least(3.0, tokens / 30)) END WHEN tokens < 30 THEN 0 ELSE (members - 1) * least(0.35, (tokens - 30) / 120) END, 9)::DOUBLE AS impact FROM g) SELECT kind, hash, members, tokens, representative, impact, row_number() OVER (ORDER BY impact DESC, members DESC, tokens DESC, kind, representative, hash)::INT AS \"rank\" FROM i")
def clone_group_order(spark, d):
    return clones.ordered(clones.impact(clones.united(_structural(spark, d))))


LOCK = "lock AS (SELECT DISTINCT l_partkey AS name, l_suppkey % 5 AS version, l_suppkey % 10 = 0 AS direct FROM lineitem)"


def _lock(spark, d):
    return a.table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), (F.col("l_suppkey") % 5).alias("version"), (F.col("l_suppkey") % 10 == 0).alias("direct")).distinct()


DUP = f"{LOCK}, dv AS (SELECT name, count(DISTINCT version) AS versions, count(DISTINCT version) FILTER (direct) AS direct, round(CASE WHEN count(DISTINCT version) FILTER (direct) > 0 THEN 2 + 0.15 * count(DISTINCT version) FILTER (direct) ELSE 0.35 + 0.03 * count(DISTINCT version) END, 9)::DOUBLE AS weight FROM lock GROUP BY name HAVING count(DISTINCT version) > 1)"


@query(f"WITH {DUP} SELECT * FROM dv")
def duplicate_versions(spark, d):
    return packages.duplicate_versions(_lock(spark, d))


@query(f"WITH {DUP} SELECT (SELECT count(DISTINCT name) FROM lock) AS packages, count(*) AS duplicates, round(1 - least(1, coalesce(sum(weight) / (SELECT count(DISTINCT name) FROM lock), 0)), 9)::DOUBLE AS score FROM dv")
def duplicate_version_score(spark, d):
    return packages.duplicate_score(_lock(spark, d))


#: Declared: parts a supplier shipped with flag A or N; used: those with R or N, R only for their types; brought: those of clerks' open lines.
HEALTH = """dc AS (SELECT l_suppkey AS owner, l_partkey AS name, bool_and(l_returnflag = 'A') AS dev FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL), us AS (SELECT l_suppkey AS owner, l_partkey AS name, max(CASE l_returnflag WHEN 'R' THEN 0.2 ELSE 1.0 END)::DOUBLE AS u FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY ALL),
rc AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS name, true AS r FROM lineitem WHERE l_discount >= 0.09),
pb AS (SELECT owner, name, CASE WHEN dev IS NULL AND r THEN 'transitive' WHEN dev IS NULL THEN 'missing' WHEN u IS NULL THEN 'unused' WHEN dev THEN 'dev-in-prod' END AS problem, coalesce(u, 1.0)::DOUBLE AS weight FROM dc FULL JOIN us USING (owner, name) LEFT JOIN rc USING (owner, name))"""


def _health(spark, d):
    lines = a.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("name"), (F.col("l_returnflag") == "A").alias("dev"), "l_returnflag", "l_discount")
    used = lines.where("l_returnflag IN ('R', 'N')").select("owner", "name", F.when(F.col("l_returnflag") == "R", "type-only").otherwise("runtime").alias("usage"))
    return packages.health(lines.where("l_returnflag IN ('A', 'N')"), used, lines.where("l_discount >= 0.09").select("owner", "name"))


@query(f"WITH {HEALTH} SELECT * FROM pb WHERE problem IS NOT NULL")
def package_health(spark, d):
    return _health(spark, d)


@query(f"WITH {HEALTH}, k AS (SELECT count(*) FILTER (problem = 'missing') AS missing, coalesce(sum(weight) FILTER (problem = 'missing'), 0) AS w, count(*) FILTER (problem = 'unused') AS unused, count(*) FILTER (problem = 'transitive') AS transitive, count(*) FILTER (problem = 'dev-in-prod') AS dev_in_prod FROM pb) SELECT missing, unused, transitive, dev_in_prod, round(1 - least(1, w / 99999 * 1.25 + unused / 5000000 + (transitive + dev_in_prod) / 2000000), 9)::DOUBLE AS score FROM k")
def package_health_score(spark, d):
    return packages.health_score(_health(spark, d), 100_000)


@query("WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_discount >= 0.1) SELECT (SELECT count(*) FROM part) AS pkgs, (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1)) AS duplicates, (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM e)::BIGINT AS depth, (SELECT count(*) FROM part WHERE p_size > 45) AS unused")
def cargo_tree(spark, d):
    crates = a.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("version"), (F.col("p_size") <= 45).alias("used"))
    edges = a.table(spark, d, "lineitem").where("l_discount >= 0.1").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return packages.cargo_tree(crates, edges)


@query("WITH t AS (SELECT o_orderkey AS sha, (o_totalprice / 500)::DOUBLE AS lines, (o_custkey % 3)::DOUBLE AS b, (o_custkey % 2)::DOUBLE AS p FROM orders) SELECT sha, round(greatest(0, 1 - CASE WHEN lines <= 100 THEN 0 WHEN lines <= 300 THEN 0.2 * (lines - 100) / 200 WHEN lines <= 500 THEN 0.2 + 0.2 * (lines - 300) / 200 ELSE least(0.6, 0.4 + (lines - 500) / 1000) END - 0.2 * b - 0.1 * p), 9)::DOUBLE AS score FROM t")
def pr_size(spark, d):
    orders = a.table(spark, d, "orders")
    return orders.select(F.col("o_orderkey").alias("sha"), F.round(findings.pr_size_score(F.col("o_totalprice") / 500, (F.col("o_custkey") % 3).cast("double"), (F.col("o_custkey") % 2).cast("double")), 9).alias("score"))


@query("SELECT round(sum(4 * a + b) / sum(4 * n + m), 9)::DOUBLE AS score FROM (SELECT l_linenumber AS n, least(l_linenumber, (l_quantity % 5)::INT) AS a, 1 AS m, (l_tax > 0.03)::INT AS b FROM lineitem)")
def annotation_coverage(spark, d):
    facts = a.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("params"), F.least("l_linenumber", (F.col("l_quantity") % 5).cast("int")).alias("params_annotated"), F.lit(1).alias("returns"), (F.col("l_tax") > 0.03).cast("int").alias("returns_annotated"))
    return findings.annotation_score(facts)


@query("WITH x AS (SELECT p_partkey, p_name AS e, p_type AS h FROM part), s AS (SELECT CASE WHEN l_partkey IS NULL THEN 'missing' WHEN p_partkey IS NULL THEN 'orphan' WHEN f = '-' THEN 'missing-provenance' WHEN f <> h THEN 'stale' ELSE 'fresh' END AS state FROM x FULL JOIN (SELECT l_partkey, CASE min(l_returnflag) WHEN 'A' THEN '-' ELSE min(l_returnflag) END AS f FROM lineitem GROUP BY 1) b ON l_partkey = p_partkey), w AS (SELECT sum(CASE state WHEN 'stale' THEN 5 WHEN 'missing' THEN 4 WHEN 'orphan' THEN 3 WHEN 'missing-provenance' THEN 2 ELSE 0 END) AS w FROM s) SELECT w::BIGINT AS weighted, round(1 / (1 + w / 8), 9)::DOUBLE AS score FROM w")
def contract_freshness(spark, d):
    built = F.when(F.min("l_returnflag") != "A", F.min("l_returnflag"))
    actual = a.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("artifact")).agg(built.alias("built_from"))
    expected = a.table(spark, d, "part").select(F.col("p_partkey").alias("artifact"), F.col("p_type").alias("source_hash"))
    return findings.freshness_score(findings.contract_states(expected, actual))


@query("SELECT l_returnflag AS flag, round(greatest(0, least(1, 1 - v / t)), 9)::DOUBLE AS score, round(avg_base * exp(-30 / 90.0), 9)::DOUBLE AS confidence FROM (SELECT l_returnflag, count(*) FILTER (l_discount > 0.08) AS v, count(*) AS t, avg(l_tax) AS avg_base FROM lineitem GROUP BY 1)")
def violation_share_and_decay(spark, d):
    sums = a.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.when(F.col("l_discount") > 0.08, 1)).alias("v"), F.count("*").alias("t"), F.avg("l_tax").alias("b"))
    return sums.select("flag", F.round(violation_share("v", "t"), 9).alias("score"), F.round(e_fold("b", 30, 90.0), 9).alias("confidence"))


@query("SELECT signal_id, file, line, severity, \"rank\"::INT AS \"rank\" FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY list_position(['block', 'warn', 'info'], severity), file, line, hash) AS \"rank\" FROM findings) WHERE \"rank\" <= 10", "findings")
def top_diagnostics(spark, d):
    return observer.top_diagnostics(a.findings(spark, d)).select("signal_id", "file", "line", "severity", "rank")


@query("SELECT count(*) AS commits FROM (SELECT o_orderkey FROM orders, (SELECT max(o_orderdate) AS h FROM orders) WHERE o_orderdate >= h - INTERVAL 90 DAY AND o_orderstatus <> 'F')")
def commit_count(spark, d):
    parents = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return history.commit_count(a.table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("committed_at"), parents.alias("parents")), 90)


@query("WITH c AS (SELECT l_partkey AS id, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS changed_in, max(l_shipdate) AS changed_at FROM lineitem, part WHERE l_partkey = p_partkey AND l_linenumber BETWEEN 2 AND 2 + p_size % 3 GROUP BY 1) SELECT p_partkey AS id, changed_in, changed_at FROM part LEFT JOIN c ON id = p_partkey")
def last_change_of_range(spark, d):
    blamed = a.table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("sha"), F.col("l_shipdate").alias("at"))
    places = a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("file"), F.lit(2).alias("start"), (2 + F.col("p_size") % 3).alias("end"))
    return history.last_change(blamed, places)


@query("SELECT count(*) AS functions, count(*) FILTER (complexity > 20) AS \"over\", max(complexity) AS worst, round(1 - greatest(least(1, 2 * count(*) FILTER (complexity > 20) / count(*)), greatest(0, (max(complexity) - 20) / max(complexity))), 9)::DOUBLE AS score FROM files", "files")
def complexity_score(spark, d):
    return findings.complexity_score(a.files(spark, d))


@query("""WITH u AS (SELECT count(*) AS n, count(*) FILTER (loc > 100) AS o, max(loc) AS m FROM files), p AS (SELECT package, sum(loc) AS loc FROM files GROUP BY package), f AS (SELECT count(*) AS n, count(*) FILTER (loc > 9000) AS o, max(loc) AS m FROM p)
SELECT u.o AS function_outliers, f.o AS file_outliers, round(1 - greatest(least(1, 2 * (u.o + f.o) / (u.n + f.n)), greatest(0, (u.m - 100) / u.m), greatest(0, (f.m - 9000) / f.m)), 9)::DOUBLE AS score FROM u, f""", "files")
def size_distribution(spark, d):
    f = a.files(spark, d)
    return findings.size_score(f, f.groupBy("package").agg(F.sum("loc").alias("loc")), 100, 9000)


@query("""WITH m AS (SELECT l_suppkey AS module, count(DISTINCT l_partkey) AS ext FROM lineitem GROUP BY l_suppkey), r AS (SELECT ext, row_number() OVER (ORDER BY ext) - 1 AS i, count(*) OVER () AS n FROM m), t AS (SELECT greatest(1, avg(ext), max(ext) FILTER (i = floor(0.95 * (n - 1)))) AS t FROM r)
SELECT count(*) AS modules, round(max(t), 9)::DOUBLE AS threshold, round(greatest(0, least(1, 1 - coalesce(sum((ext - t) / t) FILTER (ext > t) / count(*), 0))), 9)::DOUBLE AS score FROM m, t""")
def type_coupling(spark, d):
    return findings.coupling_score(a.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("module")).agg(F.count_distinct("l_partkey").alias("ext")))


@query("SELECT round(max(w), 6)::DOUBLE AS largest, round(greatest(0, least(1, 1 - greatest(0, 0.5 * log10(max(w) / 50)))), 9)::DOUBLE AS score FROM (SELECT l_suppkey AS file, sum(l_quantity) AS w FROM lineitem GROUP BY 1)")
def export_surface(spark, d):
    return findings.surface_score(a.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_quantity").alias("weight")))


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'framework-consumed' WHEN n IS NULL THEN 'unused' WHEN n < 25 THEN 'internal-only' ELSE 'cross-boundary' END AS reach, 1.0 + p_size % 3 AS weight FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)
SELECT count(*) AS exports, round(greatest(0, least(1, 1 - coalesce(sum(CASE reach WHEN 'unused' THEN weight WHEN 'internal-only' THEN 0.5 * weight ELSE 0 END) / sum(weight), 0))), 9)::DOUBLE AS score FROM e WHERE reach <> 'framework-consumed'""")
def unused_exports(spark, d):
    used = a.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    reach = F.when(F.col("p_size") % 7 == 0, "framework-consumed").when(F.col("n").isNull(), "unused").when(F.col("n") < 25, "internal-only").otherwise("cross-boundary")
    return findings.unused_score(a.table(spark, d, "part").join(used, "p_partkey", "left").select(reach.alias("reach"), (1.0 + F.col("p_size") % 3).alias("weight")))


@query("""WITH i AS (SELECT c_custkey, count(o_orderkey) AS impls FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), k AS (SELECT count(*) AS n, count(*) FILTER (impls = 1) AS o, count(*) FILTER (impls = 0) AS z FROM i)
SELECT n AS interfaces, o AS single, z AS dead, round(1 - greatest(least(1, o / n / 0.5) * least(1, n / 5), least(1, z / n) * 0.25 * least(1, n / 5)), 9)::DOUBLE AS score FROM k""")
def interface_implementations(spark, d):
    orders = a.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("impls"))
    return findings.implementation_score(a.table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("impls", F.lit(0)).alias("impls")))
