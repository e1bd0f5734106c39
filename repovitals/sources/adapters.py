"""The warehouse tables recast as facts of a repository's history.

An order is a commit, its customer the author, its date the commit date; a line
item touches a file, the part; a part's brand is its package. Events are scored
observations and, by consecutive users of a kind, edges of a dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("committed_at"), F.col("o_custkey").alias("author"))


def touches(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(sha, committed_at, author, file, added): one row for each file of a commit. only: (sha), few commits that line items are cut to before they are summed."""
    items = table(spark, sf_dir, "lineitem")
    if only is not None:
        items = items.join(F.broadcast(only.select(F.col("sha").alias("l_orderkey"))), "l_orderkey", "left_semi")
    lines = items.groupBy(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file")).agg(F.sum("l_quantity").alias("added"))
    return lines.join(commits(spark, sf_dir), "sha").select("sha", "committed_at", "author", "file", "added")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("package"), F.col("p_type").alias("kind"), F.col("p_size").alias("complexity"), F.floor(F.col("p_retailprice") / 10).cast("long").alias("loc"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, ts, category, signal, score)."""
    k = F.regexp_extract("props", "(\\d+)", 1).cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sha"), "ts", F.col("event_type").alias("category"), k.alias("signal"), F.greatest(F.lit(0.0), 1 - F.col("value") / 500).alias("score"))


def signal_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (category, signal): mean score and the registry's attributes, made from the signal's number."""
    k = F.col("signal")
    tier = F.element_at(F.array(F.lit(1.0), F.lit(1.5), F.lit(2.0)), k % 3 + 1)
    return observations(spark, sf_dir).groupBy("category", "signal").agg(F.round(F.avg("score"), 9).alias("score")).select(
        "category", F.concat(F.col("category"), F.lit("/"), k.cast("string")).alias("signal_id"), "score", tier.alias("tier"), (1 + (k % 4) * 0.25).alias("weight"),
        F.element_at(F.array(F.lit(1.0), F.lit(0.95), F.lit(0.85)), k % 3 + 1).alias("confidence"), F.when(k % 2 == 0, "typescript").otherwise("rust").alias("grp"),
        F.when(k % 11 == 0, "not_applicable").when(k % 29 == 0, "failed").when(k % 23 == 0, "insufficient_evidence").otherwise("applicable").alias("applicability"),
        ((k % 3 < 2) & (k % 5 == 0)).alias("authority"), (k % 13 == 0).alias("provider"))


def edges(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """(src, dst, weight): transitions between users of consecutive events of a kind, seen `least` times.

    Events are ordered within an hour; the last one of an hour meets the first of the kind's next hour, so a kind is many tasks."""
    hourly = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    inside = W.partitionBy("event_type", "hour").orderBy("ts", "event_id")
    step = hourly.withColumn("dst", F.lead("user_id").over(inside)).withColumn("last", F.lead("event_id").over(inside).isNull())
    firsts = hourly.groupBy("event_type", "hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    after = firsts.withColumn("next", F.lead("first").over(W.partitionBy("event_type").orderBy("hour"))).select("event_type", "hour", "next")
    met = step.join(after, ["event_type", "hour"]).withColumn("dst", F.when(F.col("last"), F.col("next")).otherwise(F.col("dst")))
    return met.where("dst IS NOT NULL AND dst <> user_id").groupBy(F.col("user_id").alias("src"), "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, file, line, severity, hash, baseline): line items as diagnostics; those shipped early are the baseline's."""
    message = F.concat_ws(" ", F.lit("finding"), F.col("l_partkey").cast("string"), F.col("l_returnflag"), (F.col("l_quantity") % 7).cast("int").cast("string"))
    severity = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_discount") >= 0.08, "block").otherwise("warn")).otherwise("info")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S-"), F.col("l_returnflag")).alias("signal_id"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), severity.alias("severity"), F.sha2(message, 256).alias("hash"), (F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp")).alias("baseline"))


#: The same views for DuckDB, as common table expressions.
CTE = {
    "commits": "commits AS (SELECT o_orderkey AS sha, o_orderdate AS committed_at, o_custkey AS author FROM orders)",
    "touches": "touches AS (SELECT l_orderkey AS sha, any_value(o_orderdate) AS committed_at, any_value(o_custkey) AS author, l_partkey AS file, sum(l_quantity) AS added FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey)",
    "files": "files AS (SELECT p_partkey AS file, p_brand AS package, p_type AS kind, p_size AS complexity, floor(p_retailprice / 10)::BIGINT AS loc FROM part)",
    "observations": "observations AS (SELECT event_id AS sha, ts, event_type AS category, regexp_extract(props, '(\\d+)', 1)::INT AS signal, greatest(0.0, 1 - value / 500) AS score FROM events)",
    "signal_results": """signal_results AS (SELECT category, category || '/' || signal::VARCHAR AS signal_id, round(avg(score), 9) AS score, [1.0, 1.5, 2.0][signal % 3 + 1]::DOUBLE AS tier, (1 + (signal % 4) * 0.25)::DOUBLE AS weight,
        [1.0, 0.95, 0.85][signal % 3 + 1]::DOUBLE AS confidence, CASE WHEN signal % 2 = 0 THEN 'typescript' ELSE 'rust' END AS grp,
        CASE WHEN signal % 11 = 0 THEN 'not_applicable' WHEN signal % 29 = 0 THEN 'failed' WHEN signal % 23 = 0 THEN 'insufficient_evidence' ELSE 'applicable' END AS applicability,
        (signal % 3 < 2 AND signal % 5 = 0) AS authority, signal % 13 = 0 AS provider FROM observations GROUP BY category, signal)""",
    "edges": "edges AS (SELECT user_id AS src, dst, count(*) AS weight FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND dst <> user_id GROUP BY user_id, dst HAVING count(*) >= 3)",
    "findings": "findings AS (SELECT 'S-' || l_returnflag AS signal_id, l_partkey AS file, l_linenumber AS line, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_discount >= 0.08 THEN 'block' ELSE 'warn' END ELSE 'info' END AS severity, sha256('finding ' || l_partkey::VARCHAR || ' ' || l_returnflag || ' ' || (l_quantity % 7)::INT::VARCHAR) AS hash, l_shipdate < TIMESTAMP '1998-06-01' AS baseline FROM lineitem)",
}
NEEDS = {"signal_results": ["observations"]}


def with_views(sql: str, *names: str) -> str:
    """sql after the views it reads; sql may begin with further views (WITH)."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    sql = sql.strip()
    more = sql[5:].strip() if sql[:5].upper() == "WITH " else None
    head = "WITH RECURSIVE " + ", ".join(CTE[n] for n in order)
    return f"{head}, {more}" if more else f"{head} {sql}"
