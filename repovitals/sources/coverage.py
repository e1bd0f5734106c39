"""Coverage reports as facts: LCOV and Istanbul."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fact(covered: Column, total: Column, name: str) -> Column:
    """pct is 1 where there is nothing to cover."""
    pct = F.when(total == 0, 1.0).otherwise(covered / total)
    return F.struct(covered.cast("long").alias("covered"), total.cast("long").alias("total"), pct.alias("pct")).alias(name)


def _stated(rows: Column, tag: str, counted: Column) -> Column:
    """A report's own total, unless it is 0 or can't be read: then what was counted."""
    said = F.try_element_at(F.filter(F.transform(rows, lambda r: F.regexp_extract(r, f"^{tag}:(\\d+)$", 1)), lambda x: x != ""), F.lit(1)).cast("long")
    return F.coalesce(F.when(said > 0, said), counted)


def read_lcov(texts: DataFrame) -> DataFrame:
    """(file, lines, functions, branches) of each record of LCOV texts (value), whole files in `value`."""
    records = texts.select(F.explode(F.split("value", "end_of_record")).alias("record")).select(F.split(F.trim("record"), "\\s*\\n\\s*").alias("rows"))
    found = records.withColumn("file", F.try_element_at(F.filter("rows", lambda r: r.startswith("SF:")), F.lit(1))).where("file IS NOT NULL")

    def metric(tag: str, hit: str, total: str, taken: str, name: str) -> Column:
        own = F.filter("rows", lambda r: r.startswith(f"{tag}:"))
        return _fact(_stated(F.col("rows"), hit, F.size(F.filter(own, lambda r: r.rlike(taken)))), _stated(F.col("rows"), total, F.size(own)), name)

    return found.select(F.substring("file", 4, 1_000_000).alias("file"), metric("DA", "LH", "LF", "^DA:\\d+,[1-9]", "lines"), metric("FNDA", "FNH", "FNF", "^FNDA:[1-9]", "functions"), metric("BRDA", "BRH", "BRF", "^BRDA:.*,[1-9]\\d*$", "branches"))


def read_istanbul(texts: DataFrame) -> DataFrame:
    """The same facts of Istanbul JSON (value): statement, function and branch hit maps by file."""
    schema = "map<string, struct<s: map<string, long>, f: map<string, long>, b: map<string, array<long>>>>"
    files = texts.select(F.explode(F.from_json("value", schema, {"mode": "FAILFAST"})).alias("file", "m"))
    hits = lambda m: F.map_values(F.coalesce(m, F.create_map().cast("map<string,bigint>")))
    some = lambda v: F.size(F.filter(v, lambda x: x > 0))
    s, f, b = hits(F.col("m.s")), hits(F.col("m.f")), F.flatten(F.map_values(F.coalesce(F.col("m.b"), F.create_map().cast("map<string,array<bigint>>"))))
    return files.select("file", _fact(some(s), F.size(s), "lines"), _fact(some(f), F.size(f), "functions"), _fact(some(b), F.size(b), "branches"))


def summary(facts: DataFrame) -> DataFrame:
    """Facts added up by file, with `state`: zero where nothing is covered or there is nothing to cover."""
    total = lambda k: _fact(F.sum(f"{k}.covered"), F.sum(f"{k}.total"), k)
    return facts.groupBy("file").agg(total("lines"), total("functions"), total("branches")).withColumn("state", F.when((F.col("lines.total") == 0) | (F.col("lines.covered") == 0), "zero").otherwise("present"))
