"""Aggregates and ranks whose definition differs from the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distribution(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """max, p95, avg, sum, n of a column; p95 is the sorted value at floor(0.95 (n - 1)); zeros without rows.

    Ranked by a window over the group and then summed up, so no group is gathered in an array."""
    by = by or []
    part = W.partitionBy(*by) if by else W.partitionBy()
    ranked = values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    if by:
        ranked = ranked.withColumn("i", F.row_number().over(part.orderBy("v")) - 1).withColumn("n", F.count("*").over(part))
        p95 = F.max(F.when(F.col("i") == F.floor(0.95 * (F.col("n") - 1)), F.col("v")))
        return ranked.groupBy(*by).agg(F.max("v").alias("max"), p95.alias("p95"), F.avg("v").alias("avg"), F.sum("v").alias("sum"), F.count("*").alias("n"))
    # One group: counts of each value, so that only distinct values are ordered in one task.
    counted = ranked.groupBy("v").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(W.orderBy("v"))).withColumn("n", F.sum("k").over(part))
    p95 = F.min(F.when(F.col("upto") > F.floor(0.95 * (F.col("n") - 1)), F.col("v")))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return counted.agg(zero(F.max("v")).alias("max"), zero(p95).alias("p95"), zero(F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("avg"), zero(F.sum(F.col("v") * F.col("k"))).alias("sum"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


def inclusive_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the share of the others that are no larger; 1 for a single row. Ranks distinct values, then joins."""
    counted = df.groupBy(value).agg(F.count("*").alias("__k")).withColumn("__upto", F.sum("__k").over(W.orderBy(value))).withColumn("__n", F.sum("__k").over(W.partitionBy()))
    ranks = counted.select(value, F.when(F.col("__n") <= 1, 1.0).otherwise((F.col("__upto") - 1) / (F.col("__n") - 1)).alias(name))
    return df.join(ranks, value)


def global_rank(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """Adds the place of each row by value, largest first, and tie. The value (a double from 0 to 1) is dealt to
    RANK_CELLS cells, so that only counts of cells are ordered in one task and rows are ordered within their cell."""
    cell = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(value))) * RANK_CELLS)
    placed = df.withColumn("__c", F.coalesce(cell, F.lit(-1)))
    before = F.coalesce(F.sum("__k").over(W.orderBy(F.desc("__c")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = placed.groupBy("__c").agg(F.count("*").alias("__k")).withColumn("__b", before).select("__c", "__b")
    inside = F.row_number().over(W.partitionBy("__c").orderBy(F.desc(value), tie))
    return placed.withColumn("__r", inside).join(F.broadcast(cells), "__c").withColumn(name, (F.col("__r") + F.col("__b")).cast("int")).drop("__c", "__r", "__b")


#: Cells that values from 0 to 1 are dealt to for a rank: at most so many rows of counts are broadcast.
RANK_CELLS = 4096


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def p_norm(pressure: Column, weight: Column, p: float = 4) -> Column:
    return F.coalesce(F.pow(F.sum(weight * F.pow(pressure, F.lit(float(p)))) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(1 / p)), F.lit(0.0))
