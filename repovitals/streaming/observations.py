"""Observations as a stream: appended once, rolled up by week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

SCHEMA = "sha string, ts timestamp, category string, score double"


def source(spark: SparkSession, path: str, schema: str = SCHEMA, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once(rows: DataFrame) -> DataFrame:
    """Observations of a (sha, category) the first time only, however late: the keys stay in the state store."""
    return rows.dropDuplicates(["sha", "category"])


def append_once(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's observations that the store lacks: late ones too, which the next compaction merges into their week."""
    from ..sources.readers import write_observations

    return rows.writeStream.foreachBatch(lambda batch, _: write_observations(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift(rows: DataFrame) -> DataFrame:
    """(category, high, last, deficit) after each batch: the running maximum of a category's scores, its last score, and the sum of
    shortfalls since the maximum was last reached. Rows of a batch count in order of time; state is one row a category."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        high, last, deficit = state.get if state.exists else (None, None, 0.0)
        for x in pd.concat(list(batches)).sort_values(["ts", "sha"])["score"].tolist():
            if high is None or x >= high:
                high, deficit = x, 0.0
            else:
                deficit += high - x
            last = x
        state.update((high, last, deficit))
        yield pd.DataFrame({"category": [key[0]], "high": [high], "last": [last], "deficit": [round(deficit, 9)]})

    told = "category string, high double, last double, deficit double"
    return rows.groupBy("category").applyInPandasWithState(step, told, "high double, last double, deficit double", "update", GroupStateTimeout.NoTimeout)


def weekly(rows: DataFrame, delay: str = "90 days") -> DataFrame:
    """(category, week_start, score, samples) of Monday weeks, out when the watermark has passed them."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return rows.withWatermark("ts", delay).groupBy("category", week.alias("w")).agg(F.avg("score").alias("score"), F.count("*").alias("samples")).select("category", F.col("w.start").alias("week_start"), "score", "samples")


def sliding(rows: DataFrame, days: int = 14, delay: str = "1 day") -> DataFrame:
    """(category, until, score) of the last `days` days, each day."""
    w = F.window("ts", f"{days} days", "1 day")
    return rows.withWatermark("ts", delay).groupBy("category", w.alias("w")).agg(F.avg("score").alias("score")).select("category", F.col("w.end").alias("until"), "score")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes to a Parquet folder parted by day, each batch exactly once, until what is there has been read."""
    return rows.withColumn("day", F.to_date("ts")).writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start(path)


def notify(rows: DataFrame, on_batch, checkpoint: str) -> StreamingQuery:
    """Calls on_batch(frame, number) for each batch of new observations."""
    return rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
