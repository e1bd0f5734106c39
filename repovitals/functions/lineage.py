"""Cutting lineage in loops, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set on the context; a folder of our own in local runs that set neither.

    On a cluster that would be a folder of one machine, so there it is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if (chosen := context._jsc.sc().getCheckpointDir()).isDefined():
        return chosen.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="repovitals-")
    return _own[context.applicationId]


def materialised(df: DataFrame, name: str = "step", instead_of: DataFrame | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again; the files go when the JVM ends.

    instead_of: an earlier step's frame that nothing reads any more once df is written; its files go at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/repovitals-steps/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    df.write.parquet(path)
    if (old := getattr(instead_of, "step_path", None)) is not None:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    out = spark.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out
