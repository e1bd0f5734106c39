"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words everywhere in this subpackage: what bytes.split() splits at.
WORD = "[^\\x20\\x09-\\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Local runs that set neither get one of their own; on a cluster that would be a folder of one machine, so it is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if (chosen := context._jsc.sc().getCheckpointDir()).isDefined():
        return chosen.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="repovitals-")
    return _own_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the JVM deletes it when it ends."""
    path = f"{shared_dir(spark)}/repovitals/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again.

    instead_of: an earlier step that nothing reads any more once df is written; its files go at once.

    Unlike an executor-local checkpoint, lost executors don't lose it; unlike
    checkpoint() it is columnar and computed once. The driver lets go of memory first."""
    let_go()
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if (old := getattr(instead_of, "step_path", None)) is not None:
        drop_path(df.sparkSession, old)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(df: DataFrame, each: int) -> int:
    """Tasks for work that grows with df: the shuffle partitions, and more where a task would get more than `each` input bytes.

    By Spark's own estimate of the table's size, which the driver has without a job."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), min(100_000, -(-size // each)) if size < 1 << 50 else 1)


def fold(doc_id, modulus: int):
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, as UTF-8."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it has grown to `limit` words."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of x in order, as np.unique gives them: by a sort, which takes a tenth of the time of its table."""
    x = np.sort(x)
    if not len(x):
        return x
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """64-bit hash of every run of `width` words, in order; the whole sequence as one when it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(width, n)
    total = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        total = total + hashes[i : n - k + 1 + i] * (_MULT[i % 5] + np.uint64(2 * (i // 5)))
    return mix64(total)


def let_go() -> None:
    """Frees what earlier tasks of other operators left in this process: the tokenizers' caches, some 200 MB when they are full,
    and memory that Arrow and the C library keep for later. Python workers live on from stage to stage."""
    if (used := sys.modules.get(f"{__package__}.tokens")) is not None and used._encoders:
        used._encoders.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # of glibc
        trim(0)


def lean(run):
    """run, a function for mapInArrow, in a process that lets go first."""

    def task(batches):
        let_go()
        yield from run(batches)

    return task


def exchanges_go(spark: SparkSession) -> None:
    """Has Spark delete the files of exchanges that nothing refers to any more: it does so when the JVM collects garbage,
    after Python has collected the frames; in a trial the third round did it."""
    for _ in range(4):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
