"""Corpus pipeline: language ID, near copies, benchmark passages, source mix, token files.

STAGES lists (name, function of (spark, docs, sf_dir)). Each stage's result is
written as Parquet and read again as the next one's docs, so a lost executor
costs a task and not a stage. All but the last return the columns of documents.

Nulls and repeats follow the operators: documents without a letter go at the
first stage, so a null text doesn't get past it; a document with a null doc_id
links with nothing; rows of a doc_id with the same text are one document to the
join, and rows with different texts are documents of their own. Rows that are
alike in doc_id, source and text are one document to the mix."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repovitals.llm import decontaminate, langid, partenum, source_mix, token_huffman
from repovitals.llm.common import new_path, written
from repovitals.llm.queries import tokenizer_path

#: The stages train, hash and encode in Python; SQL has no equal for them. Tested against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier doesn't reject."""
    return langid.keep(docs, langid.train(langid.training_fold(docs)))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds row_key: the doc_id, but another number for each further text (by its hash) under a doc_id."""
    spark = docs.sparkSession
    prints = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_print"))
    several = written(prints.groupBy("doc_id").agg(F.min("text_print").alias("first"), F.max("text_print").alias("last")).where("first <> last"), "several")
    if several.isEmpty():
        return docs.withColumn("row_key", F.col("doc_id"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    start, step = (high + 1, 1) if high < 1 << 62 else (low - 1, -1)
    others = prints.join(several, "doc_id").where("text_print <> first").select("doc_id", "text_print").distinct().orderBy("doc_id", "text_print")
    numbers = spark.createDataFrame(others.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], start + step * x[1])), "doc_id long, text_print long, other_key long")
    marked = docs.withColumn("text_print", F.xxhash64("text")).join(written(numbers, "numbers"), ["doc_id", "text_print"], "left")
    return written(marked.select(*docs.columns, F.coalesce("other_key", "doc_id").alias("row_key")), "keyed")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each component of near copies, once: of the smallest doc_id, further texts under a doc_id last."""
    keyed = _keyed(docs)
    found = partenum.jaccard_components(keyed.select(F.col("row_key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row_key")
    gone = written(found.where("component_id <> row_key").select("row_key").distinct(), "gone")
    kept = keyed.join(gone, "row_key", "left_anti").select("row_key", *docs.columns)
    repeated = written(found.where("row_key IS NOT NULL").groupBy("row_key").count().where("count > 1").select("row_key"), "repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated, "row_key", "left_semi").groupBy("row_key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(repeated, "row_key", "left_anti").select(*docs.columns).unionByName(once)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes its words, to the nearest time; 0 times drops it.

    Rows are in the order of the mix's schedule, which the files keep. Rows without doc_id take part."""
    return source_mix.copies(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and returns what is read back: doc_id, start, n_tokens, ids_crc32.

    Documents that come from files are written in the order of the files' names and rows, which is the mix's; others by doc_id."""
    path = new_path(spark, "tokens")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        docs.select(place)
    except AnalysisException:  # not rows of files
        place = None
    token_huffman.write(docs, path, tokenizer_path(), end_id=0, place=place)
    return token_huffman.read(spark, path, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("source_mix", mixed),
    ("token_output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
