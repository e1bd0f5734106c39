"""The corpus operators applied to whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, licenses, lm_mixing, oracles, partenum, pii_surrogates, source_mix, token_count, token_huffman
from .common import fold, new_path


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "huffman")
    token_huffman.write(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=0)
    return token_huffman.read(spark, path, with_ids=False)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace(table(spark, sf_dir, "documents"), key="repovitals")


def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(table(spark, sf_dir, "documents"))


def op6_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.scores(table(spark, sf_dir, "documents"), held_fold=2)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.training_fold(docs))
    return langid.predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op9_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=80)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_huffman": op1_token_huffman,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_adaptive_scan": op4_adaptive_scan,
    "op5_license_rules": op5_license_rules,
    "op6_lm_mixing": op6_lm_mixing,
    "op7_langid": op7_langid,
    "op8_source_mix": op8_source_mix,
    "op9_partenum": op9_partenum,
    "op10_token_counts": op10_token_counts,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
