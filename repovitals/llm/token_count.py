"""Token counts by the whole-token shortcut.

Each process asks the library once for every string of the vocabulary; those it
encodes as one id are the proven set. Pre-tokens in that set count one; only the
others are merged, once for each distinct piece in the cache. Texts outside the
shortcut's proof (see tokens.py) are counted from the library's encoding.

A null text has no bytes and no tokens. Every row gives a row; other columns of
the input are dropped unless named in `keep`."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder


class _Pieces:
    """Counts of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str | None) -> int:
        return len(self.model.encode(text)) if text else 0


_models: dict[str, _Pieces] = {}


def counter(path: str):
    """What counts for a tokenizer file: .model by sentencepiece, all else by tokenizers."""
    if path.endswith(".model"):
        if path not in _models:
            _models[path] = _Pieces(path)
        return _models[path]
    return encoder(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                t = text.as_py()
                n_bytes.append(len(t.encode()) if t else 0)
                n_tokens.append(count(t))
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
