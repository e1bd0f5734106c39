"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word, in lower case between "<" and ">", has the byte n-grams of 2 to 4 bytes
that lie in it, each hashed to a row of an embedding table; a text is the mean
of the rows of all its words' n-grams, and a linear layer with softmax tells
languages apart. Embeddings and layer are trained by stochastic gradient
descent in numpy on the driver, from the hashed counts of at most `sample`
different labelled texts (those whose keyed hashes of doc_id, and then of text
and label, are the smallest; whole texts): the one bound here, documented
because it limits only what a classifier is fitted on. Counts stay sparse.

Calibration, on every fifth of those texts, which descent doesn't see: a
temperature that minimises their log loss, and a rejection threshold, the
largest one up to 0.5 that rejects at most one in a thousand of the texts
predicted right. A text is rejected when its score is below the threshold, or
when it is `und`: null or without a letter (score 0).

A text's scores are sums over its words, so words are scored once per process
and cached. Nulls: a null doc_id counts as an empty text for folds; rows with a
null lang aren't learned from. Without any labelled text all are `und`. Repeated
rows each give a row. predict() drops other columns, keep() keeps all."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lean

BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
_LETTERS = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))
_LATIN = re.compile("[A-Za-z]")


def letter_words(text: str | None) -> list[bytes]:
    """Words of letters; none where the text has no letter at all."""
    if not text or not (_LATIN.search(text) or any(c.isalpha() for c in text)):
        return []
    return text.lower().encode().translate(_LETTERS).split()


def subwords(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, and the word that each is of."""
    data = np.frombuffer(b"<" + b"><".join(found) + b">", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 2
    word = np.repeat(np.arange(len(found)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes from here to the word's end
    rows, words = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint32)
        for i in range(n):
            h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        inside = left[: len(h)] >= n
        rows.append((h >> np.uint32(17))[inside])
        words.append(word[: len(h)][inside])
    return np.concatenate(rows).astype(np.int64), np.concatenate(words)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (BUCKETS, languages): embeddings times layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


class Scorer:
    """Scores of whole texts, with a cache of words' sums that is emptied at `limit` words."""

    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(model.langs) + 1), np.float64)

    def learn(self, found: set[bytes]) -> None:
        new = [w for w in found if w not in self.rows]
        if len(self.rows) + len(new) > self.limit:
            self.rows.clear()
            new = list(found)
        if not new:
            return
        start = len(self.rows)
        while len(self.table) < start + len(new):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        rows, words = subwords(new)
        k = len(self.model.langs)
        for j in range(k):
            self.table[start : start + len(new), j] = np.bincount(words, self.model.logits[rows, j], len(new))
        self.table[start : start + len(new), k] = np.bincount(words, minlength=len(new))
        self.rows.update(zip(new, range(start, start + len(new)), strict=True))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, probability) of each text; `und` and 0 where it has no letter."""
        each = [letter_words(t) for t in texts]
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.model.langs:
            return langs, scores
        self.learn(set().union(*each))
        sums = np.zeros((len(texts), self.table.shape[1]))
        for i, found in enumerate(each):
            if found:
                sums[i] = self.table[np.fromiter(map(self.rows.__getitem__, found), np.int64, len(found))].sum(0)
        full = np.flatnonzero(sums[:, -1])
        p = softmax((sums[full, :-1] / sums[full, -1:] + self.model.bias) / self.model.temperature)
        best = p.argmax(1)
        scores[full] = p[np.arange(len(full)), best]
        for i, j in zip(full.tolist(), best.tolist(), strict=True):
            langs[i] = self.model.langs[j]
        return langs, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bags(docs: DataFrame) -> DataFrame:
    """(lang, rows, share): the hashed n-grams of each whole text, at most BUCKETS of them, and their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if found := letter_words(text.as_py()):
                    n = np.bincount(subwords(found)[0], minlength=BUCKETS)
                    used = np.flatnonzero(n)
                    out.append((lang, used.astype("<u2").tobytes(), (n[used] / n.sum()).astype("<f4").tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["lang", "used", "share"])

    return docs.select("lang", "text").mapInArrow(lean(run), "lang string, used binary, share binary")


@dataclass
class Bags:
    """Sparse rows: text i has the n-grams used[start[i]:start[i + 1]] with these shares, which are never none."""

    start: np.ndarray
    used: np.ndarray
    share: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(used, share, first entry of each) of some rows, one after the other."""
        size = self.start[rows + 1] - self.start[rows]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(self.start[rows] - first, size)
        return self.used[place].astype(np.int64), self.share[place], first

    def times(self, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The rows as a matrix times a table with a row for each n-gram."""
        out = np.zeros((len(rows), table.shape[1]), table.dtype)
        for lo in range(0, len(rows), 64):
            used, share, first = self.at(rows[lo : lo + 64])
            out[lo : lo + 64] = np.add.reduceat(table[used] * share[:, None], first, 0)
        return out


def sampled(labelled: DataFrame, sample: int, seed: int) -> DataFrame:
    """At most `sample` different (doc_id, text, lang) with a text and a label, chosen by their hashes alone."""
    plain = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    by_id = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit("")))
    hashed = plain.withColumn("h", by_id).withColumn("t", F.xxhash64(F.lit(seed), "text", "lang"))
    last = hashed.select("h", "t").distinct().orderBy("h", "t").limit(sample).orderBy(F.desc("h"), F.desc("t")).first()  # no text goes to one task
    if last is None:
        return plain.limit(0).select("text", "lang")
    some = hashed.where((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("t") <= last["t"]))
    return some.groupBy("h", "t").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.text", "row.lang")


def train(labelled: DataFrame, sample: int = 3000, epochs: int = 12, batch: int = 32, rate: float = 0.5, seed: int = 0) -> Model:
    """Fits a model to labelled (doc_id, text, lang), from at most `sample` of its texts."""
    rows = sorted((r["lang"], bytes(r["used"]), bytes(r["share"])) for r in bags(sampled(labelled, sample, seed)).collect())
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    chance = np.random.default_rng(seed)
    x = Bags(np.cumsum([0, *(len(r[1]) // 2 for r in rows)]), np.frombuffer(b"".join(r[1] for r in rows), "<u2"), np.frombuffer(b"".join(r[2] for r in rows), "<f4"))
    y = np.array([langs.index(r[0]) for r in rows])
    del rows
    order = chance.permutation(len(x))
    held, fit = (order[::5], np.setdiff1d(order, order[::5])) if len(x) >= 50 else (order, order)
    emb = (chance.normal(0, 1 / DIM, (BUCKETS, DIM))).astype(np.float32)
    layer, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    seen = [np.full_like(a, 1e-8) for a in (emb, layer, bias)]  # squared gradients, for steps by coordinate
    for _ in range(epochs):
        for at in np.array_split(chance.permutation(fit), max(1, len(fit) // batch)):
            used, share, first = x.at(at)
            h = np.add.reduceat(emb[used] * share[:, None], first, 0)
            d = softmax(h @ layer + bias)
            d[np.arange(len(at)), y[at]] -= 1
            d = (d / len(at)).astype(np.float32)
            each, index = np.unique(used, return_inverse=True)
            pull = np.zeros((len(each), len(at)), np.float32)
            pull[index, np.repeat(np.arange(len(at)), np.diff(np.append(first, len(used))))] = share
            grad = pull @ (d @ layer.T)  # of the batch's own n-grams: all others' are 0
            seen[0][each] += grad * grad
            emb[each] -= rate * grad / np.sqrt(seen[0][each])
            for value, grad, sq, step in ((layer, h.T @ d, seen[1], rate / 5), (bias, d.sum(0), seen[2], rate / 50)):
                sq += grad * grad
                value -= step * grad / np.sqrt(sq)
    model = Model(langs, (emb @ layer).astype(np.float64), bias.astype(np.float64))
    z = x.times(held, model.logits) + model.bias
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y[held]])
    model.threshold = float(min(0.5, right[len(right) // 1000])) if len(right) else 0.0
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of docs (doc_id, text)."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(kept.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                langs, scores = scorer.score(part.column(1).to_pylist())
                rejected = (scores < kept.value.threshold) | np.array([x == "und" for x in langs], bool)
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject."""
    kept, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(kept.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                langs, scores = scorer.score(part.column(at).to_pylist())
                yield part.filter(pa.array([s >= kept.value.threshold and x != "und" for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def training_fold(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32(doc_id as text) mod 3 is not 1."""
    return docs.where(fold(F.col("doc_id"), 3) != 1)
