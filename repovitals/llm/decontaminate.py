"""Benchmark decontamination by SimHash windows of each item's own size.

Items and texts are words in lower case with ASCII punctuation as white space.
A window of an item's length is compared with items of that length: a 64-bit
SimHash over its weighted five-word shingles, found within RADIUS bits through
BLOCKS index blocks of 10 or 11 bits, then the exact weighted Jaccard similarity of
the shingle multisets. Of the blocks of two fingerprints that differ in at most
RADIUS bits, one differs in at most RADIUS / BLOCKS = 2; the index lists each
fingerprint under all keys so near to its own, so a query looks at one list a
block, about a quarter of the fingerprints in all, and finds every one in reach.
A shingle weighs ln(1 + items / items that hold it), so shared boilerplate of
the benchmark counts for less. Windows start at every word where they overlap
at least one shingle of an item of their length: no other window can reach a
similarity above zero, so none is lost. An item's best window is the most similar
one, of equals the first. Long texts are hashed RUN windows at a time.

Items are held in memory in chunks of at most CHUNK_WORDS words or CHUNK_ITEMS items; a larger
benchmark takes one pass over the documents for each chunk. Weights are those of
the whole benchmark in every chunk: the shingles that two and more items hold
are counted first, and all others weigh as if one item held them.

Nulls: a null or blank text or item matches nothing; rows with a null doc_id are
reported with it. Items shorter than five words match as a whole. Documents
shorter than an item are one window. Repeated rows are reported each. Empty
tables give no rows; other columns are dropped by matches(), kept by clean()."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, lean, shingles, written

RADIUS, BLOCKS = 16, 6
CHUNK_WORDS, CHUNK_ITEMS = 2_000_000, 20_000
RUN = 8192
_SPACED = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or b < 32 else b for b in range(256))
_TABLE_BITS = 20


def plain_words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SPACED).split() if text else []


def simhashes(features: np.ndarray, weights: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of features[s : s + width] for every s of starts."""
    bits = ((features[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(bits * weights[:, None], 0)])
    on = sums[np.minimum(starts + width, len(features))] - sums[starts] > 1e-9
    return (on.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def runs(starts: np.ndarray, width: int, most: int = RUN) -> list[np.ndarray]:
    """Sorted starts cut where the next window doesn't overlap, and after `most` words."""
    out, lo = [], 0
    gaps = np.flatnonzero(np.diff(starts) > width) + 1
    for hi in [*gaps.tolist(), len(starts)]:
        while lo < hi:
            end = min(hi, int(np.searchsorted(starts, starts[lo] + most)))
            out.append(starts[lo:end])
            lo = end
    return out


def _near_masks(bits: int, most: int) -> np.ndarray:
    """All patterns of at most `most` of `bits` bits."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in itertools.combinations(range(bits), k)], np.int64)


class HammingIndex:
    """All of a set of fingerprints within RADIUS bits of a query: exact, by blocks and the keys near to a fingerprint's own.

    Lists are made when they are first asked for, so that what is broadcast are the fingerprints."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.lists = prints, None
        cuts = np.linspace(0, 64, BLOCKS + 1).astype(int)
        self.blocks = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def __getstate__(self):
        return {"prints": self.prints, "lists": None, "blocks": self.blocks}

    def _keys(self, prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def _listed(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(starts, prints) of each block: under key k stand prints[starts[k] : starts[k + 1]]."""
        out = []
        for lo, hi in self.blocks:
            near = self._keys(self.prints, lo, hi)[:, None] ^ _near_masks(hi - lo, RADIUS // BLOCKS)[None]
            order = np.argsort(near.ravel(), kind="stable")
            out.append((np.searchsorted(near.ravel()[order], np.arange((1 << (hi - lo)) + 1)), (order // near.shape[1]).astype(np.int32)))
        return out

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, print, distance) triples."""
        self.lists = self.lists or self._listed()
        pairs = []
        for (lo, hi), (starts, listed) in zip(self.blocks, self.lists, strict=True):
            key = self._keys(queries, lo, hi)
            first, n = starts[key], starts[key + 1] - starts[key]
            rows = np.repeat(np.arange(len(queries)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            p = listed[at]
            pairs.append((rows * len(self.prints) + p)[np.bitwise_count(queries[rows] ^ self.prints[p]) <= RADIUS])
        found = np.unique(np.concatenate(pairs))
        q, p = found // len(self.prints), found % len(self.prints)
        return q, p, np.bitwise_count(queries[q] ^ self.prints[p])


def _window_starts(places: np.ndarray, count: int, n: int) -> np.ndarray:
    """Starts of the windows of `count` shingles that hold one of the sorted places, in a text of n shingles."""
    change = np.zeros(n + 2, np.int32)
    np.add.at(change, np.maximum(0, places - count + 1), 1)
    np.add.at(change, np.minimum(places, n - count) + 1, -1)
    return np.flatnonzero(np.cumsum(change)[: n - count + 1] > 0)


class Items:
    """One chunk of the benchmark, laid out for matching.

    whole: items with words of the whole benchmark, and the holders of each shingle that several hold; else this is all of it."""

    def __init__(self, rows: list[tuple[int, str]], width: int, whole: tuple[int, dict[int, int]] | None = None):
        hashes = WordHashes()
        self.width, self.ids, self.sets = width, [], []
        sized, holders = defaultdict(list), Counter()
        for item, text in rows:
            if found := plain_words(text):
                features = shingles(hashes.of(found), width)
                sized[len(found)].append(len(self.ids))
                self.ids.append(item)
                self.sets.append(Counter(features.tolist()))
                holders.update(set(features.tolist()))
        n, holders = whole or (len(self.ids), holders)
        self.weight = {s: float(np.log(1 + n / k)) for s, k in holders.items()}
        self.other = float(np.log(1 + n))
        self.table, self.holders = {}, {}
        for grams in {min(size, width) for size in sized}:
            table, held = np.zeros(1 << _TABLE_BITS, bool), defaultdict(set)
            for size, members in sized.items():
                if min(size, width) == grams:
                    for i in members:
                        for s in self.sets[i]:
                            held[s].add(size)
            table[np.fromiter(held, np.uint64, len(held)) & np.uint64((1 << _TABLE_BITS) - 1)] = True
            self.table[grams], self.holders[grams] = table, held
        self.index, self.members = {}, {}
        for size, members in sized.items():
            prints = []
            for i in members:
                features = np.repeat(np.fromiter(self.sets[i], np.uint64), list(self.sets[i].values()))
                prints.append(simhashes(features, self._weights(features), np.array([0]), len(features))[0])
            self.index[size], self.members[size] = HammingIndex(np.array(prints, np.uint64)), members

    def _weights(self, features: np.ndarray) -> np.ndarray:
        return np.array([self.weight.get(s, self.other) for s in features.tolist()])

    def match(self, hashes: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, distance, similarity): each item's best window of a text of these word hashes."""
        best: dict[int, tuple] = {}
        for grams, table in self.table.items():
            if not len(hashes):
                continue
            features = shingles(hashes, grams)
            hits = np.flatnonzero(table[features & np.uint64((1 << _TABLE_BITS) - 1)])
            near: dict[int, list[int]] = defaultdict(list)
            for at in hits.tolist():
                for size in self.holders[grams].get(int(features[at]), ()):
                    near[size].append(at)
            for size, places in near.items():
                count = min(size - grams + 1, len(features))  # shingles of a window
                for starts in runs(_window_starts(np.array(places), count, len(features)), count):
                    low = int(starts[0])
                    held = features[low : int(starts[-1]) + count]
                    prints = simhashes(held, self._weights(held), starts - low, count)
                    for q, p, distance in zip(*(x.tolist() for x in self.index[size].near(prints)), strict=True):
                        i, s = self.members[size][p], int(starts[q])
                        similar = self.similarity(i, features[s : s + count])
                        if similar >= threshold and (i not in best or similar > best[i][4]):
                            best[i] = (self.ids[i], s, min(size, len(hashes)), distance, similar)
        return list(best.values())

    def similarity(self, i: int, features: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item's shingles and a window's."""
        mine, its = self.sets[i], Counter(features.tolist())
        both = sum(self.weight.get(s, self.other) * min(n, mine[s]) for s, n in its.items() if s in mine)
        return both / (sum(self.weight.get(s, self.other) * n for s, n in mine.items()) + sum(self.weight.get(s, self.other) * n for s, n in its.items()) - both)


def shared_shingles(benchmark: DataFrame, width: int) -> tuple[int, dict[int, int]]:
    """Items that have words, and how many items hold each shingle that more than one holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for text in batch.column(0):
                if found := plain_words(text.as_py()):
                    held = np.unique(shingles(hashes.of(found), width))
                    yield pa.record_batch([pa.array(np.append(held.view(np.int64), 0)), pa.array(np.append(np.zeros(len(held), bool), True))], ["shingle", "item"])

    found = written(benchmark.select(F.col("text").cast("string")).where("text IS NOT NULL").mapInArrow(lean(run), "shingle long, item boolean").groupBy("shingle", "item").count(), "holders")
    items = found.where("item").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    several = found.where("NOT item AND count > 1").select("shingle", "count").toLocalIterator()
    return items, {s & (1 << 64) - 1: k for s, k in several}


def chunks(benchmark: DataFrame, width: int) -> Iterator[Items]:
    """The benchmark's items, at most CHUNK_WORDS words at a time on the driver."""
    rows, held, whole = [], 0, None
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        rows.append((item, text))
        held += len(plain_words(text))
        if held >= CHUNK_WORDS or len(rows) >= CHUNK_ITEMS:
            whole = whole or shared_shingles(benchmark, width)
            yield Items(rows, width, whole)
            rows, held = [], 0
    if rows:
        yield Items(rows, width, whole)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): the best window of every item in every document that holds it."""
    columns = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"
    out = docs.sparkSession.createDataFrame([], columns)
    for items in chunks(benchmark, width):
        kept = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            items, hashes = kept.value, WordHashes()
            for batch in batches:
                rows = []
                for d, t in zip(batch.column(0), batch.column(1), strict=True):
                    if found := plain_words(t.as_py()):
                        rows += [(d.as_py(), *m) for m in items.match(hashes.of(found), threshold)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(),) * 4 + (pa.int32(), pa.float64()), strict=True)], ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), columns))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item: one narrow pass for each chunk, no join."""
    at = docs.columns.index("text")
    for items in chunks(benchmark, width):
        kept = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            items, hashes = kept.value, WordHashes()
            for batch in batches:
                keep = [not items.match(hashes.of(plain_words(t.as_py())), threshold) for t in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
