"""Nearest neighbours by adaptive dimension scan over an inverted-list index.

Centroids, a random rotation and the number of lists to probe are fitted on the
driver to at most `sample` vectors (the smallest by a hash of vec_id); every
vector is indexed. The number of probes is the smallest whose recall, by brute
force within that sample, reaches `recall`, and each query probes on until its
lists hold enough candidates.

Lists are packed into chunks of about CHUNK vectors; a longer list is dealt over
several, so that a hot list is many tasks. Each vector goes to one chunk, once. A
query goes once to each chunk that holds a part of its lists, with their numbers,
and a chunk's queries stream past its vectors, so that a task holds no more than a
chunk. A query scans the chunk's lists from the nearest on and carries its limit,
the k-th best distance so far, from list to list. A scan holds rotated vectors in
blocks of columns. After each block it abandons the candidates whose partial
distance would, by a test on random projections, be too small with a chance of
about exp(-EPSILON^2 / 2) if they belonged to the nearest found so far. Those that
last through all blocks are measured on the original vectors in double precision.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do those of another length than most have; nor rows without vec_id. A
query's own row is every row of its vec_id. Of a repeated query one row asks.
Ties go to the smaller vec_id. An empty table gives no rows."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, written

CHUNK, EPSILON, BLOCK = 8192, 2.1, 16
SAMPLE_VALUES = 1 << 24


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v): rows that take part, and their dimension. v stays in single precision where it came so."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    good = plain.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    most = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 0
    return good.where(F.size("v") == dim), dim


def _stack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim).astype(np.float64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def fit(good: DataFrame, dim: int, count: int, k: int, recall: float, sample: int = 50_000, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroids, rotation, probes) from a bounded sample."""
    bound = max(1, min(sample, SAMPLE_VALUES // dim))
    rows = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).select("v").toArrow()
    s = _stack(rows.column("v"), dim)
    chance = np.random.default_rng(seed)
    lists = int(max(1, min(4096, round(np.sqrt(count)), len(s))))
    centroids = s[chance.choice(len(s), lists, replace=False)].copy()
    part = s[chance.choice(len(s), min(len(s), 64 * lists), replace=False)]
    for _ in range(8):
        own = _squares(part, centroids).argmin(1)
        n = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, part)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    rotation = np.linalg.qr(chance.normal(size=(dim, dim)))[0]
    asked = s[chance.choice(len(s), min(len(s), 200), replace=False)]
    near = np.argpartition(_squares(asked, s), min(k, len(s) - 1), axis=1)[:, : k + 1]
    home = _squares(s, centroids).argmin(1)
    place = _squares(asked, centroids).argsort(1).argsort(1)
    ranks = np.sort(place[np.arange(len(asked))[:, None], home[near]].ravel())
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1
    return centroids, rotation, min(lists, probes + lists // 20)


class Chunk:
    """Vectors of some lists, laid out for scanning."""

    def __init__(self, lists: np.ndarray, ids: np.ndarray, base: np.ndarray, rotation: np.ndarray):
        order = np.argsort(lists, kind="stable")
        self.ids, self.base, self.rotation, self.dim = ids[order], base[order], rotation, base.shape[1]
        self.edges = [*range(0, self.dim, BLOCK), self.dim]
        turned = self.base @ rotation
        self.blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        each, first = np.unique(lists[order], return_index=True)
        self.rows = dict(zip(each.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True))

    def nearest(self, query_id: int, query: np.ndarray, lists: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_id, distance) of at most k nearest in the lists, from the first on; the limit goes from list to list."""
        q, limit = query @ self.rotation, np.inf
        ids, found = np.zeros(0, np.int64), np.zeros(0)
        for n in lists:
            lo, hi = self.rows.get(n, (0, 0))
            alive = lo + np.flatnonzero(self.ids[lo:hi] != query_id)
            if not len(alive):
                continue
            part = np.zeros(len(alive))
            for j, block in enumerate(self.blocks):
                a, b = self.edges[j], self.edges[j + 1]
                if a and np.isfinite(limit):
                    keep = part <= limit * (a / self.dim) * (1 + EPSILON / np.sqrt(a)) ** 2
                    alive, part = alive[keep], part[keep]
                part = part + ((block[alive] - q[a:b]) ** 2).sum(1)
            alive = alive[part <= limit * (1 + 1e-9) + 1e-9]
            if len(alive) > k:
                part = ((self.base[alive] - query) ** 2).sum(1)
                alive = alive[part <= np.partition(part, k - 1)[k - 1]]
            ids = np.concatenate([ids, self.ids[alive]])
            found = np.concatenate([found, np.sqrt(((self.base[alive] - query) ** 2).sum(1))])
            if len(ids) >= k:
                order = np.lexsort((ids, found))[:k]
                ids, found = ids[order], found[order]
                limit = found[-1] ** 2
        order = np.lexsort((ids, found))[:k]
        return ids[order], found[order]


def packed_lists(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk, chunks) of each list: short lists side by side in one chunk, longer ones dealt over several."""
    first, many = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // CHUNK))
    at, held = 0, 0
    for n, size in enumerate(sizes.tolist()):
        if held and held + size > CHUNK:
            at, held = at + 1, 0
        first[n] = at
        held += size
        if many[n] > 1:
            at, held = at + int(many[n]), 0
    return first, many


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.96, sample: int = 50_000) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by `every`, among all others."""
    spark = vectors.sparkSession
    columns = "query_id long, rank int, vec_id long, score double"
    good, dim = usable(vectors)
    count = good.count()
    if not count:
        return spark.createDataFrame([], columns)
    centroids, rotation, probes = fit(good, dim, count, k, recall, sample)
    kept = spark.sparkContext.broadcast((centroids, rotation))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                own = _squares(_stack(batch.column("v"), dim), kept.value[0]).argmin(1)
                yield pa.record_batch([pa.array(own.astype(np.int32)), batch.column("vec_id"), batch.column("v")], ["list", "vec_id", "v"])

    index = written(good.select("vec_id", "v").mapInArrow(assign, f"list int, vec_id long, v {good.schema['v'].dataType.simpleString()}"), "lists")
    sizes = np.zeros(len(centroids), np.int64)
    for n, size in index.groupBy("list").count().collect():
        sizes[n] = size

    first, many = packed_lists(sizes)
    kind = good.schema["v"].dataType.simpleString()

    def place(batches):
        """A vector's chunk: its list's, or one of them by its id."""
        for batch in batches:
            lists = np.asarray(batch.column("list"))
            spread = np.fromiter((zlib.crc32(str(i).encode()) for i in batch.column("vec_id").to_pylist()), np.int64, len(lists))
            yield pa.record_batch([pa.array((first[lists] + spread % many[lists]).astype(np.int32)), *batch.columns, pa.nulls(len(lists), pa.list_(pa.int32()))], _PLACED)

    def ask(batches):
        """A query's row for each chunk with a part of the lists it probes, nearest first."""
        for batch in batches:
            if batch.num_rows:
                order = _squares(_stack(batch.column("v"), dim), kept.value[0]).argsort(1, kind="stable")
                held = np.cumsum(sizes[order], 1)
                need = np.maximum(probes, (held < 4 * k + 1).sum(1) + 1)
                at, chunks, lists = [], [], []
                for i, (o, n) in enumerate(zip(order, need, strict=True)):
                    chosen = o[:n][sizes[o[:n]] > 0]
                    wanted = np.repeat(chosen, many[chosen])
                    where = first[wanted] + np.arange(len(wanted)) - np.repeat(np.cumsum(many[chosen]) - many[chosen], many[chosen])
                    by = np.argsort(where, kind="stable")
                    each, start = np.unique(where[by], return_index=True)
                    at += [i] * len(each)
                    chunks += each.tolist()
                    lists += [x.tolist() for x in np.split(wanted[by], start[1:])]
                rows = pa.array(at, pa.int64())
                columns = [pa.array(chunks, pa.int32()), pa.nulls(len(at), pa.int32()), batch.column("vec_id").take(rows), batch.column("v").take(rows), pa.array(lists, pa.list_(pa.int32()))]
                yield pa.record_batch(columns, _PLACED)

    columns_of = f"chunk int, list int, vec_id long, v {kind}, lists array<int>"
    base = index.mapInArrow(place, columns_of)
    asked = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(ask, columns_of)
    chunks = int(max(f + m for f, m in zip(first.tolist(), many.tolist(), strict=True)))
    tasks = min(chunks, max(partitions(spark), 1))
    met = base.unionByName(asked).repartitionById(tasks, F.pmod("chunk", F.lit(tasks))).sortWithinPartitions("chunk", F.col("lists").isNotNull())

    def search(batches):
        now, held, chunk = None, [], None
        for batch in batches:
            numbers = np.asarray(batch.column("chunk"))
            queries = np.asarray(batch.column("lists").is_valid())
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (queries[1:] != queries[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                if numbers[lo] != now:
                    now, held, chunk = numbers[lo], [], None
                if not queries[lo]:
                    held.append((np.asarray(part.column("list")), np.asarray(part.column("vec_id")), _stack(part.column("v"), dim)))
                    continue
                if chunk is None and held:
                    chunk, held = Chunk(*(np.concatenate(x) for x in zip(*held, strict=True)), kept.value[1]), []
                if chunk is None:
                    continue
                ids = part.column("vec_id").to_pylist()
                got = [chunk.nearest(i, q, lists, k) for i, q, lists in zip(ids, _stack(part.column("v"), dim), part.column("lists").to_pylist(), strict=True)]
                found = [pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x, _ in got]))]
                yield pa.record_batch([*found, pa.array(np.concatenate([x for x, _ in got])), pa.array(np.concatenate([d for _, d in got]))], ["query_id", "vec_id", "score"])

    some = met.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return some.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_PLACED = ["chunk", "list", "vec_id", "v", "lists"]


def exact(vectors: pd.DataFrame, every: int = 100, k: int = 10) -> pd.DataFrame:
    """Brute force over a small table in memory, to measure recall against."""
    ids, base = vectors["vec_id"].to_numpy(), np.stack(vectors["embedding"]).astype(np.float64)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((base - base[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out += [(ids[i], r + 1, ids[j], d[j]) for r, j in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
