"""Exact Jaccard self-join of documents' shingle sets by PartEnum signatures.

Sets are dealt to size bands, band j holding sizes 2^j to 2^(j+1)-1; a set whose
partners may be in the next band signs for that one too, so two similar sets
always share a band. In a band of sizes up to L the feature domain is hashed to n1, about
L / 4, first-level groups of n2 = 3 partitions. Of each group all C(3, 2) = 3 subsets
of n2 - k2 = 2 partitions are enumerated, and a subset gives one signature, a hash
of all features that fall in its two partitions: 3 signatures a group, about 0.75 L
a band. Two sets at a Jaccard similarity of 0.8 differ in at most a quarter of the
smaller one's size, d features; each lies in one partition, which is in C(2, 1) = 2
of the group's subsets. So of the signatures of subsets that aren't empty, all but
2 d are shared. Under any order of signatures that is the same for all sets, the
first 2 d + e of both share e at least; each set signs its first 2 d + e, e being a
twelfth of its size: about 0.58 signatures a feature and band. The order puts
subsets with a rare feature first, by a table of how often features come. A set that shares fewer signatures with all others together
than it must with a partner of four fifths its size is settled: it has none. So
texts that only have a common passage in common mostly drop out before any set
is compared. A set with too few filled subsets signs all, and empty ones too.

A signature links its members as a star to one of them: first in each map task,
so that a hot signature sends one row a task, then where it is gathered. The
components of these stars, clusters of candidates, hold every pair that shares
a signature. Clusters of more than two blocks sign again among themselves, with
a table of their own features, which tells the passages that brought them
together from what makes texts alike, until they stop falling apart. Then inside
a cluster sets are compared whole, each pair once, by products of blocks of at
most about BLOCK sets with BLOCK; a large cluster is many pairs of blocks, in as
many tasks. What comes out are links that join sets, not pairs: at most as many
as there are sets in a block pair.

Nulls: a null or blank text has no shingles and links with nothing; a row whose
doc_id is null is counted but takes no part in links, and its component is null.
Rows that repeat a doc_id are versions of one document. Other columns are
dropped. An empty table gives no rows."""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, distinct, lean, mix64, partitions, ranges, shingles, words, written
from .components import components

SUBPARTS, LEFT_OUT = 3, 1
#: Subsets of a group that one partition is in, and that a differing feature so changes.
CHANGED = math.comb(SUBPARTS - 1, SUBPARTS - LEFT_OUT - 1)
#: Of a set's size, one part in so many is signed beyond what may differ.
MORE = 12
#: Input bytes for each range of signatures, at most.
RANGE_BYTES = 32 << 20
FILTER_BITS, COUNT_BITS, BLOCK = 22, 23, 256
ROUNDS, PIECES = 3, 16


#: Sets of fewer features may fill so few partitions that what two of them share has no useful lower bound.
COUNTED = 256


def least_shared(size):
    """How many of its signatures a set of this size shares with any partner, at least; size: a number or a column."""
    if isinstance(size, int):
        return max(1, -(-4 * size // 5) // MORE) if size >= COUNTED else 1
    own = F.floor(F.ceil(size * 4 / 5) / MORE)
    return F.when(size >= COUNTED, F.greatest(F.lit(1), own)).otherwise(1)


def n_partitions(band: int) -> int:
    """Partitions of a band: about one for each feature of its sets."""
    largest = (2 << band) - 1
    n = -(-3 * largest // 4) + 3
    return -(-n // SUBPARTS) * SUBPARTS


def bands(size: int) -> list[int]:
    own = size.bit_length() - 1
    return [own, own + 1] if 5 * size >= 4 * (2 << own) else [own]


def places(features: np.ndarray) -> list[np.ndarray]:
    """Two places of each feature in the tables of counts: a feature is as common as the rarer of them says."""
    return [(mix64(features ^ np.uint64(salt)) >> np.uint64(64 - COUNT_BITS)).astype(np.int64) for salt in (0x2545F4914F6CDD1D, 0x6C62272E07BB0142)]


@functools.cache
def _salts(band: int) -> list[np.ndarray]:
    """What tells a band's groups and subsets apart, for each subset."""
    groups = np.arange(n_partitions(band) // SUBPARTS, dtype=np.uint64)
    return [mix64(groups * np.uint64(64) + np.uint64(band) + np.uint64((k + 1) << 40)) for k in range(math.comb(SUBPARTS, LEFT_OUT))]


def _enumerated(features: np.ndarray, level: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all subsets in all groups of a band's partitions, which hold features, and the rarest feature's level."""
    n = n_partitions(band)
    part = (features % np.uint64(n)).astype(np.int64)
    sums, held, least = np.zeros(n, np.uint64), np.bincount(part, minlength=n) > 0, np.full(n, 255, np.uint8)
    np.add.at(sums, part, mix64(features ^ np.uint64(0x5851F42D4C957F2D)))
    np.minimum.at(least, part, level)
    signed, filled, levels = [], [], []
    for salts, subset in zip(_salts(band), itertools.combinations(range(SUBPARTS), SUBPARTS - LEFT_OUT), strict=True):
        total, some, low = sums[subset[0] :: SUBPARTS], held[subset[0] :: SUBPARTS], least[subset[0] :: SUBPARTS]
        for i in subset[1:]:
            total = total * np.uint64(0x9E3779B97F4A7C15) + sums[i::SUBPARTS]
            some = some | held[i::SUBPARTS]
            low = np.minimum(low, least[i::SUBPARTS])
        signed.append(total ^ salts)
        filled.append(some)
        levels.append(low)
    return mix64(np.concatenate(signed)), np.concatenate(filled), np.concatenate(levels)


def signatures(features: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """48-bit signatures of one set of 64-bit features; levels: how common features are, as two tables over places()."""
    found, most, level = [], CHANGED * (len(features) // 4), np.minimum(*(t[at] for t, at in zip(levels, places(features), strict=True)))
    for band in bands(len(features)):
        signed, filled, low = _enumerated(features, level, band)
        if np.count_nonzero(filled) > most:
            # In order of level and signature, as one number; what it drops of a signature, the result drops too.
            both = np.sort(low[filled].astype(np.uint64) << np.uint64(56) | signed[filled] >> np.uint64(8))
            found.append((both[: most + max(1, len(features) // MORE)] & np.uint64((1 << 56) - 1)) >> np.uint64(8))
        else:
            found.append(signed >> np.uint64(16))
    return np.concatenate(found)


def _id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _repeated(held: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(piece, packed places and counts) of the features that come twice and more in a list of sets."""
    each, times = np.unique(np.concatenate(held), return_counts=True)
    each, times = each[times >= 2], times[times >= 2]
    for t, at in enumerate(places(each)):
        for k in range(PIECES):
            mine = at * PIECES >> COUNT_BITS == k
            if mine.any():
                yield t * PIECES + k, np.stack([at[mine], times[mine]]).astype("<i8").tobytes()


def _levels(rows: DataFrame) -> np.ndarray:
    """Tables of levels from rows (piece, packed): a level is the number of digits, in base two, of a count over all tasks.

    What the driver gets has a fixed bound: two tables of 2^COUNT_BITS places."""

    size = (1 << COUNT_BITS) // PIECES

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = {}
        for batch in batches:
            for piece, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, times = np.frombuffer(x, "<i8").reshape(2, -1)
                np.add.at(total.setdefault(piece, np.zeros(size, np.int64)), at - piece % PIECES * size, times)
        yield from total.items()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, n in added(batches):
            used = np.flatnonzero(n)
            packed = np.stack([used + piece % PIECES * size, n[used]]).astype("<i8").tobytes()
            yield pa.record_batch([pa.array([piece], pa.int32()), pa.array([packed], pa.binary())], ["piece", "packed"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, n in added(batches):
            used = np.flatnonzero(n)
            level = np.ceil(np.log2(n[used] + 1)).astype(np.uint8)
            yield pa.record_batch([pa.array([piece], pa.int32()), pa.array([used.astype("<i4").tobytes()], pa.binary()), pa.array([level.tobytes()], pa.binary())], ["piece", "at", "levels"])

    # First by piece and salt, in as many tasks as the data wants, then by piece: a piece's parts are no larger than the piece.
    salts = max(1, partitions(rows.sparkSession) // (2 * PIECES))
    plain = rows.toDF("piece", "packed")
    dealt = plain.repartitionById(2 * PIECES * salts, F.col("piece") * salts + F.pmod(F.xxhash64("packed"), F.lit(salts)).cast("int"))
    met = dealt.mapInArrow(lean(some), "piece int, packed binary").repartitionById(2 * PIECES, F.col("piece"))
    levels = np.zeros((2, PIECES, size), np.uint8)
    for piece, at, level in met.mapInArrow(lean(gather), "piece int, at binary, levels binary").collect():
        levels[piece // PIECES, piece % PIECES, np.frombuffer(bytes(at), "<i4")] = np.frombuffer(bytes(level), np.uint8)
    return levels.reshape(2, -1)


def shingle_sets(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, print, head) of each whole text; and levels of features.

    print: a 128-bit fingerprint of its set; head: the first document with this set that its task met.
    Counted are features that come twice and more among a map task's different
    sets. Any levels keep the join exact; these decide which signatures come first."""
    import xxhash

    names = ["doc_id", "n_shingles", "print", "head", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, heads, seen, held, many = WordHashes(), {}, set(), [], 0

        def common() -> Iterator[pa.RecordBatch]:
            for piece, packed in _repeated(held):
                none = pa.nulls(1, pa.int64())
                yield pa.record_batch([none, none, pa.array([packed], pa.binary()), none, pa.array([piece], pa.int32())], names)

        for batch in batches:
            sizes, prints, firsts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = distinct(shingles(hashes.of(words(text.as_py())), width))
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                firsts.append(heads.setdefault(prints[-1], doc_id) if len(found) and doc_id is not None else None)
                if len(found) and prints[-1] not in seen:
                    seen.add(prints[-1])
                    held.append(found)
                    many += len(found)
            columns = [pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(firsts, pa.int64()), pa.nulls(len(sizes), pa.int32())]
            yield pa.record_batch([batch.column(0), *columns], names)
            if many > 4_000_000:
                yield from common()
                seen, held, many = set(), [], 0
        if many:
            yield from common()

    found = written(_id_and_text(docs).mapInArrow(lean(run), "doc_id long, n_shingles long, print binary, head long, piece int"), "sets")
    return found.where("piece IS NULL").drop("piece"), _levels(found.where("piece IS NOT NULL").select("piece", "print"))


def _of_texts(width: int):
    """Reads (doc_id, features) from batches of (doc_id, text); of a task's equal sets only the first, as copies are linked apart."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        import xxhash

        hashes, seen = WordHashes(), set()
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if d is not None and len(found := distinct(shingles(hashes.of(words(t.as_py())), width))):
                    if (print_ := xxhash.xxh3_128_digest(found.tobytes())) not in seen:
                        seen.add(print_)
                        yield d, found

    return read


def _of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("features"), strict=True):
            yield d, np.frombuffer(x.as_buffer(), np.uint64)


def levels_among(sets: DataFrame, count: int, together: int = 16_384) -> np.ndarray:
    """Levels from the features of some sets (doc_id, features), counted about `together` sets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for _, x in _of_sets(batches):
            held.append(x)
            many += len(x)
            if many > 8_000_000:
                for piece, packed in _repeated(held):
                    yield pa.record_batch([pa.array([piece], pa.int32()), pa.array([packed], pa.binary())], ["piece", "packed"])
                held, many = [], 0
        for piece, packed in _repeated(held) if held else ():
            yield pa.record_batch([pa.array([piece], pa.int32()), pa.array([packed], pa.binary())], ["piece", "packed"])

    parts = max(1, -(-count // together))
    return _levels(sets.repartition(parts, "doc_id").mapInArrow(lean(run), "piece int, packed binary"))


def _stars(sigs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each signature its smallest id; and the links of all other ids to it with how many signatures gave them."""
    order = np.argsort(sigs, kind="stable")
    sigs, ids = sigs[order], ids[order]
    firsts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(ids, firsts) if len(sigs) else ids
    lengths = np.diff(np.append(firsts, len(sigs)))
    hub = np.repeat(least, lengths)
    other = hub != ids
    links = np.stack([hub[other], ids[other]], 1)
    links, times = np.unique(links, axis=0, return_counts=True) if len(links) else (links.reshape(0, 2), np.zeros(0, np.int64))
    return sigs[firsts], least, links, times


def _bitmap(df: DataFrame, column) -> np.ndarray:
    """A bit for each value of column (a non-negative long): at most 2^FILTER_BITS bits, whatever the rows.

    It only spares work: what passes is joined exactly afterwards."""
    bit = F.pmod(column, F.lit(1 << FILTER_BITS))
    rows = df.select((bit / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b")).collect()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for w, b in rows:
        out[w] = b & 0xFFFFFFFF
    return out


def _id_hash(ids: list) -> np.ndarray:
    return np.fromiter((zlib.crc32(str(d).encode()) for d in ids), np.int64, len(ids)) & ((1 << FILTER_BITS) - 1)


def _held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def star_links(rows: DataFrame, read, levels: np.ndarray, n: int) -> DataFrame:
    """(kind, a, b) over the sets that read gives from batches of rows. Kind 0: document a shares b signatures with others,
    at most counted twice; kind 1: a and b are in one cluster of candidates. n: ranges of signatures."""
    kept = rows.sparkSession.sparkContext.broadcast(levels)
    flush = 3_000_000

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids, many = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            all_ids = np.concatenate(ids)
            each, least, links, times = _stars(np.concatenate(sigs), all_ids)
            home = ((each >> np.uint64(8)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(n + 1))
            link_home = (links[:, 0] + links[:, 1]) % n
            for k in range(n):
                rows = order[cuts[k] : cuts[k + 1]]
                mine = link_home == k
                if len(rows) or mine.any():
                    names, index = np.unique(least[rows], return_inverse=True)
                    small = each[rows].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    index = index.astype("<u2" if len(names) <= 1 << 16 else "<u4").tobytes()
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([small], pa.binary()), pa.array([index], pa.binary()), pa.array([names.tobytes()], pa.binary()), pa.array([np.column_stack([links[mine], times[mine]]).astype("<i8").tobytes()], pa.binary())], ["home", "sigs", "at", "ids", "links"])

        for d, found in read(batches):
            sigs.append(signatures(found, kept.value))
            ids.append(np.full(len(sigs[-1]), d, np.int64))
            many += len(sigs[-1])
            if many >= flush:
                yield from packed()
                sigs, ids, many = [], [], 0
        if many:
            yield from packed()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stars of this task's signatures; and of each id in one, how many signatures it shares, for the id's home."""
        sigs, ids, local = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                m = len(row["sigs"]) // 6
                wide = np.zeros((m, 8), np.uint8)
                wide[:, :6] = np.frombuffer(row["sigs"], np.uint8).reshape(m, 6)
                names = np.frombuffer(row["ids"], np.int64)
                sigs.append(wide.view("<u8").reshape(-1))
                ids.append(names[np.frombuffer(row["at"], "<u2" if len(names) <= 1 << 16 else "<u4")])
                local.append(np.frombuffer(row["links"], "<i8").reshape(-1, 3))
        if sigs:
            _, _, links, times = _stars(np.concatenate(sigs), np.concatenate(ids))
            links = np.concatenate([np.column_stack([links, times]).astype(np.int64), *local])
            each, index = np.unique(links[:, :2], return_inverse=True)
            shared = np.bincount(index.reshape(-1), np.repeat(links[:, 2], 2), len(each)).astype(np.int64)
            near = _forest(links[:, :2])
            for k in range(n):
                own, edges = each % n == k, near[near.sum(1) % n == k] if len(near) else near
                if own.any() or len(edges):
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.column_stack([each[own], shared[own]]).tobytes()], pa.binary()), pa.array([edges.tobytes()], pa.binary())], ["home", "shared", "edges"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: an id and how many signatures it shares. Kind 1: links."""
        counts, edges = [], []
        for batch in batches:
            counts += [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column("shared").to_pylist()]
            edges += [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column("edges").to_pylist()]
        if counts:
            x = np.concatenate(counts)
            each, index = np.unique(x[:, 0], return_inverse=True)
            links = np.unique(np.concatenate(edges), axis=0)
            yield pa.record_batch([pa.array(np.zeros(len(each), np.int32)), pa.array(each), pa.array(np.bincount(index, x[:, 1], len(each)).astype(np.int64))], ["kind", "a", "b"])
            yield pa.record_batch([pa.array(np.ones(len(links), np.int32)), pa.array(links[:, 0]), pa.array(links[:, 1])], ["kind", "a", "b"])

    sent = rows.mapInArrow(lean(emit), "home int, sigs binary, at binary, ids binary, links binary")
    met = sent.repartitionById(n, F.col("home")).mapInArrow(lean(gather), "home int, shared binary, edges binary")
    return written(met.repartitionById(n, F.col("home")).mapInArrow(lean(summed), "kind int, a long, b long"), "stars")


def _forest(links: np.ndarray) -> np.ndarray:
    """Links (smaller, larger) with the same components, at most one for each larger end and round."""
    while True:
        links = np.unique(links[links[:, 0] != links[:, 1]], axis=0)
        order = np.argsort(links[:, 1], kind="stable")
        least = links[order]
        again = np.concatenate([[False], least[1:, 1] == least[:-1, 1]]) if len(links) else np.zeros(0, bool)
        if not again.any():
            return links
        hub = np.repeat(least[~again, 0], np.diff(np.append(np.flatnonzero(~again), len(least))))
        moved = np.stack([np.minimum(hub, least[:, 0]), np.maximum(hub, least[:, 0])], 1)[again]
        links = np.concatenate([least[~again], moved])


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, component, features) of the documents in wanted (node, component): sorted 64-bit shingle hashes."""
    bits = _bitmap(wanted, F.crc32(F.col("node").cast("string").cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, sets = [], []
            all_ids = batch.column(0).to_pylist()
            for i in np.flatnonzero(_held(bits, _id_hash(all_ids))):
                if all_ids[i] is not None and len(found := distinct(shingles(hashes.of(words(batch.column(1)[int(i)].as_py())), width))):
                    ids.append(all_ids[i])
                    sets.append(found.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "features"])

    return _id_and_text(docs).mapInArrow(lean(run), "doc_id long, features binary").join(wanted.select(F.col("node").alias("doc_id"), "component"), "doc_id").select("doc_id", "component", "features")


def joined(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between like sets. left: which sets are one side of the pairs; all True compares all with all.

    Of links that close a circle one is left out."""
    sizes = np.array([len(x) for x in sets])
    every, index = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(index, minlength=len(every)) > 1
    number = np.cumsum(shared) - 1
    row, at = row[shared[index]], number[index[shared[index]]]
    whole = bool(left.all())
    a, b = np.flatnonzero(left), np.arange(len(sets)) if whole else np.flatnonzero(~left)
    both = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for start in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(at, (start, start + 4096))
        x = np.zeros((len(sets), min(4096, int(shared.sum()) - start)), np.float32)
        x[row[lo:hi], at[lo:hi] - start] = 1
        both += x[a] @ x[b].T
    same = np.rint(both).astype(np.int64)
    i, j = np.nonzero(100 * same >= percent * (sizes[a][:, None] + sizes[b][None] - same))
    parent = list(range(len(sets)))

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    links = []
    for p, q in zip(a[i].tolist(), b[j].tolist(), strict=True):
        p_, q_ = root(p), root(q)
        if p_ != q_:
            parent[max(p_, q_)] = min(p_, q_)
            links.append((int(ids[p]), int(ids[q])))
    return links


def cluster_links(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): links inside clusters of sets (doc_id, component, features), which between them join all like sets."""
    spark = placed.sparkSession
    sizes = written(placed.groupBy("component").count().where(F.col("count") > BLOCK).select("component", F.ceil(F.col("count") / BLOCK).cast("int").alias("n")), "blocks")
    blocks = F.coalesce("n", F.lit(1))
    dealt = placed.join(sizes, "component", "left").withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = dealt.select("doc_id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "features")
    rows = rows.repartition(partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                left = np.array([b == key[1] for _, b, _ in held])
                if key[1] == key[2] or 0 < left.sum() < len(left):
                    links = joined(np.array([d for d, _, _ in held], np.int64), [np.frombuffer(x, np.uint64) for _, _, x in held], left, percent)
                    if links:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

        for batch in batches:
            for c, i, j, d, b, x in zip(*(batch.column(n).to_pylist() for n in ("component", "i", "j", "doc_id", "block", "features")), strict=True):
                if key != (c, i, j):
                    yield from done()
                    key, held = (c, i, j), []
                held.append((d, b, x))
        yield from done()

    return rows.mapInArrow(lean(compare), "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    if percent < 80:
        raise ValueError("the signatures are laid out for similarities of 0.8 and more")
    base, levels = shingle_sets(docs, width)
    some = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    # A task's copies meet at the task's first, and the firsts of all tasks at the smallest: a hot set is one row a task.
    heads = some.where("doc_id = head").select("print", "head").distinct()
    one = heads.join(heads.groupBy("print").agg(F.min("head").alias("to")), "print").where("to <> head").select(F.col("head").alias("b"), "to")
    one = written(one.groupBy("b").agg(F.min("to").alias("to")), "copies")
    near = some.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    copies = near.unionByName(one.select(F.col("to").alias("a"), "b"))

    n = ranges(docs, RANGE_BYTES)
    stars = star_links(_id_and_text(docs), _of_texts(width), levels, n)
    edges, shared = stars.where("kind = 1"), stars.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("shared"))
    sizes = some.groupBy(F.col("doc_id").alias("node")).agg(F.min("n_shingles").alias("n"), (F.min("print") != F.max("print")).alias("several"))
    # A copy's place is taken by the first of its set, unless the document has other texts too.
    whole = one.join(sizes.where("several").select(F.col("node").alias("b")), "b", "left_anti")
    by = lambda side: whole.select(F.col("b").alias(side), F.col("to").alias(f"to_{side}"))
    as_first = edges.join(by("a"), "a", "left").join(by("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    alive = shared.join(sizes, "node").where(F.col("shared") >= least_shared(F.col("n"))).select("node")
    clusters = written(components(as_first).join(alive, "node", "left_semi"), "clusters")
    now = written(_sets_of(docs, clusters, width), "features")
    parts, before = [], None
    for _ in range(ROUNDS):
        big = written(now.groupBy("component").count().where(F.col("count") > 2 * BLOCK), "big")
        inside = big.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        if not inside or before is not None and inside > 0.9 * before:
            break
        before = inside
        parts.append(now.join(big.select("component"), "component", "left_anti"))
        some = now.join(big.select("component"), "component", "left_semi").select("doc_id", "features")
        again = components(star_links(some, _of_sets, levels_among(some, inside), n).where("kind = 1").select("a", "b"))
        now = written(some.join(again.select(F.col("node").alias("doc_id"), "component"), "doc_id").select("doc_id", "component", "features"), "features")
    for part in parts:
        now = now.unionByName(part)
    links = copies.unionByName(written(cluster_links(now, percent), "links"))
    found = components(links)
    return base.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
