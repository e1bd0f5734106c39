"""Token ids in files of canonical length-limited Huffman blocks.

Writing takes three jobs. The first encodes every text once and keeps the ids
as packed binaries in a shared table, and each task's counts of ids beside them;
the second adds up the counts; the third orders documents by id over ranges, and each range writes blocks of whole
documents: the code bits of all ids of the block, and the bit offset of every
256th id. The code is canonical, so the file keeps one length for each id and
nothing else. Reading decodes blocks independently, and within a block all
checkpoints at once, by a table with an entry for every `max_bits` bits.

A folder holds `blocks` (Parquet rows, one a block: a container that every
Hadoop file system takes, and whose commit survives lost tasks), `codebook`
(one row) and nothing that grows with the documents beside the blocks.

Nulls: a null text is empty, so it is its end id alone; a null doc_id comes
first. Repeated rows are written as often as they come, ties in doc_id by their
ids. An empty table gives no rows. Other columns of the input are not kept."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, let_go, new_path, partitions
from .tokens import encoder

BLOCK_TOKENS = 1 << 16
CHECKPOINT = 256
BLOCKS = "part int, block int, first long, n_tokens int, doc_ids array<bigint>, doc_tokens array<int>, checkpoints binary, n_bits long, payload binary"


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of an optimal prefix code no longer than max_bits, by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit codes of {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    merged, leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        leaf.append(order < n)
    take, found = 2 * n - 2, np.zeros(n, np.int64)
    for level in reversed(leaf):
        leaves_taken = int(level[:take].sum())
        found[:leaves_taken] += 1
        take = 2 * (take - leaves_taken)
    lengths[used] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths.max())
        step = np.uint64(1) << (top - lengths[order].astype(np.int64)).astype(np.uint64)
        starts = np.concatenate([[np.uint64(0)], np.cumsum(step)[:-1]]).astype(np.uint64)
        codes[order] = starts >> (top - lengths[order].astype(np.int64)).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Big-endian code bits of ids; the bit offset of every CHECKPOINTth id; the number of bits."""
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), 0
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word = at >> 5
    value = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sums = np.bitwise_or.reduceat(value, firsts)
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[firsts]] |= sums >> np.uint64(32)
    out[word[firsts] + 1] |= sums & np.uint64(0xFFFFFFFF)
    total = int(ends[-1])
    return out.astype(">u4").view(np.uint8)[: (total + 7) // 8], at[::CHECKPOINT], total


class Decoder:
    """Decodes any number of blocks at once, one lane for each checkpoint."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        fill = 1 << (self.bits - lengths[order].astype(np.int64))
        self.symbols = np.zeros(1 << self.bits, np.uint32)
        self.lengths = np.ones(1 << self.bits, np.uint8)
        self.symbols[: fill.sum()] = np.repeat(order, fill)
        self.lengths[: fill.sum()] = np.repeat(lengths[order], fill)

    def decode(self, payloads: list[np.ndarray], checkpoints: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        data = np.concatenate([*payloads, np.zeros(8, np.uint8)]).astype(np.uint64)
        window = (data[:-3] << np.uint64(24) | data[1:-2] << np.uint64(16) | data[2:-1] << np.uint64(8) | data[3:]).astype(np.uint32)
        bases = np.cumsum([0, *(len(p) for p in payloads)])[:-1] * 8
        at = np.concatenate([c + b for c, b in zip(checkpoints, bases, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        last, shift = len(window) - 1, np.uint32(32 - self.bits)
        out = np.empty((CHECKPOINT, len(at)), np.uint32)
        for i in range(CHECKPOINT if len(at) else 0):
            code = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> shift
            out[i] = self.symbols[code]
            at += self.lengths[code]
        lanes, done, found = out.T.reshape(-1), 0, []
        for n in counts:
            found.append(lanes[done : done + n])
            done += -(-n // CHECKPOINT) * CHECKPOINT
        return found


def encoded(docs: DataFrame, tokenizer: str, end_id: int, place: Column | None = None) -> DataFrame:
    """(doc_id, place, packed, counts): the ids of each whole text and the end id, packed by zstd.

    place: what orders rows, doc_id if not given. counts is null, but in one row more of each task, which holds how often each id came in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, press = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        size = max(coder.size, end_id + 1)
        wide = id_type(size)
        end, total = np.array([end_id], wide).tobytes(), np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if wide == coder.wide:
                    found = [coder.codes(t) + end for t in part.column(1).to_pylist()]
                else:
                    found = [np.frombuffer(coder.codes(t), coder.wide).astype(wide).tobytes() + end for t in part.column(1).to_pylist()]
                for lo in range(0, len(found), 32):
                    total += np.bincount(np.frombuffer(b"".join(found[lo : lo + 32]), wide), minlength=size)
                packed = pa.array([press.compress(x) for x in found], pa.binary())
                yield pa.record_batch([part.column(0), part.column(2), packed, pa.nulls(len(found), pa.binary())], names)
        if (used := np.flatnonzero(total)).size:
            counts = pa.array([np.stack([used, total[used]]).astype("<i8").tobytes()], pa.binary())
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, batch.schema.field(2).type), pa.nulls(1, pa.binary()), counts], names)

    names = ["doc_id", "place", "packed", "counts"]
    doc_id = F.col("doc_id").cast("long")
    chosen = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), (doc_id if place is None else place).alias("place"))
    kind = chosen.schema["place"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id long, place {kind}, packed binary, counts binary")


def id_type(size: int) -> str:
    """How ids below `size` are packed."""
    return "<u2" if size <= 1 << 16 else "<u4"


def unpacked(part: pa.RecordBatch, wide: str) -> list[np.ndarray]:
    unpress = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpress.decompress(x), wide) for x in part.column("packed").to_pylist()]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, max_bits: int = 16, num_partitions: int | None = None, place: Column | None = None) -> None:
    """Writes all documents to the folder `path`, in order of doc_id or of `place`, a column of docs.

    Counts go to the driver: at most one row for each id of the vocabulary."""
    spark = docs.sparkSession
    size = max(encoder(tokenizer).size, end_id + 1)
    wide = id_type(size)
    let_go()  # the driver doesn't encode
    kept = new_path(spark, "ids")
    encoded(docs, tokenizer, end_id, place).write.option("compression", "uncompressed").parquet(kept)
    ids = spark.read.parquet(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                used, n = np.frombuffer(x, "<i8").reshape(2, -1)
                yield pa.record_batch([pa.array(used), pa.array(n)], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in ids.where("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    used = int((counts > 0).sum())
    bits = max(max_bits, (max(1, used - 1)).bit_length() + 1 if used > 1 << (max_bits - 1) else max_bits)
    if bits > 25:
        raise ValueError("codes of more than 25 bits")
    lengths = code_lengths(counts, bits)
    spark.createDataFrame([(bits, bytearray(lengths.tobytes()))], "max_bits int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, number, first = canonical_codes(lengths), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        held_ids = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            payload, checks, n_bits = pack(ids, codes, lengths)
            row = {"part": part, "block": number, "first": first, "n_tokens": len(ids), "doc_ids": [d for d, _ in held], "doc_tokens": [len(x) for _, x in held], "checkpoints": checks.astype("<i8").tobytes(), "n_bits": n_bits, "payload": payload.tobytes()}
            return pa.RecordBatch.from_pylist([row], _BLOCK_SCHEMA)

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), unpacked(batch, wide), strict=True):
                held.append((d, x))
                held_ids += len(x)
                if held_ids >= BLOCK_TOKENS:
                    yield block()
                    number, first, held, held_ids = number + 1, first + held_ids, [], 0
        if held:
            yield block()

    n = num_partitions or partitions(spark)
    ordered = ids.where("packed IS NOT NULL").select("doc_id", "place", "packed").repartitionByRange(n, "place").sortWithinPartitions("place", "packed").drop("place")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_path(spark, kept)


_BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("checkpoints", pa.binary()), ("n_bits", pa.int64()), ("payload", pa.binary())])


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a folder that write() made.

    start: ids of all documents before it. The driver adds up one row for each range."""
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths = np.frombuffer(bytes(book["lengths"]), np.uint8)
    table = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = dict(table.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long"))).collect())
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = batch.slice(at, 16).to_pylist()
                found = decoder.decode([np.frombuffer(r["payload"], np.uint8) for r in rows], [np.frombuffer(r["checkpoints"], "<i8") for r in rows], [r["n_tokens"] for r in rows])
                for row, ids in zip(rows, found, strict=True):
                    n = np.array(row["doc_tokens"], np.int64)
                    ends = np.cumsum(n)
                    each = [ids[a:b] for a, b in zip(ends - n, ends, strict=True)]
                    columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(before[row["part"]] + row["first"] + ends - n), pa.array(n), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.tolist() for x in each], pa.list_(pa.int64())))
                    yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)
