"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and
share all words by weight; a target stops at three times its source's words and
the excess is shared anew. That is one water level over the sources in order of
words per weight, found by running sums.

Schedule: slot n stands at the fractional part of n times the golden ratio,
which falls into one source's stretch of the cumulative target shares. Slots are
ranked per source in chunks (a count for each source and chunk, added up, plus
the rank in the chunk), so no source is one task. Where a source has fewer slots
than blocks, the rest follow at the end; slots beyond its blocks are void.

Blocks: each source's documents, in an order shuffled by a keyed digest, lie end
to end, epoch after epoch, up to the target, cut every BLOCK words. A document's
place is its bucket's start plus a running sum in the bucket. Blocks meet slots
by source and rank; a document takes the words of its pieces, and stands in the
mix from the slot of its first piece on. copies() gives whole documents in the
order of the mix, as a corpus writer takes them.

Nulls: a null text has size 0; a null source is a source; a null doc_id is
shuffled by its text. Repeated rows are rows of their own. No words at all give
targets of 0; an empty table gives no rows. mix() drops other columns, copies()
keeps all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

BLOCK = 256
BUCKET_ROWS = 512
CHUNK = 8192
CELLS = 4096
EPOCHS = 3
#: A table of sources is broadcast up to this many rows, else joined by a shuffle whose skew AQE splits.
FEW = 10_000


def targets(sources: DataFrame) -> DataFrame:
    """sources: (source, source_size, n). Adds source_id, weight, target, quota. One task over a row for each source."""
    ranked = sources.withColumn("source_id", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", ((F.col("source_id") - 1) % 3 + 1).cast("double"))
    order = W.orderBy((F.col("source_size") / F.col("weight")), "source_id")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    total = F.sum("source_size").over(every)
    level = (total - EPOCHS * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_at = F.when(EPOCHS * F.col("source_size") >= F.col("weight") * F.col("level"), F.struct((F.col("source_size") / F.col("weight")).alias("at"), "source_id", "level"))
    ranked = ranked.withColumn("level", level).withColumn("level", F.min(open_at).over(every)["level"])  # of the first source below its stop
    target = F.least((EPOCHS * F.col("source_size")).cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.lit(0.0)))
    return ranked.withColumn("target", target).withColumn("quota", F.round("target").cast("long")).drop("level")


def _point(n: Column) -> Column:
    """Fractional part of n times the golden ratio, without losing digits at large n."""
    part = lambda x: x - F.floor(x)
    low, high = n % (1 << 20), F.floor(n / (1 << 20))
    return part(part(low * 0.6180339887498949) + part(high * 0.6077874097403510))


def schedule(sources: DataFrame, total: int) -> DataFrame:
    """(source_id, block, slot): the slot at which each block of each source comes."""
    spark = sources.sparkSession
    slots = -(-total // BLOCK)
    share = W.orderBy("source_id")
    edges = sources.withColumn("hi", F.sum("target").over(share.rowsBetween(W.unboundedPreceding, 0)) / F.lit(float(max(1, total)))).withColumn("lo", F.coalesce(F.lag("hi").over(share), F.lit(0.0)))
    edges = edges.withColumn("hi", F.when(F.lead("source_id").over(share).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    blocks = F.ceil(F.col("quota") / BLOCK).cast("long")
    cells = edges.where("hi > lo").select("source_id", blocks.alias("blocks"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least("hi", F.lit(1.0)) * CELLS))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = points.join(cells, "cell").where("u >= lo AND u < hi").select("source_id", "blocks", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    starts = drawn.groupBy("source_id", "chunk").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = drawn.withColumn("rank", F.row_number().over(W.partitionBy("source_id", "chunk").orderBy("slot")) - 1).join(starts, ["source_id", "chunk"]).withColumn("block", F.col("start") + F.col("rank"))
    first = ranked.where("block < blocks").select("source_id", "block", "slot")
    had = starts.groupBy("source_id").agg(F.sum("n").alias("had"))
    rest = sources.select("source_id", blocks.alias("blocks")).join(had, "source_id", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < blocks")
    late = rest.select("source_id", F.explode(F.sequence("had", F.col("blocks") - 1)).alias("block"))
    return first.unionByName(late.select("source_id", F.col("block").cast("long").alias("block"), (F.lit(slots) + F.col("block")).cast("long").alias("slot")))


def pieces(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): every document with its source's figures and its row key; and where its words lie in the mix.

    pieces: source_id, bucket, rn (the row key), epoch, slot, first (offset in the document), words."""
    spark = docs.sparkSession
    size = F.coalesce(F.call_function("regexp_count", F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).alias("print")), "sizes")
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))), "sources")
    total, few = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*") <= FEW).first()
    small = F.broadcast(sources) if few else sources

    placed = sized.join(small.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("print").cast("string")))  # rows without an id don't share one bucket
    placed = placed.withColumn("digest", F.md5(F.concat_ws(":", F.lit(str(seed)), name)))
    placed = placed.withColumn("bucket", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.ceil(F.col("n") / BUCKET_ROWS))
    inside = W.partitionBy("source_id", "bucket").orderBy("digest", "size", "print")
    placed = placed.withColumn("rn", F.row_number().over(inside)).withColumn("within", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = written(placed.drop("digest"), "placed")
    sums = placed.groupBy("source_id", "bucket").agg(F.sum("size").alias("s"))
    starts = sums.withColumn("start", F.coalesce(F.sum("s").over(W.partitionBy("source_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("s")

    laid = placed.where("size > 0").join(starts, ["source_id", "bucket"]).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    laid = laid.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start") + F.col("within")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota"))).where("from < to")
    cut = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / BLOCK), F.floor((F.col("to") - 1) / BLOCK))))
    low, high = F.greatest(F.col("from"), F.col("block") * BLOCK), F.least(F.col("to"), (F.col("block") + 1) * BLOCK)
    cut = cut.select("source_id", "bucket", "rn", "epoch", "block", (low - F.col("from")).alias("first"), (high - low).alias("words"))
    return placed, cut.join(schedule(sources, total), ["source_id", "block"])


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_blocks) of every row of docs (doc_id, source, text).

    first_slot: the slot of the schedule where the document first comes, null if it never does; n_blocks: in how many
    blocks it lies, over all epochs."""
    rows, parts = pieces(docs, seed)
    sums = (F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_blocks"))
    joined = rows.join(parts.groupBy("source_id", "bucket", "rn").agg(*sums), ["source_id", "bucket", "rn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "size", "source_size", "target", zero("taken"), F.col("first_slot").cast("long").alias("first_slot"), zero("n_blocks"))


def copies(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, whole, in its order: each as often as the mix takes its words, to the nearest time.

    A document that the mix takes in part comes once. Rows alike in doc_id, source and text are one text, taken as
    often as all of them. All columns of docs are kept; where such rows differ in others, the least row's are."""
    rows, parts = pieces(docs, seed)
    key = ["source_id", "bucket", "rn"]
    each = parts.groupBy(*key, "epoch").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))
    sized = each.join(rows.select(*key, "size", "print"), key)
    times = F.greatest(F.lit(1), F.round(F.sum("words").over(W.partitionBy(*key)) / F.col("size")))
    wanted = sized.withColumn("times", times).where("epoch < times").select(F.col("print").alias("__wanted"), F.col("slot").alias("__slot"), F.col("epoch").alias("__epoch"))
    marked = docs.withColumn("__print", F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")))
    if not rows.groupBy("print").count().where("count > 1").isEmpty():
        marked = marked.groupBy("__print").agg(F.min(F.struct(*docs.columns)).alias("row")).select("__print", "row.*")
    # A merge of both sides at every size: texts are shuffled by print, and once more into the order of the mix.
    return marked.hint("merge").join(wanted, F.col("__print") == F.col("__wanted")).orderBy("__slot", "__print", "__epoch").select(*docs.columns)
