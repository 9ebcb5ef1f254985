"""Mix sources to target weights with a low-discrepancy schedule of equal-token blocks.

1. *Targets.* Sources in code-point order (null last) weigh 1, 2, 3, repeating.
   Their targets share the words of the whole corpus by weight; a target stops
   at ``max_repeats`` times its source's words and the excess goes to the others.
2. *Streams.* Each source's documents, in the order of a hash of their id, form
   a stream of words; the stream repeats pass after pass up to the target. It
   is cut into blocks of ``block_words`` words.
3. *Schedule.* Slot ``i`` takes the golden-ratio point ``frac(i * phi)`` through
   the cumulative target shares to a source; the rank of the slot among the
   source's slots is the block that it plays. Slots beyond a source's last
   block are void; blocks left over when the slots end follow at the end.
4. *Join.* Slots and the document pieces of each block meet on (source, block).

All prefix sums have two levels (hash buckets of a source, chunks of slots), so
a source with a third of all rows is still spread over thousands of groups.
Only DataFrame functions are used.

Defined results: null text has size 0; documents of size 0 take nothing; null
ids and repeated rows are rows of their own (rows without an id are ordered by
a hash of their text); a long document is cut at the blocks' borders; equal
shares are ordered by source; other columns pass ``mixed_documents`` unread,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.llm._scratch import Scratch, materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 4096
MAX_REPEATS = 3
#: Slots of one chunk are ranked together; hash digits that name a bucket of a source's stream.
SLOT_CHUNK = 1 << 16
BUCKET_DIGITS = 3
#: Cells into which [0, 1) is cut to find a point's source by an equi-join.
CELLS = 4096
GOLDEN = 0.6180339887498949
#: frac(2**20 * golden ratio), so that points of large slots keep their precision.
GOLDEN_20 = 0.607787409740351


@dataclass
class Mix:
    """The parts of a mix; ``schedule`` is the mix itself, in slot order."""

    rows: DataFrame  # doc_id, source, size, sid, bucket, pos, begin
    sources: DataFrame  # source, sid, source_size, target, quota
    schedule: DataFrame  # slot, sid, rank, doc_id, bucket, pos, from_word, words
    temp: Scratch  # what the others read; to be released after them


def stream_key() -> Column:
    """The order of a source's stream; rows without an id are told apart by their text."""
    without_id = F.concat(F.lit("null"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("bigint").cast("string"), without_id)).cast("binary"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the shuffle key of each row."""
    return docs.select(
        F.col("doc_id").cast("bigint"),
        F.col("source").cast("string"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        stream_key().alias("key"),
    )


def source_targets(rows: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: sid, size, weight and target by water-filling.

    With caps in the order of cap per weight, source k is capped iff the share
    that is left after capping all before it still reaches its cap. The windows
    run over one row a source.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("ratio", "sid")
    all_rows = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * max_repeats
    return (
        rows.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(named))
        .withColumn("weight", (F.col("sid") - 1) % 3 + 1)
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("capped", F.col("level") >= F.col("ratio"))
        .withColumn("final", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(all_rows))
        .withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("final") * F.col("weight")))
        .withColumn("quota", F.least(F.floor(F.col("target") + 0.5), cap))
        .select("source", "sid", "source_size", "target", "quota")
    )


def stream_positions(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds sid, bucket, pos and ``begin``, the row's first word in its source's stream."""
    keyed = rows.join(sources.select("source", "sid"), rows["source"].eqNullSafe(sources["source"])).select(rows["*"], "sid", F.substring("key", 1, BUCKET_DIGITS).alias("bucket"))
    buckets = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("sid", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size")
    placed = keyed.withColumn("pos", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(offsets, ["sid", "bucket"]).select("doc_id", "source", "size", "sid", "bucket", "pos", (F.col("offset") + F.col("upto") - F.col("size")).alias("begin"))


def slot_ranks(spark: SparkSession, sources: DataFrame, n_slots: int, total: int, block_words: int) -> DataFrame:
    """slot, sid, rank: which block of which source each slot plays."""
    upto = F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    shares = sources.select("sid", "quota", F.ceil(F.col("quota") / block_words).alias("blocks"), ((upto - F.col("quota")) / total).alias("lo"), (upto / total).alias("hi"))
    cells = shares.where("quota > 0").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS)))).alias("cell"))
    i = F.col("id")
    point = (F.floor(i / (1 << 20)) * GOLDEN_20 % 1.0 + (i % (1 << 20)) * GOLDEN) % 1.0
    points = spark.range(n_slots).select(i.alias("slot"), F.floor(i / SLOT_CHUNK).alias("chunk"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    played = points.join(cells, "cell").where("lo <= u and u < hi").select("slot", "chunk", "sid")
    counts = played.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = played.withColumn("r", F.row_number().over(inside)).join(offsets, ["sid", "chunk"]).select("slot", "sid", (F.col("offset") + F.col("r") - 1).alias("rank"))
    met = shares.join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tail = met.where("n < blocks").select("sid", F.explode(F.sequence(F.col("n"), F.col("blocks") - 1)).alias("rank")).select((F.col("rank") + n_slots).alias("slot"), "sid", "rank")
    return ranked.join(shares.select("sid", "blocks"), "sid").where("rank < blocks").select("slot", "sid", "rank").unionByName(tail)


def block_pieces(placed: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """Each document's words, pass by pass up to the quota, cut at block borders."""
    s = sources.where("quota > 0").select("sid", "source_size", "quota")
    per_pass = (
        placed.where("size > 0")
        .join(s, "sid")
        .where("begin < quota")
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1 - F.col("begin")) / F.col("source_size")).cast("int"))))
        .withColumn("a", F.col("turn") * F.col("source_size") + F.col("begin"))
        .withColumn("b", F.least(F.col("a") + F.col("size"), F.col("quota")))
    )
    cut = per_pass.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block_words), F.floor((F.col("b") - 1) / block_words))))
    first = F.greatest(F.col("a"), F.col("block") * block_words)
    last = F.least(F.col("b"), (F.col("block") + 1) * block_words)
    return cut.select("sid", "block", "doc_id", "bucket", "pos", (first - F.col("a")).alias("from_word"), (last - first).alias("words"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> Mix:
    """Plan the mix of ``docs`` (columns doc_id, source, text)."""
    spark = docs.sparkSession
    temp = Scratch(spark)
    rows = temp.write(measured(docs), "mix-rows")
    sources = temp.write(source_targets(rows, max_repeats), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    n_slots = -(-total[0] // block_words) + total[1]
    placed = temp.write(stream_positions(rows, sources), "mix-streams")
    slots = slot_ranks(spark, sources, n_slots, max(1, total[0]), block_words)
    pieces = block_pieces(placed, sources, block_words)
    schedule = slots.withColumnRenamed("rank", "block").join(pieces, ["sid", "block"]).select("slot", "sid", F.col("block").alias("rank"), "doc_id", "bucket", "pos", "from_word", "words")
    return Mix(placed, sources, schedule, temp)


def mix_counts(m: Mix) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each input row."""
    played = m.schedule.groupBy("sid", "bucket", "pos").agg(F.sum("words").alias("taken"))
    s = m.sources.select("sid", "source_size", "target")
    return m.rows.join(played, ["sid", "bucket", "pos"], "left").join(s, "sid").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix plays them, whole: a row for each pass that reaches the document.

    A document is played in a pass if the pass comes to its first word before
    the source's quota ends; rows equal in id, source and size count alike.
    """
    m = mix(docs, **options)
    s = m.sources.select("sid", "source_size", "quota")
    copies = F.floor((F.col("quota") - 1 - F.col("begin")) / F.col("source_size")) + 1
    times = m.rows.join(s, "sid").where("size > 0 and begin < quota").groupBy("doc_id", "source", "size").agg(F.max(copies).cast("int").alias("copies"))
    wanted, _ = materialize(docs.sparkSession, times.select(F.col("doc_id").alias("id2"), F.col("source").alias("source2"), F.col("size").alias("size2"), "copies"), "mix-copies")
    m.temp.release()
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id1"), F.col("source").cast("string").alias("source1"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size1"))
    same = F.col("id1").eqNullSafe(F.col("id2")) & F.col("source1").eqNullSafe(F.col("source2")) & (F.col("size1") == F.col("size2"))
    return own.join(wanted, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn")).select("row.*")
