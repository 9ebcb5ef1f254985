"""Long repeated byte strings: bucket-pointer refinement over sampled suffixes.

A window (a suffix cut at ``WINDOW`` bytes) is refined by bucket identifiers at
later offsets:

* *Initial buckets.* Every offset belongs to the bucket of its ``FIRST``-gram,
  whose identifier is the gram itself.
* *Refinement.* A bucket of q-grams is refined to one of 2q-grams by the
  identifiers at an offset and at the offset q later; the updated identifiers
  are what the next step refines by, and so on up to ``GRAM`` bytes. New
  identifiers are hashes of the pair and not ranks, so that they are the same on
  all machines without a sort of the whole corpus, and each document refines
  its own suffixes.
* *Samples.* Of the offsets a window covers, the one with the least identifier
  names the window's bucket (equal windows have equal ones). Consecutive
  windows of one bucket form a run of at most ``LATER`` + 1 windows, so one entry
  in about 73 bytes goes to the shuffle, and one in 145 where a text repeats
  itself. A bucket with one entry is final, unless the entry's run has its gram
  twice: none of its windows repeats.
* *Last refinement.* A window equals (identifier at its start, identifier at the
  later offset ``WINDOW - GRAM``). A run's identifier is refined from the
  identifiers at its start, at the later offset, and at the later offset of its
  last window. Entries of one bucket and equal run identifiers repeat as a
  whole. Where runs of a bucket differ, one entry for each run identifier is
  refined once more, window by window, from the same identifiers.

Identifiers are counted by hash aggregation, which combines equal keys before
the shuffle. A passage in a third of all documents has a bucket for each of its
runs, and a text that repeats itself one entry in 145 bytes, so that no bucket
holds more than a small part of all entries.

Defined results: null text is empty; texts shorter than a window keep all
bytes, and longer ones may have any length that a row can; equal rows count as
repeats of each other, rows without an id like others; only doc_id and text are
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm._id_filter import IdFilter
from tarnflow.llm._scratch import Scratch, bound_batches, materialize

WINDOW, GRAM = 400, 256
LATER = WINDOW - GRAM
#: Bytes of the initial grams; doubling them ends at GRAM.
FIRST = 8

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
S29, S32 = np.uint64(29), np.uint64(32)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S32)) * M1
    x = (x ^ (x >> S29)) * M2
    return x ^ (x >> S32)


def identifiers(raw: bytes) -> np.ndarray:
    """Bucket identifiers of all GRAM-grams of a byte string, refined from FIRST-grams by doubling."""
    n = len(raw) - FIRST + 1
    ids = np.empty(n, np.uint64)
    for k in range(FIRST):
        ids[k::FIRST] = np.frombuffer(raw, "<u8", (n - k + FIRST - 1) // FIRST, k)
    q = FIRST
    while q < GRAM:
        ids = mix64(mix64(ids[:-q] + M1) + ids[q:] * M2)
        q *= 2
    return ids


def sliding(values: np.ndarray, out: int, least: bool) -> np.ndarray:
    """Least (or greatest) value of each of the first ``out`` stretches of LATER + 1 values, by running extremes from both ends of blocks."""
    span, pick = LATER + 1, np.minimum if least else np.maximum
    blocks = -(-(out + LATER) // span)
    grid = np.full(blocks * span, np.iinfo(np.uint64).max if least else 0, np.uint64)
    grid[: len(values)] = values
    grid = grid.reshape(blocks, span)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:out], ahead[LATER : LATER + out])


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, first and last window start of each run, and whether the run may hold equal windows."""
    n, span = len(ids) - LATER, LATER + 1
    least = sliding(ids, n, True)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    length = np.diff(np.append(begin, n))
    pieces = -(-length // span)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(begin, pieces) + nth * span
    last = np.append(first[1:], n) - 1
    # Equal windows of one run have the run's gram at two places. An offset's gram names some
    # window's bucket if it is the greatest of the least values of the windows that cover it.
    padded = np.concatenate([np.zeros(LATER, np.uint64), least, np.zeros(LATER, np.uint64)])
    at = np.flatnonzero(ids == sliding(padded, len(ids), False))
    names = np.unique(least[first])
    place = lambda value, offset: np.searchsorted(names, value) * (len(ids) + 1) + offset
    places = np.sort(place(ids[at], at))
    bucket = least[first]
    times = np.searchsorted(places, place(bucket, last + LATER), "right") - np.searchsorted(places, place(bucket, first), "left")
    return bucket, first, last, times > 1


def run_ids(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each run, from the identifiers at its start and at two later offsets."""
    a, b, c = ids[first], ids[first + LATER], ids[last + LATER]
    width = (last - first).astype(np.uint64)
    one = mix64(mix64(mix64(a + width) + b * M1) + c * M2)
    two = mix64(mix64(mix64(c + M1) + a * M2 + width) + b)
    return one.view(np.int64), two.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row key (k1, k2) and text. The key joins; equal keys have equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def entries(rows: DataFrame) -> DataFrame:
    """k1, k2, first, last, bucket, one, two, loops: the corpus as entries of buckets."""
    names = ["k1", "k2", "first", "last", "bucket", "one", "two", "loops"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                if len(raw) < WINDOW:
                    continue
                ids = identifiers(raw)
                bucket, first, last, loops = runs(ids)
                one, two = run_ids(ids, first, last)
                for o, v in zip(out, (np.full(len(first), k1), np.full(len(first), k2), first.astype(np.int32), last.astype(np.int32), bucket.view(np.int64), one, two, loops), strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names)

    return rows.select("k1", "k2", "text").mapInArrow(run, "k1 bigint, k2 bigint, first int, last int, bucket bigint, one bigint, two bigint, loops boolean")


def refine(rows: DataFrame, open_runs: DataFrame) -> DataFrame:
    """k1, k2, at, need, one, two: the windows of ``open_runs``, each with its refined identifier."""
    chosen = IdFilter.of(open_runs, "k1", "k2")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(chosen.has(batch.column(3), batch.column(4))))
            yield pa.RecordBatch.from_arrays(part.columns[:3], ["k1", "k2", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = identifiers(text.encode())
                n = np.array([s["last"] - s["first"] + 1 for s in spans])
                begin = np.array([s["first"] for s in spans])
                at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                need = np.repeat(np.array([s["need"] for s in spans], bool), n)
                for i in range(0, len(at), 1 << 18):
                    part = at[i : i + (1 << 18)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), k1)), pa.array(np.full(len(part), k2)), pa.array(part.astype(np.int32)), pa.array(need[i : i + (1 << 18)]), pa.array(ids[part].view(np.int64)), pa.array(ids[part + LATER].view(np.int64))],
                        ["k1", "k2", "at", "need", "one", "two"],
                    )

    texts = rows.select("k1", "k2", "text", *IdFilter.hashes("k1", "k2")).mapInArrow(keep, "k1 bigint, k2 bigint, text string")
    once = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    of_row = open_runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "need")).alias("spans"))
    return once.join(of_row, ["k1", "k2"]).mapInArrow(run, "k1 bigint, k2 bigint, at int, need boolean, one bigint, two bigint")


def repeated_ranges(temp: Scratch, docs: DataFrame) -> DataFrame:
    """k1, k2, start, end: byte ranges (they may overlap) that repeated windows cover."""
    bound_batches(temp.spark)
    rows = keyed(docs)
    all_ = temp.write(entries(rows), "entries")
    run = ["bucket", "one", "two"]
    shared = all_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("loops").alias("loops")).where("n > 1 or loops").select("bucket")
    live = temp.write(all_.join(shared, "bucket", "left_semi"), "live-entries")
    temp.release(all_)
    classes = live.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "first", "last")).alias("least"), F.max("loops").alias("loops"))
    classes = temp.write(classes, "run-classes")
    whole = live.join(classes.where("n > 1").select(*run), run, "left_semi")
    whole = whole.select("k1", "k2", F.col("first").alias("start"), (F.col("last") + WINDOW).alias("end")).distinct()
    # a bucket with several runs of which one is alone: that one is open, the others it may meet go along
    of_bucket = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("fewest"), F.max(F.col("loops") & (F.col("n") == 1)).alias("loops"))
    mixed = of_bucket.where("runs > 1 and fewest = 1 or loops").select("bucket")
    open_runs = classes.join(mixed, "bucket", "left_semi").select("least.k1", "least.k2", "least.first", "least.last", (F.col("n") == 1).alias("need"))
    windows = temp.write(refine(rows, temp.write(open_runs, "open-runs")), "windows")
    again = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
    parts = windows.where("need").join(again, ["one", "two"], "left_semi").select("k1", "k2", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("end"))
    ranges = temp.write(whole.unionByName(parts), "ranges")
    temp.release(live, classes, windows)
    return ranges


def cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """Columns of RESULT for every row: what is left of it, as digest and (if asked for) as bytes.

    Rows that the filter excludes have no range and are finished where they are
    read; only the others meet their ranges in a shuffle.
    """
    temp = Scratch(docs.sparkSession)
    ranges = repeated_ranges(temp, docs)
    chosen = IdFilter.of(ranges, "k1", "k2")
    names = [c.split()[0] for c in RESULT.split(", ")]

    def result(items: list[tuple[int, str, list]]) -> pa.RecordBatch:
        rows = []
        for doc_id, text, spans in items:
            raw, at, left = text.encode(), 0, []
            gone = cover([(s["start"], s["end"]) for s in spans])
            for a, b in gone:
                left.append(raw[at:a])
                at = b
            rest = b"".join([*left, raw[at:]])
            rows.append((doc_id, len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest if with_bytes else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~chosen.has(batch.column(2), batch.column(3))))
            yield result([(i, t, []) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)])

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(chosen.has(batch.column(4), batch.column(5)))).select(["doc_id", "text", "k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield result([(i, t, s or []) for i, t, s in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    rows = keyed(docs).select("doc_id", "text", "k1", "k2", *IdFilter.hashes("k1", "k2"))
    of_row = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    met = rows.mapInArrow(other, "doc_id bigint, text string, k1 bigint, k2 bigint").join(of_row, ["k1", "k2"], "left")
    bound_batches(temp.spark)
    out = rows.select("doc_id", "text", "_h1", "_h2").mapInArrow(clean, RESULT).unionByName(met.select("doc_id", "text", "spans").mapInArrow(cut, RESULT))
    if with_bytes:  # as large as the corpus: left to the caller to write
        return out
    out, _ = materialize(temp.spark, out, "cut")
    temp.release()
    return out
