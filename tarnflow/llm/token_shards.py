"""Token-id shards in ORC: encode documents, write sorted shards, read them back in parallel.

Layout. Documents are range-partitioned and sorted by ``doc_id``; every task
encodes its range and writes one ORC file whose integer columns use ORC's
run-length encoding (version 2), with a row index every ``ROW_STRIDE`` rows and
a Bloom filter on ``doc_id``. A point lookup by id therefore skips files and
stripes by their statistics and row groups by the Bloom filter; a scan splits
at stripes.

A document's global start is its start inside the shard plus the shard's
offset. Only the per-shard totals (one row a shard) are summed in order.

Defined results: a null text is empty and gets only the end id; null ids sort
first; rows that share an id are kept, ordered by a hash of
their text, and are spread over shards like others; an empty table gives an
empty result; texts of any length are one row of ids. Strings that are special
tokens become these tokens, as the library does; ``special_as_text`` makes them
ordinary text. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.llm._scratch import bound_batches

ROW_STRIDE = 1000
STRIPE_BYTES = 16 << 20
#: Entries of each worker's cache (some 60 to 110 bytes each); beyond it the cache starts anew, which costs time only.
CACHE_ENTRIES = 500_000

SHARD_SCHEMA = "doc_id bigint, shard int, rel_start bigint, n_tokens bigint, ids array<int>"

#: Characters for which every engine agrees on letter, digit and space classes.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-±´-¸»¿-ɏ]*\Z")
#: The pattern under which letters end at ASCII signs, and the kinds of bytes: white space, letter, other ASCII, beyond.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KIND = np.array([0 if c == 32 or 9 <= c <= 13 else 1 if chr(c).isalpha() and c < 128 else 2 if c < 128 else 3 for c in range(256)], np.uint8)
#: Bytes of text whose chunks are hashed together.
BLOCK_BYTES = 1 << 19
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.ones(1, np.uint64)
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    return p


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` items."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a) // 2), a.dtype)])


def odd_spaces(b: np.ndarray) -> np.ndarray:
    """Offsets of white space beyond ASCII's, and of controls that only some engines take for it."""
    at = np.flatnonzero(((b >= 0x1C) & (b <= 0x1F)) | (b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3)))
    x = b[at]
    y, z = (b[np.minimum(at + k, len(b) - 1)] for k in (1, 2))
    general = (y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F)
    odd = (x < 0x20) | (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) | (x == 0xE2) & general | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    return at[odd]


class PieceEncoder:
    """Encodes whole texts through a cache of chunks.

    A pre-token never has white space after a visible character, so a text's
    ids are the ids of its chunks (white space and the visible characters after
    it) in order; with the usual pattern an ASCII letter's run also ends at the
    next ASCII sign, so that most chunks are words. The chunks of a block of
    texts are found, hashed and looked up on the bytes at once, in arrays (a
    table of slots, and the bytes and ids of each slot); only distinct new ones
    go through the tokenizer. Hashes only gather equal chunks: the bytes of all
    are compared with their slot's, and texts with a chunk that differs go to
    the tokenizer whole, as texts with rare white space or special tokens do. A
    full cache takes nothing new and starts anew when it stops matching the
    texts; both cost time only.
    """

    def __init__(self, tokenizer_json: str, pattern: str, special_as_text: bool = False, capacity: int = CACHE_ENTRIES):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = special_as_text
        #: Strings that the tokenizer takes out of a text before anything else.
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = [t.content.encode() for t in added]
        self.words = regex.compile(pattern)
        self.letters_end = pattern == _USUAL
        #: Whether a token begins with the byte-level letter of a space.
        self.spaced = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.capacity = capacity
        self.value = _mixed(np.arange(1, 257, dtype=np.uint64) * _M1)
        self.up = self.down = np.ones(1, np.uint64)
        self.shift = np.uint64(64 - (2 * capacity + 1).bit_length())
        self._reset()

    def _reset(self) -> None:
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.keys = np.zeros(1 << 12, np.uint64)
        #: Where a slot's bytes and ids begin; they end where the next slot's begin.
        self.byte_at, self.id_at = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.bytes, self.ids = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int32)
        self.used, self.missed = 0, 0.0

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the count of each; the texts are UTF-8 at ``offsets``."""
        flat, counts, a = [], [], 0
        while a < len(offsets) - 1:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1)
            ids, n = self._block(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
            flat.append(ids)
            counts.append(n)
            a = b
        return np.concatenate([*flat, np.empty(0, np.int32)]), np.concatenate([*counts, np.empty(0, np.int64)])

    def _block(self, offsets: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts, size = len(offsets) - 1, len(b)
        if not size:
            return np.empty(0, np.int32), np.zeros(texts, np.int64)
        first = self._chunks(offsets, b)
        last = np.append(first[1:], size)
        length = last - first
        key = self._hashes(b, first, last)
        raw = b.tobytes()
        slot = self._slots(key, first, last, raw)
        begin = self.id_at[slot]
        n = self.id_at[slot + 1] - begin
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(begin - ends + n, n) + np.arange(ends[-1])]
        before = np.append(0, ends)[np.searchsorted(first, offsets)]
        counts = np.diff(before)
        begin = self.byte_at[slot]
        unlike = [first[self.byte_at[slot + 1] - begin != length], self._added_at(raw)]
        other = np.repeat(begin - first, length)
        other += np.arange(size)
        unlike.append(np.flatnonzero(self.bytes.take(other, mode="clip") != b))
        if self.used >= self.capacity and self.missed > 0.3:
            self._reset()
        odd = np.unique(np.searchsorted(offsets, np.concatenate([odd_spaces(b), *unlike]), "right") - 1)
        if len(odd):
            whole = self.tokenizer.encode_batch_fast([raw[offsets[t] : offsets[t + 1]].decode() for t in odd], add_special_tokens=False)
            parts = np.split(flat, before[1:-1])
            for t, e in zip(odd.tolist(), whole, strict=True):
                parts[t] = np.array(e.ids, np.int32)
                counts[t] = len(parts[t])
            flat = np.concatenate(parts)
        return flat, counts

    def _chunks(self, offsets: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where chunks begin."""
        kind = _KIND[b]
        space = kind == 0
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        if self.letters_end:
            begins[1:] |= (kind[:-1] == 1) & (kind[1:] == 2)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(begins)

    def _hashes(self, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        size = len(b)
        if size > len(self.up):
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(self.value[b] * self.up[:size], out=sums[1:])
        return _mixed((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64) * _M2)

    def _added_at(self, raw: bytes) -> np.ndarray:
        """Offsets of the strings that are tokens as a whole."""
        found = []
        for string in self.added:
            at = raw.find(string)
            while at >= 0:
                found.append(at)
                at = raw.find(string, at + 1)
        return np.array(found, np.int64)

    def _slots(self, key: np.ndarray, first: np.ndarray, last: np.ndarray, raw: bytes) -> np.ndarray:
        """The slot of each chunk; those that a full cache doesn't take get one for this block."""
        slot = self._find(key)
        miss = np.flatnonzero(slot < 0)
        self.missed = len(miss) / len(key)
        if len(miss):
            new, at, where = np.unique(key[miss], return_index=True, return_inverse=True)
            chunks = [raw[s:e] for s, e in zip(first[miss[at]].tolist(), last[miss[at]].tolist(), strict=True)]
            order, ids, n = self._ids(chunks)
            slots = np.empty(len(new), np.int64)
            slots[order] = np.arange(self.used, self.used + len(new))
            slot[miss] = slots[where]
            kept = max(0, min(len(new), self.capacity - self.used))
            self._append(new[order], b"".join([chunks[i] for i in order]), np.array([len(chunks[i]) for i in order]), ids, n)
            self._enter(new[order[:kept]])
        return slot

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key by linear probing, -1 if there is none."""
        at = (key >> self.shift).astype(np.int64)
        slot = self.table[at].astype(np.int64)
        probe = np.flatnonzero((slot >= 0) & (self.keys[slot] != key))
        while len(probe):
            at[probe] = (at[probe] + 1) % len(self.table)
            slot[probe] = found = self.table[at[probe]]
            probe = probe[(found >= 0) & (self.keys[found] != key[probe])]
        return slot

    def _enter(self, key: np.ndarray) -> None:
        """The next slots get keys, which are distinct and new."""
        slots, at, left = np.arange(self.used, self.used + len(key)), (key >> self.shift).astype(np.int64), np.arange(len(key))
        while len(left):
            free = left[self.table[at[left]] < 0]
            self.table[at[free]] = slots[free]
            left = left[self.table[at[left]] != slots[left]]
            at[left] = (at[left] + 1) % len(self.table)
        self.used += len(key)

    def _append(self, key: np.ndarray, raw: bytes, lengths: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Keys, bytes and ids behind the slots in use."""
        a, z = self.used, self.used + len(key)
        self.keys, self.byte_at, self.id_at = _room(self.keys, z), _room(self.byte_at, z + 1), _room(self.id_at, z + 1)
        self.keys[a:z] = key
        self.byte_at[a + 1 : z + 1] = self.byte_at[a] + np.cumsum(lengths)
        self.id_at[a + 1 : z + 1] = self.id_at[a] + np.cumsum(n)
        self.bytes, self.ids = _room(self.bytes, self.byte_at[z]), _room(self.ids, self.id_at[z])
        self.bytes[self.byte_at[a] : self.byte_at[z]] = np.frombuffer(raw, np.uint8)
        self.ids[self.id_at[a] : self.id_at[z]] = ids

    def _ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the chunks, and in it their ids and the count of each."""
        plain = _PLAIN.match
        words = [i for i, p in enumerate(chunks) if p[:1] == b" " and (p[1:].isalpha() or (t := p[1:].decode()).isalpha() and plain(t))] if self.letters_end else []
        known = set(words)
        rest = [i for i in range(len(chunks)) if i not in known]
        ids, counts = [], []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            joined = b"".join([chunks[k] for k in part])
            run = np.array(self.tokenizer.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, np.int32)
            starts = np.flatnonzero(self.spaced[run])
            if len(starts) != len(part) or starts[0] or len(self._added_at(joined)):  # not as the pattern says: each by itself
                found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([chunks[k].decode() for k in part], add_special_tokens=False)]
                run, n = np.concatenate(found), np.array(list(map(len, found)))
            else:
                n = np.diff(np.append(starts, len(run)))
            ids.append(run)
            counts.append(n)
        for i in range(0, len(rest), 20_000):
            found = self._split([chunks[k].decode() for k in rest[i : i + 20_000]])
            ids.append(np.frombuffer(b"".join(found), np.int32))
            counts.append(np.array(list(map(len, found))) // 4)
        return np.array(words + rest, np.int64), np.concatenate(ids), np.concatenate(counts)

    def _split(self, parts: list[str]) -> list[bytes]:
        """The ids of any chunks, by their distinct pre-tokens."""
        find, plain = self.words.findall, _PLAIN.match
        split = [find(p) if plain(p) else None for p in parts]
        new, known = list({w for ws in split if ws for w in ws}), {}
        for i in range(0, len(new), 20_000):
            block = new[i : i + 20_000]
            e = self.tokenizer.encode(block, is_pretokenized=True, add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(block)) * 4).tolist()
            raw = np.array(e.ids, np.int32).tobytes()
            known.update((w, raw[a:b]) for w, a, b in zip(block, [0, *ends], ends, strict=False))
        direct = iter(self.tokenizer.encode_batch_fast([p for p, ws in zip(parts, split, strict=True) if ws is None], add_special_tokens=False))
        return [np.array(next(direct).ids, np.int32).tobytes() if ws is None else b"".join(map(known.__getitem__, ws)) for ws in split]


_ENCODERS: dict[tuple[int, str, bool], PieceEncoder] = {}


def encoder_of(tokenizer_json: str, pattern: str, special_as_text: bool) -> PieceEncoder:
    """The worker's encoder; it serves all tasks of the process, so that its cache stays warm."""
    key = (hash(tokenizer_json), pattern, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(tokenizer_json, pattern, special_as_text)
    return _ENCODERS[key]


def encode_sorted(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Rows of SHARD_SCHEMA, range-partitioned and sorted by id."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:  # one tokenizer's vocabulary: a few MB
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, shard = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or encoder_of(model.value, pattern, special_as_text)
            text = batch.column(1).cast(pa.large_string())
            text = text.fill_null("") if text.null_count else text
            _, where, data = text.buffers()
            offsets = np.frombuffer(where, np.int64)[text.offset : text.offset + len(text) + 1]
            flat, counts = encoder.encode(offsets, np.frombuffer(data or b"", np.uint8))
            n = counts + 1
            ends = np.cumsum(n)
            ids = np.full(ends[-1], end_id, np.int32)
            mask = np.ones(ends[-1], bool)
            mask[ends - 1] = False
            ids[mask] = flat
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + ends - n), pa.array(n), lists], ["doc_id", "shard", "rel_start", "n_tokens", "ids"])
            start += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(run, SHARD_SCHEMA)


def write_shards(docs: DataFrame, path: str, tokenizer_file: str, pattern: str, end_id: int = 0, special_as_text: bool = False) -> None:
    """Encode ``docs`` and write the ORC shards under ``path``."""
    (
        encode_sorted(docs, tokenizer_file, pattern, end_id, special_as_text)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_shards(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """The shards' rows; a predicate on ``doc_id`` is pushed to ORC statistics and Bloom filters."""
    df = spark.read.schema(SHARD_SCHEMA).orc(path)
    return df if wanted is None else df.where(wanted)


def with_global_start(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds ``start`` to ``rows`` of ``shards``: the ids of all documents before each."""
    totals = shards.groupBy("shard").agg(F.max(F.col("rel_start") + F.col("n_tokens")).alias("total"))
    # One row a shard: the ordered sum runs in one task over as many rows as there are files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "shard").withColumn("start", F.col("offset") + F.col("rel_start"))


def checksums(shards: DataFrame) -> DataFrame:
    """doc_id, shard, rel_start, n_tokens and the unsigned crc32 of the little-endian ids read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["doc_id", "shard", "rel_start", "n_tokens", "ids_crc32"])

    bound_batches(shards.sparkSession)
    return shards.mapInArrow(run, "doc_id bigint, shard int, rel_start bigint, n_tokens bigint, ids_crc32 bigint")
