"""ISO media containers (MP4 family): write byte payloads as tracks, read tracks without their payloads.

``read_tracks`` walks the nested boxes of a container and decodes each track's
sample tables (``stts``, ``stsc``, ``stsz``/``stz2``, ``stco``/``co64``, ``stss``) and its movie
fragments (``trex``, ``tfhd``, ``trun``) to codec, duration, sample count and the byte
ranges of keyframes. It touches box headers and tables only; the media data
itself is neither decoded nor copied.

``store`` makes a container of arbitrary bytes: one track of unsigned 8-bit
samples (codec ``raw ``), ``FRAME`` bytes a frame, ``CHUNK_FRAMES`` frames a chunk,
each chunk's first frame a keyframe. Equal payloads make equal containers.
``payload`` reads them back through the sample tables.

Defined results: null or damaged containers have no tracks; a box that claims
more bytes than its parent has ends with its parent, at any depth of nesting;
track times of 0 give the sum of the samples' times, or duration 0; boxes of
unknown types are skipped; tables that contradict each other (samples beyond
the chunks' table, chunks that do not ascend, more samples than bytes) end the
track's ranges there, and no table makes arrays longer than the container.
Edit lists and composition offsets do not change durations. Null texts are
empty; long texts make one container each (64-bit boxes beyond 4 GB); repeated
rows are rows of their own; an empty table gives no rows. ``read_tracks`` keeps
all columns; a column of the name asked for is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm._scratch import bound_batches

FRAME = 64
CHUNK_FRAMES = 16
RATE = 8000

#: Box types that hold boxes.
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"moof", b"traf", b"dinf", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def _u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def _table(values: np.ndarray, kind: str = ">u4") -> bytes:
    return _u32(len(values)) + values.astype(kind).tobytes()


def padded(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of FRAME."""
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b"\0")


def store(payload: bytes) -> bytes:
    """A container with ``payload`` (a multiple of FRAME bytes) as its one track."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    head = box(b"ftyp", b"isom", _u32(0x200), b"isommp42")
    wide = len(payload) + 8 >= 1 << 32
    media = (struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")) + payload
    at = len(head) + (16 if wide else 8) + np.arange(chunks, dtype=np.int64) * FRAME * CHUNK_FRAMES
    tail = frames - (chunks - 1) * CHUNK_FRAMES
    per_chunk = [(1, CHUNK_FRAMES, 1)] * (chunks > 1 or tail == CHUNK_FRAMES) + [(chunks, tail, 1)] * (tail != CHUNK_FRAMES)
    length = frames * FRAME
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    tables = box(
        b"stbl",
        full_box(b"stsd", _u32(1), entry),
        full_box(b"stts", _u32(1, frames, FRAME)),
        full_box(b"stsc", _u32(len(per_chunk)), *(_u32(*row) for row in per_chunk)),
        full_box(b"stsz", _u32(FRAME, frames)),
        full_box(b"co64", _table(at, ">u8")) if wide else full_box(b"stco", _table(at)),
        full_box(b"stss", _table(np.arange(chunks) * CHUNK_FRAMES + 1)),
    )
    matrix = _u32(1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    info = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", _u32(1), full_box(b"url ", flags=1))), tables)
    times = struct.pack(">QQIQ", 0, 0, RATE, length)
    track = box(
        b"trak",
        struct.pack(">I4sI", 104, b"tkhd", 1 << 24 | 7) + struct.pack(">QQIIQ", 0, 0, 1, 0, length) + bytes(8) + struct.pack(">HHHH", 0, 0, 0x100, 0) + matrix + _u32(0, 0),
        box(b"mdia", struct.pack(">I4sI", 44, b"mdhd", 1 << 24) + times + struct.pack(">HH", 0x55C4, 0), full_box(b"hdlr", _u32(0), b"soun", bytes(12), b"\0"), info),
    )
    movie = struct.pack(">I4sI", 120, b"mvhd", 1 << 24) + times + _u32(1 << 16) + struct.pack(">H", 0x100) + bytes(10) + matrix + bytes(24) + _u32(2)
    return head + media + box(b"moov", movie, track)


def walk(data: bytes) -> Iterator[tuple[bytes, int, int, int, int]]:
    """Kind, depth, begin, content start and content end of every box, parents before children."""
    open_ = [(0, len(data))]  # what is left of each parent, so that nesting costs no recursion
    while open_:
        begin, end = open_.pop()
        if begin + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1 and begin + 16 <= end:
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        stop = end if size == 0 else min(end, begin + size)
        if size and size < head:
            continue
        yield kind, len(open_), begin, begin + head, stop
        open_.append((stop, end))
        if kind in PARENTS:
            open_.append((begin + head, stop))


def _times(data: bytes, at: int) -> tuple[int, int]:
    """Time scale and duration of an mvhd or mdhd box."""
    if data[at]:
        return struct.unpack_from(">IQ", data, at + 20)
    return struct.unpack_from(">II", data, at + 12)


NO_RANGES = np.empty((0, 2), np.int64)


class Track:
    """The tables and fragments of one track, and what follows from them."""

    def __init__(self, limit: int):
        self.limit = limit  # bytes of the container: no track has more samples with bytes
        self.handler = self.codec = ""
        self.id = self.scale = self.duration = 0
        self.stts = self.stsc = self.sizes = self.chunks = np.empty(0, np.int64)
        self.sync: np.ndarray | None = None
        self.fixed = self.count = self.later = self.later_time = 0
        self.defaults = (0, 0, 0)  # time, size and flags of a fragment's sample
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # ranges of each fragment run, and which are keyframes

    def read(self, kind: bytes, data: bytes, a: int, b: int) -> None:
        ints = lambda at, n, t=">u4": np.frombuffer(data, t, max(0, min(n, (b - at) // np.dtype(t).itemsize)), at).astype(np.int64)
        if kind == b"tkhd":
            self.id = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
        elif kind == b"mdhd":
            self.scale, self.duration = _times(data, a)
        elif kind == b"hdlr":
            self.handler = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd" and b - a >= 16:
            self.codec = data[a + 12 : a + 16].decode("latin-1")
        elif kind in (b"stts", b"stsc", b"stco", b"co64", b"stss"):
            n = struct.unpack_from(">I", data, a + 4)[0]
            if kind in (b"stts", b"stsc"):
                width = 2 if kind == b"stts" else 3
                rows = ints(a + 8, width * n)
                setattr(self, kind.decode(), rows[: len(rows) // width * width].reshape(-1, width))
            elif kind == b"stss":
                self.sync = ints(a + 8, n) - 1
            else:
                self.chunks = ints(a + 8, n, ">u4" if kind == b"stco" else ">u8")
        elif kind == b"stsz":
            self.fixed, self.count = struct.unpack_from(">II", data, a + 4)
            self.sizes = np.empty(0, np.int64) if self.fixed else ints(a + 12, self.count)
        elif kind == b"stz2":
            bits, self.count = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
            if bits == 4:
                pairs = ints(a + 12, -(-self.count // 2), "u1")
                self.sizes = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[: self.count]
            elif bits in (8, 16):
                self.sizes = ints(a + 12, self.count, f">u{bits // 8}")

    def run(self, data: bytes, a: int, b: int, at: int, defaults: tuple[int, int, int], base: int) -> int:
        """Take in a fragment's run of samples; returns where its bytes end."""
        flags, n = struct.unpack_from(">II", data, a)
        a += 8
        if flags & 1:
            at = base + struct.unpack_from(">i", data, a)[0]
            a += 4
        first = struct.unpack_from(">I", data, a)[0] if flags & 4 else None
        a += 4 if flags & 4 else 0
        fields = [k for k in (0x100, 0x200, 0x400, 0x800) if flags & k]
        if fields:
            n = min(n, (b - a) // (4 * len(fields)))
            table = np.frombuffer(data, ">u4", n * len(fields), a).reshape(n, len(fields)).astype(np.int64)
        elif not defaults[1]:  # samples without bytes: counted, but without ranges
            self.later += n
            self.later_time += n * defaults[0]
            return at
        else:
            n, table = min(n, self.limit // defaults[1]), None
        column = lambda k, d: table[:, fields.index(k)] if k in fields else np.full(n, d, np.int64)
        times, sizes, marks = column(0x100, defaults[0]), column(0x200, defaults[1]), column(0x400, defaults[2])
        if first is not None and n:
            marks = np.concatenate([[first], marks[1:]])
        ends = at + np.cumsum(sizes)
        self.later += n
        self.later_time += int(times.sum())
        self.parts.append((np.stack([ends - sizes, ends], axis=1), (marks & 0x10000) == 0))
        return int(ends[-1]) if n else at

    def ranges(self) -> np.ndarray:
        """Byte ranges (start, end) of the samples that the tables place, in order."""
        sizes = np.full(min(self.count, self.limit // self.fixed), self.fixed, np.int64) if self.fixed else self.sizes
        if not len(self.stsc) or not len(self.chunks) or not len(sizes):
            return NO_RANGES
        first = self.stsc[:, 0] - 1
        good = np.logical_and.accumulate(np.diff(first, prepend=-1) > 0)  # chunks ascend
        first, each = first[good], np.minimum(self.stsc[good, 1], len(sizes))
        per_chunk = np.repeat(each, np.maximum(0, np.diff(np.append(np.minimum(first, len(self.chunks)), len(self.chunks)))))
        per_chunk = per_chunk[: int(np.searchsorted(np.cumsum(per_chunk), len(sizes))) + 1]
        chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[: len(sizes)]
        if not len(chunk):
            return NO_RANGES
        sizes = sizes[: len(chunk)]
        ends = np.cumsum(sizes)
        opens = np.flatnonzero(np.diff(chunk, prepend=-1))
        base = np.repeat((ends - sizes)[opens], np.diff(np.append(opens, len(chunk))))
        start = self.chunks[chunk + (first[0] if len(first) else 0)] + ends - sizes - base
        return np.stack([start, start + sizes], axis=1)

    def keyframes(self) -> np.ndarray:
        """Byte ranges of the samples that decode on their own."""
        own = self.ranges()
        if self.sync is not None:
            own = own[self.sync[(self.sync >= 0) & (self.sync < len(own))]]
        return np.concatenate([own, *(r[keys] for r, keys in self.parts)])

    def summary(self) -> dict:
        ticks = self.duration or (int((self.stts[:, 0] * self.stts[:, 1]).sum()) if len(self.stts) else 0) + self.later_time
        return {
            "handler": self.handler,
            "codec": self.codec,
            "seconds": ticks / self.scale if self.scale else 0.0,
            "samples": int(self.count) + self.later,
            "keyframes": [{"start": int(a), "end": int(b)} for a, b in self.keyframes()],
        }


def parsed(data: bytes) -> list[Track]:
    """The tracks of a container; none if it is damaged."""
    found: list[Track] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    moof = at = base = 0
    track, own = None, (0, 0, 0)
    inside: int | None = None  # depth of the open trak box
    try:
        for kind, depth, begin, a, b in walk(data):
            if inside is not None and depth <= inside:
                inside = None
            if kind == b"trak":
                found.append(Track(len(data)))
                inside = depth
            elif kind == b"trex":
                defaults[struct.unpack_from(">I", data, a + 4)[0]] = struct.unpack_from(">III", data, a + 12)
            elif kind == b"moof":
                moof = at = begin
            elif kind == b"tfhd":
                flags, name = struct.unpack_from(">II", data, a)
                track, own, at_field = next((t for t in found if t.id == name), None), list(defaults.get(name, (0, 0, 0))), a + 8
                base = struct.unpack_from(">Q", data, at_field)[0] if flags & 1 else moof
                at_field += (8 if flags & 1 else 0) + (4 if flags & 2 else 0)
                for k, flag in enumerate((8, 16, 32)):
                    if flags & flag:
                        own[k] = struct.unpack_from(">I", data, at_field)[0]
                        at_field += 4
                at = base
            elif kind == b"trun" and track:
                at = track.run(data, a, b, at, tuple(own), base)
            elif inside is not None:
                found[-1].read(kind, data, a, b)
        return found
    except (struct.error, ValueError, IndexError):
        return []


def tracks(data: bytes | None) -> list[dict]:
    """Handler, codec, seconds, samples and keyframe ranges of each track of a container."""
    try:
        return [t.summary() for t in parsed(data or b"")]
    except (ValueError, IndexError):
        return []


def payload(data: bytes) -> bytes:
    """The bytes of the first track's samples, in order, as the sample tables place them."""
    ranges = parsed(data)[0].ranges()
    begins = np.flatnonzero(np.append(True, ranges[1:, 0] != ranges[:-1, 1]))  # neighbours are read as one
    ends = np.append(begins[1:] - 1, len(ranges) - 1)
    return b"".join(data[a:b] for a, b in zip(ranges[begins, 0].tolist(), ranges[ends, 1].tolist(), strict=True))


TRACKS = "array<struct<handler:string,codec:string,seconds:double,samples:bigint,keyframes:array<struct<start:bigint,end:bigint>>>>"


def read_tracks(df: DataFrame, media: str, out: str = "tracks") -> DataFrame:
    """Adds the tracks of the containers in column ``media``; other columns pass."""
    from pyspark.sql.functions import pandas_udf

    bound_batches(df.sparkSession)

    @pandas_udf(TRACKS)
    def decode(column):
        import pandas as pd

        return pd.Series([tracks(x) for x in column])

    return df.withColumn(out, decode(F.col(media)))


def store_texts(df: DataFrame, text: Column) -> DataFrame:
    """doc_id, n_bytes and the container that holds the text's UTF-8 bytes."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([store(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(F.col("doc_id").cast("bigint"), text.cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


DIGEST = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "codec string, seconds double, keyframes array<struct<start:bigint,end:bigint>>"
)


def write_media(stored: DataFrame, path: str) -> DataFrame:
    """Write the containers to ``path`` and return the table that reads them from there."""
    stored.write.option("compression", "zstd").parquet(path)
    return stored.sparkSession.read.schema(stored.schema).parquet(path)


def payload_digest(stored: DataFrame) -> DataFrame:
    """What the containers of ``store_texts`` hold, found through their own boxes and tables."""
    bound_batches(stored.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
        + [("codec", pa.string()), ("seconds", pa.float64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def feature(t: dict) -> str:
        spots = [f"{k['start']}-{k['end']}" for k in t["keyframes"]]
        table = zlib.crc32(",".join(spots).encode())
        return f"{t['handler']}|{t['codec'].strip()}|{t['seconds']:.6f}s|{t['samples']} samples|{len(spots)} keyframes|{spots[0]}|{spots[-1]}|{table:08x}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, t = payload(media), tracks(media)[0]
                rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(t), t["codec"].strip(), t["seconds"], t["keyframes"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return stored.mapInArrow(run, DIGEST)
