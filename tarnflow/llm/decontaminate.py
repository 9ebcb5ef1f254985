"""Benchmark leaks: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

* *Embedding.* A random walk maps a word sequence to a longer one: at step t it
  writes the current word and moves on by a coin that depends on t and the word
  only. Sequences at a small edit distance meet again after an edit, so their
  embeddings differ in few places (edit distance becomes Hamming distance).
* *Windows.* Items are grouped by length (``LENGTH_RATIO``); a group's tables have
  windows of its own size, taken from the items at another place for each table,
  so that no item is looked at by its first words only. Every word of a document
  starts a window. All windows of a block of texts walk at once.
* *LSH.* Each table has a walk of its own and samples its first ``HEAD`` steps and
  ``SPREAD`` steps further on. A window that agrees with an item on all of a table's samples
  is a candidate; windows leave a table's walk at the first sample at which no
  item agrees. A group gets tables until they find ``RECALL`` of edited copies of
  its own items.
* *Pieces.* An item with at most e edits, cut into e + 1 pieces, keeps one of
  them word for word. So every place where a document holds a piece is a
  candidate too, wherever the edits are: no leak is lost, whatever the tables find.
* *Check.* Candidate items are aligned to the words around their windows (free
  ends, exact edit distance); an item is a leak if at most ``EDITS`` of its words
  need an edit.

Words are runs of letters and digits, case-folded; words that no item has are
one symbol, which agrees with nothing. Items of fewer than ``LEAST_WORDS`` words
are leaks only word for word. Items are shipped to the executors in slices of
``SLICE_BYTES``, a pass over the documents each; the driver holds one slice.

Defined results: null texts have no words, items without words are in no
document; items without an id are looked for like others; items with equal
words are all reported; repeated documents are reported once by id, without an
id as well; texts of any length are searched whole, in blocks; columns other
than doc_id and text pass ``clean`` unread, whatever their names; an empty table
on either side gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm._scratch import bound_batches

EDITS = 0.2
#: Shorter items have no edits.
LEAST_WORDS = 8
#: Items of a group differ in length by this factor at most.
LENGTH_RATIO = 1.5
#: Samples of a table: the first steps of its walk, and steps spread over the rest.
HEAD, SPREAD = 3, 2
#: Steps for a word of a window: a walk needs two on average, and should not end before its samples.
STEPS = 1.7
#: Target recall of a group's tables for items with EDITS of their words edited, and the most tables (pieces find the rest).
RECALL, MOST_TABLES = 0.95, 64
SLICE_BYTES = 16 << 20
SEED = 29
#: Words of one walk; a text's windows are split between walks.
BLOCK_WORDS = 1 << 18
PIECE_BITS = 20
#: Spreads a key, so that its high bits tell keys apart.
SPREAD_BITS = np.uint64(0xD6E8FEB86659FD93)

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").casefold())


def joined(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Keys of sequences that go on with ``symbol``."""
    x = (key + symbol) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


class Table:
    """One walk over windows of ``words`` words: coins, sampled steps, and the keys that items still have after each sample."""

    def __init__(self, coded: list[np.ndarray], members: list[int], symbols: int, words: int, rng: np.random.Generator):
        self.steps = max(HEAD, int(STEPS * words))
        self.coins = rng.integers(0, 2, (self.steps, symbols), dtype=np.int8)
        edges = np.linspace(HEAD, self.steps, SPREAD + 1).astype(int)
        late = [int(rng.integers(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
        self.at = [*range(HEAD), *late]
        share = rng.random()
        offsets = [int(share * (len(coded[k]) - words + 1)) for k in members]
        flat = np.concatenate([*(coded[k] for k in members), np.zeros(self.steps + 1, np.int32)])
        ends = np.cumsum([len(coded[k]) for k in members])
        pos = ends - [len(coded[k]) for k in members] + np.array(offsets)
        seen = []
        for t in range(max(self.at) + 1):
            symbol = np.where(pos < ends, flat[np.minimum(pos, len(flat) - 1)], 0)
            if t in self.at:
                seen.append(symbol)
            pos = pos + self.coins[t, symbol]
        whole = np.all(np.array(seen) > 0, axis=0)
        key, self.levels = np.zeros(len(members), np.uint64), []
        for symbol in seen:
            key = joined(key, symbol.astype(np.uint64))
            self.levels.append(np.unique(key[whole]))
        self.opens = np.zeros(symbols, bool)
        self.opens[seen[0][whole]] = True
        self.owners = defaultdict(list)
        for v, k, o in zip(key[whole].tolist(), np.array(members)[whole].tolist(), np.array(offsets)[whole].tolist(), strict=True):
            self.owners[v].append((k, o))

    def find(self, padded: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window start, item, the window's offset in the item) of each window that agrees on all samples."""
        if not self.owners:
            return
        start = np.flatnonzero(self.opens[padded])
        pos, key, t = start.copy(), np.zeros(len(start), np.uint64), 0
        for stop, level in zip(self.at, self.levels, strict=True):
            while t < stop:
                pos = pos + self.coins[t, padded[pos]]
                t += 1
            symbol = padded[pos]
            key = joined(key, symbol.astype(np.uint64))
            slot = np.minimum(np.searchsorted(level, key), len(level) - 1)
            alive = (level[slot] == key) & (symbol > 0)
            start, pos, key = start[alive], pos[alive], key[alive]
            if not len(start):
                return
        for p, k in zip(start.tolist(), key.tolist(), strict=True):
            yield from ((p, item, offset) for item, offset in self.owners.get(k, ()))


class Tables:
    """The hash tables of a slice of items."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        self.items = [(i, w) for i, w in items if w]
        names = sorted({w for _, ws in self.items for w in ws})
        self.symbol = {w: k + 1 for k, w in enumerate(names)}  # 0: any other word
        self.coded = [np.array([self.symbol[w] for w in ws], np.int32) for _, ws in self.items]
        self.most = [int(EDITS * len(c)) if len(c) >= LEAST_WORDS else 0 for c in self.coded]
        self.counts = [Counter(c.tolist()) for c in self.coded]
        self.tables: list[Table] = []
        recall = [self._add_group(members, len(names) + 1) for members in self._groups()]
        self.reach = max((t.steps for t in self.tables), default=0) + 1
        #: Of the edited copies, the share that the tables of their groups find; the least one.
        self.expected_recall = min(recall, default=1.0)
        self.pieces = self._pieces()

    def _groups(self) -> list[list[int]]:
        """Items that may have edits, by length."""
        order = sorted((k for k, c in enumerate(self.coded) if len(c) >= LEAST_WORDS), key=lambda k: len(self.coded[k]))
        groups: list[list[int]] = []
        for k in order:
            if not groups or len(self.coded[k]) > LENGTH_RATIO * len(self.coded[groups[-1][0]]):
                groups.append([])
            groups[-1].append(k)
        return groups

    def _add_group(self, members: list[int], symbols: int) -> float:
        """Add tables for one group until they find RECALL of edited copies; returns what they find."""
        rng = np.random.default_rng(SEED + len(self.tables))
        edited = self._edited(members, rng)
        least = len(self.coded[members[0]])
        reach = int(STEPS * least) + HEAD + 1
        text = np.concatenate([part for _, c in edited for part in (c, np.zeros(reach, np.int32))])
        ends = np.cumsum([len(c) + reach for _, c in edited])
        found = np.zeros(len(edited), bool)
        for n in range(MOST_TABLES):
            words = int(rng.integers(-(-least // 2), least + 1))
            table = Table(self.coded, members, symbols, words, rng)
            self.tables.append(table)
            for p, item, _ in table.find(text):
                copy = int(np.searchsorted(ends, p, "right"))
                found[copy] |= edited[copy][0] == item
            if n and found.mean() >= RECALL:
                break
        return float(found.mean())

    def _pieces(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By piece length: a bit for each high part of a key, the sorted keys, where their owners begin, and the owners (item, offset)."""
        by_length = defaultdict(list)
        for k, c in enumerate(self.coded):
            cuts = np.linspace(0, len(c), self.most[k] + 2).astype(int).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                by_length[b - a].append((k, a))
        out = []
        for length, owners in sorted(by_length.items()):
            item, offset = np.array(owners).T
            key = np.zeros(len(owners), np.uint64)
            for i in range(length):
                key = joined(key, np.array([self.coded[k][a + i] for k, a in owners], np.uint64))
            keys = key * SPREAD_BITS
            order = np.argsort(keys, kind="stable")
            distinct, begins = np.unique(keys[order], return_index=True)
            bits = np.zeros(1 << PIECE_BITS, bool)
            bits[distinct >> np.uint64(64 - PIECE_BITS)] = True
            out.append((length, bits, distinct, np.append(begins, len(keys)), item[order], offset[order]))
        return out

    def shared_pieces(self, seq: np.ndarray) -> set[tuple[int, int, int]]:
        """(position, item, offset in the item) of every piece that a symbol sequence holds."""
        found: set[tuple[int, int, int]] = set()
        words, key, done = seq.astype(np.uint64), np.zeros(len(seq), np.uint64), 0
        for length, bits, keys, begins, item, offset in self.pieces:  # by length: a longer key goes on where a shorter one ends
            if length > len(seq):
                break
            while done < length:
                key = joined(key[: len(seq) - done], words[done:])
                done += 1
            spread = key * SPREAD_BITS
            at = np.flatnonzero(bits[spread >> np.uint64(64 - PIECE_BITS)])
            slot = np.minimum(np.searchsorted(keys, spread[at]), len(keys) - 1)
            same = keys[slot] == spread[at]
            for p, k in zip(at[same].tolist(), slot[same].tolist(), strict=True):
                owned = slice(begins[k], begins[k + 1])
                found.update((p, i, o) for i, o in zip(item[owned].tolist(), offset[owned].tolist(), strict=True))
        return found

    def _edited(self, members: list[int], rng: np.random.Generator) -> list[tuple[int, np.ndarray]]:
        """Copies of items (at most 400 of them) with EDITS of their words edited at random."""
        out = []
        for k in rng.permutation(members)[:400].tolist():
            c = self.coded[k].tolist()
            for _ in range(max(1, self.most[k])):
                at, how = int(rng.integers(len(c))), int(rng.integers(3))
                c[at : at + (how != 2)] = [0] if how else []
            out.append((k, np.array(c, np.int32)))
        return out

    def candidates(self, seq: np.ndarray) -> set[tuple[int, int, int]]:
        """(window start, item, the window's offset in the item) of a symbol sequence that some table agrees on."""
        padded = np.concatenate([seq, np.zeros(self.reach, np.int32)])
        return {hit for table in self.tables for hit in table.find(padded)}

    def align(self, item: int, seq: np.ndarray, start: int, last: int) -> tuple[int, int, int] | None:
        """Edit distance, first and last word of the item's best alignment around the starts from ``start`` to ``last``."""
        code = self.coded[item]
        n = len(code)
        most = self.most[item]
        low = max(0, start - most)
        text = seq[low : last + n + most]
        have = Counter(text.tolist())
        if n - sum(min(c, have.get(s, 0)) for s, c in self.counts[item].items()) > most:
            return None
        # rows: words of the text; a cell holds the least cost and where its alignment began
        cost, begin = np.arange(n + 1), np.zeros(n + 1, int)
        best: tuple[int, int, int] | None = None
        steps = np.arange(n + 1)
        for j, s in enumerate(text.tolist()):
            swap, gap = cost[:-1] + (code != s), cost[1:] + 1
            new = np.concatenate([[0], np.minimum(swap, gap)])
            origin = np.concatenate([[j + 1], np.where(swap <= gap, begin[:-1], begin[1:])])
            # deletions run along the item: a prefix minimum of cost - position
            shifted = new - steps
            source = np.maximum.accumulate(np.where(shifted == np.minimum.accumulate(shifted), steps, 0))
            cost, begin = new[source] + steps - source, origin[source]
            if cost[n] <= most and (best is None or cost[n] < best[0]):
                best = (int(cost[n]), low + int(begin[n]), low + j + 1)
        return best

    def leaks(self, seq: np.ndarray, places: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(item, first word, end word, edits): the best place of each item in a sequence, of those around ``places`` (start, item)."""
        starts: dict[int, list[int]] = defaultdict(list)
        for start, item in sorted(places):
            starts[item].append(start)
        out = []
        for item, at in sorted(starts.items()):
            n, best, first = len(self.coded[item]), None, at[0]
            for last, following in zip(at, [*at[1:], None], strict=True):
                if following is not None and following - last <= n:  # their windows overlap: one alignment
                    continue
                hit = self.align(item, seq, first, last)
                if hit and (best is None or hit < best):
                    best = hit
                first = following
                if best and best[0] == 0:
                    break
            if best:
                out.append((item, best[1], best[2], best[0]))
        return out


LEAK = "doc_id bigint, item_id bigint, first_word bigint, end_word bigint, edits bigint, item_words bigint"


def item_slices(items: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The items in slices whose texts fit SLICE_BYTES each (by a hash of their id, so evenly), one at a time."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size * 5 // (4 * SLICE_BYTES)) if size > SLICE_BYTES else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for k in range(n):
        yield sorted(((r.item_id, words_of(r.text)) for r in rows.where(part == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


_TABLES: dict[str, Tables] = {}


def tables_of(key: str, shared) -> Tables:
    """The worker's tables of a slice; they serve all tasks of the process."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Tables(shared.value)
    return _TABLES[key]


def _leaks_in(tables: Tables, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """The leaks of each text; short texts walk together, apart by a symbol that agrees with nothing."""
    get, gap = tables.symbol.get, tables.reach
    out: list[list] = [[] for _ in texts]
    block: list[np.ndarray] = []
    owner: list[tuple[int, int, int]] = []
    at = 0

    def flush() -> None:
        nonlocal at
        if not block:
            return
        text = np.concatenate(block)
        begins = np.array([b for _, b, _ in owner])
        places: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for p, item, offset in tables.candidates(text) | tables.shared_pieces(text):
            h = int(np.searchsorted(begins, p, "right")) - 1
            places[h].add((p - offset - owner[h][1], item))
        for h, near in sorted(places.items()):
            k, b, n = owner[h]
            out[k] = tables.leaks(text[b : b + n], near)
        block.clear()
        owner.clear()
        at = 0

    for k, text in enumerate(texts):
        ws = words_of(text)
        seq = np.fromiter((get(w, 0) for w in ws), np.int32, len(ws))
        block += [seq, np.zeros(gap, np.int32)]
        owner.append((k, at, len(seq)))
        at += len(seq) + gap
        if at >= BLOCK_WORDS:
            flush()
    flush()
    return out


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """LEAK rows: each item found in each document, with its best place and its edits."""
    spark = docs.sparkSession
    bound_batches(spark)
    names = [c.split()[0] for c in LEAK.split(", ")]
    out = None
    for part in item_slices(items):
        shared, key = spark.sparkContext.broadcast(part), uuid.uuid4().hex  # at most about SLICE_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tables = tables_of(key, shared)
                if not tables.items:
                    return
                rows = [
                    (doc_id, tables.items[item][0], a, b, d, len(tables.items[item][1]))
                    for doc_id, found in zip(batch.column(0).to_pylist(), _leaks_in(tables, batch.column(1).to_pylist()), strict=True)
                    for item, a, b, d in found
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names)

        rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, LEAK)
        out = rows if out is None else out.unionByName(rows)
    return (out if out is not None else spark.createDataFrame([], LEAK)).distinct()


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    spark = docs.sparkSession
    bound_batches(spark)
    for part in item_slices(items):
        shared, key = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tables = tables_of(key, shared)
                found = _leaks_in(tables, batch.column(batch.schema.get_field_index("text")).to_pylist()) if tables.items else [()] * batch.num_rows
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
