"""MinHash near-duplicate groups: one-permutation hashing, bands, star edges, delta join.

* *Sets.* A document's set is its distinct word shingles, as 64-bit hashes.
  Documents with equal sets collapse into one class before anything else.
* *Signature.* One hash a shingle puts it into one of ``BINS`` bins, each bin
  keeps its least value; an empty bin borrows from a filled bin that a hash of
  (bin, attempt) names (optimal densification), the same for all documents.
* *Bands.* ``ROWS`` signature values make a band. Two classes at the threshold
  share some band with a probability of 1 - (1 - 0.8**6)**64 > 1 - 1e-8.
* *Stars.* A bucket's hub is the member that shares most buckets with others. A
  hub that shares ``NEAR_BUCKETS`` or more with a better one hands its bucket to
  that one, hop by hop, so that a group of near copies has one centre for nearly
  all of its buckets. Only edges between a centre and a member are compared.
* *Deltas.* Members that their centre does not link may still be linked with
  each other. The edge has their delta, the symmetric difference to the centre,
  and of two members' deltas
  ``|A ^ B| = |dA| + |dB| - 2 |dA & dB|``: to be similar they must share a stated
  part of their deltas. So the rest is an exact similarity join on deltas, by
  prefixes in order of rarity and positional bounds, and a group of n near
  copies makes neither n * n pairs nor a pair that only the common text suggests.
  Members far from the centre are joined on their sets, in the same way; as
  Jaccard distance is a metric, the two overlapping rings hold every link.
* *Check.* What passes the bounds is confirmed on the full sets; links contract
  to components in tables of the shared folder, and nothing is gathered on the
  driver. No pair of classes that share a band and reach the similarity is lost.

Defined results: null or wordless text has an empty set and is linked with
nothing; rows that share an id are documents of their own; rows without an id
are compared like others, and a group without any id has none; columns other
than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.llm._id_filter import IdFilter
from tarnflow.llm._scratch import Scratch, bound_batches, materialize

BINS, ROWS = 384, 6
#: Words whose hashes a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 120_000
#: A hub yields to a better one with which it shares at least this many buckets; so many times the hops double.
NEAR_BUCKETS, HOP_DOUBLINGS = 4, 2
#: A centre's set goes to this many tasks at most, so that a large group is not one task.
SALTS = 64

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
S29, S32, S31 = np.uint64(29), np.uint64(32), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    x = (x ^ (x >> S32)) * M1
    x = (x ^ (x >> S29)) * M2
    return x ^ (x >> S32)


class Shingler:
    """Distinct shingle hashes of texts; A-Z count as a-z, words end at ASCII white space."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.digest, self.words = width, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        hashes = list(map(known.get, words))
        if None in hashes:
            for i, h in enumerate(hashes):
                if h is None:
                    w = words[i]
                    h = known.get(w)
                    if h is None:
                        h = known[w] = self.digest(w)
                    hashes[i] = h
        h = np.array(hashes, dtype=np.uint64)
        n = max(1, len(h) - self.width + 1)
        out = np.full(n, len(h) if len(h) < self.width else 0, np.uint64)
        for k in range(min(self.width, len(h))):
            out = mix64(out + h[k : k + n] * (M1 + np.uint64(2 * k)))
        return np.unique(out)


def probes() -> np.ndarray:
    """For each bin the order in which it looks for a filled one (attempt by attempt)."""
    tries = np.arange(4 * BINS, dtype=np.uint64)
    bins = np.arange(BINS, dtype=np.uint64)
    return (mix64(bins[:, None] * M2 + tries[None, :] * M1 + np.uint64(7)) % np.uint64(BINS)).astype(np.int64)


def signature(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """BINS values: each bin's least hash, empty bins filled from the bins they probe."""
    h = mix64(shingles + M2)
    bins = (h >> S32) % np.uint64(BINS)
    top = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(top, bins.astype(np.int64), h)
    filled = np.zeros(BINS, bool)
    filled[bins.astype(np.int64)] = True
    empty = np.flatnonzero(~filled)
    for begin in range(0, order.shape[1], 8):
        if not len(empty):
            break
        tries = order[empty, begin : begin + 8]
        hit = filled[tries]
        done = hit.any(axis=1)
        top[empty[done]] = top[tries[done, hit[done].argmax(axis=1)]]
        empty = empty[~done]
    top[empty] = top[filled].min() if len(empty) else 0
    return top


def band_keys(sig: np.ndarray) -> np.ndarray:
    grid = sig.reshape(BINS // ROWS, ROWS)
    key = np.arange(BINS // ROWS, dtype=np.uint64) * M1
    for k in range(ROWS):
        key = mix64(key + grid[:, k])
    return key.view(np.int64)


def row_key(text: Column) -> Column:
    """A hash of the text as it stands, to find a row again."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def set_ids(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits for each set as two columns, null for empty sets."""
    import xxhash

    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
    mask = np.array([not len(s) for s in sets], bool)
    return [pa.array(raw[:, k], pa.int64(), mask=mask) for k in (0, 1)]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row_key, n_shingles, s1, s2 (a 128-bit hash of the set; null if empty) and its band keys."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, order = Shingler(width), probes()
        for batch in batches:
            sets, keys = [], []
            for text in batch.column(2).to_pylist():
                s = shingler(text)
                sets.append(s)
                keys.append(band_keys(signature(s, order)).tobytes() if len(s) else None)
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], size, *set_ids(sets), pa.array(keys, pa.binary())], ["doc_id", "row_key", "n_shingles", "s1", "s2", "keys"])

    rows = docs.select(F.col("doc_id").cast("bigint"), row_key(F.col("text")).alias("row_key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, row_key bigint, n_shingles bigint, s1 bigint, s2 bigint, keys binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """node, key: an entry for each band of each class."""
    bands = BINS // ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), bands)), pa.array(keys)], ["node", "key"])

    return classes.select("node", "keys").mapInArrow(run, "node bigint, key bigint")


#: Stands for a missing id among the filter's keys.
NO_ID = -(1 << 63)


def candidate_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, shingles: the full sets of ``nodes`` (node, least, s1, s2).

    Texts of other documents are dropped before the shuffle by a filter of
    fixed size; what it lets through wrongly, the join drops.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    chosen = IdFilter.of(nodes.select(F.coalesce("least", F.lit(NO_ID)).alias("id")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            part = batch.filter(pa.array(chosen.has(batch.column(1), batch.column(2))))
            sets = [s for s in map(shingler, part.column(0).to_pylist()) if len(s)]
            if sets:
                yield pa.RecordBatch.from_arrays([*set_ids(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["s1", "s2", "shingles"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    sets = rows.select("text", *IdFilter.hashes("id")).mapInArrow(run, "s1 bigint, s2 bigint, shingles binary")
    # the join sorts by the keys that the aggregation groups by, so that repeated rows cost no sort of their own
    met = sets.join(nodes.select("node", "s1", "s2"), ["s1", "s2"])
    return met.groupBy("s1", "s2").agg(F.first("node").alias("node"), F.first("shingles").alias("shingles")).select("node", "shingles")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, by 100 * inter >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * (len(x) // 8 + len(y) // 8 - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    bound_batches(pairs.sparkSession)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def least_neighbour(links: DataFrame) -> DataFrame:
    """u, low: the least of each node and its neighbours, where that is not the node itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low")).where("low < u")


def mapped(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``df`` with ``column`` moved to its parent, where it has one."""
    moved = df.join(parents.select(F.col("u").alias(column), "low"), column, "left")
    return moved.withColumn(column, F.coalesce("low", column)).drop("low").select(*df.columns)


def components(temp: Scratch, links: DataFrame) -> DataFrame:
    """node, label for the nodes of ``links`` (a, b): the least node reachable.

    Every round moves each node to its least neighbour and contracts the links;
    stars vanish in one or two rounds and chains halve. The moves of all rounds,
    kept in the shared folder, are then applied in turn.
    """
    first = temp.write(links.distinct(), "links")
    rest, moves = first, []
    while True:
        parents = temp.write(least_neighbour(rest), "moves")
        if not parents.limit(1).count():
            break
        moves.append(parents)
        rest = temp.write(mapped(mapped(rest, "a", parents), "b", parents).where("a <> b").distinct(), "links")
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    labels = nodes.withColumn("label", F.col("node"))
    for parents in moves:
        labels = mapped(labels, "label", parents)
    return temp.write(labels, "labels")


def centres(temp: Scratch, buckets: DataFrame) -> DataFrame:
    """ref, node: the centre of each bucket of ``buckets`` (key, node) with each of its members."""
    met = buckets.join(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key").groupBy("node").agg(F.sum("m").alias("rank"))
    ranked = buckets.join(met, "node")
    best = F.max(F.struct("rank", F.negative("node").alias("other"))).alias("best")
    hubs = ranked.groupBy("key").agg(best).select("key", F.negative("best.other").alias("hub"), F.col("best.rank").alias("hub_rank"))
    shared = ranked.join(hubs, "key").groupBy("hub", "node").agg(F.count(F.lit(1)).alias("shared"), F.max("hub_rank").alias("hub_rank"), F.max("rank").alias("rank"))
    shared = temp.write(shared, "hub-members")
    every = shared.select(F.col("hub").alias("node")).distinct()
    better = (F.col("hub_rank") > F.col("rank")) | ((F.col("hub_rank") == F.col("rank")) & (F.col("hub") < F.col("node")))
    up = shared.where((F.col("shared") >= NEAR_BUCKETS) & better).join(every, "node", "left_semi")
    up = up.groupBy("node").agg(F.max(F.struct("hub_rank", F.negative("hub").alias("other"))).alias("to")).select("node", F.negative("to.other").alias("to"))
    moves = temp.write(every.join(up, "node", "left").select("node", F.coalesce("to", "node").alias("to")), "hub-moves")
    for _ in range(HOP_DOUBLINGS):
        onward = moves.select(F.col("node").alias("to"), F.col("to").alias("end"))
        moves = temp.write(moves.join(onward, "to").select("node", F.col("end").alias("to")), "hub-moves")
    refs = shared.select("hub", "node").join(moves.select(F.col("node").alias("hub"), F.col("to").alias("ref")), "hub").where("ref <> node").select("ref", "node").distinct()
    return temp.write(refs, "stars")


def deltas(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each star edge with what ``delta_links`` needs.

    ref, node, n and h (set sizes of node and centre), linked, and the delta to
    the centre if the node is in the near ring, its set if it is in the far one.
    """
    names = ["ref", "node", "n", "h", "linked", "near", "far"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ref, node, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)
                n, h = len(x) // 8, len(y) // 8
                union, bound = (n + h + len(d)) // 2, 100 - percent
                linked = (100 + percent) * len(d) <= bound * (n + h)
                near, far = 100 * len(d) <= 3 * bound * union, 100 * len(d) >= 2 * bound * union
                rows.append((ref, node, n, h, linked, d.tobytes() if near else None, x if far and not linked else None))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)

    bound_batches(stars.sparkSession)
    salted = stars.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    own = sets.select("node", F.col("shingles").alias("x"))
    centre = salted.select("ref", "salt").distinct().join(sets.select(F.col("node").alias("ref"), F.col("shingles").alias("y")), "ref")
    edges = salted.join(own, "node").join(centre, ["ref", "salt"]).select("ref", "node", "x", "y")
    return edges.mapInArrow(run, "ref bigint, node bigint, n bigint, h bigint, linked boolean, near binary, far binary")


def elements(edges: DataFrame) -> DataFrame:
    """ref, far, node, n, h, d, linked, element: a row for each element of the rings that may hold more links."""
    names = ["ref", "far", "node", "n", "h", "d", "linked", "element"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ref, node, n, h, linked, *rings in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for far, raw in enumerate(rings):
                    e = np.frombuffer(raw or b"", np.int64)
                    for i in range(0, len(e), 1 << 16):
                        part = pa.array(e[i : i + (1 << 16)])
                        same = lambda v, kind, k=len(part): pa.array(np.full(k, v, kind))
                        yield pa.RecordBatch.from_arrays([same(ref, np.int64), same(bool(far), bool), same(node, np.int64), same(n, np.int64), same(0 if far else h, np.int64), same(len(e), np.int64), same(linked, bool), part], names)

    rings = [F.count("near").alias("near_n"), F.count(F.when(~F.col("linked"), F.col("near"))).alias("near_open"), F.count("far").alias("far_n")]
    more = edges.groupBy("ref").agg(*rings).select("ref", ((F.col("near_n") > 1) & (F.col("near_open") > 0)).alias("of_near"), (F.col("far_n") > 1).alias("of_far")).where("of_near or of_far")
    live = edges.join(more, "ref").select("ref", "node", "n", "h", "linked", F.when(F.col("of_near"), F.col("near")).alias("near"), F.when(F.col("of_far"), F.col("far")).alias("far"))
    return live.mapInArrow(run, "ref bigint, far boolean, node bigint, n bigint, h bigint, d bigint, linked boolean, element bigint")


def delta_links(temp: Scratch, edges: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of members of one centre that may be similar and that no edge joins yet.

    ``left`` counts an element and those after it, in order of rarity, that a
    member has and some other has too: at the first element that two members
    share it bounds what they share. Elements at which a member's bound cannot
    be enough for any partner are dropped before the join.
    """
    bound, both = 100 - percent, 100 + percent
    each = temp.write(elements(edges), "delta-elements")
    key = ["ref", "far", "element"]
    common = each.groupBy(*key).agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = Window.partitionBy("ref", "far", "node").orderBy(F.desc("often"), F.desc("element"))
    kept = each.join(common, key).withColumn("left", F.row_number().over(order))
    searching = ~F.col("linked") & ((F.col("d") - F.col("left")) * percent <= bound * F.col("n"))
    near_found = both * (F.col("d") - 2 * F.col("left")) + bound * F.col("h") < bound * F.col("n")
    far_found = 100 * both * (F.col("d") - 2 * F.col("left")) + 2 * percent * percent * F.col("n") <= 100 * bound * F.col("n")
    kept = kept.withColumn("searching", searching).where(F.col("searching") | F.when(F.col("far"), far_found).otherwise(near_found))
    kept = temp.write(kept.select(*key, "node", "n", "d", "linked", "left", "searching"), "delta-prefixes")
    x = kept.where("searching").select(*key, F.col("node").alias("a"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("left").alias("la"))
    y = kept.select(*key, F.col("node").alias("b"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("left").alias("lb"), "linked")
    once = F.col("linked") & (F.col("a") != F.col("b")) | (F.col("a") < F.col("b"))  # of two searching members, one finds the other
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    enough = both * (F.col("da") + F.col("db") - 2 * F.least("la", "lb")) <= bound * (F.col("na") + F.col("nb"))
    return x.join(y, key).where(once & sizes & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links_of(temp: Scratch, buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: confirmed links that join everything in ``buckets`` (key, node) that links join."""
    edges = temp.write(deltas(centres(temp, buckets), sets, percent), "star-edges")
    star = edges.where("linked").select(F.least("ref", "node").alias("a"), F.greatest("ref", "node").alias("b"))
    return star.unionByName(confirm(delta_links(temp, edges, percent), sets, percent))


def class_keys(rows: DataFrame, names: DataFrame) -> DataFrame:
    """node, keys: the band keys of each class, from its row with the least id."""
    own = names.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "least", "node")
    same = (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & F.col("doc_id").eqNullSafe(F.col("least"))
    found = rows.join(own, same).select("doc_id", "node", "keys")
    without_id = found.where("doc_id is null").groupBy("node").agg(F.first("keys").alias("keys"))
    return found.where("doc_id is not null").select("node", "keys").unionByName(without_id)


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row_key, n_shingles, label (of the group; null for an empty set), component_id of every row."""
    temp = Scratch(docs.sparkSession)
    rows = temp.write(sketches(docs, width), "sketches")
    named = rows.where("s1 is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"))
    # written once, so that every later reader sees the same numbers
    names = temp.write(named.withColumn("node", F.monotonically_increasing_id()), "set-names")
    entries = temp.write(bucket_rows(class_keys(rows, names)), "band-keys")
    common = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    shared = temp.write(entries.join(common, "key", "left_semi"), "shared-keys")
    temp.release(entries)
    nodes = names.join(shared.select("node").distinct(), "node", "left_semi").select("node", "least", "s1", "s2")
    sets = temp.write(candidate_sets(docs, nodes, width), "sets")
    labels = components(temp, links_of(temp, shared, sets, percent))
    ids = labels.join(names.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("component"))
    of_node = labels.join(ids, "label").select("node", "label", "component")
    alone = F.col("label").isNull()
    of_set = names.join(of_node, "node", "left").select("s1", "s2", F.coalesce("label", "node").alias("label"), F.when(alone, F.col("least")).otherwise(F.col("component")).alias("component"))
    out = rows.select("doc_id", "row_key", "n_shingles", "s1", "s2").join(of_set, ["s1", "s2"], "left")
    own = F.when(F.col("s1").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    result, _ = materialize(temp.spark, out.select("doc_id", "row_key", "n_shingles", "label", own.alias("component_id")), "groups")
    temp.release()
    return result


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    return grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the least id (missing ids last).

    Rows without words are in no group and all stay. Columns may have any name.
    """
    found = grouped(docs, width, percent)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    kept = found.where("label is not null").groupBy("label").agg(F.min(first).alias("first")).select(F.col("first.id").alias("kept_id"), F.col("first.key").alias("kept_key"))
    packed = docs.select(F.col("doc_id").cast("bigint").alias("id"), row_key(F.col("text")).alias("key"), has_words(F.col("text")).alias("words"), F.struct("*").alias("row"))
    whole = packed.where("words").join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    once = whole.withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy("key"))).where("nth = 1")
    return once.select("row.*").unionByName(packed.where("not words").select("row.*"))


def has_words(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
