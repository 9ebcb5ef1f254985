import hashlib
import random
import re
import string
from collections import Counter

import pytest

from tarnflow.llm import near_dup
from tarnflow.llm._scratch import Scratch
from tarnflow.llm.near_dup import components, keep_one, near_duplicates
from tarnflow.llm.repeat_ranges import cover, identifiers, runs, without_repeats

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def groups(rows, width):
    """Of every row its id, set size and least id reachable over links, by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b, (_, t) in enumerate(sets[:a]):
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(s), least.get(find(a))) for a, (i, s) in enumerate(sets)]


def found(df, width):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, width).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


#: One id with two different texts, near copies without an id, and a group in which no row has one.
MORE = [
    (50, " ".join(f"p{k}" for k in range(60))), (50, " ".join(f"q{k}" for k in range(60))), (None, " ".join(f"q{k}" for k in range(61))), (None, " ".join(f"p{k}" for k in range(1, 60))),
    (None, " ".join(f"r{k}" for k in range(90))), (None, " ".join(f"r{k}" for k in range(91))), (None, " ".join(f"r{k}" for k in range(91))), (60, " \n"), (None, ""),
]


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, edge, edge_rows, width):
    rows = [(r[0], r[1]) for r in edge_rows] + MORE
    df = edge.select("doc_id", "text").unionByName(frame(spark, MORE))
    assert found(df, width) == Counter(groups(rows, width))


@pytest.mark.parametrize(("edits", "with_base"), [((1, 12), True), ((5, 7), False), ((7, 8), True)])
def test_family_around_the_threshold(spark, edits, with_base):
    """300 copies of one text whose pairs lie just below and above 80 %, next to a second such family that shares a passage."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(110)]
    other = base[:30] + [f"c{k}" for k in range(90)]
    rows = []
    for i in range(300):
        w = list(base if i % 3 else other)
        for at in rng.sample(range(len(w)), rng.randint(*edits)):
            w[at] = rng.choice([f"x{i}", f"x{at}", "and", "of"])
        rows.append((i, " ".join(w)))
    if with_base:
        rows += [(400, " ".join(base)), (401, " ".join(other))]
    want = groups(rows, 2)
    assert 20 < len({c for _, _, c in want}) < 300
    assert found(frame(spark, rows), 2) == Counter(want)


@pytest.mark.parametrize("near", [1, 1000])
def test_any_centre_gives_the_same_groups(spark, monkeypatch, near):
    """Whether hubs yield to each other at once or never is a matter of speed only."""
    monkeypatch.setattr(near_dup, "NEAR_BUCKETS", near)
    rng = random.Random(8)
    rows = []
    for f in range(4):
        for i in range(60):
            w = [f"f{f}w{k}" if k % 4 else f"all{k}" for k in range(70)]
            for at in rng.sample(range(70), rng.randint(0, 7)):
                w[at] = rng.choice([f"x{i}", f"y{at}", "of"])
            rows.append((100 * f + i, " ".join(w)))
    assert found(frame(spark, rows), 2) == Counter(groups(rows, 2))


def test_chains_stay_connected(spark):
    """Each text is linked with its neighbours only, and the centres of its buckets are seldom among them."""
    rows = [(i, " ".join(f"w{k}" for k in range(i * 8, i * 8 + 100))) for i in range(40)]
    want = groups(rows, 2)
    assert {c for _, _, c in want} == {0}
    assert found(frame(spark, rows), 2) == Counter(want)


def test_nothing_is_a_duplicate_of_nothing(empty):
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0


def test_keep_one_keeps_one_of_each(spark, edge, edge_rows):
    # names that a careless operator would take for its own
    clash = {"lang": "id", "source": "_hash", "n_chars": "row", "node": "label", "label": "words", "score": "kept_id", "size": "nth", "key": "key"}
    more = spark.createDataFrame([(*r, *edge_rows[0][2:]) for r in MORE], edge.schema)
    out = keep_one(edge.unionByName(more).toDF(*(clash.get(c, c) for c in edge.columns)))
    assert out.columns == [clash.get(c, c) for c in edge.columns]
    got = out.collect()
    assert {(r["_hash"], r["words"], r["key"]) for r in got} <= {(r[3], r[6], r[9]) for r in edge_rows}
    rows = [(r[0], r[1]) for r in edge_rows] + MORE
    label = {}
    for (i, t), (_, n, c) in zip(rows, groups(rows, 5), strict=True):
        label[(i, t)] = (c, t if c is None else None, i if c == 50 else None) if n else None
    assert Counter(label[(r.doc_id, r.text)] for r in got if label[(r.doc_id, r.text)] and r.doc_id not in (50, None)) == Counter({v for k, v in label.items() if v and v[0] not in (50, None)})
    assert sum(label[(r.doc_id, r.text)] is None for r in got) == sum(label[x] is None for x in rows)
    assert sorted(r.text[0] for r in got if r.doc_id == 50) == ["p", "q"] and len([r for r in got if r.doc_id is None and (r.text or "").startswith("r")]) == 1


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(0, 60)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(Scratch(spark), links).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def cut_by_hand(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + 400] for _, t in raw for p in range(len(t) - 399))
    want = Counter()
    for i, t in raw:
        gone = cover([(p, p + 400) for p in range(len(t) - 399) if seen[t[p : p + 400]] > 1])
        mask = bytearray(len(t))
        for a, b in gone:
            mask[a:b] = b"\1" * (b - a)
        rest = bytes(c for c, m in zip(t, mask) if not m)
        want[(i, len(t), sum(mask), len(gone), hashlib.sha256(rest).hexdigest(), rest)] += 1
    return want


def cut(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in without_repeats(df).collect())


def test_repeats_equal_brute_force(edge, edge_rows):
    want = cut_by_hand([(r[0], r[1]) for r in edge_rows])
    assert cut(edge) == want
    assert sum(k[2] for k in want) > 3000


def test_texts_that_repeat_themselves(spark):
    """Periodic stretches with other ends, a stretch broken in the middle, and repeats that start or end inside a run."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = noise(700)
    rows = [(1, "ab" * 500 + "c" + "ab" * 300), (2, "x" + "ab" * 450 + noise(50)), (3, "abc" * 200), (4, "q" * 400), (5, "q" * 399), (6, noise(300) + "q" * 399 + noise(300)), (7, "Ored " * 400), (8, noise(90) + "Ored " * 90 + noise(700))]
    rows += [(15, noise(60) + "0123456789" * 41 + noise(60)), (16, "vwxyz" * 82)]
    rows += [(9, noise(100) + shared + noise(40)), (10, shared[200:]), (11, noise(30) + shared[:405]), (12, shared[130:531] + noise(10)), (13, shared[:399]), (14, "é" * 600), (None, "é" * 210)]
    want = cut_by_hand(rows)
    assert cut(frame(spark, rows)) == want
    assert sum(k[2] > 0 for k in want) >= 9


def test_a_periodic_text_has_few_entries():
    bucket, _, _, loops = runs(identifiers(b"ab" * 50_000))
    assert len(bucket) < 100_000 // 140 and loops[:-2].all()
    plain = random.Random(1).randbytes(50_000)
    assert not runs(identifiers(plain))[3].any()
    assert len(identifiers(bytes(256))) == 1 and len(identifiers(bytes(400))) == 145


def test_repeats_in_nothing(empty):
    assert without_repeats(empty).count() == 0
