import hashlib
import random
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnflow.llm import chat_format, decontaminate, iso_media, quality, toxicity
from tarnflow.llm.token_shards import PieceEncoder, checksums, read_shards, with_global_start, write_shards

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def shards(spark, docs, path, **options):
    write_shards(docs, path, TOKENIZER, public_tokenizers.PATTERN, **options)
    return read_shards(spark, path)


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("special_as_text", [False, True])
def test_shards_equal_the_tokenizer(spark, edge, edge_rows, tmp_path, special_as_text):
    extra = [(900, "a  b\n\n\nc  d\x1c e it's\t<|endoftext|> \n"), (901, " \n lead"), (902, "tail \n\n"), (903, "x <|endoftext|> y"), (904, "<|endoftext|><|endoftext|>x<|endoftext|")]
    # words that every polynomial hash modulo a power of two takes for one another
    extra += [(910 + k, text) for k, text in enumerate(thue_morse(n, *ab) for n in (1024, 2048) for ab in ("ab", "ba"))]
    extra += [(920, " ".join(thue_morse(1024, *ab) for ab in ("ab", "ba", "ab")))]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string").coalesce(1))
    read = shards(spark, docs, str(tmp_path / "s"), special_as_text=special_as_text)
    got = with_global_start(checksums(read), read).orderBy("start").collect()
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = special_as_text
    rows = [(r[0], r[1] or "") for r in edge_rows] + extra
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want[(i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    one = read_shards(spark, str(tmp_path / "s"), F.col("doc_id") == 42)
    assert "EqualTo(doc_id,42)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1


def test_words_are_cached_whatever_sign_follows():
    """Each word goes through the tokenizer once, and a cache of any size gives the library's ids."""
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    signs = [",", ".", "; ", "!?", "'s", "'tis", "9", "-x", "\n", "\n\n  ", "  ", " 12ab", "\u00a0", "日本", " é", "'", '"(', "\x1c"]
    texts = ["".join(" " + rng.choice(pool) + rng.choice(signs) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
    with open(TOKENIZER, encoding="utf-8") as f:
        model = f.read()
    want = [e.ids for e in Tokenizer.from_str(model).encode_batch(texts, add_special_tokens=False)]
    for capacity in (1, 50, 10_000):
        encoder = PieceEncoder(model, public_tokenizers.PATTERN, capacity=capacity)
        for _ in range(2):
            flat, counts = encoder.encode(offsets, data)
            assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want
    plain = "".join(f" {w}{s}" for w in ("alpha", "beta", "gamma") for s in ",.;:!?()").encode()
    encoder = PieceEncoder(model, public_tokenizers.PATTERN)
    encoder.encode(np.array([0, len(plain)]), np.frombuffer(plain, np.uint8))
    assert encoder.used == 3 + 8


def test_cache_stays_small():
    """A worker keeps its cache for all stages that follow, so an entry must not take more than its bytes, ids and places."""
    with open(TOKENIZER, encoding="utf-8") as f:
        encoder = PieceEncoder(f.read(), public_tokenizers.PATTERN, capacity=20_000)
    tracemalloc.start()
    for a in range(0, 19_000, 1000):
        raw = "".join(f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}xyz" for i in range(a, a + 1000)).encode()
        encoder.encode(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 20_000 * 150


def test_shards_of_nothing(spark, empty, tmp_path):
    read = shards(spark, empty, str(tmp_path / "s"))
    assert with_global_start(checksums(read), read).count() == 0


def test_media_round_trip(edge, edge_rows, empty, tmp_path):
    stored = iso_media.write_media(iso_media.store_texts(edge, F.col("text")), str(tmp_path / "m"))
    assert iso_media.payload_digest(iso_media.store_texts(empty, F.col("text"))).count() == 0
    want = sorted((r[0] or -1, (r[1] or "").encode()) for r in edge_rows)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r) for r in iso_media.payload_digest(stored).collect()), key=lambda x: (x[0], x[1].n_bytes))
    assert len(got) == len(want)
    by = {}
    for i, raw in want:
        by.setdefault((i, len(raw)), raw)
    for i, r in got:
        raw = by[(i if i else -1, r.n_bytes)] if (i if i else -1, r.n_bytes) in by else by[(i, r.n_bytes)]
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    tracks = iso_media.read_tracks(stored, "media").select("media", "tracks").first()
    assert tracks.tracks[0].codec == "raw " and tracks.tracks[0].handler == "soun"


def test_tracks_by_hand():
    data = iso_media.store(bytes(range(64)) * 40)
    (t,) = iso_media.tracks(data)
    assert (t["samples"], t["seconds"]) == (40, 40 * 64 / 8000)
    ranges = [(k["start"], k["end"]) for k in t["keyframes"]]
    begin = data.index(b"mdat") + 4
    assert ranges == [(begin + c * 1024, begin + c * 1024 + 64) for c in range(3)]
    b, fb, u = iso_media.box, iso_media.full_box, iso_media._u32
    # sizes differ, two samples in the first chunk, one in the others, no sync table, a 64-bit box and an unknown one
    stbl = b(b"stbl", fb(b"stsd", u(1), b(b"avc1", bytes(78))), fb(b"stts", u(1, 4, 100)), fb(b"stsc", u(2), u(1, 2, 1), u(2, 1, 1)), fb(b"stsz", u(0, 4, 10, 20, 30, 40)), fb(b"stco", u(3, 1000, 2000, 3000)), fb(b"stss", u(2, 1, 3)))
    body = b(b"trak", b(b"mdia", fb(b"mdhd", u(0, 0, 1000, 400), bytes(4)), fb(b"hdlr", u(0), b"vide", bytes(12)), b(b"minf", stbl)))
    moov = struct.pack(">I4sQ", 1, b"moov", len(body) + 16 + 12) + body + b(b"zzzz", bytes(4))
    (v,) = iso_media.tracks(b(b"free", bytes(9)) + moov)
    assert (v["codec"], v["handler"], v["seconds"], v["samples"]) == ("avc1", "vide", 0.4, 4)
    assert [(k["start"], k["end"]) for k in v["keyframes"]] == [(1000, 1010), (2000, 2030)]
    assert iso_media.tracks(None) == [] and iso_media.tracks(b"\0\0\0\1moov") == [] and iso_media.tracks(data[:-30]) is not None


def test_damaged_and_nested_containers():
    b, fb, u = iso_media.box, iso_media.full_box, iso_media._u32
    deep = b(b"free")
    for _ in range(3000):
        deep = b(b"moov", deep)
    assert iso_media.tracks(deep) == []
    most = (1 << 32) - 1

    def track(*tables):
        return b(b"moov", b(b"trak", b(b"mdia", fb(b"mdhd", u(0, 0, 1000, 0), bytes(4)), b(b"minf", b(b"stbl", *tables)))))

    for tables in (
        (fb(b"stsc", u(1), u(1, most, 1)), fb(b"stsz", u(1, most)), fb(b"stco", u(2, 0, 9))),
        (fb(b"stsc", u(3), u(1, 1, 1), u(1, 5, 1), u(0, most, 1)), fb(b"stsz", u(0, most, 1, 1)), fb(b"stco", u(most, 0, 9))),
        (fb(b"stts", u(most, 1)), fb(b"stsc", u(most)), fb(b"stsz", u(7, 3)), fb(b"stss", u(most, 5))),
    ):
        (t,) = iso_media.tracks(track(*tables))
        assert len(t["keyframes"]) < 1000
    (t,) = iso_media.tracks(track(fb(b"stsc", u(1), u(1, 9, 1)), fb(b"stz2", b"\0\0\0\4", u(3), b"\x12\x30"), fb(b"stco", u(1, 100))))
    assert [(k["start"], k["end"]) for k in t["keyframes"]] == [(100, 101), (101, 103), (103, 106)]
    data = iso_media.store(bytes(4096))
    for cut in range(0, len(data), 7):
        iso_media.tracks(data[:cut])
        iso_media.tracks(data[:cut] + b"\xff" * 9 + data[cut + 9 :])


def test_movie_fragments():
    b, fb, u = iso_media.box, iso_media.full_box, iso_media._u32
    tkhd = fb(b"tkhd", u(0, 0, 7, 0, 0))
    moov = b(b"moov", b(b"trak", tkhd, b(b"mdia", fb(b"mdhd", u(0, 0, 100, 0), bytes(4)), fb(b"hdlr", u(0), b"vide", bytes(12)))), b(b"mvex", fb(b"trex", u(7, 1, 10, 50, 0x10000))))
    sizes = fb(b"trun", u(3, 200, 0, 5, 6, 7), flags=0x1 | 0x4 | 0x200)  # first sample is a keyframe, others as the defaults say
    more = fb(b"trun", u(2), flags=0)  # goes on where the last run ends, in default sizes
    data = moov + b(b"moof", b(b"traf", fb(b"tfhd", u(7), flags=0x20000), sizes, more))
    at = len(moov)
    (t,) = iso_media.tracks(data)
    assert (t["samples"], t["seconds"], t["handler"]) == (5, 0.5, "vide")
    assert [(k["start"], k["end"]) for k in t["keyframes"]] == [(at + 200, at + 205)]
    own = b(b"moof", b(b"traf", fb(b"tfhd", u(7, 0, 5000, 30, 0), flags=0x1 | 0x10 | 0x20), fb(b"trun", u(2), flags=0)))
    (t,) = iso_media.tracks(moov + own)
    assert [(k["start"], k["end"]) for k in t["keyframes"]] == [(5000, 5030), (5030, 5060)]


def test_chat_layouts_and_masks(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}'), (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'), (3, '{"instruction":"do","input":"this","output":"done"}'),
        (4, '{"prompt":"p","completion":"c"}'), (5, '{"data":{"turns":[{"speaker":"bot","text":"t"}]}}'), (6, '{"what":1}'), (7, "no json"), (8, None),
    ]
    rows = chat_format.canonical_turns(spark.createDataFrame(records, "id int, r string"), F.col("id"), F.col("r")).collect()
    turns = {}
    for r in sorted(rows, key=lambda r: (r.key, r.position or 0)):
        turns.setdefault(r.key, []).append((r.role, r.text) if r.known else None)
    assert turns[1] == [("user", "hi"), ("assistant", "yo")] and turns[2] == [("user", "a"), ("assistant", "b")]
    assert turns[3] == [("user", "do\n\nthis"), ("assistant", "done")] and turns[4] == [("user", "p"), ("assistant", "c")] and turns[5] == [("assistant", "t")]
    assert turns[6] == turns[7] == turns[8] == [None]


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "</s>[INST] \\ <|im_end|> é😀"), (1, 0, "user", None), (1, 1, "assistant", "</s>[INST] \\ <|im_end|> é😀"), (2, None, None, "x"), (None, 0, "assistant", "")] + [(9, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_conversations(chat_format.format_turns(df)).collect()}
    for conv in (1, 2, None, 9):
        own = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_conversations(chat_format.format_turns(df.limit(0))).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(1500):
        text = [rng.choice(pool) for _ in range(rng.randint(20, 60))]
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["zorkface", "blurghead"])
        low = i % 7 == 0
        docs.append((i, " ".join(w + "$$$" if low else w for w in text)))
        labels.append((i, int(not low), int(bad)))
    docs += [(9000, None), (9001, ""), (9002, "the z0rkf@ce said"), (9003, "said b l u r g h e a d here"), (9004, "zorkfaaaaace"), (None, "zorkface")]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels + labels[:3] + [(9999, 1, 1), (None, 0, 0)], "doc_id bigint, quality int, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    got = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.train(docs, labels)).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == bool(truth[i]) for i in held)
    assert min(got[i] for i in (9002, 9003, 9004, None)) >= 0.7 and max(got[9000], got[9001]) < 0.3
    model = toxicity.train(docs, labels)
    assert toxicity.accepted(docs, model, 0.7).where("doc_id in (9002, 5)").count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score < 0.01 for r in toxicity.scores(docs, none).collect()} == {True}
    assert toxicity.scores(docs.limit(0), model).count() == 0


def test_one_symbol_a_character():
    assert toxicity.symbols_of("aZ é-字").tolist() == [0, 25, 27, 26, 27, 26]


def test_scores_of_any_rows(edge, edge_rows, labelled):
    """Nulls, blanks, a very long text, repeated rows and clashing names; a text's score is its own."""
    docs, labels = labelled
    names = {"lang": "score", "score": "found", "label": "held_out"}
    clash = edge.toDF(*(names.get(c, c) for c in edge.columns))
    for scores, model in ((toxicity.scores, toxicity.train(docs, labels)), (quality.scores, quality.train(docs, labels))):
        got = scores(clash, model).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_rows)
        assert all(0 <= r.score <= 1 for r in got)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add(r.score)
        assert len(by[43]) == 1 and by[0] == by[1] == by[2]
        assert scores(clash.limit(0), model).count() == 0
    model = toxicity.train(docs, labels)
    kept = toxicity.accepted(clash, model, 2.0)
    assert kept.columns == clash.columns and Counter(kept.collect()) == Counter(clash.collect())


def test_quality(labelled):
    docs, labels = labelled
    got = {r.doc_id: r.score for r in quality.scores(docs, quality.train(docs, labels)).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.7) == bool(i % 7) for i in held)
    assert right >= 0.98 * len(held) and 0 <= got[9001] <= 1
    assert {r.score for r in quality.scores(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_decontamination(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(15, 50)))) for i in range(60)] + [(90, "too short"), (91, None), (None, " ".join(text(20)))]
    docs, want = [], set()
    for i in range(60):
        w = items[i][1].split()
        for k in range(len(w) // 12):
            w[rng.randrange(len(w))] = f"edit{k}"
        docs.append((i, " ".join([*text(rng.randint(0, 80)), *w, *text(rng.randint(0, 80))]).upper()))
        want.add((i, i))
    docs += [(200 + i, " ".join(text(400))) for i in range(60)] + [(500, None), (501, ""), (0, docs[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.leaks(d, b).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs <= want and len(pairs) >= 0.95 * len(want)
    tables = decontaminate.Tables([(i, decontaminate.words_of(t)) for i, t in items if t])
    for r in got:
        w = decontaminate.words_of(next(t for i, t in docs if i == r.doc_id))
        assert r.edits <= 0.2 * r.item_words and r.end_word - r.first_word <= r.item_words + r.edits
        assert r.edits == levenshtein(decontaminate.words_of(items[r.item_id][1]), w[r.first_word : r.end_word])
    assert tables.expected_recall >= 0.9
    left = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in pairs}
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.clean(d, b.limit(0)).count() == len(docs)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_items_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 200)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(20)]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert len(list(decontaminate.item_slices(b))) > 3
    d = spark.createDataFrame([(i, "x y " + t) for i, t in items], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == {(i, i) for i in range(20)}


def test_leaks_wherever_the_edits_are(spark):
    rng = random.Random(31)
    pool = [f"w{i}" for i in range(2000)]
    items = [(i, [rng.choice(pool) for _ in range(8 if i == 0 else rng.randint(40, 59))]) for i in range(60)]
    docs, want = [], {}
    for i, w in items[1:]:
        most = len(w) // 5
        for how in range(4):
            x = list(w)
            if how == 0:  # other first words
                x[:most] = ["other"] * most
            elif how == 1:  # without the first words
                x = x[most:]
            elif how == 2:  # as many words in between, in the first half
                for _ in range(most):
                    x.insert(rng.randrange(1, 20), "other")
            else:
                for at in rng.sample(range(len(w)), most):
                    x[at] = "other"
            docs.append((4 * i + how, " ".join(["before"] * rng.randint(0, 30) + x + ["after"] * rng.randint(0, 30))))
            want[4 * i + how] = i
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == set(want.items())
    assert decontaminate.clean(d, b).count() == 0


def test_tables_reach_the_recall_they_state():
    rng = random.Random(5)
    items = [(i, [f"w{rng.randrange(3000)}" for _ in range(rng.randint(8, 130))]) for i in range(400)]
    tables = decontaminate.Tables(items)
    found = {"random": 0, "head": 0, "tail": 0}
    for k, (_, w) in enumerate(items):
        most = len(w) // 5
        x = list(w)
        for _ in range(most):
            at, how = rng.randrange(len(x)), rng.randrange(3)
            x[at : at + (how != 2)] = ["other"] if how else []
        for kind, y in (("random", x), ("head", w[most:]), ("tail", w[: len(w) - most])):
            seq = [tables.symbol.get(v, 0) for v in y]
            found[kind] += any(item == k for _, item, _ in tables.candidates(decontaminate.np.array(seq, "int32")))
    assert tables.expected_recall >= decontaminate.RECALL, (len(tables.tables), tables.expected_recall)
    assert min(found.values()) >= 0.9 * len(items), (len(tables.tables), found)


def best_distance(item, words):
    """Least edits between the item and any stretch of the words."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        new = [0]
        for j, x in enumerate(item, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_equal_all_windows(spark):
    """Every item against every document by full alignment: edits around the limit, short items, ties, nulls, clashing names."""
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(60)]
    items = [(i, [rng.choice(pool) for _ in range(rng.choice([1, 2, 4, 7, 8, 9, 14, 25, 40, 70]))]) for i in range(40)]
    items += [(100, list(items[20][1])), (None, [rng.choice(pool) for _ in range(30)])]
    docs = []
    for n in range(120):
        w = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, len(w) // 4 + 1)):
            at, how = rng.randrange(len(w) + 1), rng.randrange(3)
            w[at : at + (how != 2)] = [rng.choice([*pool, "é9", "other"])] if how else []
        docs.append((n if n % 10 else None, " ".join([*rng.choices(pool, k=rng.randint(0, 20)), *w, *rng.choices(pool, k=rng.randint(0, 20))]), "x", 1))
    docs += [(500, None, None, None), (501, "", "x", 2), (502, "é " * 50_000 + " ".join(items[-1][1]), "x", 3), docs[3]]
    limit = lambda w: len(w) // 5 if len(w) >= 8 else 0
    want = {(d, i, best_distance(w, t.split())) for d, t, _, _ in docs if t for i, w in items if len(t) < 5000 and best_distance(w, t.split()) <= limit(w)}
    want |= {(502, i, 0) for i, w in items if i is None or " ".join(w) in " ".join(items[-1][1]).split(" ") or f" {' '.join(w)} " in f" {' '.join(items[-1][1])} "}
    d = spark.createDataFrame(docs, "doc_id bigint, text string, edits string, item_id int")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(700, None), (701, " .,")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(d, b).collect()}
    near = {x for x in got if x[0] == 502 and x[2]}  # edited places in the long text, not searched by hand
    assert got - near == want
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns
    found = {(d_, t) for d_, t, _, _ in docs if t and len(t) < 5000 and any(best_distance(w, t.split()) <= limit(w) for _, w in items)}
    assert {(r.doc_id, r.text) for r in left.collect()} == {(d_, t) for d_, t, _, _ in docs if d_ != 502} - found


def test_leetspeak_reaches_the_decoder():
    words = ["idiot", "worthless", "people", "that", "said", "there", "letter", "house", "water", "river", "other", "this", "and", "then"]
    text = " ".join(random.Random(2).choices(words, k=4000)) + " 2024 455 1000"
    s = toxicity.symbols_of(text)
    n = toxicity.SYMBOLS
    counts = toxicity.np.bincount(s[:-2] * n * n + s[1:-1] * n + s[2:], minlength=n**3)
    restore = toxicity.Restorer(toxicity.log_model(counts))
    long = "w" * 13 + "o" * 12 + "r" * 14 + "thless"
    for token in ("w0r7hl355", "1d107", "id-iot", "id.iot", "iddiioott", "i  d  i  o  t", "i d i o t.", "i.d.i.o.t!"):
        assert restore.words(token) == {"worthless" if token[0] == "w" else "idiot"}, token
    assert next(iter(restore.words(long))).startswith("worthles")
    for token in ("letter", "worthless", "2024", "455", "1000", "3.14", "12:30"):
        assert restore.words(token) == {token}
    assert restore.words("t h i s  i d i o t") == {"this", "idiot"}
    assert len(restore.text("a1" * 50_000)) <= 100_000


def test_scorer_restores_a_token_once():
    """Case and repetition cost nothing, the short ways change no word, and those in use outlive a full memory."""
    rng = random.Random(5)
    letters = "aAbBzZéÉİſΣK0413@$!.,'-\"()"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    text = " ".join([*odd, "iddiioott! Worthless, 1D10T. (w0r7hl355) i d i o t. I.D.I.O.T Σας a@B.c http://X.y"])
    flat = toxicity.log_model(np.ones(toxicity.SYMBOLS**3, np.int64))
    restore, slow = toxicity.Restorer(flat), toxicity.Restorer(flat)
    by_hand = set()
    for token in slow._spaced(text).split():
        core = toxicity._HEAD.sub("", toxicity._TAIL.sub("", token))
        simple = core.isascii() and core.isalpha() and not toxicity._REPEAT.search(core)
        by_hand.add(core.lower() if simple else slow.word(token))
    assert restore.words(text) == by_hand - {""}

    scorer = toxicity.Scorer(toxicity.Model(flat, dict.fromkeys(toxicity.features("worthless"), 1.0), -2.0))
    seen, word = [], scorer.restore.word
    scorer.restore.word = lambda token: seen.append(token) or word(token)
    assert scorer("Plain PLAIN plain Worthless WORTHLESS") == scorer("worthless") > scorer("plain") == scorer(None)
    assert sorted(seen) == ["plain", "worthless"]
    for i in range(3 * toxicity.CACHE_WORDS // 1000):
        scorer(" ".join(["plain", *(f"w{i}x{k}" for k in range(1000))]))
    assert seen.count("plain") == 1 and len(scorer.blank.new) + len(scorer.blank.old) < 2 * toxicity.CACHE_WORDS + 2002
