"""The registered queries themselves, on the smallest data set, against plain Python."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnflow.llm.registry import QUERIES
from tests.llm.test_dedup import cut_by_hand, groups
from tests.llm.test_native import base_spans, expected_mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def answer(spark, name, sf=SF):
    (query,) = (q for k, q in QUERIES.items() if k.startswith(f"{name}_"))
    return query(spark, sf).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, documents):
    got = {r.doc_id: r for r in answer(spark, "op1")}
    assert len(got) == len(documents)
    for i, text, _ in documents:
        spans = base_spans(text)
        kinds = Counter(s.split(":")[0] for s in spans.split(",") if s)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (kinds["assign"], kinds["access"], kinds["hex"], sha(spans))
        assert set(spans.split(",")) - {""} <= set(r.spans.split(","))


def test_op2(spark, documents):
    t, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, set()
    for i, text, _ in sorted(documents):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.add((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert {tuple(r) for r in answer(spark, "op2")} == want


@pytest.mark.parametrize(("name", "target", "modulus", "remainder"), [("op3", "toxic", 3, 1), ("op10", "quality", 4, 2)])
def test_op3_and_op10(spark, name, target, modulus, remainder):
    sf = SF.replace("0.001", "0.01")  # the smallest set has hardly a label
    got = {r.doc_id: r for r in answer(spark, name, sf)}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    labels = {r.doc_id: r[target] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    pairs = [(a > b) + (a == b) / 2 for a, y in held for b, z in held if y > z]
    assert pairs and sum(pairs) / len(pairs) > 0.7


def test_op4(spark, documents):
    got = {r.doc_id: r for r in answer(spark, "op4")}
    for i, text, _ in documents:
        raw = text.encode()
        payload, r = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0"), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.codec == "raw" and len(r.keyframes) == -(-len(payload) // 1024) and r.media_bytes > r.payload_bytes


def test_op5(spark, documents):
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t, s in documents]
    size, target = expected_mix(sizes)
    by, taken = {i: (s, n) for i, s, n in sizes}, Counter()
    for r in answer(spark, "op5"):
        s, n = by[r.doc_id]
        assert (r["size"], r.source_size) == (n, size[s]) and abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.taken <= 3 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_op6(spark, documents):
    want = {(i, n, c, i == c) for i, n, c in groups([(i, t) for i, t, _ in documents], 2)}
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in answer(spark, "op6")} == want


def test_op7(spark, documents):
    from tarnflow.llm.decontaminate import words_of
    from tests.llm.test_pipeline import leaked

    items = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(i, item, d) for i, text, _ in documents for item, d in leaked(words_of(text), items)}
    assert want and {(r.doc_id, r.item_id, r.edits) for r in answer(spark, "op7")} == want


def test_op8(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    rows[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in answer(spark, "op8")}
    assert set(got) == set(rows)
    for conv, turns in rows.items():
        turns.sort()
        loss, r = "".join(x for _, role, x in turns if role == "assistant"), got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{role}\n{x}\n" for _, role, x in turns)), len(loss), sha(loss))


def test_op9(spark, documents):
    want = {k[:5] for k in cut_by_hand([(i, t) for i, t, _ in documents])}
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in answer(spark, "op9")} == want
