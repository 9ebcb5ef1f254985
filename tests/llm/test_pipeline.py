import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tarnflow.llm import decontaminate, near_dup, toxicity


def test_stages_take_effect(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before, bench = docs, spark.read.parquet(f"{d}/benchmark.parquet")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, d).cache()
        assert out.columns == before.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and ids
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
            assert {r.doc_id for r in toxicity.scores(docs, model).where("score < 0.7").collect()} == ids
        if name == "near_duplicates":
            assert near_dup.near_duplicates(out).where("component_id <> doc_id").count() == 0
        if name == "decontamination":
            assert decontaminate.leaks(out, bench).count() == 0
        docs = out
    digest = c.STAGES[-1][1](spark, docs, d)
    assert digest.count() == docs.count()


def leaked(words, items):
    """(item, edits) of every item that some stretch of the words holds, by full alignment with all items at once."""
    n = np.array([len(w) for _, w in items])
    width = n.max()
    code = {w: k for k, w in enumerate({w for _, ws in items for w in ws})}
    grid = np.full((len(items), width), -1)
    for row, (_, ws) in zip(grid, items):
        row[: len(ws)] = [code[w] for w in ws]
    steps = np.arange(width + 1)
    cost = np.tile(steps, (len(items), 1))
    best = n.copy()
    for w in words:
        new = np.zeros_like(cost)
        new[:, 1:] = np.minimum(cost[:, :-1] + (grid != code.get(w, -2)), cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
        best = np.minimum(best, cost[np.arange(len(items)), n])
    most = np.where(n >= 8, n // 5, 0)
    return [(items[k][0], int(best[k])) for k in np.flatnonzero((best <= most) & (n > 0))]


def test_whole_pipeline_equals_plain_python(spark):
    """Every stage by hand on the smallest data set; the trained score alone is the operator's own."""
    import corpus_pipeline as c
    from tests.llm.test_dedup import groups
    from tests.llm.test_native import expected_mix

    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    score = toxicity.Scorer(toxicity.train(table, spark.read.parquet(f"{d}/labels.parquet")))
    docs = [(r.doc_id, r.text, r.source) for r in table.collect()]
    docs = [r for r in docs if score(r[1]) < 0.7]
    kept = {i for i, n, label in groups([r[:2] for r in docs], 5) if i == label or not n}
    docs = [r for r in docs if r[0] in kept]
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = [r for r in docs if not leaked(decontaminate.words_of(r[1]), items)]
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in docs]
    size, target = expected_mix(sizes)
    copies, at = {}, Counter()
    for i, s, n in sorted(sizes, key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
        quota = min(int(target[s] + 0.5), 3 * size[s])
        copies[i] = (quota - 1 - at[s]) // size[s] + 1 if n and at[s] < quota else 0
        at[s] += n
    t, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text, _ in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for _ in range(copies[i]):
            want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            start += len(ids)
    assert sorted(tuple(r) for r in c.run(spark, d).collect()) == sorted(want)
