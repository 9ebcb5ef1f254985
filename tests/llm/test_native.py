import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tarnflow.llm.secret_scan import scan, span_text, token_tests
from tarnflow.llm.source_mix import mix, mix_counts, mixed_documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_base_spans_equal_brute_force(spark, edge):
    tricky = [(100, "token=secret: abcdefghijk", None), (101, "é😀 PASSWORD = 'abc' passwd:12345678 token==xxxxxxxx", None), (102, "apikey" * 400 + "=abcdefgh " + "f" * 31 + " " + "0" * 32, None), (103, "secret: 'a.b-c_d/e' " * 700, None)]
    docs = edge.select("doc_id", "text", "source").unionByName(spark.createDataFrame(tricky, "doc_id bigint, text string, source string"))
    got = Counter((r.doc_id, r.s) for r in scan(docs).select("doc_id", span_text(F.concat("assign", "access", "hex")).alias("s")).collect())
    assert got == Counter((r.doc_id, base_spans(r.text or "")) for r in docs.collect())


def test_random_tokens_are_found_and_words_are_not(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:48]
    rows = [(i, f"key {digest(i)} end") for i in range(40)] + [(100 + i, f"id aaaaaaaaaa{'ab' * 12}0000{i % 7}000000 internationalization2024settings{i}") for i in range(40)]
    got = {r.doc_id: len(r.random) for r in scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i] for i in range(40)) >= 30
    assert sum(got[100 + i] for i in range(40)) <= 2


def p_values(token):
    """The battery by the textbook, for hex tokens."""
    import math

    tail = lambda z: 1 / (1 + math.exp(max(-700, min(700, 1.5976 * z + 0.070565 * z**3))))
    v, k = [int(c, 16) for c in token], 16
    n = len(v)
    cells = min(k, max(4, n // 2))
    chi = sum(c * c for c in Counter(x * cells // k for x in v).values()) * cells / n - n
    away = n * 1.2
    p_chi = tail((cells - 1 + away - chi) / math.sqrt(2 * (cells - 1 + 2 * away)))
    high = [x >= k / 2 for x in v]
    ones = sum(high)
    zeros = n - ones
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * ones * zeros / n + 1
    p_runs = tail((n * 0.32 - abs(runs - mean)) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))) if ones and zeros else 1.0
    m = sum(v) / n
    spread = sum((x - m) ** 2 for x in v)
    p_serial = tail((0.6 - abs(sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / spread)) * math.sqrt(n)) if spread else 1.0
    return max(p_chi, p_runs, p_serial)


def test_battery_equals_the_textbook(spark):
    rows = [(i, t) for i, t in enumerate([hashlib.sha256(str(i).encode()).hexdigest()[: 20 + i] for i in range(40)] + ["0123456789abcdef" * 3, "a1" * 20, "0a" + "0" * 30])]
    tests = spark.createDataFrame(rows, "i int, t string").select("i", token_tests(F.col("t")).alias("x")).collect()
    for r in tests:
        (x,) = r.x
        token = rows[r.i][1]
        assert (x.start, x.end) == (0, len(token)) and abs(x.bin - min(3000, -100 * __import__("math").log10(max(p_values(token), 1e-30)))) <= 1.001


def test_many_tokens_in_one_text(spark):
    n = 10_000
    text = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[:40] for i in range(n))
    import time

    began = time.perf_counter()
    row = scan(spark.createDataFrame([(1, "é" + text)], "doc_id bigint, text string")).select(F.size("hex").alias("h"), F.size("random").alias("r")).first()
    assert row.h == n and row.r > 0.9 * n and time.perf_counter() - began < 60


def test_scan_of_nothing(empty):
    assert scan(empty).count() == 0


def expected_mix(rows):
    size = Counter()
    for _, source, n in rows:
        size[source] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, free = {}, float(sum(size.values())), set(names)
    while True:
        share = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] >= 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = float(3 * size[s])
            left -= target[s]
            free.discard(s)
    return size, target | {s: share * weight[s] for s in free}


def test_mix_meets_its_targets(edge, edge_rows):
    m = mix(edge, block_words=64)
    got = mix_counts(m).collect()
    sizes = [(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in edge_rows]
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter(sizes)
    size, target = expected_mix(sizes)
    taken = Counter()
    for r in got:
        assert r.taken <= 3 * r["size"] and r.source_size == size[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    # every block is played by one slot, every slot has one source
    slots = m.schedule.groupBy("slot", "sid").agg(F.countDistinct("rank").alias("n"), F.sum("words").alias("w")).collect()
    assert max(r.n for r in slots) == 1 and max(r.w for r in slots) <= 64
    again = {(r.doc_id, r["size"], r.taken) for r in mix_counts(mix(edge, block_words=64)).collect()}
    assert again == {(r.doc_id, r["size"], r.taken) for r in got}


def test_slots_interleave_sources(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", "w " * 50) for i in range(400)], "doc_id bigint, source string, text string")
    rows = mix(docs, block_words=50).schedule.select("slot", "sid").distinct().orderBy("slot").collect()
    share = sum(r.sid == 1 for r in rows) / len(rows)
    for i in range(0, len(rows) - 60, 30):  # low discrepancy: every stretch has about the whole's share
        assert abs(sum(r.sid == 1 for r in rows[i : i + 60]) / 60 - share) < 0.08


def test_mix_of_nothing_and_documents(edge, empty):
    assert mix_counts(mix(empty)).count() == 0 and mixed_documents(empty).count() == 0
    clash = dict(zip(edge.columns[5:], ["_id", "_words", "turn", "copies", "row"], strict=True))
    out = mixed_documents(edge.toDF(*(clash.get(c, c) for c in edge.columns)))
    assert out.columns == [clash.get(c, c) for c in edge.columns]
    assert {tuple(r[c] for c in clash.values()) for r in out.collect()} == {(7, 1, "s", "z", "k")}
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(v for k, v in n.items() if k != 43) <= 3 and 0 not in n


def test_native_plans_have_no_python(edge):
    for df in (scan(edge), mix_counts(mix(edge))):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
