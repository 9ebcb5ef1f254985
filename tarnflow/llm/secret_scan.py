"""Secret spans: named patterns plus a randomness test battery with false-discovery control.

Base spans come from three patterns (assignments, access keys, hex runs), each
matched leftmost and without overlap. The battery looks at every token of 20
or more key characters that mixes letters and digits:

* *Encoding.* The token's characters name the smallest alphabet that holds them:
  hex, base 32, letters and digits, or base 64; its symbols become numbers.
* *Tests.* Each test takes as its null that the token is structured by at least
  a margin, so that only evidence of randomness rejects it, and long tokens can
  give more of it than short ones: chi-squared against an even use of the
  alphabet (the null's statistic is noncentral, with a noncentrality that grows
  with the length), runs above and below the alphabet's middle, and lag-one
  serial correlation (both two one-sided tests). A token's p-value is the
  largest of the three (intersection-union test).
* *Control.* Benjamini-Hochberg over all tokens of the corpus, within bands of
  length, so that the many short tokens do not set the level for long ones.
  P-values are binned at a tenth of a decibel; the counts of a band's bins are
  all that the whole corpus has to agree on.

Only DataFrame functions are used. The text is scanned once; what was found is
kept in the shared folder for the second step.

Short tokens give little evidence: a typical random token's p-value is about
7e-3 for 24 base-64 characters, 2e-3 for 32 hex digits and 8e-4 for 40 base-64
characters. The control finds such tokens only in corpora in which about 14, 5
and 1.5 % of the candidates of their band are random.

Defined results: null text is empty; offsets count code points, ends are
exclusive; ids may be null or repeat (each row is scanned on its own); the time
grows with the text's length and the number of its tokens, whatever they are;
tokens of equal p-value are found together; only doc_id and text are read; a
table without tokens yields base spans only, an empty one no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm._scratch import materialize

#: The patterns of the base spans, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: False discoveries that are allowed among the tokens found in a band of length.
FDR = 0.05
#: Margins of structure per symbol: divergence, share of runs, correlation.
MARGIN_CHI, MARGIN_RUNS, MARGIN_SERIAL = 1.2, 0.32, 0.6
#: Length bands end at these lengths.
BANDS = (24, 32, 48, 64, 128)
BIN_TOP = 3000

#: Spans are summed up in chunks of this many, so that long lists stay linear.
CHUNK = 256

SPAN = "kind:string,rank:int,start:bigint,end:bigint"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often it is read."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_offsets(text: Column, pattern: str, kind: str, rank: int, keep=None, mark=None) -> Column:
    """All matches of ``pattern`` in ``text`` as an array of spans.

    The pieces between matches and the matches themselves alternate, so their
    running lengths are the offsets. ``keep`` may refuse a match by its text, and
    ``mark`` gives each that is kept a number, in the field ``bin``.
    """
    span_type = f"array<struct<{SPAN}{',bin:int' if mark else ''}>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(found: Column) -> Column:
        parts = F.arrays_zip(
            F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint")).alias("gap"),
            F.transform(found, lambda m: F.struct(F.length(m).cast("bigint").alias("n"), (keep(m) if keep else F.lit(True)).alias("ok"), *([F.when(keep(m), mark(m)).alias("bin")] if mark else []))).alias("hit"),
        )
        empty = F.from_json(F.lit("[]"), span_type)

        def step(acc: Column, p: Column) -> Column:
            at = acc["at"] + p["gap"]
            span = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), at.alias("start"), (at + p["hit"]["n"]).alias("end"), *([p["hit"]["bin"].alias("bin")] if mark else []))
            spans_ = F.when(p["hit"]["ok"], F.array_append(acc["spans"], span)).otherwise(acc["spans"])
            return F.struct((at + F.coalesce(p["hit"]["n"], F.lit(0))).alias("at"), spans_.alias("spans"))

        def joined(parts: Column) -> Column:
            def chunk(acc: Column, c: Column) -> Column:
                start = F.struct(F.element_at(acc, -1)["at"].alias("at"), empty.alias("spans"))
                return F.array_append(acc, F.aggregate(F.slice(parts, c * CHUNK + 1, CHUNK), start, step))

            chunks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int"))
            first = F.array(F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")))
            return F.flatten(F.transform(F.aggregate(chunks, first, chunk), lambda a: a["spans"]))

        return bound(parts, joined)

    return F.when(F.size(found) > 0, spans(found)).otherwise(F.from_json(F.lit("[]"), span_type))


def base_spans(text: Column) -> dict[str, Column]:
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE
    return {
        "assign": match_offsets(text, ASSIGN, "assign", 0, long_value),
        "access": match_offsets(text, ACCESS, "access", 1),
        "hex": match_offsets(text, HEX, "hex", 2),
    }


#: A normal value whose upper tail is 1.
NO_EVIDENCE = -1000.0


def upper_tail(z: Column) -> Column:
    """Normal upper tail, by a logistic curve (error below 2e-4) and its own decay beyond."""
    w = F.greatest(F.lit(-700.0), F.least(F.lit(701.0), 1.5976 * z + 0.070565 * z * z * z))
    return bound(w, lambda w: F.when(w > 700, F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(w))))


#: The alphabets, in symbol order.
ALPHABETS = (
    ("hex", "^[0-9a-fA-F-]+$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def symbols(token: Column) -> Column:
    """struct(k, v): the size of the token's alphabet and its symbols as numbers."""

    def numbers(text: Column, alphabet: str) -> Column:
        return F.struct(F.lit(len(alphabet)).alias("k"), F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c) - 1).alias("v"))

    plain = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    out = numbers(plain, ALPHABETS[3][2])
    out = F.when(token.rlike(ALPHABETS[2][1]), numbers(token, ALPHABETS[2][2])).otherwise(out)
    out = F.when(token.rlike(ALPHABETS[1][1]), numbers(F.regexp_replace(token, "=+$", ""), ALPHABETS[1][2])).otherwise(out)
    return F.when(token.rlike(ALPHABETS[0][1]), numbers(F.lower(F.regexp_replace(token, "-", "")), ALPHABETS[0][2])).otherwise(out)


def battery(k: Column, v: Column) -> Column:
    """The largest of the three p-values of structure for symbols ``v`` of an alphabet of ``k``, in one pass over them and one over their sorted cells."""
    whole = lambda x: F.lit(x).cast("bigint")
    high = lambda x: x * 2 >= k

    def step(a: Column, x: Column) -> Column:
        before = a["last"] >= 0
        return F.struct(
            x.cast("bigint").alias("last"),
            (a["ones"] + high(x).cast("bigint")).alias("ones"),
            (a["changes"] + (before & (high(x) != high(a["last"]))).cast("bigint")).alias("changes"),
            (a["sum"] + x).alias("sum"),
            (a["squares"] + x * x).alias("squares"),
            (a["lag"] + F.when(before, a["last"] * x).otherwise(whole(0))).alias("lag"),
        )

    def count(a: Column, c: Column) -> Column:  # a cell's j-th symbol adds 2j - 1, so that a cell of o adds o * o
        j = F.when(a["cell"] == c, a["j"] + 1).otherwise(whole(1))
        return F.struct(c.alias("cell"), j.alias("j"), (a["total"] + 2 * j - 1).alias("total"))

    cells = F.least(k, F.greatest(F.lit(4), F.floor(F.size(v) / 2).cast("int")))
    sums = F.aggregate(v, F.struct(whole(-1).alias("last"), *(whole(0).alias(f) for f in ("ones", "changes", "sum", "squares", "lag"))), step)
    sorted_cells = F.array_sort(F.transform(v, lambda x: F.floor(x * cells / k)))
    squared = F.aggregate(sorted_cells, F.struct(whole(-1).alias("cell"), whole(0).alias("j"), whole(0).alias("total")), count)["total"]

    def p_value(s: Column) -> Column:
        n = F.size(v).cast("double")
        chi, df, away = s["squared"] * s["cells"] / n - n, s["cells"] - 1.0, n * MARGIN_CHI
        z_chi = (df + away - chi) / F.sqrt(2 * (df + 2 * away))
        t = s["sums"]
        ones = t["ones"].cast("double")
        zeros = n - ones
        mean_runs = 2 * ones * zeros / n + 1
        sd_runs = F.sqrt(F.greatest(F.lit(1e-9), (mean_runs - 1) * (mean_runs - 2) / (n - 1)))
        z_runs = F.when((ones == 0) | (zeros == 0), F.lit(NO_EVIDENCE)).otherwise((n * MARGIN_RUNS - F.abs(t["changes"] + 1 - mean_runs)) / sd_runs)
        spread = F.size(v) * t["squares"] - t["sum"] * t["sum"]  # times n, in whole numbers
        mean = t["sum"] / n
        lagged = t["lag"] - mean * (2 * t["sum"] - F.element_at(v, 1) - F.element_at(v, -1)) + (n - 1) * mean * mean
        z_serial = F.when(spread == 0, F.lit(NO_EVIDENCE)).otherwise((MARGIN_SERIAL - F.abs(lagged * n / spread)) * F.sqrt(n))
        return F.array_max(F.transform(F.array(z_chi, z_runs, z_serial), upper_tail))

    return F.when(F.size(v) < 8, F.lit(1.0)).otherwise(bound(F.struct(cells.alias("cells"), sums.alias("sums"), squared.alias("squared")), p_value))


def token_tests(text: Column) -> Column:
    """array<struct<start,end,band,bin>>: candidate tokens with their length band and binned p-value."""
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")

    def level(token: Column) -> Column:
        p = bound(symbols(token), lambda e: battery(e["k"], e["v"]))
        return F.least(F.lit(BIN_TOP), F.floor(-100 * F.log10(F.greatest(p, F.lit(1e-30))))).cast("int")

    def banded(s: Column) -> Column:
        n = s["end"] - s["start"]
        band = sum(((n > b).cast("int") for b in BANDS[1:]), (n > BANDS[0]).cast("int"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), band.alias("band"), s["bin"].alias("bin"))

    return F.transform(match_offsets(text, CANDIDATE, "random", 3, mixed, level), banded)


def band_levels(tests: DataFrame, fdr: float) -> DataFrame:
    """One row: the least bin that Benjamini-Hochberg accepts, by band (missing: none)."""
    from pyspark.sql import Window

    bins = tests.select(F.explode("tests").alias("t")).groupBy("t.band", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("band")  # at most BIN_TOP + 1 rows a band
    strongest = w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumn("found", F.sum("n").over(strongest)).withColumn("all", F.sum("n").over(w))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 100) <= fdr * F.col("found") / F.col("all"))
    least = passed.groupBy("band").agg(F.min("bin").alias("bin"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("band", "bin"))).alias("levels"))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base (spans of the three patterns) and random (tokens found by the battery)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base_spans(F.col("text"))
    found, _ = materialize(spark, rows.select("doc_id", *(c.alias(k) for k, c in base.items()), token_tests(F.col("text")).alias("tests")), "secret-tests")
    levels = band_levels(found.where(F.size("tests") > 0), fdr).scalar()
    chosen = F.filter("tests", lambda t: t["bin"] >= F.coalesce(F.element_at(F.col("levels"), t["band"]), F.lit(BIN_TOP + 1)))
    random = F.transform(chosen, lambda t: F.struct(F.lit("random").alias("kind"), F.lit(3).alias("rank"), t["start"].alias("start"), t["end"].alias("end")))
    return found.withColumn("levels", levels).select("doc_id", "assign", "access", "hex", random.alias("random"))


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
