"""Toxicity by noisy-channel deobfuscation and a lexical model of the restored text.

* *Language model.* Counts of letter trigrams over all documents (a table of
  ``SYMBOLS`` cubed cells, summed in the shuffle) give log-probabilities.
* *Lattice.* A token with substituted characters (``1d10t``), repeated letters
  (``idiiiot``, ``iddiioott``) or separators (``i d i o t``, ``i.d.i.o.t``, ``id-iot``) becomes a
  lattice, whatever its length: every character offers the letters it may stand
  for, a repeat may be dropped, a separator may vanish, and characters may stay.
  Viterbi's algorithm finds the path of greatest language and channel
  probability. Other tokens have one path, themselves.
* *Score.* Words of the restored text and their prefixes are features of
  presence. Those whose share differs between the labels by far more than
  chance enter a logistic regression, fitted by Newton's method in numpy.

Labels are learnt from at most ``TRAIN_ROWS`` rows and the ``MOST_FEATURES`` features
that differ most; scoring reads whole texts.
Defined results: null and empty texts get the score of no evidence; without
both labels among the training rows every score is their share (0 without
rows); a labelled id with several labels has the largest; features of equal
evidence are taken in the order of their hash; each input row gets a row,
repeated rows and rows without an id as well, and equal texts equal scores;
texts and tokens may have any length; ``accepted`` keeps all columns, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm._scratch import bound_batches, materialize, release
from tarnflow.llm._training import labelled

TRAIN_ROWS = 20_000
FEATURE_BITS = 22
#: A feature enters if its two shares differ by this many standard errors, on this many rows.
LEAST_Z, LEAST_ROWS, MOST_FEATURES = 5.0, 6, 600
PREFIXES = (4, 5, 6, 7)
CACHE_WORDS = 60_000

#: Letters, any other letter, and the border of a word.
SYMBOLS = 28
#: What characters stand for in obfuscated words.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
COST_SWAP, COST_DROP, COST_KEEP, COST_JOIN = 0.7, 2.0, 8.0, 0.5
#: What a reading without doubled letters must gain on a word (and most of its letters must be doubled: worthless stays).
LEAST_GAIN = 3.0
#: Longer tokens are not remembered.
LONGEST_KNOWN = 200

_TOKEN = re.compile(r"\S+")
#: A word of letters and the marks after it: it stays as it is unless letters are doubled.
_SIMPLE = re.compile(r"""([A-Za-z]+)[.,;:?!)"']*\Z""")
#: Three or more single letters (or their stand-ins) that one separator, repeated alike, splits.
_SPACED = re.compile(r"""(?<![^\s("'\[])[A-Za-z0-9@$!|+](([ ._\-*])\2*)(?:[A-Za-z0-9@$!|+]\1)+[A-Za-z0-9@$!|+](?=[.,;:!?)"'\]]*(?!\S))""")
_REPEAT = re.compile(r"([A-Za-z])\1", re.IGNORECASE)
_STRETCH = re.compile(r"(.)\1{3,}", re.IGNORECASE)
_JOINT = re.compile(r"[^\W_][._\-*]+[^\W_]")
#: Symbols without letters and digits that may stand for a word.
_SIGNS = re.compile(r"[@$!|+(<€£¡*#]{3,}")
_TAIL = re.compile(r"[^\w@$]+$|[$#%&*!?]{2,}[.,;:]*$")
_HEAD = re.compile(r"^[^\w@$!|+(<]+")
_MIXED = re.compile(r"[A-Za-z].*[0-9@$!|+(<€£¡*#]|[0-9@$!|+(<€£¡*#].*[A-Za-z]")

#: Symbols of ASCII characters, and of all beyond.
_SYMBOL = np.full(129, 27, np.uint8)
_SYMBOL[128] = 26
for _i in range(26):
    _SYMBOL[ord("a") + _i] = _SYMBOL[ord("A") + _i] = _i


def symbols_of(text: str) -> np.ndarray:
    """One symbol a character, as the decoder counts them."""
    return _SYMBOL[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 128)].astype(np.int32)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all texts: SYMBOLS ** 3 numbers, whatever the corpus."""
    bound_batches(docs.sparkSession)
    cells = SYMBOLS**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = symbols_of(f" {text or ''} ")
                total += np.bincount(s[:-2] * (SYMBOLS * SYMBOLS) + s[1:-1] * SYMBOLS + s[2:], minlength=cells) if len(s) > 2 else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    table = docs.select(F.col("text").cast("string")).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed by the shorter contexts."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((three + 20 * p2) / (three.sum(axis=2, keepdims=True) + 20))


class Memory:
    """Values by key: at most twice CACHE_WORDS of them, of which those in use survive."""

    def __init__(self):
        self.new, self.old = {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= CACHE_WORDS:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Seen:
    """A set of at most twice CACHE_WORDS strings, of which those in use survive."""

    def __init__(self):
        self.new, self.old = set(), set()

    def unseen(self, tokens: set[str]) -> set[str]:
        rest = tokens - self.new
        again = rest & self.old
        self.add(again)
        return rest - again

    def add(self, tokens: set[str]) -> None:
        if len(self.new) >= CACHE_WORDS:
            self.old, self.new = self.new, set()
        self.new |= tokens


class Decoder:
    """Viterbi over the lattice of one token; results are remembered."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model.tolist(), Memory()

    def __call__(self, token: str) -> str:
        out = self.known.get(token)
        if out is None:
            out = self._best(_STRETCH.sub(r"\1\1\1", token.lower()))
            if len(token) <= LONGEST_KNOWN:
                self.known.put(token, out)
        return out

    def _plain(self, token: str) -> float:
        """The cost of a token of letters as it stands."""
        s = [SYMBOLS - 1] * 2 + [ord(c) - 97 if "a" <= c <= "z" else 26 for c in token] + [SYMBOLS - 1]
        return -sum(self.model[x][y][z] for x, y, z in zip(s, s[1:], s[2:]))

    def _best(self, token: str) -> str:
        lm, border = self.model, SYMBOLS - 1
        numeric = not any(c.isalpha() for c in token) and any(c.isdigit() for c in token)
        # state: the last two symbols and whether the last may be stretched -> (cost, letters)
        states: dict = {(border, border): (0.0, None)}  # letters as a linked list: linear in the token
        for i, ch in enumerate(token):
            options = []
            if "a" <= ch <= "z":
                options.append((ch, 0.0))
            else:
                options += [(c, COST_SWAP) for c in STANDS_FOR.get(ch, "")]
                if ch.isalpha():
                    options.append((ch, 0.0))
                elif ch.isdigit() or numeric:
                    options.append((ch, 0.0 if numeric else COST_KEEP))
                elif ch in "._-":
                    options.append((ch, 0.0))
            drop = COST_DROP if i and ch == token[i - 1] and ch.isalpha() else COST_JOIN if ch in "._-" else 0.0 if not ch.isalnum() and not options else None
            after: dict = {}
            for (a, b), (cost, text) in states.items():
                if drop is not None:
                    self._put(after, (a, b), cost + (0.05 if drop and token[max(0, i - 2) : i] == ch + ch else drop), text)
                for c, price in options:
                    s = ord(c) - 97 if "a" <= c <= "z" else border if numeric or c in "._-" else 26
                    self._put(after, (b, s), cost + price - lm[a][b][s], (text, c))
            states = after or states
        cost, path = min(((cost - lm[a][b][border], text) for (a, b), (cost, text) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, c = path
            out.append(c)
        if token.isalpha() and not re.search(r"(.)\1\1", token) and (2 * (len(token) - len(out)) <= len(out) or self._plain(token) - cost < LEAST_GAIN):
            return token
        return "".join(reversed(out))

    @staticmethod
    def _put(states: dict, key: tuple, cost: float, text: str) -> None:
        old = states.get(key)
        if old is None or cost < old[0]:
            states[key] = (cost, text)


class Restorer:
    """Words of a text after deobfuscation; ``text`` joins them again."""

    def __init__(self, model: np.ndarray):
        self.decode, self.known = Decoder(model), Memory()

    def word(self, token: str) -> str:
        simple = _SIMPLE.match(token)
        if simple:
            core = simple[1]
            return self.decode(core) if _REPEAT.search(core) else core.lower()
        signs = token.strip(".,;:?\"'")
        if _SIGNS.fullmatch(signs) and len(set(signs)) > 1:
            return self.decode(signs)
        core = _HEAD.sub("", _TAIL.sub("", token))
        if not core:
            return ""
        if "://" in core or "@" in core and "." in core.rpartition("@")[2]:  # addresses are no words
            return core.lower()
        if any(c.isalpha() for c in core):
            if _MIXED.search(core) or _REPEAT.search(core) or _JOINT.search(core):
                return self.decode(core)
        elif any(c.isdigit() for c in core):  # a number, unless letters are likelier
            word = self.decode(core)
            return word if word.isalpha() else core.lower()
        return core.lower()

    def _spaced(self, text: str) -> str:
        if not _SPACED.search(text):
            return text
        return _SPACED.sub(lambda m: self.decode(m[0].replace(m[1], "")), text)

    def tokens(self, text: str | None) -> set[str]:
        """The distinct tokens, their ASCII letters in lower case, which no word depends on."""
        return set(self._spaced((text or "").encode().lower().decode()).split())

    def words(self, text: str | None) -> set[str]:
        """The distinct restored words."""
        known, out = self.known, set()
        for token in self.tokens(text):
            w = known.get(token)
            if w is None:
                w = self.word(token)
                known.put(token, w)
            out.add(w)
        out.discard("")
        return out

    def text(self, text: str | None) -> str:
        return _TOKEN.sub(lambda m: self.word(m[0]) or m[0], self._spaced(text or ""))


def features(word: str) -> list[int]:
    """Hashes of a word and of its prefixes."""
    import xxhash

    forms = ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(f) >> (64 - FEATURE_BITS) for f in forms]


def fit(presence: list[np.ndarray], labels: np.ndarray, n: int, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on presence features."""
    w = np.zeros(n + 1)
    penalty = np.full(n + 1, ridge)
    penalty[n] = 1e-6

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(labels), 1000):
            part = presence[i : i + 1000]
            x = np.zeros((len(part), n + 1))
            x[:, n] = 1
            for row, at in zip(x, part, strict=True):
                row[at] = 1
            yield x, labels[i : i + 1000]

    for _ in range(25):
        gradient, curvature = -penalty * w, np.diag(penalty)
        for x, y in blocks():
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient += x.T @ (y - p)
            curvature += (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(curvature, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:n], float(w[n])


class Model:
    """Everything that scoring needs: the language model and the weights by feature."""

    def __init__(self, lm: np.ndarray, weights: dict[int, float], intercept: float):
        self.lm, self.weights, self.intercept = lm, weights, intercept


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", modulus: int = 3, remainder: int = 1, most: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows of ``docs`` outside the held-out fold."""
    spark = docs.sparkSession
    bound_batches(spark)
    lm = log_model(trigram_counts(docs))
    shared = spark.sparkContext.broadcast(lm)  # SYMBOLS ** 3 numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            found = [np.unique(np.array([f for w in restore.words(t) for f in features(w)], np.int32)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["label", "found"])

    rows, path = materialize(spark, labelled(docs, labels, target, modulus, remainder, most).select("text", "label").mapInArrow(extract, "label int, found array<int>"), "toxicity-rows")
    n0, n1 = rows.agg(F.coalesce(F.sum(1 - F.col("label")), F.lit(0)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n0 or not n1:
        release(spark, path)
        share = np.clip(n1 / max(1, n0 + n1), 1e-6, 1 - 1e-6)
        return Model(lm, {}, float(np.log(share / (1 - share))))
    counts = rows.select("label", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("label").alias("k1"), F.sum(1 - F.col("label")).alias("k0"))
    both = (F.col("k1") + F.col("k0")) / (n0 + n1)
    z = (F.col("k1") / n1 - F.col("k0") / n0) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    chosen = counts.where(F.col("k1") + F.col("k0") >= LEAST_ROWS).withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "feature").limit(MOST_FEATURES)
    names = {r.feature: i for i, r in enumerate(chosen.select("feature").collect())}
    keep = F.array(*(F.lit(int(f)) for f in names)) if names else F.lit(None).cast("array<int>")
    table = rows.select("label", F.array_intersect("found", keep).alias("found")).toArrow()
    release(spark, path)
    presence = [np.array([names[f] for f in row or []], int) for row in table.column("found").to_pylist()]
    w, b = fit(presence, table.column("label").to_numpy().astype(float), len(names))
    return Model(lm, {f: float(w[i]) for f, i in names.items()}, b)


class Scorer:
    """Scores texts; tokens without any feature of the model, which are nearly all, are remembered as a set."""

    def __init__(self, model: Model):
        self.model, self.restore, self.known, self.blank = model, Restorer(model.lm), Memory(), Seen()

    def __call__(self, text: str | None) -> float:
        known, weights, found, blank = self.known, self.model.weights, set(), set()
        for token in self.blank.unseen(self.restore.tokens(text)):
            hits = known.get(token)
            if hits is None:
                word = self.restore.word(token)
                hits = tuple(f for f in features(word) if f in weights) if word else ()
                if hits:
                    known.put(token, hits)
                else:
                    blank.add(token)
            found.update(hits)
        self.blank.add(blank)
        z = self.model.intercept + sum(weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most MOST_FEATURES weights and the trigram table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([scorer(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())], [*batch.schema.names[:-1], "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("score"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def accepted(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            clean = [scorer(t) < threshold for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
