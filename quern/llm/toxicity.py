"""Toxicity scores from a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding: compatibility forms (full-width, mathematical) become plain letters, marks and invisible format characters go, lower case,
look-alike letters of other scripts and digits and signs that stand for letters become Latin letters, everything
else that isn't a letter becomes a space. The lexicon's entries are whole words and word beginnings; their weights are
log-odds from labelled texts. Within a word the heaviest entry counts, unless an exception phrase covers it: two words, one of which has an
entry, that the labelled texts show to be harmless together. The sum is
normalised by the logarithm of the text's words and mapped to 0 to 1 by a logistic curve fitted to the same labels.

Learning uses at most ``PER_LABEL`` labelled texts of each label, chosen by a hash of the key; scoring reads every text whole.

Defined cases: null and empty texts score as texts without any entry; without labels of both kinds every score is the share
of toxic labels (0 if there are none); several labels of one key count as the largest; rows with a null key are scored, never
learned from; other columns aren't read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled texts of each label that the lexicon is learned from.
PER_LABEL = 4_000
#: Least support in toxic texts, and least lower bound of the log-odds: an entry is twenty times as likely in a toxic text.
LEAST_TEXTS, LEAST_ODDS = 4, 3.0
#: Highest log-odds of an exception phrase.
SAFE_ODDS = -0.5
#: Lengths of word beginnings that may be entries.
BEGINNINGS = range(3, 9)

# Look-alike letters by the Latin letter that they look like, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "a": "аɑαⲁ", "b": "ьвƅβ", "c": "сϲⅽ", "d": "ԁɗժ", "e": "еєεҽ", "f": "ƒք", "g": "ɡցġ", "h": "һнհ", "i": "іıιɩӏ", "j": "јϳյ", "k": "кκ",
    "l": "ⅼɫ", "m": "мⅿ", "n": "пηոո", "o": "оοσօ", "p": "рρϱ", "q": "ԛգզ", "r": "гɾᴦ", "s": "ѕꜱʂ", "t": "тτƭ", "u": "υʋսц", "v": "ѵνᴠ", "w": "ԝωա",
    "x": "хχ", "y": "уүγʏ", "z": "ᴢʐ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = {"@": "a", "$": "s"}

_SIGNS = re.compile(r"(?<=[^\W\d_])[@$]+|[@$]+(?=[^\W\d_])")


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: " " for c in range(0x3100) if not chr(c).isalpha()}
    table |= {c: None for c in (*range(0x3100), 0xFEFF, *range(0xFE00, 0xFE10)) if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf")}
    table |= {ord(c): a for a, alike in HOMOGLYPHS.items() for c in alike}
    table |= {ord(a): b for a, b in DIGITS.items()}
    return table


def fold(text: str) -> str:
    """Folded words between single or more spaces, with a space at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    return f" {text.lower().translate(_table())} "


def entries_of(folded: str) -> set[str]:
    found = set()
    for w in set(folded.split()):
        found.add(f" {w} ")
        for k in BEGINNINGS:
            if len(w) > k:
                found.add(" " + w[:k])
    return found


class Scorer:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, w in weights.items():
            self.automaton.add_word(entry, (len(entry), w))
        self.safe = [f" {x} " for x in exceptions]
        for phrase in self.safe:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[float, int]:
        """Normalised weight and number of matched words."""
        if not len(self.automaton):  # nothing was learned
            return 0.0, 0
        folded = fold(text)
        best: dict[int, float] = {}
        safe = []
        for end, (size, w) in self.automaton.iter(folded):
            start = end - size + 1
            if w is None:
                safe.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if not best:
            return 0.0, 0
        kept = [w for s, w in best.items() if not any(a <= s < b for a, b in safe)]
        words = folded.count(" ")
        return sum(kept) / math.log(8 + words), len(kept)


@lru_cache(maxsize=2)
def _scorer(weights: tuple, exceptions: tuple) -> Scorer:
    return Scorer(dict(weights), exceptions)


def held_out(key: str) -> F.Column:
    """Rows that nothing is learned from: CRC-32 of the key as text divisible by five."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """``text, toxic`` of the labelled texts to learn from, at most about ``PER_LABEL`` of each label."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    known = known.filter(~held_out("key"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) / 1_000_000
    most = F.when(F.col("toxic") == 1, PER_LABEL / max(1, sizes.get(1, 0))).otherwise(PER_LABEL / max(1, sizes.get(0, 0)))
    chosen = F.broadcast(known.filter(share < most))  # 2 * PER_LABEL rows, give or take the hash
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(chosen, "key").select("text", "toxic")


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], dict[int, int]]:
    """Weights of the entries, and texts by label."""

    def count(batches):
        of: dict[int, Counter] = {0: Counter(), 1: Counter()}
        texts = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                texts[toxic] += 1
                of[toxic].update(entries_of(fold(text or "")))
                if len(of[0]) + len(of[1]) > 1_000_000:
                    yield _counted(of)
                    of = {0: Counter(), 1: Counter()}
        yield _counted(of)
        yield pa.RecordBatch.from_pydict({"entry": ["", ""], "toxic": [0, 1], "n": [texts[0], texts[1]]}, schema=_COUNTS)

    counts = train.mapInArrow(count, "entry string, toxic int, n long")
    by_entry = counts.groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n")
    )
    supported = by_entry.filter((F.col("entry") == "") | (F.col("t") >= LEAST_TEXTS)).cache()
    sizes = supported.filter(F.col("entry") == "").collect()
    texts = {1: sizes[0].t, 0: sizes[0].n} if sizes else {0: 0, 1: 0}
    if not texts[0] or not texts[1]:
        return {}, texts
    odds = F.log((F.col("t") + 0.5) / (texts[1] + 1)) - F.log((F.col("n") + 0.5) / (texts[0] + 1))
    rated = supported.filter(F.col("entry") != "").withColumn("w", odds).withColumn("low", F.col("w") - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") + 0.5)))
    best = rated.filter(F.col("low") >= LEAST_ODDS).collect()  # of the chosen texts, so bounded by PER_LABEL
    supported.unpersist()
    return {r.entry: round(r.w, 4) for r in best}, texts


def learn_exceptions(train: DataFrame, weights: dict[str, float], texts: dict[int, int]) -> tuple[str, ...]:
    """Two words, one of which has an entry, that hold in texts that aren't toxic and hardly in others."""

    def count(batches):
        of: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = fold(text or "").split()
                listed = [f" {w} " in weights or any(" " + w[:k] in weights for k in BEGINNINGS) for w in words]
                of[toxic].update({f"{a} {b}" for a, b, x, y in zip(words, words[1:], listed, listed[1:]) if x or y})
        yield _counted(of)

    counts = train.mapInArrow(count, "entry string, toxic int, n long")
    each = counts.groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n")
    )
    odds = F.log((F.col("t") + 0.5) / (texts[1] + 1)) - F.log((F.col("n") + 0.5) / (texts[0] + 1))
    return tuple(sorted(r.entry for r in each.filter((F.col("n") >= LEAST_TEXTS) & (odds <= SAFE_ODDS)).collect()))


_COUNTS = pa.schema([("entry", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])


def _counted(of: dict[int, Counter]) -> pa.RecordBatch:
    rows = [(e, k, n) for k, c in of.items() for e, n in c.items()]
    entry, toxic, n = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), pa.array(toxic, pa.int32()), pa.array(n, pa.int64())], schema=_COUNTS)


def weigh(docs: DataFrame, weights: dict[str, float], text: str = "text", exceptions: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``weight`` (normalised) and ``n_hits``."""
    fixed = tuple(sorted(weights.items()))
    kind = T.StructType([T.StructField("weight", T.DoubleType()), T.StructField("n_hits", T.LongType())])

    @F.arrow_udf(kind)
    def rate(texts: pa.Array) -> pa.Array:
        score = _scorer(fixed, exceptions)
        found = [score(x.as_py() or "") for x in texts]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.int64())], ["weight", "n_hits"])

    made = docs.withColumn("_rate", rate.asNondeterministic()(F.col(text).cast("string")))
    return made.withColumns({"weight": F.col("_rate.weight"), "n_hits": F.col("_rate.n_hits")}).drop("_rate")


def fit_curve(counts: list[tuple[float, int, float]], steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (weight, label, count), with a weak prior on both."""
    x, y, n = (np.array(v, dtype=float) for v in zip(*counts))
    b = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (n * (y - p)) - 0.01 * b
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        b = b + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(b[0]), float(b[1])


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: key, ``held_out``, ``score``, ``predicted`` and ``n_hits``."""
    train = training(docs, labels, key, text, label).cache()
    weights, texts = learn_lexicon(train)
    safe = learn_exceptions(train, weights, texts) if weights else ()
    if weights:
        binned = weigh(train, weights, exceptions=safe).groupBy(F.round("weight", 2).alias("x"), "toxic").agg(F.count("*").alias("n"))
        # the sample is balanced by label, the curve need not be: its threshold is where the labels are as likely in it
        slope, base = fit_curve([(r.x, r.toxic, float(r.n)) for r in binned.collect()])
    else:
        share = texts[1] / max(1, texts[0] + texts[1])
        slope, base = 0.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    train.unpersist()
    slim = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    rated = weigh(slim, weights, "_text", safe)
    value = 1 / (1 + F.exp(-(F.col("weight") * slope + base)))
    return rated.select(key, held_out(key).alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), "n_hits")
