"""Quality rules on whole texts: base rules on counted statistics, then robust multivariate outliers.

The statistics of every text are transformed to a short vector. For each language and source the minimum
covariance determinant (MCD) estimate of centre and scatter is found by concentration steps from several starts, of whose
results the one of least determinant is taken, and a text is
rejected when the Mahalanobis distance of its vector is beyond ``CUT``. DataFrame functions only.

Defined cases: a null text counts as empty, has no words and fails the base rules; a null language or source is a
group of its own; repeated rows count as often as they occur; groups with fewer than ``MIN_GROUP`` texts take the
estimate of their language, languages with fewer take that of all texts, and with fewer texts than that in all
nobody is an outlier; of starts with equal determinants the first counts, and a distance equal to the cut is kept; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import settle

# Fixed values of the contract: ASCII white space and the symbols that count.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also for use inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words between ASCII white space."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def repeated_words(words: Column, hash_of=F.xxhash64) -> Column:
    """Words that lie in a three-word window found twice or more.

    Each window is a long: the upper bits of its hash and, in as few lower bits as the text needs, its place. After
    sorting, equal windows are neighbours. Where neighbours of one hash differ in their words, the windows themselves are sorted instead.
    """
    windows = F.size(words) - 2
    place_bits = F.length(F.bin(windows))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), place_bits) - F.lit(1)

    def covered(places: Column) -> Column:
        """Words under windows at sorted places."""
        start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places,
            start,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def exact() -> Column:
        whole = F.array_sort(F.transform(F.sequence(F.lit(0), windows - 1), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, 3)).alias("w"), i.cast("long").alias("at"))))

        def found(x: Column) -> Column:
            same = lambda a, j: F.coalesce(F.get(x, j)["w"] == a["w"], F.lit(False))
            return covered(F.array_sort(F.transform(F.filter(x, lambda a, j: same(a, j - 1) | same(a, j + 1)), lambda a: a["at"])))

        return let(whole, found)

    def count(packed: Column, mask: Column) -> Column:
        same = lambda x, j: F.coalesce((F.get(packed, j).bitwiseAND(F.bitwise_not(mask))) == x.bitwiseAND(F.bitwise_not(mask)), F.lit(False))
        at = lambda x: F.slice(words, (x.bitwiseAND(mask) + 1).cast("int"), 3)
        repeated = let(
            F.filter(packed, lambda x, j: same(x, j - 1) | same(x, j + 1)),
            lambda r: F.when(F.size(r) == 0, F.lit(0).cast("long")).when(_mixed(r, mask, at), exact()).otherwise(covered(F.array_sort(F.transform(r, lambda x: x.bitwiseAND(mask))))),
        )
        return repeated

    def _mixed(r: Column, mask: Column, at) -> Column:
        """Whether two neighbours of one hash are different windows."""
        upper = F.bitwise_not(mask)
        return F.size(F.filter(r, lambda x, j: (j > 0) & (F.get(r, j - 1).bitwiseAND(upper) == x.bitwiseAND(upper)) & (at(F.get(r, j - 1)) != at(x)))) > 0

    def pack(mask: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), windows - 1),
                lambda i: hash_of(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
                .bitwiseAND(F.bitwise_not(mask))
                .bitwiseOR(i.cast("long")),
            )
        )

    many = let(mask, lambda m: let(pack(m), lambda packed: count(packed, m)))
    return F.when(windows < 2, F.lit(0).cast("long")).otherwise(many)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` and ``base_failed``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    found = docs.withColumn("_w", let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))))
    found = found.withColumn("_l", let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))))
    out = found.withColumns(
        {
            "n_words": F.col("_w.n"),
            "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_lines": F.col("_l.n"),
            "n_dup_lines": F.col("_l.n") - F.col("_l.d"),
            "n_repeat_words": F.col("_w.r"),
        }
    ).drop("_w", "_l")
    return out.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


# The transformed vector: log mean word length, and square roots of three shares; the last two are counted against some lines or words more, as
# one repetition in a short text says little.
VECTOR = {
    "x1": "ln(word_chars / cast(greatest(n_words, 1) as double) + 0.1)",
    "x2": "sqrt(n_symbols / cast(greatest(n_words, 1) as double))",
    "x3": "sqrt(n_dup_lines / cast(n_lines + 2 as double))",
    "x4": "sqrt(n_repeat_words / cast(n_words + 50 as double))",
}
#: Standard deviations added to the scatter, so that coordinates that hardly vary don't reject honest texts.
#: The last two are shares of few lines or of few passages, so wider; each coordinate can still pass the cut alone.
FLOORS = (0.06, 0.06, 0.12, 0.10)
#: Share of the texts in the subset of least determinant, and the factor that makes its scatter consistent in four dimensions.
SHARE = 0.75
CONSISTENCY = 1.486
STEPS = 5
#: Starts of the concentration: medians with the floors alone, moments of all texts, spatial signs around the medians.
STARTS = 3
#: Squared Mahalanobis distance that chi-squared with four degrees of freedom exceeds once in ten million.
CUT = 38.2
#: Sources with fewer texts are pooled with the other small ones of their language, small pools over all languages.
MIN_GROUP = 50

_N = len(VECTOR)
_PAIRS = [(i, j) for i in range(1, _N + 1) for j in range(1, i + 1)]
MOMENTS = [f"avg(x{i}) as m{i}" for i in range(1, _N + 1)] + [f"covar_pop(x{i}, x{j}) as s{i}{j}" for i, j in _PAIRS]


def _cholesky() -> list[str]:
    """Lower triangle of the regularised scatter, one column after the other."""
    out = []
    for j in range(1, _N + 1):
        for i in range(j, _N + 1):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            entry = f"{CONSISTENCY} * coalesce(s{i}{j}, 0)" + (f" + {FLOORS[i - 1] ** 2:.6f}" if i == j else "")
            out.append(f"sqrt({entry}{inner}) as l{i}{j}" if i == j else f"({entry}{inner}) / l{j}{j} as l{i}{j}")
    return out


def _distance() -> list[str]:
    """Squared Mahalanobis distance by forward substitution."""
    out = []
    for i in range(1, _N + 1):
        inner = "".join(f" - l{i}{k} * y{k}" for k in range(1, i))
        out.append(f"(x{i} - m{i}{inner}) / l{i}{i} as y{i}")
    return [*out, " + ".join(f"y{i} * y{i}" for i in range(1, _N + 1)) + " as d2"]


CHOLESKY, DISTANCE = _cholesky(), _distance()
BIN = "cast(floor(16 * ln(d2 + 0.000001)) as int)"
#: Of the scatter; what the concentration makes least.
DETERMINANT = " * ".join(f"l{i}{i} * l{i}{i}" for i in range(1, _N + 1))
#: A text's direction from the medians in units of the floors, as far out as the floors times two.
NORM = "sqrt(" + " + ".join(f"power((x{i} - m{i}) / {FLOORS[i - 1]}, 2)" for i in range(1, _N + 1)) + ")"
SIGNS = [f"coalesce((x{i} - m{i}) * 2 / nullif(norm, 0), 0) as z{i}" for i in range(1, _N + 1)]
SIGN_MOMENTS = [f"avg(m{i}) as m{i}" for i in range(1, _N + 1)] + [f"avg(z{i} * z{j}) as s{i}{j}" for i, j in _PAIRS]
FLAT = [f"cast({FLOORS[i - 1] if i == j else 0} as double) as l{i}{j}" for i, j in _PAIRS]


def _units(rows: DataFrame) -> DataFrame:
    """Rows of ``_lang, _source, unit``: the language and source itself, or the pool that a small one joins."""
    sizes = rows.filter("not base_failed").groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    small = sizes.filter(F.col("_n") < MIN_GROUP).groupBy(F.col("_lang").alias("_pool")).agg(F.sum("_n").alias("_pooled"))
    joined = sizes.join(small, F.col("_lang").eqNullSafe(F.col("_pool")), "left")
    return joined.select(
        "_lang",
        "_source",
        F.when(F.col("_n") >= MIN_GROUP, F.to_json(F.struct("_lang", "_source")))
        .when(F.col("_pooled") >= MIN_GROUP, F.to_json(F.struct("_lang")))
        .otherwise(F.lit("pool"))
        .alias("unit"),
    )


def _starts(rows: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of each ``unit`` and ``start``."""
    factors = [x.rpartition(" ")[2] for x in CHOLESKY]
    columns = ["unit", "start", *[f"m{i}" for i in range(1, _N + 1)], *factors]
    medians = settle(rows.groupBy("unit").agg(*[F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"m{i}") for i in range(1, _N + 1)]), "medians")
    flat = medians.selectExpr("*", "0 as start", *FLAT)
    plain = rows.groupBy("unit").agg(*map(F.expr, MOMENTS)).selectExpr("*", "1 as start").selectExpr("*", *CHOLESKY)
    signs = rows.join(medians, "unit").selectExpr("*", f"{NORM} as norm").selectExpr("*", *SIGNS)
    signs = signs.groupBy("unit").agg(*map(F.expr, SIGN_MOMENTS)).selectExpr("*", "2 as start").selectExpr("*", *CHOLESKY)
    return settle(flat.select(columns).unionByName(plain.select(columns)).unionByName(signs.select(columns)), "mcd")


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """New estimates, from the ``SHARE`` of each unit's rows that lie nearest by the old ones, to the next bin of the distances' histogram."""
    binned = rows.join(estimate, "unit").selectExpr("*", *DISTANCE).selectExpr("unit", "start", *VECTOR, f"{BIN} as bin")
    counts = binned.groupBy("unit", "start", "bin").agg(F.count("*").alias("n"))
    within = Window.partitionBy("unit", "start")
    running = counts.withColumns({"upto": F.sum("n").over(within.orderBy("bin")), "all": F.sum("n").over(within)})
    last = running.filter(F.col("upto") >= SHARE * F.col("all")).groupBy("unit", "start").agg(F.min("bin").alias("last"))
    near = binned.join(last, ["unit", "start"]).filter("bin <= last")
    return settle(near.groupBy("unit", "start").agg(*map(F.expr, MOMENTS)).selectExpr("*", *CHOLESKY), "mcd")


def rate(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row of ``docs``: its key, its statistics, ``base_failed``, ``distance`` and ``kept``."""
    return _rated(docs, key, text, lang, source).drop("_row")


def _row_hash(text: str, lang: str, source: str) -> Column:
    """Hash of what a verdict hangs on besides the key; a null differs from an empty string."""
    return F.xxhash64(*[x for c in (text, lang, source) for x in (F.col(c).isNull(), F.col(c).cast("string"))])


def _rated(docs: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """``rate`` with the ``_row_hash`` of each row."""
    slim = docs.select(F.col(key), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"), _row_hash(text, lang, source).alias("_row"))
    vector = [f"{v} as {k}" for k, v in VECTOR.items()]
    counted = settle(statistics(slim, "_text").drop("_text").selectExpr("*", *vector), "quality")
    units = settle(_units(counted), "units")
    rows = counted.join(units.withColumnsRenamed({"_lang": "_l", "_source": "_s"}), F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    good = rows.filter("not base_failed").select("unit", *VECTOR)
    estimate = _starts(good)
    for _ in range(STEPS):
        estimate = _concentrated(good, estimate)
    # of each unit's estimates the one of least determinant
    best = estimate.withColumn("det", F.expr(DETERMINANT)).groupBy("unit").agg(F.min_by(F.struct(*[c for c in estimate.columns if c != "unit"]), F.struct("det", "start")).alias("e")).select("unit", "e.*")
    estimate = settle(best, "mcd")
    far = rows.join(estimate, "unit", "left").selectExpr("*", *DISTANCE)
    kept = F.expr(f"not base_failed and d2 <= {CUT}")
    return far.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, ~F.col("base_failed")).alias("kept"), F.col("d2").alias("distance"), "unit", "_row")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep. Rows that agree in key, text, language and source are judged alike."""
    verdicts = _rated(docs, key, text, lang, source).groupBy(F.col(key).alias("__quern_key"), F.col("_row").alias("__quern_row")).agg(F.bool_and("kept").alias("__quern_kept"))
    same = F.col(key).eqNullSafe(F.col("__quern_key")) & (_row_hash(text, lang, source) == F.col("__quern_row"))
    return docs.join(verdicts.filter("__quern_kept"), same, "left_semi")
