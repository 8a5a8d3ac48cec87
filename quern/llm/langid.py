"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in log space: the likelihood of the text under byte-trigram models; the language that the markup declares
and the address suffix, each with probabilities counted over the corpus; and a prior for the host, smoothed by its domain,
which is smoothed by the whole corpus. Counts are sums of text-only posteriors, made by grouped aggregation and without
the row's own share. Evidence that a row lacks is left out.

The text models learn from at most ``PER_LANGUAGE`` labelled texts of each language, chosen by a hash of the text; everything
else covers all rows. Hosts with a third of all rows are sums like others; the join that brings them back is left to Spark's
skew handling.

Defined cases: null and empty texts have an even likelihood and are judged by the other evidence, if any; null or malformed
addresses and undeclared languages are missing evidence; without labels there are no languages and the result's language is
null; repeated rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import settle

#: Labelled texts of a language that its model is learned from.
PER_LANGUAGE = 1_500
#: Hash buckets of byte trigrams.
BUCKETS = 1 << 15
#: Trigrams from which on the evidence of a text stops to grow, as neighbouring trigrams aren't independent.
FULL_EVIDENCE = 60
#: Rows' worth of the broader prior in a narrower one.
STRENGTH = 5.0

_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def _trigrams(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, dtype=np.uint32)
    mixed = raw[:-2] * np.uint32(0x01000193) + raw[1:-1] * np.uint32(0x9E3779B1) + raw[2:] * np.uint32(0x85EBCA6B)
    return (mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log probabilities of the buckets in each."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and length(text) > 0")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    most = F.create_map(*[x for lg in langs for x in (F.lit(lg), F.lit(PER_LANGUAGE / sizes[lg]))])
    chosen = rows.filter(share < most[F.col("lang")])

    def count(batches):
        at = {lg: i for i, lg in enumerate(langs)}
        for batch in batches:
            grams = {}
            for t, lg in zip(batch.column("text"), batch.column("lang").to_pylist()):
                grams.setdefault(at[lg], []).append(_trigrams(t.as_py()))
            for i, each in grams.items():
                j, n = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, dtype=np.int32)), pa.array(j.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])

    counts = np.full((len(langs), BUCKETS), 0.5, dtype=np.float32)
    summed = chosen.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toArrow()  # BUCKETS rows a language at most
    counts[got["lang"].to_numpy(), got["bucket"].to_numpy()] += got["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32)


def text_evidence(text: Column, logs: np.ndarray) -> Column:
    """Log likelihoods of a text by language, each less the largest; markup is left out. Even for texts without trigrams."""

    @F.arrow_udf("array<double>")
    def rate(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            t = t.as_py() or ""
            grams = _trigrams(_MARKUP.sub(" ", t) if "<" in t else t)
            if len(grams) <= 2:
                out.append([0.0] * len(logs))
                continue
            total = logs @ np.bincount(grams, minlength=BUCKETS).astype(np.float32) if len(grams) > BUCKETS else logs[:, grams].sum(axis=1)
            total = total.astype(np.float64) * min(1.0, FULL_EVIDENCE / len(grams))
            out.append((total - total.max()).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return rate.asNondeterministic()(text)


def _normalised(logs: Column) -> Column:
    """Probabilities of an array of logs."""
    top = F.array_max(logs)
    return F.transform(F.array(F.transform(logs, lambda x: F.exp(x - top))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def _sums(n: int) -> list[Column]:
    return [F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias("sums")]


def _less_own(sums: Column, own: Column) -> Column:
    """Sums of the other rows; no row is in its own evidence."""
    return F.zip_with(sums, own, lambda s, p: F.greatest(s - p, F.lit(0.0)))


def _smoothed(sums: Column, broader: Column) -> Column:
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(sums, broader, lambda s, b: (s + STRENGTH * b) / (total + STRENGTH))


def identify(rows: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """``rows`` of ``id`` (any columns in a struct), ``body``, ``declared``, ``suffix``, ``domain``, ``host`` with ``lang`` and ``probability``."""
    n = len(langs)
    if not n:
        return rows.select("id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    read = rows.select("id", "declared", "suffix", "domain", "host", text_evidence(F.col("body"), logs).alias("text_logs"))
    base = settle(read.withColumn("p", _normalised(F.col("text_logs"))), "evidence")
    sums = base.agg(*_sums(n)).first().sums  # one number a language
    sums = [x or 0.0 for x in sums]
    whole = F.array(*[F.lit((x + STRENGTH / n) / (sum(sums) + STRENGTH)) for x in sums])
    out = base
    names = {}
    for level in ("domain", "host", "declared", "suffix"):
        sums = base.filter(F.col(level).isNotNull()).groupBy(level).agg(*_sums(n)).withColumnsRenamed({level: f"_{level}", "sums": f"{level}_sums"})
        out = out.join(sums, F.col(level) == F.col(f"_{level}"), "left").drop(f"_{level}")
        names[level] = F.when(F.col(f"{level}_sums").isNotNull(), _less_own(F.col(f"{level}_sums"), F.col("p")))
    out = out.select("id", "text_logs", whole.alias("whole"), *[x.alias(level) for level, x in names.items()])
    domain = F.coalesce(_smoothed(F.col("domain"), F.col("whole")), F.col("whole"))
    out = out.withColumn("domain_prior", domain)
    out = out.withColumn("prior", F.coalesce(_smoothed(F.col("host"), F.col("domain_prior")), F.col("domain_prior")))
    # p(language | sign) / p(language) is p(sign | language) but for a factor that all languages share
    sign = lambda level: F.coalesce(F.zip_with(_smoothed(F.col(level), F.col("whole")), F.col("whole"), lambda a, b: F.log(a / b)), F.array(*[F.lit(0.0)] * n))
    out = out.select("id", "text_logs", F.transform("prior", lambda x: F.log(x)).alias("prior"), sign("declared").alias("declared"), sign("suffix").alias("suffix"))
    total = F.col("text_logs")
    for c in ("prior", "declared", "suffix"):
        total = F.zip_with(total, F.col(c), lambda a, b: a + b)
    out = out.withColumn("p", _normalised(total))
    best = F.array_max("p")
    lang = F.element_at(F.array(*map(F.lit, langs)), F.array_position("p", best).cast("int"))
    return out.select("id", lang.alias("lang"), best.alias("probability"))


def signs_of_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows for ``identify`` of web pages."""
    body, address = F.col(html).cast("string"), F.col(url).cast("string")
    declared = F.lower(F.regexp_extract(body, r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-z]{2,3})\b""", 1))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(
        F.struct(F.col(key).alias(key)).alias("id"),
        body.alias("body"),
        F.when(declared != "", declared).alias("declared"),
        F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("suffix"),
        F.when(host != "", F.substring_index(host, ".", -2)).alias("domain"),
        F.when(host != "", host).alias("host"),
    )


def signs_of_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows for ``identify`` of plain texts; the source stands for the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.struct(F.col(key).alias(key)).alias("id"), F.col(text).cast("string").alias("body"), none.alias("declared"), none.alias("suffix"), none.alias("domain"), F.col(source).cast("string").alias("host"))
