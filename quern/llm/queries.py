"""Registered queries of the operators for training data."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, jaccard, langid, oracles, pii, quality, secrets, token_counts, toxicity, warc
from quern.session import table

RANK_FILE = "byte_bpe_50k.tiktoken"
#: A deployment passes its own secret; this one makes the registered query repeatable.
PII_KEY = "registered-query"
COUNT_FILE = "word_bpe_49k.json"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents whose three-word shingle sets have a similarity of 0.9 or more."""
    return jaccard.components(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers over every text of ``documents``."""
    return quality.rate(table(spark, sf_dir, "documents")).drop("distance", "unit")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` with surrogates for personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, count="n_mentions")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts of ``documents`` hold a text of ``benchmark``."""
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learned from ``labels``."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every page, by text, markup, address and host, and of every document, by text and source."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    langs, logs = langid.learn(docs)
    none = F.lit(None).cast("long")
    of_docs = langid.signs_of_documents(docs).withColumn("id", F.struct(F.col("id.doc_id").alias("doc_id"), none.alias("page_id")))
    of_pages = langid.signs_of_pages(pages).withColumn("id", F.struct(none.alias("doc_id"), F.col("id.page_id").alias("page_id")))
    found = langid.identify(of_pages.unionByName(of_docs), langs, logs)
    return found.select("id.doc_id", "id.page_id", "lang", "probability")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded again."""
    return bpe.encode_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of ``documents``."""
    return token_counts.token_budget(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_FILE))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality": op2_quality,
    "op3_surrogates": op3_surrogates,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_warc": op7_warc,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_secrets": op10_secrets,
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op2_quality": oracles.quality_rules(),
    "op7_warc": warc.ORACLE_SQL,
    "op10_secrets": secrets.oracle_sql(),
}
