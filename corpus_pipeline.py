"""A corpus pipeline of five stages; each is a function of (spark, docs, sf_dir).

quality: documents that the quality rules reject go. near_duplicates: of every group of linked documents (five-word shingles, similarity
0.8 or more) the one with the smallest doc_id stays. decontaminate: documents that hold a benchmark item go. pii:
personal data in the texts is replaced. bpe: the texts are encoded, and decoded again as a check.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, jaccard, pii, quality
from quern.llm.queries import PII_KEY, RANK_FILE
from quern.session import settle, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs, width=5, num=8, den=10)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" not in changed.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token ids and their digests."""
    return bpe.encode_digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: The stages hold robust estimates, window joins and BPE merges, which SQL can't express; each is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs, name)
    return docs
