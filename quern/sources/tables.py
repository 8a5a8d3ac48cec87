"""Tables as facts: predicates over typed columns, and triples of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import table

#: Key columns of the tables; a subject is made of the table's name and these. Line items have no key: all columns tell them apart.
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
}


def subject(name: str, columns: list[str]) -> F.Column:
    """``table/key`` as text."""
    keys = KEYS.get(name)
    if keys is None:
        return F.concat(F.lit(f"{name}/"), F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"), 256))
    return F.concat(F.lit(f"{name}/"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))


def relation(spark: SparkSession, sf_dir: str, name: str, /, *columns: str, **renamed: str) -> DataFrame:
    """A predicate's rows: columns of a table, with variables for names where given (``variable=column``). Only these are read."""
    df = table(spark, sf_dir, name)
    return df.select(*columns, *[F.col(c).alias(v) for v, c in renamed.items()])


def triples(spark: SparkSession, sf_dir: str, name: str, predicates: list[str] | None = None) -> DataFrame:
    """``s, p, o`` rows of a table: a subject for each row, a predicate for each column. One pass over the table."""
    df = table(spark, sf_dir, name)
    chosen = predicates or [c for c in df.columns if c not in KEYS.get(name, [])]
    pairs = F.array(*[F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in chosen])
    return df.select(subject(name, df.columns).alias("s"), F.explode(pairs).alias("x")).select("s", "x.p", "x.o").filter("o is not null")
