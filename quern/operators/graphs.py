"""Named graphs: set operations on ``s, p, o, g`` facts, retraction and state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLE = ["s", "p", "o"]


def graph(facts: DataFrame, name: str | None) -> DataFrame:
    """Triples of a named graph, or of the default one."""
    return facts.filter(F.col("g").isNull() if name is None else F.col("g") == name).select(*TRIPLE)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*TRIPLE).unionByName(b.select(*TRIPLE)).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*TRIPLE).intersect(b.select(*TRIPLE))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*TRIPLE).subtract(b.select(*TRIPLE))


def sizes(facts: DataFrame) -> DataFrame:
    """Triples of every graph."""
    return facts.distinct().groupBy("g").agg(F.count("*").alias("n_triples"))


def retract(facts: DataFrame, gone: DataFrame) -> DataFrame:
    return facts.join(gone.select(*TRIPLE).distinct(), TRIPLE, "left_anti")


def becomes(facts: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The next state: what is old is retracted, then what is new asserted."""
    return union(retract(facts.select(*TRIPLE), old), new)
