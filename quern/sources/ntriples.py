"""N-Triples and N-Quads, a line a fact: splittable sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TERM = r'<[^>]*>|_:[^\s]+|"(?:[^"\\]++|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?'
_LINE = rf"^\s*({_TERM})\s+(<[^>]*>)\s+({_TERM})\s*({_TERM})?\s*\.\s*(?:#.*)?$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o, g`` in N-Triples syntax; ``g`` is null for triples. Comments and blank lines give no rows, malformed lines are in ``rejects``."""
    lines = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", _LINE, i)
    found = lines.filter(F.col("value").rlike(_LINE))
    return found.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), F.when(part(4) != "", part(4)).alias("g"))


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither facts nor comments nor blank."""
    return spark.read.text(path).filter(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(?:#.*)?$"))


def iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def literal(text: Column, datatype: str | None = None) -> Column:
    escaped = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    end = '"' if datatype is None else f'"^^<{datatype}>'
    return F.concat(F.lit('"'), escaped, F.lit(end))


# Escapes of one letter.
ESCAPES = (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"))


def _code_points(text: Column, letter: str, size: int) -> Column:
    """``text`` with its escapes of ``size`` hexadecimal digits after ``letter`` as characters."""
    parts = F.split(text, r"\\" + letter + f"(?=[0-9A-Fa-f]{{{size}}})")
    char = lambda x: F.decode(F.unhex(F.lpad(F.substring(x, 1, size), 8, "0")), "UTF-32")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(char(x), F.substring(x, F.lit(size + 1), F.length(x))))), "")


def lexical(term: Column) -> Column:
    """The text of a literal, without quotes, datatype and escapes."""
    text = F.regexp_extract(term, r'^"((?:[^"\\]++|\\.)*+)"', 1)

    def plain(part: Column) -> Column:
        for a, b in ESCAPES:
            part = F.replace(part, F.lit(a), F.lit(b))
        return part

    def unescaped(part: Column) -> Column:
        return F.when(F.contains(part, F.lit("\\")), _code_points(_code_points(plain(part), "u", 4), "U", 8)).otherwise(part)

    # between escaped backslashes every other backslash is an escape of its own
    return F.array_join(F.transform(F.split(text, r"\\\\"), unescaped), "\\")


def write(facts: DataFrame, path: str) -> None:
    """One line a fact, ``g`` where there is one."""
    line = F.concat_ws(" ", *[F.col(c) for c in ("s", "p", "o", "g") if c in facts.columns], F.lit("."))
    facts.select(line.alias("value")).write.text(path)


def write_by_graph(facts: DataFrame, path: str) -> None:
    """Named graphs in folders of their own."""
    named = facts.withColumn("graph", F.coalesce("g", F.lit("default")))
    named.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"), "graph").write.partitionBy("graph").text(path)
