"""Rule bodies as joins: patterns share variables (column names), and each construct of a body is a DataFrame operation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(facts: DataFrame, predicate: str, s: str, o: str) -> DataFrame:
    """A triple pattern with a constant predicate; the same variable twice keeps equal pairs."""
    found = facts.filter(F.col("p") == predicate)
    if s == o:
        return found.filter("s = o").select(F.col("s").alias(s))
    return found.select(F.col("s").alias(s), F.col("o").alias(o))


def conjunction(*patterns: DataFrame) -> DataFrame:
    """All patterns at once: joined on the variables they share; patterns that share none are refused, as their product would be."""

    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in left.columns if c in right.columns]
        if not shared:
            raise ValueError(f"no shared variable between {left.columns} and {right.columns}")
        return left.join(right, shared)

    return reduce(both, patterns)


def negation(rows: DataFrame, pattern: DataFrame) -> DataFrame:
    """Rows for which the pattern has no solution."""
    return rows.join(pattern, [c for c in rows.columns if c in pattern.columns], "left_anti").select(*rows.columns)


def includes(rows: DataFrame, pattern: DataFrame) -> DataFrame:
    """Rows for which the pattern has a solution; binds nothing."""
    return rows.join(pattern, [c for c in rows.columns if c in pattern.columns], "left_semi").select(*rows.columns)


def first_solution(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One solution for each binding of ``by``, the first by ``order``: an aggregation, so that a hot binding is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    keyed = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], *rest)
    return rows.groupBy(*by).agg(F.min(keyed).alias("_first")).select(*by, *[f"_first.{c}" for c in rest])


def optional_first(rows: DataFrame, pattern: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with the first solution of the pattern, or nulls where there is none."""
    shared = [c for c in rows.columns if c in pattern.columns]
    return rows.join(first_solution(pattern, shared, order), shared, "left")


def for_all(rows: DataFrame, condition: DataFrame, action: DataFrame) -> DataFrame:
    """Rows none of whose solutions of ``condition`` lacks a solution of ``action``."""
    return negation(rows, negation(condition, action))


def if_then_else(rows: DataFrame, condition: DataFrame, then, otherwise) -> DataFrame:
    """``then`` of the rows that meet the condition and ``otherwise`` of the others."""
    return then(includes(rows, condition)).unionByName(otherwise(negation(rows, condition)))


def collect_all(rows: DataFrame, pattern: DataFrame, template: str, into: str) -> DataFrame:
    """Every solution of the pattern as a sorted list, empty where there is none. Lists grow with their groups: where only a
    number is wanted, ``fold_all`` makes it without the list."""
    shared = [c for c in rows.columns if c in pattern.columns]
    lists = pattern.groupBy(*shared).agg(F.sort_array(F.collect_list(template)).alias(into))
    kind = dict(lists.dtypes)[into]
    return rows.join(lists, shared, "left").withColumn(into, F.coalesce(into, F.array().cast(kind)))


def fold_all(rows: DataFrame, pattern: DataFrame, **folds: Column) -> DataFrame:
    """A collected list and its fold in one: aggregates of the pattern's solutions by the rows' variables; ``count`` columns are 0 for none."""
    shared = [c for c in rows.columns if c in pattern.columns]
    made = pattern.groupBy(*shared).agg(*[f.alias(name) for name, f in folds.items()])
    out = rows.join(made, shared, "left")
    counts = [n for n in folds if n.startswith("n_")]
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, width: int) -> DataFrame:
    """Pairs with equal ``on`` and ``0 < right_at - left_at <= width``: joined on buckets as wide as the band, so that each row meets
    two buckets and not all rows of its key."""
    bucket = F.floor(F.col(left_at) / width)
    a = left.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1)))
    b = right.withColumn("_bucket", F.floor(F.col(right_at) / width))
    gap = F.col(right_at) - F.col(left_at)
    return a.join(b, [*on, "_bucket"]).filter((gap > 0) & (gap <= width)).drop("_bucket")


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str) -> DataFrame:
    """Each left row with the latest ``value`` of the right at or before it, by one sort of both sides."""
    both = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_side", F.lit(1)).unionByName(
        right.select(*on, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    upto = Window.partitionBy(*on).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(upto)).filter("_side = 1").drop("_v", "_side")


def contradiction(rows: DataFrame) -> None:
    """Raise if a body that must not hold has a solution."""
    found = rows.limit(1).collect()
    if found:
        raise ValueError(f"contradiction: {found[0]}")
