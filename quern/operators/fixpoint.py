"""Recursive rules to a fixpoint, set at a time: each round joins only what the last one found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import settle


class StepLimit(RuntimeError):
    """The rounds allowed were used up before nothing new was found."""


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """The least set of rows that holds ``seed`` and ``step``'s results. ``step(delta, known)`` gives what the last round's new rows lead
    to; each round's rows are written to the shared folder, so a lost executor costs no earlier round."""
    known = delta = settle(seed.distinct(), "fixpoint")
    for _ in range(max_rounds):
        found = step(delta, known).select(*seed.columns).distinct()
        delta = settle(found.join(known, seed.columns, "left_anti"), "fixpoint")
        if delta.isEmpty():
            return known
        known = known.unionByName(delta)
    raise StepLimit(f"no fixpoint after {max_rounds} rounds")


def transitive_closure(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Distinct ``a, b`` with a path of one edge or more. New pairs are joined to all known ones on both sides, so paths double in
    length each round and long chains take few rounds."""

    def step(new: DataFrame, known: DataFrame) -> DataFrame:
        before, after = known.select("a", F.col("b").alias("m")), known.select(F.col("a").alias("m"), "b")
        new_before, new_after = new.select("a", F.col("b").alias("m")), new.select(F.col("a").alias("m"), "b")
        return before.join(new_after, "m").select("a", "b").unionByName(new_before.join(after, "m").select("a", "b"))

    return fixpoint(edges.select("a", "b"), step, max_rounds)


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Distinct ``root, node`` for the wanted roots only: what a goal asks for, without the closure of everything else."""
    hop = edges.select(F.col("a").alias("node"), F.col("b").alias("next"))
    seed = start.select("root").join(edges.select(F.col("a").alias("root"), F.col("b").alias("node")), "root").select("root", "node")
    return fixpoint(seed, lambda new, _: new.join(hop, "node").select("root", F.col("next").alias("node")), max_rounds)


def distances(edges: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``root, node, hops``: the fewest edges. A node that is known is never entered again, so cycles end."""
    hop = edges.select(F.col("a").alias("node"), F.col("b").alias("next"))
    known = delta = settle(start.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct(), "hops")
    for n in range(1, max_rounds + 1):
        found = delta.join(hop, "node").select("root", F.col("next").alias("node")).distinct()
        delta = settle(found.join(known, ["root", "node"], "left_anti").withColumn("hops", F.lit(n)), "hops")
        if delta.isEmpty():
            return known
        known = known.unionByName(delta)
    raise StepLimit(f"paths longer than {max_rounds}")


def with_lineage(rules: dict[str, Callable[[DataFrame], DataFrame]], seed: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Facts ``s, p, o`` with the rule and round that first gave them; of several rules in a round the first by name counts."""
    cols = ["s", "p", "o"]
    known = settle(seed.select(*cols).distinct().select("*", F.lit("given").alias("rule"), F.lit(0).alias("round")), "lineage")
    for n in range(1, max_rounds + 1):
        facts, found = known.select(*cols), None
        for name, rule in rules.items():
            made = rule(facts).select(*cols, F.lit(name).alias("rule"))
            found = made if found is None else found.unionByName(made)
        fresh = found.groupBy(*cols).agg(F.min("rule").alias("rule")).join(known, cols, "left_anti").withColumn("round", F.lit(n))
        fresh = settle(fresh, "lineage")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise StepLimit(f"no fixpoint after {max_rounds} rounds")
