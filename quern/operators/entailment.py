"""Schema entailment over ``s, p, o`` facts: RDFS and the practical part of OWL RL, as joins with the schema's small relations.

Each rule is a function of facts, and of the facts that its other premise is taken from where those differ; ``rdfs`` and ``owl`` run theirs to a fixpoint. Schema predicates are recognised by local
names without a namespace (``subClassOf``, ``domain`` ...); ``type`` states membership.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.operators.fixpoint import fixpoint

COLUMNS = ["s", "p", "o"]
#: Rows up to which a rule's schema side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def schema_side(rows: DataFrame) -> DataFrame:
    """The schema side of a join, broadcast where it is counted to be small: a few properties or classes as keys of a shuffle would send
    all facts of one of them to one task."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _or(other: DataFrame | None, facts: DataFrame) -> DataFrame:
    return facts if other is None else other


def having(facts: DataFrame, predicate: str, s: str, o: str) -> DataFrame:
    return facts.filter(F.col("p") == predicate).select(F.col("s").alias(s), F.col("o").alias(o))


def _typed(df: DataFrame, s: str, o: str) -> DataFrame:
    return df.select(F.col(s).alias("s"), F.lit("type").alias("p"), F.col(o).alias("o"))


def subclass(facts: DataFrame, other: DataFrame | None = None) -> DataFrame:
    return _typed(having(facts, "type", "x", "a").join(schema_side(having(_or(other, facts), "subClassOf", "a", "b")), "a"), "x", "b")


def subproperty(facts: DataFrame, other: DataFrame | None = None) -> DataFrame:
    return facts.join(schema_side(having(_or(other, facts), "subPropertyOf", "p", "q")), "p").select("s", F.col("q").alias("p"), "o")


def domain(facts: DataFrame, other: DataFrame | None = None) -> DataFrame:
    return _typed(facts.join(schema_side(having(_or(other, facts), "domain", "p", "d")), "p"), "s", "d")


def value_range(facts: DataFrame, other: DataFrame | None = None) -> DataFrame:
    return _typed(facts.join(schema_side(having(_or(other, facts), "range", "p", "d")), "p"), "o", "d")


def _marked(facts: DataFrame, kind: str, other: DataFrame | None = None) -> DataFrame:
    """Facts of the properties that have this type."""
    return facts.join(schema_side(having(_or(other, facts), "type", "p", "k").filter(F.col("k") == kind).select("p")), "p").select(*COLUMNS)


def symmetric(facts: DataFrame, other: DataFrame | None = None) -> DataFrame:
    return _marked(facts, "SymmetricProperty", other).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def transitive(facts: DataFrame, other: DataFrame | None = None) -> DataFrame:
    def steps(first: DataFrame, second: DataFrame) -> DataFrame:
        return first.select("s", "p", F.col("o").alias("m")).join(second.select(F.col("s").alias("m"), "p", "o"), ["p", "m"]).select(*COLUMNS)

    own = _marked(facts, "TransitiveProperty", other)
    if other is None:
        return steps(own, own)
    every = _marked(facts.unionByName(other), "TransitiveProperty")
    return steps(own, every).unionByName(steps(every, own))


def inverse(facts: DataFrame, other: DataFrame | None = None) -> DataFrame:
    return facts.join(schema_side(having(_or(other, facts), "inverseOf", "p", "q")), "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"))


def equivalent_property(facts: DataFrame, other: DataFrame | None = None) -> DataFrame:
    pairs = having(_or(other, facts), "equivalentProperty", "p", "q")
    both = pairs.unionByName(pairs.select(F.col("q").alias("p"), F.col("p").alias("q")))
    return facts.join(schema_side(both), "p").select("s", F.col("q").alias("p"), "o")


def equivalent_class(facts: DataFrame, other: DataFrame | None = None) -> DataFrame:
    pairs = having(facts, "equivalentClass", "s", "o")
    both = pairs.unionByName(pairs.select(F.col("o").alias("s"), F.col("s").alias("o")))
    return both.select("s", F.lit("subClassOf").alias("p"), "o")


def property_chain(facts: DataFrame, chains: DataFrame) -> DataFrame:
    """``chains``: ``first, second, result`` properties."""
    a = facts.select("s", F.col("p").alias("first"), F.col("o").alias("m")).join(schema_side(chains), "first")
    b = facts.select(F.col("s").alias("m"), F.col("p").alias("second"), "o")
    return a.join(b, ["second", "m"]).select("s", F.col("result").alias("p"), "o")


def some_or_all_values(facts: DataFrame, restrictions: DataFrame) -> DataFrame:
    """``restrictions``: ``class, property, filler``; a member's values of the property are members of the filler."""
    members = having(facts, "type", "s", "class").join(schema_side(restrictions), "class").select("s", F.col("property").alias("p"), "filler")
    return _typed(facts.join(members, ["s", "p"]), "o", "filler")


def has_value(facts: DataFrame, restrictions: DataFrame) -> DataFrame:
    """``restrictions``: ``class, property, value``; members have the value."""
    return having(facts, "type", "s", "class").join(schema_side(restrictions), "class").select("s", F.col("property").alias("p"), F.col("value").alias("o"))


def union_of(facts: DataFrame, unions: DataFrame) -> DataFrame:
    """``unions``: ``class, member``."""
    return _typed(having(facts, "type", "s", "member").join(schema_side(unions), "member"), "s", "class")


def intersection_of(facts: DataFrame, intersections: DataFrame) -> DataFrame:
    """``intersections``: ``class, member``; both directions."""
    types = having(facts, "type", "s", "member")
    sizes = intersections.groupBy("class").agg(F.count_distinct("member").alias("size"))
    full = types.join(schema_side(intersections), "member").groupBy("s", "class").agg(F.count_distinct("member").alias("n")).join(sizes, "class").filter("n = size")
    down = having(facts, "type", "s", "class").join(schema_side(intersections), "class")
    return _typed(full, "s", "class").unionByName(_typed(down, "s", "member"))


def one_of(classes: DataFrame) -> DataFrame:
    """``classes``: ``class, member``; the listed individuals are members. (That any member is the same as each listed one doesn't follow.)"""
    return _typed(classes, "member", "class")


def all_different(members: DataFrame) -> DataFrame:
    """``members``: ``list, item``; the items of a declared list differ pairwise, in both directions."""
    other = members.select("list", F.col("item").alias("o"))
    return members.join(other, "list").filter(F.col("item") != F.col("o")).select(F.col("item").alias("s"), F.lit("differentFrom").alias("p"), "o")


def different_symmetric(facts: DataFrame, other: DataFrame | None = None) -> DataFrame:
    return having(facts, "differentFrom", "o", "s").select("s", F.lit("differentFrom").alias("p"), "o")


def same_by_function(facts: DataFrame) -> DataFrame:
    """``a, b`` pairs with the same identity: values of a functional property of one subject, subjects of an inverse functional one of
    one value. Each is paired with the least of its group, which makes the same classes as all pairs."""
    f, i = _marked(facts, "FunctionalProperty"), _marked(facts, "InverseFunctionalProperty")
    values = f.join(f.groupBy("p", "s").agg(F.min("o").alias("least")), ["p", "s"]).select(F.col("least").alias("a"), F.col("o").alias("b"))
    subjects = i.join(i.groupBy("p", "o").agg(F.min("s").alias("least")), ["p", "o"]).select(F.col("least").alias("a"), F.col("s").alias("b"))
    return values.unionByName(subjects).filter("a != b").distinct()


def same_by_keys(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys``: ``class, property``; members of a class with equal, non-empty values of all its key properties are the same."""
    members = having(facts, "type", "s", "class").join(schema_side(keys), "class").select("s", "class", F.col("property").alias("p"))
    values = facts.join(members, ["s", "p"]).groupBy("class", "s", "p").agg(F.sort_array(F.collect_set("o")).alias("set"))
    sizes = keys.groupBy("class").agg(F.count_distinct("property").alias("size"))
    whole = values.groupBy("class", "s").agg(F.sort_array(F.collect_list(F.struct("p", "set"))).alias("key")).join(sizes, "class").filter(F.size("key") == F.col("size"))
    least = whole.groupBy("class", "key").agg(F.min("s").alias("a"))
    return whole.join(least, ["class", "key"]).select("a", F.col("s").alias("b")).filter("a != b").distinct()


def same_as(pairs: DataFrame) -> DataFrame:
    """``id, label``: every individual of a ``sameAs`` pair with the least one of its class: the reflexive, symmetric and transitive closure
    without its square."""
    return connected_components(pairs)


def with_representatives(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """Facts about the representatives of ``sameAs`` classes."""
    subject, obj = classes.select(F.col("id").alias("s"), F.col("label").alias("s_label")), classes.select(F.col("id").alias("o"), F.col("label").alias("o_label"))
    out = facts.join(subject, "s", "left").join(obj, "o", "left")
    return out.select(F.coalesce("s_label", "s").alias("s"), "p", F.coalesce("o_label", "o").alias("o")).distinct()


RDFS = (subclass, subproperty, domain, value_range)
OWL = (symmetric, transitive, inverse, equivalent_property, equivalent_class, different_symmetric)


def entail(facts: DataFrame, rules=RDFS, max_rounds: int = 100) -> DataFrame:
    """All facts that follow. The schema is part of the facts and meets every round's new facts; new facts that a rule needs two
    of meet the known ones as well, so no round joins old facts with old ones."""

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        out = None
        for rule in rules:
            made = rule(delta, known).unionByName(rule(known, delta))
            out = made if out is None else out.unionByName(made)
        return out

    return fixpoint(facts.select(*COLUMNS), step, max_rounds)


def rdfs(facts: DataFrame) -> DataFrame:
    return entail(facts, RDFS)


def owl(facts: DataFrame) -> DataFrame:
    return entail(facts, OWL)
