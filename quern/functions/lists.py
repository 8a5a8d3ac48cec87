"""``list:`` builtins on arrays; generators are for ``explode``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.registry import builtin

builtin("list:length", "e:length", "riff:count")(lambda x: F.size(x))
builtin("list:first", "list:car", "rdf:first")(lambda x: F.get(x, F.lit(0)))
builtin("list:last")(lambda x: F.try_element_at(x, F.lit(-1)))
builtin("list:memberAt")(lambda x, at: F.when(at >= 0, F.get(x, at.cast("int"))))
builtin("list:in")(lambda item, x: F.array_contains(x, item))
builtin("list:notMember")(lambda x, item: ~F.array_contains(x, item))
builtin("list:reverse", "e:reverse", "riff:reverse")(lambda x: F.reverse(x))
builtin("list:sort", "e:sort")(lambda x: F.array_sort(x))
builtin("list:unique", "list:removeDuplicates", "e:unique", "riff:distinct-values")(lambda x: F.array_distinct(x))
builtin("list:append", "riff:concatenate")(lambda *xs: F.concat(*xs))
builtin("list:isList")(lambda x: x.isNotNull())
builtin("list:permutation")(lambda x: F.shuffle(x))
builtin("list:member")(lambda x: x)


@builtin("list:rest", "list:cdr", "rdf:rest")
def rest(x: Column) -> Column:
    """Null for an empty list."""
    return F.when(F.size(x) > 0, F.slice(x, F.lit(2), F.size(x)))


@builtin("list:firstRest", "e:firstRest")
def first_rest(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.struct(F.get(x, F.lit(0)).alias("first"), F.slice(x, F.lit(2), F.size(x)).alias("rest")))


@builtin("list:removeAt")
def remove_at(x: Column, at: Column) -> Column:
    return F.when((at >= 0) & (at < F.size(x)), F.concat(F.slice(x, F.lit(1), at.cast("int")), F.slice(x, at.cast("int") + 2, F.size(x))))


@builtin("list:iterate")
def iterate(x: Column) -> Column:
    """Pairs of place, from 0, and item."""
    return F.transform(x, lambda item, i: F.struct(i.alias("index"), item.alias("item")))


@builtin("list:select")
def select(x: Column) -> Column:
    """Pairs of an item and the list without it."""
    return F.transform(x, lambda item, i: F.struct(item.alias("item"), F.concat(F.slice(x, F.lit(1), i), F.slice(x, i + 2, F.size(x))).alias("rest")))


@builtin("list:intersection")
def intersection(a: Column, b: Column) -> Column:
    """Items of the first list, in its order and with its repetitions, that the second has."""
    return F.filter(a, lambda x: F.array_contains(b, x))


@builtin("list:setEqualTo")
def set_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


builtin("list:setNotEqualTo")(lambda a, b: ~set_equal(a, b))
builtin("list:multisetEqualTo", "e:multisetEqualTo")(lambda a, b: F.array_sort(a) == F.array_sort(b))
builtin("list:multisetNotEqualTo", "e:multisetNotEqualTo")(lambda a, b: F.array_sort(a) != F.array_sort(b))


@builtin("e:subsequence")
def subsequence(whole: Column, part: Column) -> Column:
    """Whether ``part`` is left of ``whole`` when items are struck out."""
    found = F.aggregate(whole, F.lit(0), lambda at, x: F.when(F.get(part, at) == x, at + 1).otherwise(at))
    return found == F.size(part)


builtin("log:repeat")(lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>")))
