"""``math:`` and the numeric ``e:`` and ``pred:`` builtins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.registry import builtin

_D = "double"


def finite(x: Column) -> Column:
    """Null instead of NaN and infinity, for results outside a function's domain."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


for _name, _f in {"equalTo": lambda a, b: a.cast(_D) == b.cast(_D), "notEqualTo": lambda a, b: a.cast(_D) != b.cast(_D), "lessThan": lambda a, b: a < b, "greaterThan": lambda a, b: a > b, "notLessThan": lambda a, b: a >= b, "notGreaterThan": lambda a, b: a <= b}.items():
    builtin(f"math:{_name}")(_f)
builtin("pred:less-than")(lambda a, b: a < b)
builtin("pred:greater-than")(lambda a, b: a > b)
builtin("pred:equalTo", "log:equalTo")(lambda a, b: a == b)
builtin("log:notEqualTo")(lambda a, b: a != b)
builtin("e:notLabel")(lambda a, b: a.cast("string") != b.cast("string"))


@builtin("math:sum", "math:plus")
def total(*xs: Column) -> Column:
    return reduce(F.try_add, xs)


@builtin("math:product", "math:times")
def product(*xs: Column) -> Column:
    return reduce(F.try_multiply, xs)


builtin("math:difference", "math:minus")(lambda a, b: F.try_subtract(a, b))
builtin("math:quotient", "math:divide")(lambda a, b: F.try_divide(a.cast(_D), b.cast(_D)))


@builtin("math:integerQuotient")
def integer_quotient(a: Column, b: Column) -> Column:
    """Floor division; null for a zero divisor."""
    return F.floor(F.try_divide(a.cast(_D), b.cast(_D)))


@builtin("math:remainder")
def remainder(a: Column, b: Column) -> Column:
    """With the sign of the divisor; null for a zero divisor."""
    return F.when(b != 0, F.try_mod(F.try_mod(a, b) + b, b))


@builtin("math:exponentiation")
def power(a: Column, b: Column) -> Column:
    return finite(F.pow(a.cast(_D), b.cast(_D)))


builtin("math:logarithm")(lambda x: F.when(x > 0, F.log(x)))
builtin("math:absoluteValue")(lambda x: F.abs(x))
builtin("math:negation")(lambda x: -x)
builtin("math:floor")(lambda x: F.floor(x))
builtin("math:ceiling")(lambda x: F.ceil(x))
builtin("math:rounded")(lambda x: F.rint(x.cast(_D)))


@builtin("math:roundedTo")
def rounded_to(x: Column, digits: Column) -> Column:
    """Half to even, at a number of digits that may differ by row."""
    scale = F.pow(F.lit(10.0), digits)
    return F.rint(x.cast(_D) * scale) / scale


for _name in "sin cos tan sinh cosh tanh atan asinh degrees radians".split():
    builtin(f"math:{_name}")(lambda x, f=getattr(F, _name): f(x.cast(_D)))
for _name in "asin acos acosh atanh".split():
    builtin(f"math:{_name}")(lambda x, f=getattr(F, _name): finite(f(x.cast(_D))))
builtin("math:atan2")(lambda y, x: F.atan2(y.cast(_D), x.cast(_D)))
builtin("math:max", "e:max")(lambda *xs: F.greatest(*xs))
builtin("math:min", "e:min")(lambda *xs: F.least(*xs))
builtin("math:memberCount")(lambda items: F.size(items))


@builtin("math:avg", "e:avg")
def mean(*xs: Column) -> Column:
    return total(*[x.cast(_D) for x in xs]) / len(xs)


@builtin("math:std", "e:std")
def deviation(*xs: Column) -> Column:
    """Sample standard deviation of the arguments, 0 for fewer than two."""
    if len(xs) < 2:
        return F.lit(0.0)
    m = mean(*xs)
    return F.sqrt(total(*[(x - m) * (x - m) for x in xs]) / (len(xs) - 1))


@builtin("math:rms", "e:rms")
def root_mean_square(*xs: Column) -> Column:
    return F.sqrt(mean(*[x.cast(_D) * x for x in xs]))


@builtin("e:sigmoid")
def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x.cast(_D)))


@builtin("e:binaryEntropy")
def binary_entropy(p: Column) -> Column:
    p = p.cast(_D)
    return F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)


builtin("e:numeral")(lambda x: x.try_cast(_D))
builtin("e:epsilon")(lambda: F.lit(1e-10))
builtin("e:boolean")(lambda x: x.cast("string") == "true")
builtin("e:T", "e:true")(lambda: F.lit(True))
builtin("e:F")(lambda: F.lit(False))
builtin("e:random")(lambda: F.rand())
