"""Builtin predicates as Column functions, by their usual prefixed names.

A function takes Columns and gives a Column. Where a rule's builtin would fail, the result is null, and ``bind`` and ``hold`` drop the
row, as a failing builtin drops a binding. Filters give booleans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUILTINS: dict[str, Callable[..., Column]] = {}


def builtin(*names: str):
    def keep(f):
        for name in names:
            BUILTINS[name] = f
        return f

    return keep


def call(name: str, *args) -> Column:
    """The Column of a builtin; text arguments are column names, other values literals or Columns."""
    return BUILTINS[name](*[F.col(a) if isinstance(a, str) else a if isinstance(a, Column) else F.lit(a) for a in args])


def bind(df: DataFrame, var: str, name: str, *args) -> DataFrame:
    """Bind ``var`` to a builtin's result; if it is bound already, keep the rows where both are equal."""
    value = call(name, *args)
    if var in df.columns:
        return df.filter(F.coalesce(F.col(var) == value, F.lit(False)))
    return df.withColumn(var, value).filter(F.col(var).isNotNull())


def hold(df: DataFrame, name: str, *args) -> DataFrame:
    """Rows for which a filter builtin holds."""
    return df.filter(F.coalesce(call(name, *args), F.lit(False)))
