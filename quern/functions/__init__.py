"""Builtin predicates of rules as Spark Column functions."""

from quern.functions import lists, numbers, strings, times  # noqa: F401
from quern.functions.registry import BUILTINS, bind, call, hold  # noqa: F401
