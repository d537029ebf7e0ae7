"""Naming an intermediate value inside one column expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def let_sql(value: Column, use: str) -> Column:
    """The same with a SQL lambda (``v -> ...``). Long expressions are built faster as one text."""
    return F.get(F.call_function("transform", F.array(value), F.expr(use)), F.lit(0))


def nested_let(value: str, use: str) -> str:
    """The same as SQL text, for use inside such a lambda."""
    return f"get(transform(array({value}), {use}), 0)"


def once(value: Column) -> Column:
    """``value`` as the only column of its kind in a select, for costly values that are filtered on.

    Predicates on the result of a generator stay above it; on a plain column they would be pushed below the
    projection and compute the value, or run its UDF, a second time.
    """
    return F.explode(F.array(value))
