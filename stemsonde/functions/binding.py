"""Local bindings inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once.

    A column derived in one projection and read inside a lambda of the next is
    inlined into the lambda by the optimizer and then evaluated per element.  A
    lambda argument is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def explode_rows(df: DataFrame, array: str | Column, name: str) -> DataFrame:
    """One row per element; empty arrays give none.

    The outer form with a filter on its output keeps the optimizer from adding a
    size test below, which would evaluate a derived array twice.
    """
    return df.select("*", F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def inline_rows(df: DataFrame, keep: list, array: str | Column, probe: str) -> DataFrame:
    """The same for arrays of structs; ``probe`` is a field that is never null."""
    return df.select(*keep, F.inline_outer(array)).filter(F.col(probe).isNotNull())
