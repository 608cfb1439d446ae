"""Evaluating an expression once where its value is needed several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Catalyst shares repeated subexpressions of a projection, but neither those
    of a filter nor those inside conditional branches.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
