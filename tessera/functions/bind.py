"""Binding a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    A column used twice in an expression is written, and may be computed, twice;
    nested, the copies multiply.  A lambda's parameter isn't.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
