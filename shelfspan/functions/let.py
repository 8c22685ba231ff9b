"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it; otherwise nested functions repeat their inputs' expressions."""
    return F.get(F.transform(F.array(x), f), 0)


def some(x: Column) -> Column:
    """x, or null if it is the empty text. For values that `let` has named."""
    return F.when(x != "", x)
