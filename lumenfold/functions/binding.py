"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being computed once however often the body uses it: Spark computes an
    expression anew at each use inside a lambda, and projections that it merges grow likewise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
