"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is computed once for each row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
