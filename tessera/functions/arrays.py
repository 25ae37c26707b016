"""Running totals inside one array, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are scanned together.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of ``values`` (bigint) the result of ``step`` over it and all before it.

    ``step`` must be associative (a sum, a minimum).  The array is scanned in
    chunks whose totals are scanned in turn, so the cost of growing an
    array an element at a time stays bounded by the chunk.  Null gives null, an
    empty array an empty one.
    """
    none = F.array().cast("array<bigint>")
    scan = lambda part: F.aggregate(part, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(step(F.try_element_at(acc, F.lit(-1)), x)))))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: scan(F.slice(v, k * CHUNK + 1, CHUNK)))

    def joined(inner: Column) -> Column:
        # each chunk beside the total of those before it
        before = F.slice(F.concat(F.array(F.lit(None).cast("bigint")), scan(F.transform(inner, lambda part: F.element_at(part, -1)))), F.lit(1), F.size(inner))
        return F.flatten(F.zip_with(inner, before, lambda part, total: F.when(total.isNull(), part).otherwise(F.transform(part, lambda x: step(total, x)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), joined)).otherwise(v))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_min(values: Column) -> Column:
    return running(values, lambda a, b: F.least(a, b))
