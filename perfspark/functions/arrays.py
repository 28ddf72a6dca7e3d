"""Column expressions over arrays of doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def sq_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(sq_distance(x, y))


def softmax(x: Column) -> Column:
    """Shares ``exp(v) / sum(exp(v))``; the greatest entry goes first, so none
    overflows.  An empty array stays empty."""
    top = F.array_max(x)
    powers = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(F.array(powers), lambda p: F.transform(p, lambda v: v / total(p)))[0]


def without(x: Column, j: Column) -> Column:
    """``x`` with entry ``j`` (0-based) removed."""
    return F.filter(x, lambda v, i: i != j)


def entries(df: DataFrame, x: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per array entry: the kept columns, ``pos`` (0-based), ``v``."""
    return df.select(*keep, F.posexplode(x).alias("pos", "v"))
