"""Ordered computations that never put one group into one task.

A plain window over a key sends all rows of that key to one task.  Here rows
are range-partitioned on (key, order), written once, and numbered inside each
range; a small table of run lengths per (range, key) turns the local numbers
into global ones.  A key of any size is spread over as many ranges as it needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfspark.runtime import lookup, materialize

POS, CHUNK = "__pos", "__chunk"
#: Rows up to which a table is ranked where only a few places matter.
RANKED_ROWS = 1_000_000
#: Rows of a larger table for one row of the sample that brackets such places.
SAMPLED_OF = 256


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right["__k_" + n])
    return cond


def _attach(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on ``names`` where nulls match, keeping the left names."""
    renamed = right.select(
        *[F.col(n).alias("__k_" + n) for n in names],
        *[c for c in right.columns if c not in names],
    )
    return left.join(renamed, _same(left, renamed, names)).drop(*["__k_" + n for n in names])


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Range-partition and sort by (keys, order); number rows by position.

    The position holds the range number in its upper bits, so it is ordered
    over the whole table and splits into (range, local row).
    """
    by = [F.col(k) for k in keys] + [_column(c) for c in order]
    numbered = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn(POS, F.monotonically_increasing_id())
    )
    return materialize(numbered).withColumn(CHUNK, F.shiftright(POS, 33))


def _runs(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (range, key): first position, rows, rows of the key before
    this range, rows of the key in total."""
    runs = chunks.groupBy(CHUNK, *keys).agg(
        F.min(POS).alias("__start"), F.count(F.lit(1)).alias("__rows")
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    prior = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(
        CHUNK,
        *keys,
        "__start",
        F.coalesce(F.sum("__rows").over(prior), F.lit(0)).alias("__before"),
        F.sum("__rows").over(whole).alias("__total"),
    )


def add_rank(
    df: DataFrame,
    order: Sequence,
    keys: Sequence[str] = (),
    name: str = "rank",
    size: str | None = None,
) -> DataFrame:
    """1-based row number by ``order`` inside each key (or over the table).

    End ``order`` with a unique column: equal sort keys cannot be split over
    ranges.  ``size`` also adds the number of rows of the key.
    """
    keys = list(keys)
    chunks = chunked(df, keys, order)
    runs = lookup(_runs(chunks, keys))
    joined = _attach(chunks, runs, [CHUNK, *keys])
    out = joined.withColumn(name, F.col("__before") + F.col(POS) - F.col("__start") + 1)
    if size:
        out = out.withColumn(size, F.col("__total"))
    return out.drop(POS, CHUNK, "__start", "__before", "__total")


def add_segment(df: DataFrame, order: Sequence, places: Sequence[int], name: str = "segment") -> DataFrame:
    """How many of the ascending ``places`` lie before each row: 0 for the rows
    ranked 1 to ``places[0]``, and so on.  Equal sort keys are cut anywhere.

    A large table is not moved: a sample brackets every place, the rows outside
    the brackets are counted, and only those inside are ranked.  The rows of
    ``df`` have to be the same on every scan.
    """
    past = lambda rank: sum((F.when(rank > p, 1).otherwise(0) for p in places), F.lit(0))
    ranked = lambda rows: add_rank(rows, order, (), "__r").withColumn(name, past(F.col("__r"))).drop("__r")
    if not places:
        return df.withColumn(name, F.lit(0))
    total = df.count()
    if total <= RANKED_ROWS:
        return ranked(df)
    key = F.struct(*[_column(c).alias(f"k{i}") for i, c in enumerate(order)])
    some = add_rank(df.sample(max(1 / SAMPLED_OF, RANKED_ROWS / total / 8), seed=0).select(key.alias("__key")), ["__key"], (), "__r")
    size = some.count()
    at = [min(p / total, 1.0) for p in places]
    slack = [5 * math.sqrt(size * q * (1 - q)) + 10 for q in at]  # five deviations: a miss is caught below
    # in ascending order; a bound before the first or behind the last row of the sample is null
    low = [*accumulate((math.floor(size * q - s) for q, s in zip(at[::-1], slack[::-1])), min)][::-1]
    high = [*accumulate((math.ceil(size * q + s) for q, s in zip(at, slack)), max)]
    bounds = {f"__{k}{i}": r for k, rs in (("low", low), ("high", high)) for i, r in enumerate(rs)}
    row = some.where(F.col("__r").isin(*set(bounds.values()))).agg(
        *[F.max(F.when(F.col("__r") == r, F.col("__key"))).alias(c) for c, r in bounds.items()])
    marked = df.crossJoin(F.broadcast(materialize(row)))
    count = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    marked = marked.withColumns({
        "__in": count(F.coalesce(key >= F.col(f"__low{i}"), F.lit(True)) for i in range(len(places))),
        "__out": count(F.coalesce(key > F.col(f"__high{i}"), F.lit(False)) for i in range(len(places))),
    }).drop(*bounds)
    found = {(r["__in"], r["__out"]): r["count"] for r in marked.groupBy("__in", "__out").count().collect()}
    under = lambda test: sum(n for at, n in found.items() if test(*at))
    if not all(under(lambda a, b: a <= i) <= p and (p >= total or p <= under(lambda a, b: b <= i)) for i, p in enumerate(places)):
        return ranked(df)
    # before a row of the brackets it has entered lie all rows that have left fewer and are in none
    before = [under(lambda a, b: a == b < m) for m in range(len(places) + 1)]
    inside = add_rank(marked.where("__in > __out"), order, (), "__r")
    rank = F.col("__r") + F.element_at(F.array(*[F.lit(n) for n in before]), F.col("__in") + 1)
    outside = marked.where("__in = __out").withColumn(name, F.col("__out"))
    return outside.drop("__in", "__out").unionByName(inside.withColumn(name, past(rank)).drop("__in", "__out", "__r"))


def percentiles(
    df: DataFrame, value, probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linear percentiles, one row per key, one column per entry of
    ``probs`` (name -> probability).  No group is gathered: the values are
    ranked in place and only the rows next to each position are kept."""
    keys = list(keys)
    base = df.select(
        *keys, _column(value).cast("double").alias("__v")
    ).where(F.col("__v").isNotNull())
    ranked = add_rank(
        base, ["__v", F.monotonically_increasing_id()], keys, name="__r", size="__n"
    )
    row = F.col("__r") - 1
    weights = {}
    for name, p in probs.items():
        at = (F.col("__n") - 1) * F.lit(float(p))
        low = F.floor(at)
        weights[name] = (
            F.when(row == low, 1 - (at - low)).when(row == low + 1, at - low)
        )
    wanted = F.lit(False)
    for w in weights.values():
        wanted = wanted | w.isNotNull()
    return ranked.where(wanted).groupBy(*keys).agg(
        *[F.sum(F.col("__v") * w).alias(n) for n, w in weights.items()]
    )


def quantile_grid(df: DataFrame, value, size: int, keys: Sequence[str] = (), name: str = "quantiles") -> DataFrame:
    """Per key the array of ``size`` exact quantiles at 0, 1/(size-1), ..., 1.

    A ranked row knows which grid points lie next to it, so only the few rows
    around the grid points leave the scan.
    """
    keys = list(keys)
    base = df.select(*keys, _column(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    ranked = add_rank(base, ["__v", F.monotonically_increasing_id()], keys, "__r", "__n")
    row, gap = F.col("__r") - 1, F.col("__n") - 1
    per_row = F.when(gap > 0, F.lit(float(size - 1)) / gap).otherwise(F.lit(0.0))
    first = F.greatest(F.floor((row - 1) * per_row) - 1, F.lit(0).cast("bigint"))
    last = F.least(F.ceil((row + 1) * per_row) + 1, F.lit(size - 1).cast("bigint"))
    last = F.when(gap > 0, last).otherwise(F.lit(size - 1).cast("bigint"))
    near = ranked.withColumn("__i", F.explode(F.sequence(first, last)))
    at = F.col("__i") * gap / F.lit(float(size - 1))
    low = F.floor(at)
    weight = F.when(row == low, 1 - (at - low)).when(row == low + 1, at - low)
    points = near.where(weight.isNotNull()).groupBy(*keys, "__i").agg(F.sum(F.col("__v") * weight).alias("q"))
    return points.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "q"))), lambda s: s["q"]).alias(name)
    )


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    aggs: dict[str, tuple[str, str]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``/``min``/``max`` per key: name -> (function, column).

    Each range is scanned on its own; what came before it for the same key is
    one pre-aggregated row.
    """
    keys = list(keys)
    chunks = chunked(df, keys, order)
    per_run = chunks.groupBy(CHUNK, *keys).agg(
        *[_COMBINE[fn][0](c).alias("__c_" + n) for n, (fn, c) in aggs.items()]
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    prior = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_run.select(
        CHUNK,
        *keys,
        *[_COMBINE[fn][0]("__c_" + n).over(prior).alias("__c_" + n) for n, (fn, _) in aggs.items()],
    )
    local = (
        Window.partitionBy(CHUNK, *keys)
        .orderBy(POS)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    scanned = chunks
    for n, (fn, c) in aggs.items():
        scanned = scanned.withColumn("__l_" + n, _COMBINE[fn][0](c).over(local))
    out = _attach(scanned, lookup(carry), [CHUNK, *keys])
    for n, (fn, _) in aggs.items():
        out = out.withColumn(n, _COMBINE[fn][1](F.col("__c_" + n), F.col("__l_" + n)))
    helper = ["__c_" + n for n in aggs] + ["__l_" + n for n in aggs]
    return out.drop(POS, CHUNK, *helper)


def in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    rank: str,
    before: int = 0,
    after: int = 0,
    rows: int = 65536,
) -> tuple[DataFrame, Window]:
    """Cut each key into blocks of ``rows`` ranked rows for bounded windows.

    Rows near a border are copied into the neighbour block and marked
    ``__halo``; filter ``~__halo`` after the window columns are added.  The
    returned window sees at most ``rows + before + after`` rows per task.
    """
    block = F.floor((F.col(rank) - 1) / rows)
    inside = F.pmod(F.col(rank) - 1, F.lit(rows))
    homes = [F.struct(block.alias("b"), F.lit(False).alias("h"))]
    options = F.array(
        *homes,
        F.when(inside >= rows - before, F.struct((block + 1).alias("b"), F.lit(True).alias("h"))),
        F.when(inside < after, F.struct((block - 1).alias("b"), F.lit(True).alias("h"))),
    )
    blocked = (
        df.withColumn("__home", F.explode(F.array_compact(options)))
        .withColumn("__block", F.col("__home.b"))
        .withColumn("__halo", F.col("__home.h"))
        .drop("__home")
    )
    return blocked, Window.partitionBy(*keys, "__block").orderBy(rank)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("__halo")).drop("__block", "__halo")
