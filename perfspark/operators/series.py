"""Ordered series: best so far, convergence, smoothing, pairing, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfspark.functions.numbers import ratio as divided
from perfspark.operators import domain
from perfspark.operators.metrics import ape
from perfspark.operators.ranking import add_rank, drop_halo, in_blocks, running
from perfspark.runtime import lookup, materialize


def running_best(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Best value so far and whether the row improves it."""
    before = running(df, keys, order, {"__prev": ("min", value)}, inclusive=False)
    better = F.col("__prev").isNull() | (F.col(value) < F.col("__prev"))
    return before.withColumn("improved", better).withColumn("best", F.least("__prev", value)).drop("__prev")


def convergence(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
    window: int = 10, mean_bound: float = 10.0, ratio: float = 1e-4,
) -> DataFrame:
    """True where the last ``window`` values have a mean below the bound and a
    population std below ``ratio`` of the mean."""
    ranked = add_rank(df, order, keys, "__r")
    blocks, w = in_blocks(ranked, keys, "__r", before=window - 1)
    last = w.rowsBetween(-(window - 1), 0)
    mean, std = F.avg(value).over(last), F.stddev_pop(value).over(last)
    flag = (F.count(value).over(last) == window) & (mean < mean_bound) & (divided(std, mean) < ratio)
    return drop_halo(blocks.withColumn("converged", F.coalesce(flag, F.lit(False)))).drop("__r")


def ema(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, weight: float, block: int = 65536
) -> DataFrame:
    """Exponential smoothing ``s = weight * s + (1 - weight) * x`` per key,
    starting at the first value.

    Each block is smoothed alone as if it began the series.  The true start
    changes it by ``weight^(i+1) * (carry - first)``, so the carry over blocks
    is itself a short chain of one row per block.
    """
    keys = list(keys)
    ranked = add_rank(df, order, keys, "__r")
    ranked = ranked.withColumn("__b", F.floor((F.col("__r") - 1) / block)).withColumn(
        "__i", F.pmod(F.col("__r") - 1, F.lit(block))
    )

    def smooth(batches):
        s = 0.0
        for rows in batches:
            out = []
            for i, x in zip(rows["__i"].tolist(), rows[value].tolist()):
                s = x if i == 0 else weight * s + (1 - weight) * x
                out.append(s)
            yield rows.assign(__s=out)

    # A task reads its blocks one after the other; row 0 starts a block.
    ordered = ranked.repartition(*keys, "__b").sortWithinPartitions(*keys, "__b", "__r")
    local = materialize(ordered.mapInPandas(smooth, T.StructType([*ordered.schema.fields, T.StructField("__s", T.DoubleType())])))
    ends = local.groupBy(*keys, "__b").agg(
        F.min_by(value, "__r").alias("first"), F.max_by("__s", "__r").alias("last"), F.count(F.lit(1)).alias("rows")
    )

    def chain(batches):
        carry = 0.0
        for rows in batches:
            carries = []
            for b, first, last, n in zip(rows["__b"], rows["first"], rows["last"], rows["rows"]):
                start = first if b == 0 else carry
                carries.append(start)
                carry = last + weight**n * (start - first)
            yield rows.assign(carry=carries)[[*keys, "__b", "first", "carry"]]

    fields = {f.name: f for f in ends.schema.fields}
    schema = T.StructType([*[fields[c] for c in [*keys, "__b"]], T.StructField("first", T.DoubleType()), T.StructField("carry", T.DoubleType())])
    series = ends.repartition(*keys) if keys else ends.coalesce(1)  # one row per block
    whole = series.sortWithinPartitions(*keys, "__b").mapInPandas(chain, schema)
    joined = local.join(whole, [*keys, "__b"])
    s = F.col("__s") + F.pow(F.lit(weight), F.col("__i") + 1) * (F.col("carry") - F.col("first"))
    return joined.withColumn("ema", s).drop("__r", "__b", "__i", "__s", "first", "carry")


def trim_after_spike(df: DataFrame, keys: Sequence[str], order: str, value: str, bound: float = 10.0) -> DataFrame:
    """Points after the last one above the bound; the first point is not tested.

    The last spike is one row per key, so no window is needed.
    """
    facts = df.groupBy(*keys).agg(
        F.min(order).alias("__first"), F.max(F.when(F.col(value) > bound, F.col(order))).alias("__last")
    )
    # A last spike at the first point means there is none after it.
    spikes = facts.where(F.col("__last") > F.col("__first")).select(*keys, F.col("__last").alias("__spike"))
    return df.join(lookup(spikes), list(keys), "left").where(
        F.col("__spike").isNull() | (F.col(order) > F.col("__spike"))
    ).drop("__spike")


def align_to_min(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    low = df.groupBy(*keys).agg(F.min(value).alias("__low"))
    return df.join(lookup(low), list(keys)).withColumn("aligned", F.col(value) - F.col("__low")).drop("__low")


def pair_begin_end(df: DataFrame, keys: Sequence[str], order: Sequence[str], phase: str = "ph", name: str = "name", ts: str = "ts") -> DataFrame:
    """Durations of B/E pairs: an E row right after a B row of the same name on
    the same track."""
    ranked = add_rank(df, order, keys, "__r")
    blocks, w = in_blocks(ranked, keys, "__r", before=1)
    paired = drop_halo(blocks.withColumns({
        "__ph": F.lag(phase).over(w), "__name": F.lag(name).over(w), "begin": F.lag(ts).over(w),
    }))
    good = (F.col(phase) == "E") & (F.col("__ph") == "B") & (F.col("__name") == F.col(name))
    return paired.where(good).withColumn("dur", F.col(ts) - F.col("begin")).drop("__r", "__ph", "__name")


def ape_buckets(df: DataFrame, id_col: str, buckets: int = 100, label: str = "label", pred: str = "pred") -> DataFrame:
    """Rows by error in equal chunks of ``n // buckets`` rows (at least one);
    the rest goes, and so do rows without an error."""
    scored = df.withColumn("ape", ape(label, pred)).where("ape IS NOT NULL")
    ranked = add_rank(scored, ["ape", id_col], (), "__r", "__n")
    bucket = F.floor((F.col("__r") - 1) / F.greatest(F.floor(F.col("__n") / buckets), F.lit(1)))
    return ranked.withColumn("bucket", bucket).where(F.col("bucket") < buckets).drop("__r", "__n")


def mape_vs_shift(bucketed: DataFrame, train: DataFrame, x: str) -> DataFrame:
    """Per error bucket: its error and the distance of its rows to the train rows."""
    errors = bucketed.groupBy("bucket").agg(F.avg("ape").alias("mape"), F.count(F.lit(1)).alias("n"))
    return errors.join(domain.cmd_by_group(bucketed, train, "bucket", x), "bucket")


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def duration_seconds(text: str) -> Column:
    """Seconds of a text like ``1h2m3s``; missing parts count 0."""
    def part(unit):
        digits = F.nullif(F.regexp_extract(text, rf"(\d+){unit}", 1), F.lit(""))
        return F.coalesce(digits.cast("bigint"), F.lit(0))

    return part("h") * 3600 + part("m") * 60 + part("s")
