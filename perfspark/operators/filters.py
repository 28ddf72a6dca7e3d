"""Row filters over samples, operator rows and measured records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfspark.functions import arrays
from perfspark.operators.ranking import percentiles
from perfspark.runtime import lookup

# Bounds the results depend on.
STD_TO_AVG_BOUND = 0.01
OUTLIER_RANGE = (0.1, 0.9)
MIN_TASK_SAMPLES = 48
ENVELOPE_RANGE = (0.05, 0.95)


def min_latency(df: DataFrame, time_lb: float, avg: str = "avg") -> DataFrame:
    return df.where(F.col(avg) >= time_lb)


def is_stable(std: str = "std", avg: str = "avg", bound: float = STD_TO_AVG_BOUND) -> Column:
    return F.coalesce(F.try_divide(F.col(std), F.col(avg)) <= bound, F.lit(False))


def unstable(df: DataFrame, bound: float = STD_TO_AVG_BOUND) -> DataFrame:
    return df.where(is_stable(bound=bound))


def percentile_bounds(df: DataFrame, value: str, low: float, high: float) -> tuple[float, float]:
    """Two numbers for the whole table; one row comes back to the driver."""
    row = percentiles(df, value, {"low": low, "high": high}).first()
    return row["low"], row["high"]


def percentile_range(
    df: DataFrame,
    value: str = "avg",
    bounds: tuple[float, float] | None = None,
    low: float = OUTLIER_RANGE[0],
    high: float = OUTLIER_RANGE[1],
) -> DataFrame:
    """Keep ``low percentile <= value < high percentile``.  Known bounds of the
    corpus may be passed; the bounds are literals, so the scan can prune."""
    lo, hi = bounds or percentile_bounds(df, value, low, high)
    return df.where((F.col(value) >= lo) & (F.col(value) < hi))


def chain(
    df: DataFrame,
    flags: str = "110",
    time_lb: float | None = None,
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Latency, stability and percentile filters, switched by ``flags``."""
    if flags[0] == "1" and time_lb is not None:
        df = min_latency(df, time_lb)
    if flags[1] == "1":
        df = unstable(df)
    if flags[2] == "1":
        df = percentile_range(df, bounds=bounds)
    return df


def chain_mask(df: DataFrame, flags: str, time_lb: float, bounds: tuple[float, float]) -> DataFrame:
    """As ``chain`` but keeps every row and adds the boolean ``kept``."""
    kept = F.lit(True)
    if flags[0] == "1":
        kept = kept & (F.col("avg") >= time_lb)
    if flags[1] == "1":
        kept = kept & is_stable()
    if flags[2] == "1":
        kept = kept & (F.col("avg") >= bounds[0]) & (F.col("avg") < bounds[1])
    return df.withColumn("kept", kept)


def leaf_count(df: DataFrame, allowed: Sequence[int] = (5,), leaves: str = "leaves") -> DataFrame:
    return df.where(F.col(leaves).isin(list(allowed)))


def flop_bound(df: DataFrame, lower: float | None, upper: float | None) -> DataFrame:
    """Unknown work (-1) goes; then ``lower <= flops < upper``."""
    df = df.where(F.col("flops") != -1)
    if lower:
        df = df.where(F.col("flops") >= lower)
    if upper:
        df = df.where(F.col("flops") < upper)
    return df


def cost_range(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.where(F.col("avg").between(low, high) & is_stable())


def min_group_size(df: DataFrame, keys: str | Sequence[str], least: int = MIN_TASK_SAMPLES) -> DataFrame:
    """Drop groups with fewer than ``least`` rows.  Groups are counted with
    partial sums and semi-joined, so a hot group is not gathered."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return df.join(lookup(big.select(*keys)), keys, "left_semi")


def dims(df: DataFrame, keep: dict[str, Sequence]) -> DataFrame:
    """Membership per dimension; an empty list keeps all."""
    for name, values in keep.items():
        if values:
            df = df.where(F.col(name).isin(list(values)))
    return df


def dims_name(keep: dict[str, Sequence]) -> str:
    """Stable text of a dimension filter, for table names."""
    return "-".join(
        f"{d}_" + "_".join(sorted(str(v) for v in keep[d])) for d in sorted(keep) if keep[d]
    )


def entry_bounds(df: DataFrame, x: str, low: float, high: float) -> tuple[list, list]:
    """Per-entry percentiles as two lists; one row per array entry is read."""
    rows = percentiles(arrays.entries(df, x), "v", {"lo": low, "hi": high}, ["pos"]).collect()
    rows.sort(key=lambda r: r["pos"])
    return [r["lo"] for r in rows], [r["hi"] for r in rows]


def train_envelope(test: DataFrame, train: DataFrame, x: str = "features", between: tuple[float, float] = ENVELOPE_RANGE) -> DataFrame:
    """Keep test rows whose every entry lies between two percentiles of the
    train rows; entries where these are equal are ignored."""
    lo, hi = entry_bounds(train, x, *between)
    box = F.arrays_zip(F.col(x).alias("v"), arrays.literal(lo).alias("lo"), arrays.literal(hi).alias("hi"))
    return test.where(
        F.forall(box, lambda e: (e["lo"] == e["hi"]) | ((e["v"] >= e["lo"]) & (e["v"] <= e["hi"])))
    )


def _zscores(df: DataFrame, x: str) -> Column:
    rows = (
        arrays.entries(df, x).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    ).collect()
    rows.sort(key=lambda r: r["pos"])
    m, s = arrays.literal([r["m"] for r in rows]), arrays.literal([r["s"] for r in rows])
    gap = F.zip_with(F.col(x), m, lambda v, c: F.abs(v - c))
    return F.zip_with(gap, s, lambda g, d: g / (d + 1e-6))


def zscore_band(
    df: DataFrame, radii: Sequence[float], x: str = "features", check: str = "max", compat: bool = False
) -> DataFrame:
    """Rows inside the largest radius, with ``band`` = smallest radius they fit.

    ``check`` is ``max`` (every entry) or ``l1norm`` (mean over entries).  With
    ``compat`` the smaller radii use mean and spread of the rows kept first.
    """
    radii = sorted(radii, reverse=True)

    def fits(z: Column, r: float) -> Column:
        if check == "max":
            return F.forall(z, lambda v: v <= r)
        return arrays.mean(z) <= r

    z = _zscores(df, x)
    kept = df.where(fits(z, radii[0]))
    inner = _zscores(kept, x) if compat and len(radii) > 1 else z
    band = F.lit(float(radii[0]))
    for r in radii[1:]:
        band = F.when(fits(inner, r), F.lit(float(r))).otherwise(band)
    return kept.withColumn("band", band)
