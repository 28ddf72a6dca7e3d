"""Aggregations over samples, entries, operators and runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfspark.functions.numbers import ratio
from perfspark.functions import arrays
from perfspark.operators.ranking import add_rank, percentiles
from perfspark.runtime import lookup, materialize, small_side

# Percentiles kept for the label.
LABEL_PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]
# Upper bounds in ms of the operator time classes.
COST_BOUNDS = [0.01, 0.05, 0.06, 0.1, 0.5, 1, 5, 10, 100, 1000]
# Fixed values: (bad from, good below) pairs of the flip table.
FLIP_BOUNDS = [(0.2, 0.1), (0.2, 0.05), (0.3, 0.1), (0.4, 0.1), (0.5, 0.1)]


# ------------------------------------------------------------ corpus facts

def feature_stats(df: DataFrame, x: str = "features", eps: float = 0.0) -> DataFrame:
    """Smallest and largest value per entry (``eps`` is added to both)."""
    return arrays.entries(df, x).groupBy("pos").agg(
        (F.min("v") + eps).alias("min"), (F.max("v") + eps).alias("max")
    )


def label_stats(df: DataFrame, label: str = "avg") -> DataFrame:
    """One row: mean, population std, count and the kept percentiles."""
    ranks = percentiles(df, label, {f"p{p}": p / 100 for p in LABEL_PERCENTILES}).first()
    facts = df.agg(
        F.avg(label).alias("mean"), F.stddev_pop(label).alias("std"), F.count(label).alias("n")
    )
    return facts.select("*", *[F.lit(ranks[f"p{p}"]).alias(f"p{p}") for p in LABEL_PERCENTILES])


def label_range(df: DataFrame, label: str, first_tasks: int | None = None, task: str = "task_id") -> DataFrame:
    """Mean, min and max of the label, optionally of the first tasks by id."""
    if first_tasks:
        tasks = df.select(task).distinct().orderBy(task).limit(first_tasks)
        df = df.join(F.broadcast(tasks), task, "left_semi")
    return df.agg(F.avg(label).alias("mean"), F.min(label).alias("min"), F.max(label).alias("max"))


def entry_profile(df: DataFrame, group: str, x: str) -> DataFrame:
    """Per group and entry: mean cut at 0, population std, rows."""
    return arrays.entries(df, x, [group]).groupBy(group, "pos").agg(
        F.greatest(F.avg("v"), F.lit(0.0)).alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.count(F.lit(1)).alias("n"),
    )


# ------------------------------------------------------------- histograms

def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin; the upper edge belongs to the last bin; outside is null."""
    width = (high - low) / bins or 1.0  # one value: one bin
    raw = F.least(F.floor((value - low) / width), F.lit(bins - 1))
    return F.when((value >= low) & (value <= high), raw.cast("int"))


def value_range(df: DataFrame, value: str, low: float | None, high_percentile: float) -> tuple[float, float]:
    top = percentiles(df, value, {"p": high_percentile}).first()["p"]
    return (df.agg(F.min(value)).first()[0] if low is None else low), top


def histogram(df: DataFrame, value: str, bins: int, low: float | None = 0.0, high_percentile: float = 0.75) -> DataFrame:
    """Counts in equal bins from ``low`` (or the minimum) to a percentile."""
    lo, hi = value_range(df, value, low, high_percentile)
    return (
        df.select(_bin(F.col(value), lo, hi, bins).alias("bin"))
        .where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )


def histogram_2d(
    df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 100
) -> DataFrame:
    return (
        df.select(_bin(F.col(x), *x_range, bins).alias("xbin"), _bin(F.col(y), *y_range, bins).alias("ybin"))
        .where(F.col("xbin").isNotNull() & F.col("ybin").isNotNull())
        .groupBy("xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))
    )


def hist_equalize(df: DataFrame, label: str, id_col: str, bins: int = 10, least_bound: int = 100, seed: str = "0") -> DataFrame:
    """Equal counts per label bin.

    The target is the count of the first bin, lowered by any later bin with
    more than ``least_bound`` rows; smaller bins go, larger ones are sampled
    by hash order.  The largest label falls into an extra bin of its own.
    """
    lo, hi = df.agg(F.min(label), F.max(label)).first()
    binned = df.withColumn("bin", F.floor((F.col(label) - lo) / ((hi - lo) / bins or 1.0)))
    counts = sorted((r["bin"], r["count"]) for r in binned.groupBy("bin").count().collect())
    target = min([counts[0][1]] + [n for _, n in counts[1:] if n > least_bound])
    large = [b for b, n in counts if n >= target]
    order = [F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))), id_col]
    ranked = add_rank(binned.where(F.col("bin").isin(large)), order, ["bin"], "__r")
    return ranked.where(F.col("__r") <= target).drop("__r")


# ---------------------------------------------------------------- box plots

def box_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles, extremes and the 1.5 IQR whiskers per group."""
    q = percentiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    rows = df.select(*keys, F.col(value).alias("__v")).join(lookup(q), list(keys))
    return rows.groupBy(*keys, "q1", "median", "q3").agg(
        F.min("__v").alias("min"),
        F.max("__v").alias("max"),
        F.min(F.when(F.col("__v") >= F.col("q1") - reach, F.col("__v"))).alias("low_whisker"),
        F.max(F.when(F.col("__v") <= F.col("q3") + reach, F.col("__v"))).alias("high_whisker"),
        F.count("__v").alias("n"),
    )


def network_box_stats(samples: DataFrame, tasks: DataFrame, value: str) -> DataFrame:
    """Box statistics per network and for ``ALL`` networks together."""
    shares = tasks.select("network", "task_id").distinct()
    shares = shares.unionByName(shares.withColumn("network", F.lit("ALL"))).where("network IS NOT NULL")
    shares = shares.groupBy("network", "task_id").agg(F.count(F.lit(1)).alias("weight"))
    return shared_box_stats(samples, value, "task_id", shares, "network")


def shared_box_stats(df: DataFrame, value: str, part: str, shares: DataFrame, group: str, bins: int = 2000) -> DataFrame:
    """``box_stats`` of groups that are unions of parts, where a part may be in
    any number of groups: ``shares(group, part, weight)`` counts its rows
    ``weight`` times.

    No row is repeated for its groups.  Rows are counted per part and bin of
    values, and counts are added up to groups; values are looked at one by one
    only in the bins that hold a wanted place or a whisker's bound.
    """
    values = df.select(part, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    cuts = values.where(~F.isnan("__v")).agg(F.percentile_approx("__v", [i / bins for i in range(1, bins)], 10 * bins)).first()[0] or []
    edges = [-math.inf, *sorted({c + 0.0 for c in cuts if math.isfinite(c)}), math.inf]
    values = Bucketizer(splits=edges, inputCol="__v", outputCol="__bin", handleInvalid="keep").transform(values)
    values = materialize(values.withColumn("__bin", F.col("__bin").cast("int")))  # NaN is in a last bin of its own
    shares = lookup(shares)
    counts = values.groupBy(part, "__bin").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    counts = counts.join(shares, part).groupBy(group, "__bin").agg(
        F.sum(F.col("__n") * F.col("weight")).alias("__n"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.withColumns({"__before": F.coalesce(before, F.lit(0)), "__total": F.sum("__n").over(whole)}))

    def single(wanted: DataFrame) -> DataFrame:
        """The values in the wanted bins: group, bin, value, times."""
        wanted = materialize(wanted)
        asked = wanted.select(group, "__bin").join(shares, group).select(part, "__bin").distinct()
        rows = values.join(lookup(asked), [part, "__bin"]).groupBy(part, "__bin", "__v").agg(F.count(F.lit(1)).alias("__c"))
        rows = rows.join(shares, part).join(small_side(wanted), [group, "__bin"])
        return rows.groupBy(*wanted.columns, "__v").agg(F.sum(F.col("__c") * F.col("weight")).alias("__c"))

    places = {}
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = (F.col("__total") - 1) * F.lit(p)
        places[name] = (F.floor(at), at - F.floor(at))
    inside = lambda place, start, n: (place >= start) & (place < start + n)
    held = F.lit(False)
    for low, _ in places.values():
        held = held | inside(low, F.col("__before"), F.col("__n")) | inside(low + 1, F.col("__before"), F.col("__n"))
    order = Window.partitionBy(group, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    rows = single(counts.where(held).select(group, "__bin", "__before", "__total")).withColumn(
        "__start", F.col("__before") + F.coalesce(F.sum("__c").over(order), F.lit(0)))
    quartile = lambda low, rest: F.coalesce(
        F.sum(F.when(inside(low, F.col("__start"), F.col("__c")), F.col("__v") * (1 - rest))), F.lit(0.0)) + F.coalesce(
        F.sum(F.when(inside(low + 1, F.col("__start"), F.col("__c")), F.col("__v") * rest)), F.lit(0.0))
    quartiles = rows.groupBy(group).agg(*[quartile(*place).alias(name) for name, place in places.items()])

    reach = 1.5 * (F.col("q3") - F.col("q1"))
    bounded = counts.join(lookup(quartiles), group).withColumns({"__from": F.col("q1") - reach, "__to": F.col("q3") + reach})
    bounded = materialize(bounded)
    cut = ((F.col("__lo") < F.col("__from")) & (F.col("__hi") >= F.col("__from"))) | ((F.col("__lo") <= F.col("__to")) & (F.col("__hi") > F.col("__to")))
    ends = single(bounded.where(cut).select(group, "__bin", "__from", "__to")).groupBy(group).agg(
        F.min(F.when(F.col("__v") >= F.col("__from"), F.col("__v"))).alias("__low"),
        F.max(F.when(F.col("__v") <= F.col("__to"), F.col("__v"))).alias("__high"))
    kind = df.schema[value].dataType
    return bounded.groupBy(group, "q1", "median", "q3").agg(
        F.min("__lo").alias("min"), F.max("__hi").alias("max"),
        F.min(F.when(F.col("__lo") >= F.col("__from"), F.col("__lo"))).alias("__in_low"),
        F.max(F.when(F.col("__hi") <= F.col("__to"), F.col("__hi"))).alias("__in_high"),
        F.sum("__n").alias("n"),
    ).join(small_side(ends), group, "left").select(
        group, "q1", "median", "q3", F.col("min").cast(kind).alias("min"), F.col("max").cast(kind).alias("max"),
        F.least("__low", "__in_low").cast(kind).alias("low_whisker"), F.greatest("__high", "__in_high").cast(kind).alias("high_whisker"), "n")


# ----------------------------------------------------------- device, task

def device_task_means(df: DataFrame, label: str = "avg") -> DataFrame:
    return df.groupBy("device", "task_id").agg(F.avg(label).alias("mean"))


def device_ratio(means: DataFrame, base: str) -> DataFrame:
    """Task mean on a device over ``1e-6 +`` its mean on the base device."""
    b = means.where(F.col("device") == base).select("task_id", F.col("mean").alias("base_mean"))
    return means.join(b, "task_id").withColumn("ratio", F.col("mean") / (F.lit(1e-6) + F.col("base_mean")))


def per_task_report(df: DataFrame, ape: Column, first: int, label: str = "label") -> DataFrame:
    """Per task mean label, work (null if not unique), error; the ``first``
    best and worst by error.  Tasks without an error are left out."""
    tasks = df.groupBy("task_id").agg(
        F.avg(label).alias("mean"),
        F.when(F.min("flops") == F.max("flops"), F.min("flops")).alias("flops"),
        F.avg(ape).alias("error"),
    ).where(F.col("error").isNotNull())
    ranked = add_rank(tasks, ["error", "task_id"], (), "place", "__n")
    keep = (F.col("place") <= first) | (F.col("place") > F.col("__n") - first)
    return ranked.where(keep).drop("__n")


def network_task_errors(
    tasks: DataFrame, records: DataFrame, ape: Column, leaves: Sequence[int], low: float, high: float
) -> DataFrame:
    """Error per task of a network, or the reason why there is none."""
    in_range = F.col("avg").between(low, high)
    fits = in_range & F.col("leaves").isin(list(leaves))
    per_task = records.groupBy("task_id").agg(
        F.count_if(in_range).alias("in_range"), F.count_if(fits).alias("fits"), F.avg(F.when(fits, ape)).alias("error")
    )
    return tasks.join(per_task, "task_id", "left").select(
        "task_id",
        "error",
        F.when(F.coalesce("in_range", F.lit(0)) == 0, "cost_range")
        .when(F.col("fits") == 0, "leaf_count").alias("reason"),
    )


# ------------------------------------------------------------- operators

def scaler_bounds(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.greatest(F.max(c), F.lit(1.0)).alias(c) for c in cols]).first()
    return {c: float(row[c]) for c in cols}


def combine_bounds(a: dict[str, float], b: dict[str, float]) -> dict[str, float]:
    return {c: max(a.get(c, 1.0), b.get(c, 1.0)) for c in {*a, *b}}


def scale_columns(df: DataFrame, cols: Sequence[str], bounds: dict[str, float] | None = None, back: bool = False) -> DataFrame:
    """Divide columns by ``max(1, largest value)``, or multiply ``back``."""
    bounds = bounds or scaler_bounds(df, cols)
    scaled = {c: F.col(c) * F.lit(bounds[c]) if back else F.col(c) / F.lit(bounds[c]) for c in cols}
    return df.withColumns(scaled)


def group_id(dims: Sequence) -> Column:
    """``dim=value/...``; a dimension may be ``(name, "//", step)``."""
    parts = []
    for d in dims:
        if isinstance(d, str):
            parts.append(F.concat(F.lit(f"{d}="), F.col(d).cast("string")))
        else:
            name, _, step = d
            parts.append(F.concat(F.lit(f"{name}//{step}="), F.floor(F.col(name) / step).cast("string")))
    return F.concat_ws("/", *parts)


def op_time_stats(events: DataFrame, name: str, time: str, order: Sequence[str]) -> DataFrame:
    """Count, mean, median, std per operator; a noisy one (std/mean > 0.1)
    drops its first run from mean and std."""
    first = F.min_by(F.col(time), F.struct(*order))
    base = events.groupBy(name).agg(
        F.count(time).alias("cnt"), F.avg(time).alias("avg"), F.stddev_pop(time).alias("std"), first.alias("first")
    )
    median = percentiles(events, time, {"median": 0.5}, [name])
    n, a, s, f = (F.col(c) for c in ("cnt", "avg", "std", "first"))
    rest_avg = (n * a - f) / (n - 1)
    # Variance without one value from mean and variance of all.
    rest_var = F.greatest(n / (n - 1) * s * s - n / ((n - 1) * (n - 1)) * (f - a) * (f - a), F.lit(0.0))
    noisy = F.coalesce(ratio(s, a) > 0.1, F.lit(False)) & (n > 1)
    return base.join(median, name).select(
        name, "cnt", "median",
        F.when(noisy, rest_avg).otherwise(a).alias("avg"),
        F.when(noisy, F.sqrt(rest_var)).otherwise(s).alias("std"),
    )


def iteration_time(events: DataFrame, step: str, ts_us: str, dur: str, order: Sequence[str]) -> DataFrame:
    """Mean iteration time in ms: start of the first event to the end of the
    last event of a step; the last step is open and not counted."""
    seq = F.struct(*order)
    steps = events.where(F.col(step).isNotNull()).groupBy(step).agg(
        F.min_by(ts_us, seq).alias("start"), F.max_by(F.col(ts_us) + F.col(dur), seq).alias("end"),
        F.count(F.lit(1)).alias("n"),
    )
    first, last = steps.agg(F.min(step), F.max(step)).first()
    # The first step has no end when it holds a single event.
    end = F.when((F.col(step) == first) & (F.col("n") == 1), None).otherwise(F.col("end"))
    return steps.where(F.col(step) != last).agg(
        F.avg((end - F.col("start")) / 1000).alias("iter_time"), F.count(F.lit(1)).alias("steps")
    )


def cost_cdf(stats: DataFrame, time: str = "avg", bounds: Sequence[float] = COST_BOUNDS) -> DataFrame:
    """Share and running share of count and time per time class.  The classes
    are fixed, so the running sums are conditional sums over one aggregation."""
    aggs = [F.count_if(F.col(time) <= bounds[-1]).alias("n"), F.sum(F.when(F.col(time) <= bounds[-1], F.col(time))).alias("t")]
    for i, b in enumerate(bounds):
        here = F.col(time) <= b
        aggs += [F.count_if(here).alias(f"n{i}"), F.coalesce(F.sum(F.when(here, F.col(time))), F.lit(0.0)).alias(f"t{i}")]
    one = stats.agg(*aggs)
    rows = []
    for i, b in enumerate(bounds):
        pn = F.col(f"n{i - 1}") if i else F.lit(0)
        pt = F.col(f"t{i - 1}") if i else F.lit(0.0)
        rows.append(F.struct(
            F.lit(float(b)).alias("bound"),
            ratio(F.col(f"n{i}") - pn, F.col("n")).alias("share_n"), ratio(F.col(f"t{i}") - pt, F.col("t")).alias("share_t"),
            ratio(F.col(f"n{i}"), F.col("n")).alias("cum_n"), ratio(F.col(f"t{i}"), F.col("t")).alias("cum_t"),
        ))
    return one.select(F.inline(F.array(*rows)))


def kernel_summary(rows: DataFrame, categories: dict[str, str], name: str = "name") -> DataFrame:
    """Per name category: time share, total, calls, mean, extremes (ns -> us,
    one digit).  A row counts for every category whose pattern it contains."""
    hits = F.array_compact(F.array(*[F.when(F.col(name).rlike(p), F.lit(c)) for c, p in categories.items()]))
    us = lambda c: F.round(c / 1000, 1)
    return rows.select("*", F.explode(hits).alias("category")).groupBy("category").agg(
        F.round(F.sum("percent"), 1).alias("percent"),
        us(F.sum("total")).alias("total_us"),
        F.sum("calls").alias("calls"),
        us(ratio(F.sum("total"), F.sum("calls"))).alias("avg_us"),
        us(F.min("low")).alias("min_us"),
        us(F.max("high")).alias("max_us"),
        F.count(F.lit(1)).alias("kernels"),
    )


def precision(rows: DataFrame, half: str, keys: Sequence[str] = (), name: str = "name") -> DataFrame:
    """FP16 if any kernel name fits the pattern, else FP32."""
    return rows.groupBy(*keys).agg(
        F.when(F.bool_or(F.col(name).rlike(half)), "FP16").otherwise("FP32").alias("precision")
    )


def single_task_check(records: DataFrame, file: str, key: str = "workload_key") -> DataFrame:
    """Is there one workload key per file?  Two extremes decide it."""
    return records.groupBy(file).agg((F.min(key) == F.max(key)).alias("single"), F.count(F.lit(1)).alias("n"))


def compare_two_sets(a: DataFrame, b: DataFrame, cols: Sequence[str], row: str) -> DataFrame:
    """Per column: mean absolute difference by row, difference of the means,
    and rows without a partner."""
    left = a.select(row, *[F.col(c).alias("__a_" + c) for c in cols])
    right = b.select(row, *[F.col(c).alias("__b_" + c) for c in cols])
    one = left.join(right, row, "full").agg(
        F.count_if(F.col("__a_" + cols[0]).isNull() | F.col("__b_" + cols[0]).isNull()).alias("unmatched"),
        *[F.avg(F.abs(F.col("__a_" + c) - F.col("__b_" + c))).alias("d_" + c) for c in cols],
        *[F.abs(F.avg("__a_" + c) - F.avg("__b_" + c)).alias("m_" + c) for c in cols],
    )
    return one.select(
        "unmatched",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col("d_" + c).alias("mean_abs_diff"), F.col("m_" + c).alias("diff_of_means"))
            for c in cols
        ])),
    )


def func_time(pairs: DataFrame, name: str, dur: str, kinds: Sequence[str]) -> DataFrame:
    """Mean duration per function of the given kinds, and their sum."""
    means = pairs.where(F.col(name).rlike("|".join(kinds))).groupBy(name).agg(F.avg(dur).alias("mean"))
    return means


# ---------------------------------------------------------------- reports

def leaf_count_dist(df: DataFrame, leaves: str, tree: str) -> DataFrame:
    """Frequency by leaf count and node count, and the number of equal trees."""
    return df.groupBy(
        F.col(leaves).alias("leaves"), (F.array_max(tree) + 1).alias("nodes")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.array_join(F.col(tree).cast("array<string>"), ",")).alias("trees"))


def learnability(df: DataFrame, group: str, id_col: str, x: str, y: str, pairs: int | None = None, skip: Sequence[int] = (), seed: str = "0") -> DataFrame:
    """Norm of ``|dy|/(|dx|+1e-6)`` for random row pairs of a group.

    Rows are put in hash order and neighbours paired, so every row is used
    once; ``pairs`` keeps that many per group.
    """
    order = [F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))), F.col(id_col)]
    ranked = add_rank(df.select(group, id_col, x, y), order, [group], "__r")
    if pairs:
        ranked = ranked.where(F.col("__r") <= 2 * pairs)
    both = ranked.groupBy(group, F.floor((F.col("__r") - 1) / 2).alias("pair")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(x, "__r").alias("x1"), F.max_by(x, "__r").alias("x2"),
        F.min_by(y, "__r").alias("y1"), F.max_by(y, "__r").alias("y2"),
    ).where("n = 2")
    dy = F.abs(F.col("y2") - F.col("y1"))
    slopes = F.zip_with("x1", "x2", lambda a, b: dy / (F.abs(b - a) + 1e-6))
    if skip:
        slopes = F.filter(slopes, lambda v, i: ~i.isin([int(s) for s in skip]))
    norm = F.sqrt(F.aggregate(slopes, F.lit(0.0), lambda s, v: s + v * v))
    return both.select(group, "pair", norm.alias("norm"))


def best_run(log: DataFrame, file: str, error: str = "mape") -> DataFrame:
    """The log row with the smallest error per file (first step on ties)."""
    cols = [c for c in log.columns if c not in (file, error, "step")]
    row = F.min(F.struct(error, "step", *cols)).alias("b")
    return log.groupBy(file).agg(row).select(file, "b.*")


def result_pivot(runs: DataFrame, row: str, column: str, values: Sequence, value: str, sample_num: int | None = None) -> DataFrame:
    """One row per device, one column per variant; a missing result is 0."""
    if sample_num is not None:
        runs = runs.where(F.col("sample_num") == sample_num)
    return runs.groupBy(row).pivot(column, list(values)).agg(F.max(value)).na.fill(0.0)


def network_latency(tasks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total in ms: cost x weight; a predicted cost is scaled by profile over
    recorded time when both are known."""
    scale = F.when(
        (F.col("cost_src") == "T_predict") & (F.col("t_record") > 0) & (F.col("t_profile") > 0),
        F.col("t_profile") / F.col("t_record"),
    ).otherwise(F.lit(1.0))
    return tasks.groupBy(*keys).agg((F.sum(F.col("cost") * scale * F.col("weight")) * 1000).alias("latency_ms"))


def end2end_error(totals: DataFrame, truth: str, others: Sequence[str]) -> DataFrame:
    """Relative error of each estimate of a total against the measured one."""
    return totals.withColumns({f"{o}_error": ratio(F.abs(F.col(o) - F.col(truth)), F.col(truth)) for o in others})


def flip_table(df: DataFrame, before: str, after: str, bounds: Sequence[tuple[float, float]] = FLIP_BOUNDS) -> DataFrame:
    """Per bound pair: good / middle / bad counts of two error columns and the
    rows that go from bad to good.  One aggregation serves all bounds."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (bad, good) in enumerate(bounds):
        for p, c in (("b", before), ("a", after)):
            aggs += [
                F.count_if(F.col(c) < good).alias(f"{p}{i}_good"),
                F.count_if((F.col(c) >= good) & (F.col(c) < bad)).alias(f"{p}{i}_mid"),
                F.count_if(F.col(c) >= bad).alias(f"{p}{i}_bad"),
            ]
        aggs.append(F.count_if((F.col(before) >= bad) & (F.col(after) < good)).alias(f"flip{i}"))
    rows = [
        F.struct(
            F.lit(good).alias("good_below"), F.lit(bad).alias("bad_from"),
            *[F.col(f"{p}{i}_{k}").alias(f"{n}_{k}") for p, n in (("b", "before"), ("a", "after")) for k in ("good", "mid", "bad")],
            F.col(f"flip{i}").alias("flips"), ratio(F.col(f"flip{i}"), F.col("rows")).alias("flip_ratio"),
        )
        for i, (bad, good) in enumerate(bounds)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def cluster_error_summary(errors: DataFrame, clustering: str, error: str = "error") -> DataFrame:
    return errors.groupBy(clustering).agg(
        F.avg(error).alias("average"), F.max(error).alias("maximum"), F.count(F.lit(1)).alias("clusters")
    )


def invalid_flops_by_network(tasks: DataFrame) -> DataFrame:
    """Networks and their tasks with unknown work; ``place`` 1 has the most.
    ``tasks``: ``task_id``, ``flops``, ``networks`` (array of text)."""
    bad = tasks.where(F.col("flops") == -1)
    found = bad.select(F.explode("networks").alias("network"), "task_id").groupBy("network").agg(
        F.sort_array(F.collect_set("task_id")).alias("tasks"))
    counted = found.withColumn("invalid_tasks", F.size("tasks").cast("bigint"))
    return add_rank(counted.withColumn("__least", -F.col("invalid_tasks")), ["__least", "network"], (), "place").drop("__least")


def log_flops(flops: str = "flops") -> Column:
    return F.log10(F.greatest(F.col(flops), F.lit(1.0)))


def op_type_coverage(source: DataFrame, target: DataFrame, col: str = "op_type") -> DataFrame:
    """Operator types in source, in target, only in target, in both."""
    a = source.select(F.col(col).alias("t")).distinct().withColumn("s", F.lit(True))
    b = target.select(F.col(col).alias("t")).distinct().withColumn("g", F.lit(True))
    return a.join(b, "t", "full").agg(
        F.count("s").alias("in_source"), F.count("g").alias("in_target"),
        F.count_if(F.col("s").isNull()).alias("target_only"),
        F.count_if(F.col("s").isNotNull() & F.col("g").isNotNull()).alias("common"),
    )
