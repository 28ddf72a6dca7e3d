"""Equal and almost equal feature vectors, without listing pairs.

Every result is built from counts and sums per group, so a group of copies
that holds a large part of the table is merged on the map side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfspark.functions.numbers import ratio
from perfspark.functions import arrays
from perfspark.operators.ranking import add_rank, drop_halo, in_blocks, percentiles
from perfspark.runtime import lookup, materialize

# Fixed value: relative label gap from which copies count as conflicting.
CONFLICT_RATIO = 0.05
# Percentiles kept of the gaps between copies.
GAP_PERCENTILES = [5, 10, 25, 50, 75, 90, 95]
#: Different labels of a key that are compared in one row.
FEW_LABELS = 256
#: Step of the quadrature, and blocks of labels that are merged at once.
STEP, MERGED = 0.35, 64


def _pairs(n):
    return n * (n - 1) / 2


def conflicting(df: DataFrame, x: str = "x", y: str = "y", bound: float = CONFLICT_RATIO) -> DataFrame:
    """Drop rows that have a copy with a label larger by the bound.

    The ratio grows with the other label, so comparing with the largest label
    of the copies decides for all of them.
    """
    top = df.groupBy(x).agg(F.max(y).alias("__top"))
    gap = ratio(2 * (F.col("__top") - F.col(y)), F.col("__top") + F.col(y))
    return df.join(lookup(top), x).where(~F.coalesce(gap >= bound, F.lit(False))).drop("__top")


def conflicting_between(kept: DataFrame, later: DataFrame, x: str = "x", y: str = "y", bound: float = CONFLICT_RATIO) -> DataFrame:
    """Rows of ``later`` without a conflicting larger copy in ``kept``."""
    top = kept.groupBy(x).agg(F.max(y).alias("__top"))
    gap = ratio(2 * (F.col("__top") - F.col(y)), F.col("__top") + F.col(y))
    return later.join(lookup(top), x, "left").where(~F.coalesce(gap >= bound, F.lit(False))).drop("__top")


def duplicate_groups(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Per vector with copies: rows, labels, pairs with equal and with different
    labels, and the largest relative gap.  Labels are shifted to start at 0."""
    low = df.agg(F.min(y)).first()[0]
    labels = df.groupBy(x, (F.col(y) - F.lit(low)).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    groups = labels.groupBy(x).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("labels"),
        F.sum(_pairs(F.col("n"))).cast("bigint").alias("same_y_pairs"),
        F.min("y").alias("low"),
        F.max("y").alias("high"),
    ).where(F.col("rows") > 1)
    return groups.withColumn(
        "diff_y_pairs", (_pairs(F.col("rows")) - F.col("same_y_pairs")).cast("bigint")
    ).withColumn(
        "max_ratio",
        F.when(F.col("labels") > 1, 2 * (F.col("high") - F.col("low")) / (F.col("high") + F.col("low"))),
    ).drop("low", "high")


def mean_gaps(df: DataFrame, x: str = "x", y: str = "y", block: int = 1024) -> DataFrame:
    """Per vector whose copies differ in their labels: those pairs, and the
    mean of their relative gaps ``2|a-b|/(a+b)``."""
    sizes = df.groupBy(x, F.col(y).alias("__y")).agg(F.count(F.lit(1)).alias("n")).groupBy(x).agg(
        (_pairs(F.sum("n")) - F.sum(_pairs(F.col("n")))).cast("bigint").alias("diff_y_pairs")).where("diff_y_pairs > 0")
    return sizes.join(label_gap_sums(df, [x], y, block), x).select(
        x, "diff_y_pairs", (F.col("gap_sum") / F.col("diff_y_pairs")).alias("mean_gap"))


def gap_distribution(gaps: DataFrame) -> DataFrame:
    """One row: extremes and percentiles of the groups' mean gaps."""
    points = {f"p{p}": p / 100 for p in GAP_PERCENTILES}
    return percentiles(gaps, "mean_gap", {"low": 0.0, **points, "high": 1.0})


def quadrature(ratio_: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates t and weights w with ``1/s = sum(w exp(-t s))`` to a relative error
    of 1e-10 for all s from 1 to ``ratio_``: the trapezoidal rule for
    ``1/s = integral of exp(u - s exp(u))``, whose error falls with
    ``exp(-pi^2 / step)``, between places where the tails are as small."""
    u = np.arange(math.log(1e-11 / ratio_), math.log(26.0) + STEP, STEP)
    return np.exp(u), STEP * np.exp(u)


def _sums(sums: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> float:
    """``sum (b - a) / (a + b)`` over pairs of elements of different parts, from
    each part's ``(sum n exp(-t y), sum n y exp(-t y))``, parts in order."""
    zero, one = np.array([s[0] for s in sums]), np.array([s[1] for s in sums])
    before0, before1 = np.cumsum(zero, axis=0) - zero, np.cumsum(one, axis=0) - one
    return float(((one * before0 - zero * before1) @ weights).sum())


def label_gap_sums(df: DataFrame, keys: Sequence[str], y: str, block: int = 1024, few: int = FEW_LABELS) -> DataFrame:
    """Per key the sum of ``2|a-b|/(a+b)`` over all pairs of rows.

    Equal labels are merged with their counts.  Keys with few different labels
    are summed where they are.  For the others ``1/(a+b)`` is a short sum of
    products of exponentials, so the pairs across two parts of the ordered
    labels need only sums over each part: blocks of ranked labels become two
    vectors each, and neighbouring blocks are merged, a few levels high.  Work
    is near-linear in the labels, the relative error below 1e-9.  Keys with a
    label below zero have no such sums; their blocks meet block by block.
    """
    keys = list(keys)
    labels = df.groupBy(*keys, F.col(y).alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    labels = materialize(labels)
    sizes = lookup(labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__m"), F.min("__y").alias("__low"), F.max("__y").alias("__high")))
    sized = labels.join(sizes, keys)
    gathered = sized.where(F.col("__m") <= few).groupBy(*keys).agg(F.collect_list(F.struct("__y", "__n")).alias("__l"))
    gap = lambda p, q: F.when(q["__y"] > p["__y"], F.coalesce(
        ratio(2 * (q["__y"] - p["__y"]), p["__y"] + q["__y"]), F.lit(0.0)) * p["__n"] * q["__n"]).otherwise(0.0)
    in_row = gathered.select(*keys, F.aggregate("__l", F.lit(0.0), lambda s, p: s + F.aggregate(
        "__l", F.lit(0.0), lambda t, q: t + gap(p, q))).alias("gap_sum"))
    many = sized.where((F.col("__m") > few) & F.col("__y").isNotNull())
    out = in_row
    if not many.where("__low < 0").isEmpty():
        out = out.unionByName(_gaps_by_blocks(many.where("__low < 0"), df, keys, block))
    if not many.where("__low >= 0").isEmpty():
        out = out.unionByName(_gaps_by_sums(many.where("__low >= 0"), df, keys, block))
    return out


def _gaps_by_sums(many: DataFrame, df: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Gap sums of keys whose labels are not negative."""
    ranked = materialize(add_rank(many, ["__y"], keys, "__r", "__size"))
    # the least sum of two different labels scales all sums of a key
    least = ranked.where("__r <= 2").groupBy(*keys).agg(F.sum("__y").alias("__least"))
    rows = ranked.join(lookup(least), keys).select(
        *keys, F.floor((F.col("__r") - 1) / block).alias("__b"), "__y", "__n", "__least", "__low", (2 * F.col("__high")).alias("__most"))
    kinds = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    schema = kinds + ", __b bigint, __least double, __most double, zero array<double>, one array<double>, inside double"

    def summed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__y")
        least_, most, low = (float(part[c].iloc[0]) for c in ("__least", "__most", "__low"))
        t, w = quadrature(most / least_)
        values, n = part["__y"].to_numpy(np.float64), part["__n"].to_numpy(np.float64)[:, None]
        zero = n * np.exp(-np.outer(values / least_, t))
        one = zero * (values - low)[:, None]  # differences need no common offset
        inside = _sums(list(zip(zero, one)), w) / least_
        return pd.DataFrame([[*key, least_, most, zero.sum(axis=0).tolist(), one.sum(axis=0).tolist(), inside]],
                            columns=[*keys, "__b", "__least", "__most", "zero", "one", "inside"])

    def merged(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("__b")
        least_, most = float(parts["__least"].iloc[0]), float(parts["__most"].iloc[0])
        zero, one = np.stack(parts["zero"].to_numpy()), np.stack(parts["one"].to_numpy())
        inside = float(parts["inside"].sum()) + _sums(list(zip(zero, one)), quadrature(most / least_)[1]) / least_
        return pd.DataFrame([[*key, least_, most, zero.sum(axis=0).tolist(), one.sum(axis=0).tolist(), inside]],
                            columns=[*keys, "__b", "__least", "__most", "zero", "one", "inside"])

    parts = materialize(rows.groupBy(*keys, "__b").applyInPandas(summed, schema))
    blocks = -(-(many.agg(F.max("__m")).first()[0] or 1) // block)
    while blocks > 1:
        upper = parts.withColumn("__up", F.floor(F.col("__b") / MERGED)).groupBy(*keys, "__up")
        parts = materialize(upper.applyInPandas(merged, schema))
        blocks = -(-blocks // MERGED)
    return parts.select(*keys, (2 * F.col("inside")).alias("gap_sum"))


def _gaps_by_blocks(many: DataFrame, df: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Gap sums of keys with negative labels, where a sum of two labels may
    have either sign."""
    ranked = add_rank(many.select(*keys, "__y", "__n"), ["__y"], keys, "__r", "__size")
    own = F.floor((F.col("__r") - 1) / block)
    last = F.floor((F.col("__size") - 1) / block)
    left = ranked.withColumn("__i", own).withColumn("__j", F.explode(F.sequence(own, last)))
    right = ranked.withColumn("__j", own).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), own)))
    by = [*keys, "__i", "__j"]

    def total(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        p, q = a["__y"].to_numpy(), b["__y"].to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            gap = np.nan_to_num(2 * np.abs(p[:, None] - q[None, :]) / (p[:, None] + q[None, :]))
        weight = a["__n"].to_numpy()[:, None] * b["__n"].to_numpy()[None, :]
        if key[-1] == key[-2]:
            weight = np.triu(weight, 1)
        return pd.DataFrame([[*key[:-2], float((gap * weight).sum())]], columns=[*keys, "part"])

    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", part double"
    cols = [*by, "__y", "__n"]
    right = right.select(*[F.col(c).alias(c) for c in cols])
    parts = left.select(*cols).groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(total, schema)
    return parts.groupBy(*keys).agg(F.sum("part").alias("gap_sum"))


def one_entry_differs(df: DataFrame, x: str = "x", y: str = "y", id_col: str = "sample_id") -> DataFrame:
    """Per entry: pairs of rows that agree everywhere else, how many of them
    have equal labels, and the label slope over all such pairs.

    A row's key at an entry is the exclusive or of the hashes of all its other
    entries with their places: 16 bytes, from one hash of the whole row and one
    for the entry.  Real vectors are compared only where rows meet in a key, and
    rows of a key whose vectors differ are parted by them.  Inside a key, pairs
    are counted from group sizes, and sums of ``dx*dy`` and ``dx*dx`` over all
    pairs equal ``n`` times the centred sums, so no pair is formed.
    """
    rows = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    by = ["entry", "k1", "k2"]
    placed = lambda seed: F.transform("x", lambda v, i: F.xxhash64(F.lit(seed), i, v))
    hashes = [placed(1), placed(2)]
    whole = [F.aggregate(h, F.lit(0).cast("bigint"), lambda t, v: t.bitwiseXOR(v)) for h in hashes]
    keyed = rows.select("row", "y", "n", "x", *[c.alias(f"w{i}") for i, c in enumerate(whole)], *[c.alias(f"h{i}") for i, c in enumerate(hashes)])
    at = F.transform("x", lambda v, i: F.struct(i.alias("entry"), F.col("w0").bitwiseXOR(F.get("h0", i)).alias("k1"),
                                                F.col("w1").bitwiseXOR(F.get("h1", i)).alias("k2"), v.alias("v")))
    wide = keyed.select("row", "y", "n", F.inline(at))
    shared = wide.groupBy(*by).agg(F.min("v").alias("p"), F.max("v").alias("q")).where("p <> q").select(*by)
    met = materialize(wide.join(lookup(shared), by))
    rest = arrays.without(F.col("x"), F.col("entry"))
    together = met.join(rows.select("row", "x"), "row").groupBy(*by).agg(F.min(rest).alias("p"), F.max(rest).alias("q"))
    apart = materialize(together.where("p <> q").select(*by))
    cells = met.drop("row").withColumn("rest", F.lit(""))
    if not apart.isEmpty():  # different vectors with one key
        own = met.join(apart, by).join(rows.select("row", "x"), "row").withColumn("rest", F.to_json(rest)).drop("row", "x")
        cells = cells.join(apart, by, "left_anti").unionByName(own)
    by = [*by, "rest"]
    cells = cells.groupBy(*by, "v", "y").agg(F.sum("n").alias("n"))
    cells = materialize(cells.withColumns({"nv": F.col("n") * F.col("v"), "ny": F.col("n") * F.col("y")}))

    def pair_count(*cols):
        sums = cells.groupBy(*by, *cols).agg(F.sum("n").alias("m"))
        return sums.groupBy(*by).agg(F.sum(_pairs(F.col("m"))).alias("p"))

    per_group = cells.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.sum("nv").alias("sv"), F.sum("ny").alias("sy"),
        F.sum(F.col("nv") * F.col("v")).alias("svv"), F.sum(F.col("nv") * F.col("y")).alias("svy"),
        F.sum(_pairs(F.col("n"))).alias("same_both"),
    )
    out = (
        per_group.join(pair_count("v").withColumnRenamed("p", "same_v"), by)
        .join(pair_count("y").withColumnRenamed("p", "same_y"), by)
        .withColumn("pairs", _pairs(F.col("rows")) - F.col("same_v"))
        .withColumn("useless", F.col("same_y") - F.col("same_both"))
        .withColumn("dxx", F.col("rows") * F.col("svv") - F.col("sv") * F.col("sv"))
        .withColumn("dxy", F.col("rows") * F.col("svy") - F.col("sv") * F.col("sy"))
    )
    return out.groupBy("entry").agg(
        F.sum("pairs").cast("bigint").alias("pairs"),
        F.sum("useless").cast("bigint").alias("same_label_pairs"),
        F.try_divide(F.sum("dxy"), F.sum("dxx")).alias("slope"),
    )


def neighbour_slopes(df: DataFrame, entry: int, x: str = "x", y: str = "y") -> DataFrame:
    """Partial derivatives along one entry: mean label per value of the entry,
    difference quotient to the next value with all other entries equal."""
    v = F.element_at(F.col(x), entry + 1)
    means = df.groupBy(
        arrays.without(F.col(x), F.lit(entry)).alias("rest"), v.alias("v")
    ).agg(F.avg(y).alias("y"))
    blocks, step = in_blocks(add_rank(means, ["v"], ["rest"], "__r"), ["rest"], "__r", after=1)
    out = drop_halo(blocks.withColumns({"v2": F.lead("v").over(step), "y2": F.lead("y").over(step)})).drop("__r")
    return out.where(F.col("v2").isNotNull()).withColumn("slope", (F.col("y2") - F.col("y")) / (F.col("v2") - F.col("v")))


def same_x_across_devices(df: DataFrame, n_devices: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Per task, vector and device pair (first < second): label pairs that
    differ, and both label ranges.  Counts come from (device, label) groups."""
    if n_devices:
        from perfspark.operators.joins import tasks_on_all

        df = df.join(tasks_on_all(df, n_devices), "task_id", "left_semi")
    labels = df.groupBy("task_id", x, "device", F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    per_device = labels.groupBy("task_id", x, "device").agg(
        F.sum("n").alias("rows"), F.min("y").alias("low"), F.max("y").alias("high")
    )
    def side(d, p, keys):
        return d.select(*keys, *[F.col(c).alias(p + c) for c in d.columns if c not in keys])

    keys = ["task_id", x]
    pair = side(per_device, "a_", keys).join(side(per_device, "b_", keys), keys).where("a_device < b_device")
    with_label = [*keys, "y"]
    equal = (
        side(labels, "a_", with_label).join(side(labels, "b_", with_label), with_label)
        .where("a_device < b_device")
        .groupBy(*keys, "a_device", "b_device")
        .agg(F.sum(F.col("a_n") * F.col("b_n")).alias("equal_pairs"))
    )
    out = pair.join(equal, ["task_id", x, "a_device", "b_device"], "left")
    return out.withColumn(
        "diff_pairs", F.col("a_rows") * F.col("b_rows") - F.coalesce("equal_pairs", F.lit(0))
    ).drop("equal_pairs").where("diff_pairs > 0")
