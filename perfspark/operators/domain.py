"""How far two groups of feature vectors differ."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfspark.functions import arrays
from perfspark.operators import kernel_sums
from perfspark.runtime import lookup, materialize

# Moments used, kernel widths.
MOMENTS = 5
RBF_SCALES = (1.0, 0.1, 0.001)
#: Largest error of the discrepancy.
MMD_ERROR = 1e-9


def entry_means(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    return arrays.entries(df, x, list(group)).groupBy(*group, "pos").agg(F.avg("v").alias("m1"))


def central_moments(df: DataFrame, group: Sequence[str], x: str, k: int = MOMENTS) -> DataFrame:
    """Per group and entry: mean ``m1`` and central moments ``m2..mk``.

    Two passes keep it stable: means first, then powers of the centred values.
    """
    group = list(group)
    means = materialize(entry_means(df, group, x))
    vec = means.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m1"))), lambda s: s["m1"]).alias("__mu")
    )
    if group:
        centred = df.select(*group, x).join(lookup(vec, 20_000), group)
    else:
        centred = df.select(x, arrays.literal(vec.first()["__mu"]).alias("__mu"))
    centred = centred.withColumn("__c", F.zip_with(x, "__mu", lambda v, m: v - m))
    powers = arrays.entries(centred, "__c", group).groupBy(*group, "pos").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.pow("v", F.lit(i))).alias(f"m{i}") for i in range(2, k + 1)],
    )
    return powers.join(means, [*group, "pos"])


def _norms(joined: DataFrame, group: Sequence[str], k: int, bound: float) -> DataFrame:
    parts = [
        F.sqrt(F.sum((F.col(f"a_m{i}") - F.col(f"b_m{i}")) ** 2)) / (bound**i if i > 1 else bound)
        for i in range(1, k + 1)
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return joined.groupBy(*group).agg(parts[0].alias("centroid"), total.alias("cmd"))


def _renamed(m: DataFrame, prefix: str, k: int) -> list:
    return [F.col(f"m{i}").alias(f"{prefix}_m{i}") for i in range(1, k + 1)]


def cmd(a: DataFrame, b: DataFrame, x: str = "x", k: int = MOMENTS, bound: float = 1.0) -> DataFrame:
    """One row: L2 distance of the means, and the central moment discrepancy."""
    ma = central_moments(a, [], x, k).select("pos", *_renamed(a, "a", k))
    mb = central_moments(b, [], x, k).select("pos", *_renamed(b, "b", k))
    return _norms(ma.join(mb, "pos"), [], k, bound)


def cmd_by_group(groups: DataFrame, base: DataFrame, group: str, x: str = "x", k: int = MOMENTS, bound: float = 1.0) -> DataFrame:
    """Per group: distance of its rows to the base rows."""
    mg = central_moments(groups, [group], x, k).select(group, "pos", *_renamed(groups, "a", k))
    mb = central_moments(base, [], x, k).select("pos", *_renamed(base, "b", k))
    return _norms(mg.join(F.broadcast(mb), "pos"), [group], k, bound)  # one row per entry


def power_sums(df: DataFrame, group: Sequence[str], x: str, centre: Sequence[float], k: int = MOMENTS) -> DataFrame:
    """Per group and entry: rows and sums of powers about a common centre.
    These add up and subtract, so groups can be combined or removed."""
    moved = df.select(*group, F.zip_with(x, arrays.literal(centre), lambda v, c: v - c).alias("__c"))
    return arrays.entries(moved, "__c", list(group)).groupBy(*group, "pos").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.pow("v", F.lit(i))).alias(f"s{i}") for i in range(1, k + 1)]
    )


def centre_of(df: DataFrame, x: str) -> list[float]:
    """Mean vector of the table: one number per entry on the driver."""
    rows = entry_means(df, [], x).collect()
    return [r["m1"] for r in sorted(rows, key=lambda r: r["pos"])]


def _from_sums(prefix: str, n, sums: list) -> list:
    """Mean (about the centre) and central moments from power sums."""
    raw = [F.lit(1.0)] + [s / n for s in sums]
    out = [raw[1].alias(f"{prefix}_m1")]
    for i in range(2, len(sums) + 1):
        term = F.lit(0.0)
        for j in range(i + 1):
            term = term + comb(i, j) * raw[j] * F.pow(-raw[1], F.lit(i - j))
        out.append(term.alias(f"{prefix}_m{i}"))
    return out


def domain_vs_rest(df: DataFrame, group: str, x: str = "x", k: int = MOMENTS, bound: float = 1.0) -> DataFrame:
    """Per group: distance of its rows to all other rows, from one pass of
    power sums and their totals."""
    sums = power_sums(df, [group], x, centre_of(df, x), k)
    total = sums.groupBy("pos").agg(F.sum("n").alias("tn"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(1, k + 1)])
    both = sums.join(F.broadcast(total), "pos")  # one row per entry
    mine = _from_sums("a", F.col("n"), [F.col(f"s{i}") for i in range(1, k + 1)])
    rest = _from_sums("b", F.col("tn") - F.col("n"), [F.col(f"t{i}") - F.col(f"s{i}") for i in range(1, k + 1)])
    return _norms(both.where("tn > n").select(group, "pos", *mine, *rest), [group], k, bound)


def mmd(a: DataFrame, b: DataFrame, x: str = "x", scales: Sequence[float] = RBF_SCALES, tolerance: float = MMD_ERROR) -> float:
    """Squared maximum mean discrepancy of all rows, summed over RBF kernels:
    the mean kernel within each side, less twice the mean between them.

    With weights 1/|a| and -1/|b| it is one sum over all pairs of rows, which a
    tree of cells takes to an error of at most ``tolerance``.  0 if a side is empty.
    """
    n, m = a.count(), b.count()
    if not n or not m:
        return 0.0
    side = lambda df, s: df.select(F.col(x).cast("array<double>").alias("px"), F.lit(s).alias("s"))
    # the sizes of all weights add up to at most 2
    return kernel_sums.rbf_sum(side(a, 1.0 / n).unionByName(side(b, -1.0 / m)), scales, tolerance / 4)


def cluster_mix(assigned: DataFrame, group: str, cluster: str = "cluster") -> DataFrame:
    """Per group the L2-normalised cluster counts, as rows."""
    counts = assigned.groupBy(group, cluster).agg(F.count(F.lit(1)).alias("n"))
    norm = counts.groupBy(group).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, group).select(group, cluster, (F.col("n") / F.col("norm")).alias("share"))


def cluster_mix_distance(assigned: DataFrame, base: DataFrame, group: str, cluster: str = "cluster") -> DataFrame:
    """Per group: L2 distance of its cluster mix to the mix of the base rows.

    Clusters a group never uses count with the base share alone:
    |g - b|^2 = |g|^2 + |b|^2 - 2 g.b with both norms 1.
    """
    mix = cluster_mix(assigned, group, cluster)
    counts = materialize(base.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")))
    norm = counts.agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")).first()["norm"]
    ref = counts.select(cluster, (F.col("n") / F.lit(norm)).alias("ref"))
    dot = mix.join(F.broadcast(ref), cluster, "left").groupBy(group).agg(
        F.sum(F.col("share") * F.coalesce("ref", F.lit(0.0))).alias("dot")
    )
    return dot.select(group, F.sqrt(F.greatest(2 - 2 * F.col("dot"), F.lit(0.0))).alias("distance"))
