"""Joins between measurements, devices, networks, graphs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfspark.functions.numbers import ratio
from perfspark.runtime import lookup, materialize_each, small_side

# Fixed value: cost in seconds that marks a record without a measurement.
INVALID_TIME = 1e10
#: Rows of both sides that one round of a join in rounds shuffles.
ROUND_ROWS = 100_000_000


def join_in_rounds(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join, written out: every round joins a share of the keys, so the
    disk holds the shuffle files of one share.  Join only the columns needed."""
    rounds = max(1, -(-(left.count() + right.count()) // ROUND_ROWS))
    if rounds == 1:
        return materialize_each([left.join(right, key)])
    share = F.pmod(F.xxhash64(key), F.lit(rounds))
    return materialize_each(left.where(share == i).join(right.where(share == i), key) for i in range(rounds))


def device_features(samples: DataFrame, devices: DataFrame, key: str = "device") -> DataFrame:
    """Attach the device vector; the catalog is broadcast if it is small."""
    return samples.join(small_side(devices), key)


def op_key(dims: Sequence[str]) -> Column:
    """Text key of an operator; missing dimensions are written as ``?``."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in dims])


def cross_device_pairs(
    df: DataFrame,
    source: str,
    target: str,
    dims: Sequence[str],
    order: str,
    gpu: str = "gpu_model",
    time: str = "ave",
    time_lb: float | None = None,
) -> DataFrame:
    """Same operator on two devices: ``source_time`` and ``target_time``.

    The last row by ``order`` wins on each side.  One conditional aggregation
    replaces the self join, so a hot operator key is merged before the shuffle.
    On one device the source time is set to 1.
    """
    if time_lb:
        df = df.where(F.col(time) >= time_lb)
    df = df.where(F.col(gpu).isin(source, target))

    def last_on(device):
        here = F.col(gpu) == device
        return F.max_by(F.when(here, F.col(time)), F.when(here, F.col(order)))

    x = F.lit(1.0) if source == target else last_on(source)
    pairs = df.groupBy(op_key(dims).alias("op_key"), *dims).agg(
        x.alias("source_time"), last_on(target).alias("target_time")
    )
    return pairs.where(F.col("source_time").isNotNull() & F.col("target_time").isNotNull())


def tasks_on_all(samples: DataFrame, n_devices: int, task: str = "task_id", device: str = "device") -> DataFrame:
    """Tasks measured on every device."""
    seen = samples.select(task, device).distinct()
    return seen.groupBy(task).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_devices).select(task)


def in_model_vs_standalone(in_model: DataFrame, alone: DataFrame, key: str, order: str, time: str = "ave") -> DataFrame:
    """Mean percentage error of stand-alone times against in-model times."""
    a = in_model.groupBy(key).agg(F.max_by(time, order).alias("x"))
    b = alone.groupBy(key).agg(F.max_by(time, order).alias("y"))
    return a.join(b, key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ratio(F.col("y") - F.col("x"), F.col("x"))).alias("mpe")
    )


def strip_scope(name: str, model: str) -> Column:
    """Part of an operator path from the model name on, if it is there."""
    at = F.array_position(F.split(name, "/"), F.lower(F.col(model)))
    parts = F.split(name, "/")
    return F.when(
        at > 0, F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "/")
    ).otherwise(F.col(name))


def trace_metadata(stats: DataFrame, metadata: DataFrame, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """Operator statistics with their parameters, and the names that miss."""
    named = stats.withColumn("name", strip_scope("name", model))
    return named.join(metadata, "name"), named.join(metadata, "name", "left_anti")


def zip_by_line(op: DataFrame, system: DataFrame, kernel: DataFrame, least: int = 4) -> DataFrame:
    """Line i of three logs side by side (columns ``line_no``, ``value``).

    Lines of the system log shorter than ``least`` characters are skipped;
    its mean is in nanoseconds and becomes milliseconds.
    """
    s = system.where(F.length("value") >= least).select("line_no", F.col("value").alias("system_line"))
    o = op.select("line_no", F.col("value").alias("op_line"))
    k = kernel.select("line_no", F.col("value").alias("kernel_line"))
    mean_ns = F.regexp_extract("system_line", r"'Average': '([^']+)'", 1).cast("double")
    return s.join(o, "line_no").join(k, "line_no").select(
        "line_no",
        "op_line",
        (mean_ns / 1e6).alias("system_ms"),
        F.regexp_extract("system_line", r"'Operation': '(.*)'", 1).alias("system_kernel"),
        F.split("kernel_line", ",")[0].alias("kernel"),
        F.split("kernel_line", ",")[3].cast("double").alias("kernel_ms"),
    )


def network_tasks(network_tasks: DataFrame, stat: DataFrame, wanted: Sequence[tuple[str, int | None]]) -> DataFrame:
    """Tasks of the wanted (network, batch size) pairs that have a shape; no
    batch size means all."""
    cond = F.lit(False)
    for name, bs in wanted:
        one = F.col("network") == name
        cond = cond | (one if bs is None else one & (F.col("bs") == bs))
    tasks = network_tasks.where(cond)
    return tasks.join(stat.where(F.col("n_rows").isNotNull()).select("task_id"), "task_id", "left_semi")


def remap_ids(df: DataFrame, mapping: DataFrame, key: str = "workload_key") -> DataFrame:
    """Replace ``task_id`` by the ``new_id`` that has the same key."""
    return df.join(mapping, key).drop("task_id").withColumnRenamed("new_id", "task_id")


def merge_errors(left: DataFrame, right: DataFrame, key: str, error: str = "error") -> DataFrame:
    """All keys of both sides with the smaller error."""
    a = left.select(key, F.col(error).alias("__a"))
    b = right.select(key, F.col(error).alias("__b"))
    return a.join(b, key, "full").select(key, F.least("__a", "__b").alias(error))


def upsert_runs(old: DataFrame, new: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Keyed cache: new values win, missing ones keep the old; ``complete``
    when every value is known."""
    a = old.select(key, *[F.col(v).alias("__o_" + v) for v in values])
    b = new.select(key, *[F.col(v).alias("__n_" + v) for v in values])
    merged = a.join(b, key, "full").select(
        key, *[F.coalesce("__n_" + v, "__o_" + v).alias(v) for v in values]
    )
    known = F.lit(True)
    for v in values:
        known = known & F.col(v).isNotNull()
    return merged.withColumn("complete", known)


def group_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """Group id ``first-to-last`` of the sorted names."""
    return df.groupBy(key).agg(
        F.concat_ws("-to-", F.min(name), F.max(name)).alias("group_id")
    )


def pick_record(tasks: DataFrame, records: DataFrame, key: str, record_id: str, seed: str = "0") -> DataFrame:
    """One valid record per task, drawn by hash order; without one the task
    gets the invalid-time marker and source ``random``."""
    order = F.md5(F.concat(F.lit(seed), F.col(record_id).cast("string")))
    chosen = records.groupBy(key).agg(
        F.min_by(F.struct(F.col(record_id).alias("record"), F.col("cost").alias("cost")), order).alias("r")
    )
    return tasks.join(chosen, key, "left").select(
        *tasks.columns,
        F.col("r.record").alias("record"),
        F.coalesce("r.cost", F.lit(INVALID_TIME)).alias("cost"),
        F.when(F.col("r").isNull(), "random").otherwise("recorded").alias("src"),
    )


def replay_vs_profile(replay: DataFrame, profile: DataFrame, leaves: int = 5) -> DataFrame:
    """Compare two reports by task: error of comparable rows and of the total.

    ``mismatches`` counts tasks whose key, weight or source differ,
    ``unmatched`` tasks that only one report has; those count in its total.
    """
    cols = ["workload_key", "cost", "weight", "n_leaf", "src"]
    a = replay.select("task_id", F.lit(True).alias("a_in"), *[F.col(c).alias("a_" + c) for c in cols])
    b = profile.select("task_id", F.lit(True).alias("b_in"), *[F.col(c).alias("b_" + c) for c in cols])
    valid = (F.col("a_n_leaf") == leaves) & (F.col("a_src") != "random")
    ape = F.abs(ratio(F.col("a_cost") - F.col("b_cost"), F.col("b_cost")))
    both = F.col("a_in") & F.col("b_in")
    same = F.lit(True)
    for c in ("workload_key", "weight", "src"):
        same = same & F.col("a_" + c).eqNullSafe(F.col("b_" + c))
    total_a, total_b = (F.sum(F.col(p + "_cost") * F.col(p + "_weight")) for p in "ab")
    return a.join(b, "task_id", "full").agg(
        (F.avg(F.when(valid, ape)) * 100).alias("mape"),
        (ratio(F.abs(total_b - total_a), total_b) * 100).alias("end2end_error"),
        F.count_if(both & ~same).alias("mismatches"),
        F.count_if(F.col("a_in").isNull() | F.col("b_in").isNull()).alias("unmatched"),
    )


def graph_edges(nodes: DataFrame, keys: Sequence[str] = (), kind: str = "tvm_op", prefix: str = "Comp.") -> DataFrame:
    """Edges between operator nodes.  ``nodes``: keys, ``node_id``, ``op``,
    ``name``, ``inputs`` (arrays of [id, 0, 0])."""
    keys = list(keys)
    ops = nodes.where(F.col("op") == kind)
    sources = ops.select(
        *keys, F.col("node_id").alias("src_id"), F.concat(F.lit(prefix), "name").alias("src")
    )
    return (
        ops.select(*keys, F.concat(F.lit(prefix), "name").alias("dst"), F.explode("inputs").alias("i"))
        .select(*keys, "dst", F.col("i")[0].alias("src_id"))
        .join(sources, [*keys, "src_id"])
        .select(*keys, "src", "dst")
        .distinct()
    )


def node_cost(nodes: DataFrame, costs: DataFrame, key: str) -> DataFrame:
    """Cost per node by key; a missing one is 0 and marked."""
    joined = nodes.join(lookup(costs.select(key, F.col("cost").alias("__c"))), key, "left")
    return joined.withColumn("cost", F.greatest(F.coalesce("__c", F.lit(0.0)), F.lit(0.0))).withColumn(
        "missing", F.col("__c").isNull()
    ).drop("__c")


def missing_ids(present: DataFrame, errors: DataFrame, key: str = "task_id") -> DataFrame:
    """Gaps between the first and last present id, minus ids with an error."""
    low, top = present.agg(F.min(key), F.max(key)).first()
    ids = present.sparkSession.range(low or 0, (top if top is not None else -1) + 1).withColumnRenamed("id", key)
    return ids.join(present.select(key), key, "left_anti").join(errors.select(key), key, "left_anti")


def unmatched(df: DataFrame, name: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose name fits none of the category patterns."""
    cond = F.lit(False)
    for p in patterns:
        cond = cond | F.col(name).rlike(p)
    return df.where(~cond)


def idw(df: DataFrame, keys: Sequence[str], value: str, dist: str, compat: bool = False) -> DataFrame:
    """Inverse-distance mean per key with weights 1/(d+1).  ``compat`` divides
    once more by the number of neighbours."""
    w = 1 / (F.col(dist) + 1)
    mean = F.sum(w * F.col(value)) / F.sum(w)
    if compat:
        mean = mean / F.count(F.lit(1))
    return df.groupBy(*keys).agg(mean.alias("predicted"))


def best_kernel(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate with the smallest predicted time per operator."""
    row = F.min(F.struct("predicted", "kernel", "error")).alias("b")
    return candidates.groupBy(*keys).agg(row).select(*keys, "b.kernel", "b.predicted", "b.error")
