"""Measured samples, tuning records and task tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfspark.functions import arrays
from perfspark.functions.text import with_groups
from perfspark.operators.filters import MIN_TASK_SAMPLES, STD_TO_AVG_BOUND
from perfspark.runtime import lookup, materialize

# Task eligibility and warm-up runs.
MIN_VALID_SHARE, MIN_VALID, SMALL_TASK = 0.25, 100, 100
WARM_UPS = 10

SAMPLE = T.StructType([
    T.StructField("sample_id", T.StringType()),
    T.StructField("avg", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("flops", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("leaves", T.IntegerType()),
    T.StructField("device", T.StringType()),
    T.StructField("task_id", T.LongType()),
])


def write_samples(samples: DataFrame, path: str) -> None:
    """One folder per device and task, so that scans prune by both.  Writers are
    balanced by size: a task with very many rows has several files."""
    samples.hint("rebalance", "device", "task_id").write.partitionBy("device", "task_id").parquet(path)


def scan_samples(spark: SparkSession, path: str, width: int | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """Samples with device and task from the folders.

    ``tasks`` (device, task_id) restricts the scan to selected tasks; a feature
    vector of another ``width`` is skipped; a repeated sample id is an error.
    """
    rows = spark.read.schema(SAMPLE).parquet(path)
    if tasks is not None:
        rows = rows.join(lookup(tasks.select("device", "task_id").distinct()), ["device", "task_id"], "left_semi")
    if width is not None:
        rows = rows.where(F.size("features") == width)
    return rows


def check_unique(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {twice[0][0]}")
    return rows


def _mean(costs: Column) -> Column:
    return arrays.mean(costs)


def _std(costs: Column) -> Column:
    m = _mean(costs)
    return F.sqrt(F.aggregate(costs, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(costs))


# Fixed value: parts of a record that are read; results are of mixed kinds.
RECORD = "i array<array<string>>, r array<string>, flops double"


def parse_records(lines: DataFrame) -> DataFrame:
    """Tuning record lines -> workload key, costs, error number, mean, std.

    A line is JSON with inputs ``i`` (the first is the workload key) and the
    result ``r`` = [costs, error number, ...].
    """
    parsed = lines.select("path", F.from_json("value", RECORD).alias("j"))
    return parsed.select(
        "path",
        F.get(F.get("j.i", F.lit(0)), F.lit(0)).alias("workload_key"),
        F.from_json(F.get("j.r", F.lit(0)), "array<double>").alias("costs"),
        F.get("j.r", F.lit(1)).try_cast("int").alias("error_no"),
        F.col("j.flops").alias("flops"),
    ).withColumns({"avg": _mean(F.col("costs")), "std": _std(F.col("costs"))})


def measure_records(records: DataFrame, least: int = MIN_TASK_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """Valid records of tasks with enough of them, and the rejected tasks with
    a reason.  Unknown work is null."""
    records = materialize(records)  # the lines are parsed once
    ok = records.where(F.col("error_no") == 0).withColumn("flops", F.nullif("flops", F.lit(-1.0)))
    counts = records.groupBy("workload_key").agg(F.count_if(F.col("error_no") == 0).alias("valid"))
    small = counts.where(F.col("valid") < least).withColumn(
        "reason", F.when(F.col("valid") == 0, "No valid data").otherwise("Too few samples"))
    return ok.join(lookup(small.select("workload_key")), "workload_key", "left_anti"), small


def cost_label(records: DataFrame, warm_ups: int = WARM_UPS, bound: float = STD_TO_AVG_BOUND) -> DataFrame:
    """Mean and std without the warm-up runs; unstable records go."""
    rest = F.slice("costs", warm_ups + 1, F.greatest(F.size("costs") - warm_ups, F.lit(0)))
    out = records.where((F.col("error_no") == 0) & (F.size("costs") > warm_ups)).withColumn("__c", rest)
    out = out.withColumns({"avg": _mean(F.col("__c")), "std": _std(F.col("__c"))}).drop("__c")
    return out.where(F.try_divide("std", "avg") <= bound)


def eligible_tasks(stat: DataFrame) -> DataFrame:
    """Tasks with a large enough share and number of valid measurements."""
    valid = F.col("counter")[0]
    return stat.where(
        (F.try_divide(valid, F.col("total_num")) >= MIN_VALID_SHARE)
        & ((valid > MIN_VALID) | (F.col("total_num") < SMALL_TASK))
    )


def task_stat(
    records: DataFrame, width: int, done: DataFrame | None = None, least: int = MIN_TASK_SAMPLES, networks: DataFrame | None = None
) -> DataFrame:
    """Per task its workload key, its networks (``networks``: task_id, network)
    and its shape or an error; tasks already ``done`` keep their row."""
    key = F.min("workload_key") if "workload_key" in records.columns else F.lit(None).cast("string")
    fresh = records.groupBy("task_id").agg(key.alias("workload_key"), F.count_if(F.col("error_no") == 0).alias("n"))
    named = F.lit(None).cast("array<string>")
    if networks is not None:
        fresh = fresh.join(networks.groupBy("task_id").agg(F.sort_array(F.collect_set("network")).alias("networks")), "task_id", "left")
        named = F.col("networks")
    fits = F.col("n") >= least
    fresh = fresh.select(
        "task_id", "workload_key", named.alias("networks"), F.when(fits, F.col("n")).alias("n_rows"), F.when(fits, width).alias("n_cols"),
        F.when(~fits, "No valid data").alias("error"))
    if done is None:
        return fresh
    kept = done.where(F.col("n_rows").isNotNull() | F.col("error").isNotNull()).select(*fresh.columns)
    return kept.unionByName(fresh.join(kept.select("task_id"), "task_id", "left_anti"))


# Fixed value: how a network is written in a task table.
NETWORK_PATTERN = r"\((\w+),\[\((\d+),.+\)\]\),(\w+)"


def parse_networks(stat: DataFrame) -> DataFrame:
    """``network, bs, device, task_id`` rows from the network texts."""
    rows = stat.select("task_id", F.explode("networks").alias("text"))
    named = with_groups(rows, "text", NETWORK_PATTERN, ["network", "bs", "device"]).where(F.col("network").isNotNull())
    return named.select("network", F.col("bs").cast("int").alias("bs"), "device", "task_id").distinct()


def network_map(network_tasks: DataFrame) -> DataFrame:
    """Nested form: network -> map of batch size to its sorted task ids."""
    per_bs = network_tasks.groupBy("network", "bs").agg(F.sort_array(F.collect_set("task_id")).alias("tasks"))
    return per_bs.groupBy("network").agg(F.map_from_entries(F.collect_list(F.struct("bs", "tasks"))).alias("by_bs"))
