"""Profiler traces: complete events, begin/end events, folder trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfspark.functions.text import with_groups
from perfspark.operators.series import pair_begin_end
from perfspark.runtime import lookup, materialize

EVENT = (
    "struct<ph:string, cat:string, name:string, pid:bigint, tid:bigint, ts:double, dur:double, "
    "args:struct<name:string, group_id:string, long_name:string, op:string>>"
)
# Process and thread names that mark device operators.
GPU_PROCESS, OP_THREAD = "/device:GPU", "TensorFlow Ops"
# Processes of the begin/end traces; their order is the core type.
CORE_PROCESSES = ["*MME", "*TPC"]
CALL_PREFIX = "StatefulPartitionedCall"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of trace files (plain or gzip) with file and place in it.

    A trace is one JSON document, so the unit of work is a file.
    """
    docs = spark.read.schema(f"traceEvents array<{EVENT}>").option("multiLine", True).json(path)
    rows = docs.select(F.col("_metadata.file_path").alias("path"), F.posexplode("traceEvents").alias("seq", "e"))
    # Later steps read the events several times; parse the text only once.
    return materialize(rows.select("path", "seq", "e.*"))


def process_names(events: DataFrame) -> DataFrame:
    return events.where((F.col("ph") == "M") & (F.col("name") == "process_name")).groupBy("path", "pid").agg(
        F.min_by("args.name", "seq").alias("process"))


def thread_names(events: DataFrame) -> DataFrame:
    return events.where((F.col("ph") == "M") & (F.col("name") == "thread_name")).groupBy("path", "pid", "tid").agg(
        F.min_by("args.name", "seq").alias("thread"))


def complete_events(events: DataFrame, op_types: Sequence[str] = ()) -> DataFrame:
    """Device operator events: operator name, type, step, start, duration.

    The operator name is the long name up to the colon, without the leading
    call scope; a scope without a rest is dropped.
    """
    named = (
        events.where(F.col("ph") == "X")
        .join(lookup(process_names(events)), ["path", "pid"])
        .where(F.col("process").contains(GPU_PROCESS))
        .join(lookup(thread_names(events)), ["path", "pid", "tid"])
        .where(F.col("thread").contains(OP_THREAD))
    )
    long = F.split("args.long_name", ":")[0]
    scope = F.get(F.split(long, f"{CALL_PREFIX}/"), F.lit(1))
    out = named.withColumn("op_name", F.when(long.startswith(CALL_PREFIX), scope).otherwise(long)).where(
        F.col("op_name").isNotNull())
    if op_types:
        out = out.where(F.col("name").isin(list(op_types)))
    return out.select(
        "path", "seq", "op_name", F.col("name").alias("op_type"),
        F.try_to_number("args.group_id", F.lit("999999999")).cast("bigint").alias("step"), "ts", "dur")


def begin_end_stats(events: DataFrame) -> DataFrame:
    """Summed duration (ms) and core type per operator from B/E pairs of the
    core processes; events named after a core are ignored."""
    order = F.array_position(F.array(*[F.lit(p) for p in CORE_PROCESSES]), F.col("process")) - 1
    cores = process_names(events).where(F.col("process").isin(CORE_PROCESSES)).select(
        "path", "pid", order.cast("int").alias("core_type"))
    rows = events.where(F.col("ph").isin("B", "E") & ~F.col("name").startswith("MME") & ~F.col("name").startswith("TPC"))
    paired = pair_begin_end(rows.join(lookup(cores), ["path", "pid"]), ["path", "pid", "tid"], ["seq"])
    return paired.groupBy("path", "name").agg(
        (F.sum("dur") * 1e-3).alias("dur"), F.min_by("core_type", "seq").alias("core_type"))


def profile_tree(rows: DataFrame) -> DataFrame:
    """Network, device, type and batch size from the folders of a file path;
    each path is parsed once."""
    paths = with_groups(
        rows.select("path").distinct(), "path", r"/([^/]+)/([^/]+)/dtype_([^/]+)/BS_(\d+)/", ["network", "device", "dtype", "bs"])
    return rows.join(lookup(paths.withColumn("bs", F.col("bs").cast("int"))), "path")


def model_and_version(folder: str):
    """Model name and framework version from ``TF_2_4_ResNet50``."""
    parts = F.split(folder, "_")
    return F.element_at(parts, -1), F.array_join(F.slice(parts, 2, 2), ".")
