"""From samples and selected tasks to a normalised, sharded data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfspark.operators import filters, joins, split
from perfspark.operators import transforms as tf
from perfspark.runtime import lookup, materialize
from perfspark.sources import sinks

KEYS = ["device", "task_id"]


def split_rows(
    chosen: DataFrame,
    tasks: DataFrame,
    mode: str,
    time_lb: float,
    flags: str = "110",
    leaves: Sequence[int] | None = None,
    flop_bound: tuple[float | None, float | None] = (None, None),
) -> DataFrame:
    """Rows of the selected tasks with their split code.

    The split sees only label, spread and id.  By default every k-th label is
    a test row; with a split mode the code of the task decides.  Small task
    files, other leaf counts and other amounts of work go afterwards.
    """
    bounds = filters.percentile_bounds(chosen, "avg", *filters.OUTLIER_RANGE) if flags[2] == "1" else None
    if mode == "default":
        kept = filters.chain(chosen, flags, time_lb, bounds).select("sample_id", "avg")
        codes = split.every_kth(kept, "avg", "sample_id").select("sample_id", "split_code")
        rows = chosen.join(codes, "sample_id")
    else:
        marked = filters.chain_mask(chosen, flags, time_lb, bounds or (0.0, 0.0))
        rows = split.combine_codes(marked, tasks, KEYS).drop("kept")
    big = chosen.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= filters.MIN_TASK_SAMPLES)
    rows = rows.join(lookup(big.select(*KEYS)), KEYS, "left_semi").where(F.col("split_code") != split.FILTERED)
    if leaves:
        rows = filters.leaf_count(rows, leaves)
    if any(b is not None for b in flop_bound):
        rows = filters.flop_bound(rows, *flop_bound)
    return rows


def make_dataset(
    samples: DataFrame,
    tasks: DataFrame,
    path: str,
    mode: str = "default",
    time_lb: float = 0.0,
    flags: str = "110",
    leaves: Sequence[int] | None = None,
    flop_bound: tuple[float | None, float | None] = (None, None),
    devices: DataFrame | None = None,
    input_method: str = "min-max",
    output_method: str = "Box-Cox",
    per_shard: int = split.FILES_PER_SHARD,
) -> dict:
    """Write the data set and return its manifest.

    Transforms are fitted on all rows of the selected tasks; the device vector
    is attached when ``devices`` (device, device_vector) is given; the task
    files are dealt to shards.
    """
    tasks = materialize(tasks)
    # written once: the fits, the split and the output read it again, each its own columns
    chosen = materialize(samples.join(lookup(tasks.select(*KEYS).distinct()), KEYS, "left_semi"))
    x = tf.Transform.fitted(chosen, "features", input_method)
    y = tf.Transform.fitted(chosen, "avg", output_method)
    rows = split_rows(chosen, tasks, mode, time_lb, flags, leaves, flop_bound)
    out = rows.withColumns({"x": x.forward("features", True), "y": y.forward("avg")})
    columns = ["sample_id", *KEYS, "x", "y", "split_code", "shard_id"]
    if devices is not None:
        out = joins.device_features(out, devices)
        columns.append("device_vector")
    shards = materialize(split.assign_shards(tasks, KEYS, per_shard))
    out = out.join(lookup(shards), KEYS)
    manifest = {
        "mode": mode, "shard_size": per_shard, "shards": shards.agg(F.max("shard_id") + 1).first()[0],
        "input_method": input_method, "output_method": output_method, "cross_device": devices is not None,
    }
    sinks.write_shards(out.select(*columns), path, manifest)
    return manifest
