"""Selecting tasks, splitting rows into train and test, set operations."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfspark.operators.ranking import add_rank, add_segment
from perfspark.runtime import lookup, materialize, small_side

# Split codes are bit sets.
FILTERED, TRAIN, TEST, ALL = 0, 1, 2, 7
TRAIN_RATIO = 0.8
FILES_PER_SHARD = 64
#: Classes up to which the rows to be repeated are found by their places in the whole table.
CUT_CLASSES = 16


def hash_order(id_col: str, seed: str = "0") -> Column:
    """Reproducible random order: the md5 of seed and id."""
    return F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))


# ------------------------------------------------------------------- splits

def every_kth(df: DataFrame, label: str, id_col: str, ratio: float = TRAIN_RATIO, keep_tail: bool = False) -> DataFrame:
    """Sort by label; every k-th row is a test row, k from the ratio.

    The last incomplete period gets code 0, or trains with ``keep_tail``.
    With fewer rows than one period all rows are both train and test.
    """
    k = round(ratio / (1 - ratio)) + 1
    ranked = add_rank(df, [label, id_col], (), "__r", "__n")
    r, n = F.col("__r"), F.col("__n")
    code = (
        F.when(n < k, TRAIN | TEST)
        .when(r > k * F.floor(n / k), TRAIN if keep_tail else FILTERED)
        .when(r % k == 0, TEST)
        .otherwise(TRAIN)
    )
    return ranked.withColumn("split_code", code).drop("__r", "__n")


def random_split(df: DataFrame, id_col: str, ratio: float, seed: str = "0") -> DataFrame:
    """Each row trains with probability ``ratio``, decided by its own hash: no
    shuffle, and the same answer on every run.  With no test row all rows are
    both."""
    share = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("double") / 2.0**32
    coded = df.withColumn("split_code", F.when(share < ratio, TRAIN).otherwise(TEST))
    if coded.where(F.col("split_code") == TEST).limit(1).count() == 0:
        coded = coded.withColumn("split_code", F.lit(TRAIN | TEST))
    return coded


def is_train(code: str = "split_code") -> Column:
    return F.col(code).bitwiseAND(TRAIN) != 0


def is_test(code: str = "split_code") -> Column:
    return F.col(code).bitwiseAND(TEST) != 0


def combine_codes(rows: DataFrame, tasks: DataFrame, keys: Sequence[str], kept: str = "kept") -> DataFrame:
    """Row code = OR of the codes its task was selected with, AND the filter."""
    per_task = tasks.groupBy(*keys).agg(F.bit_or("split_code").alias("__code"))
    joined = rows.join(lookup(per_task), list(keys))
    return joined.withColumn(
        "split_code", F.col("__code").bitwiseAND(F.when(F.col(kept), ALL).otherwise(FILTERED))
    ).drop("__code")


# ------------------------------------------------------------ mode grammar

def parse_mode(mode: str, default_device: str) -> dict:
    """``device:mode+mode,device:mode[.by_device:...|.by_net:...]`` as a dict."""
    source, _, split = mode.partition(".")
    devices = []
    for part in source.split(","):
        device, _, modes = part.rpartition(":")
        devices.append((device or default_device, modes.split("+")))
    spec = {"devices": devices, "split": "default", "train": None, "test": None}
    if split:
        kind, _, text = split.partition(":")
        if kind not in ("by_device", "by_net"):
            raise ValueError(f"unknown split mode {split!r}")
        spec["split"] = kind
        names = sorted({d for d, _ in devices}, key=len, reverse=True) + ["all"]
        for item in text.split(","):
            side, _, rest = item.partition("-")
            if side not in ("train", "test"):
                raise ValueError(f"unknown split side {item!r}")
            if kind == "by_device":
                spec[side] = re.findall("|".join(map(re.escape, names)), rest)
            else:
                spec[side] = [n for n in rest.split("-") if n]
        if spec["train"] is None and spec["test"] is None:
            raise ValueError("neither train nor test is given")
    return spec


def _default_code(spec: dict) -> int:
    """The side that is not named takes the rest; both named leave none."""
    if spec["train"] is not None:
        return FILTERED if spec["test"] is not None else TEST
    return TRAIN


def _network_filter(text: str) -> Column:
    cond = F.lit(False)
    for item in text.split("-"):
        found = re.match(r"^(\w+?)_(?:bs(\d+))?$", item)
        if not found:
            raise ValueError(f"unknown network {item!r}")
        name, bs = found.groups()
        one = F.col("network") == name
        cond = cond | (one if bs is None else one & (F.col("bs") == int(bs)))
    return cond


def _device_tasks(device: str, modes: Sequence[str], tasks: DataFrame, networks: DataFrame, stat: DataFrame, seed: str) -> DataFrame:
    mine = tasks.where(F.col("device") == device).select("task_id").distinct()
    chosen = mine.limit(0)
    for m in modes:
        if m == "cross":
            chosen = mine
        elif m.startswith("sample"):
            chosen = mine.orderBy("task_id").limit(int(m[len("sample"):]))
        elif m.startswith("random"):
            chosen = mine.orderBy(hash_order("task_id", seed), "task_id").limit(int(m[len("random"):]))
        elif m.startswith("list-"):
            wanted = [int(t) for t in m[len("list-"):].replace(" ", "").split("-")]
            listed = mine.where(F.col("task_id").isin(wanted))
            if listed.count() != len(set(wanted)):
                raise ValueError(f"some tasks of {m!r} do not exist on {device}")
            chosen = chosen.union(listed).distinct()
        elif m.startswith("network-"):
            found = networks.where(_network_filter(m[len("network-"):])).select("task_id").distinct()
            ready = found.join(stat.where(F.col("n_rows").isNotNull()), "task_id", "left_semi")
            chosen = chosen.union(new_tasks(ready, chosen))
        else:
            raise ValueError(f"unknown mode {m!r}")
    return chosen.select(F.lit(device).alias("device"), "task_id")


def select_tasks(
    mode: str, tasks: DataFrame, networks: DataFrame, stat: DataFrame, default_device: str, seed: str = "0"
) -> DataFrame:
    """``device, task_id, split_code`` for a mode string.

    Later modes of a device replace (cross, sampleK, randomK) or extend
    (list-, network-) the earlier ones.  The string is parsed on the driver;
    everything else is a plan over the task tables.
    """
    spec = parse_mode(mode, default_device)
    parts = [_device_tasks(dev, modes, tasks, networks, stat, seed) for dev, modes in spec["devices"]]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    if spec["split"] == "default":
        return chosen.withColumn("split_code", F.lit(FILTERED))

    def code(matches) -> Column:
        train = matches(spec["train"]) if spec["train"] is not None else F.lit(False)
        test = matches(spec["test"]) if spec["test"] is not None else F.lit(False)
        decided = F.when(train, TRAIN).otherwise(0).bitwiseOR(F.when(test, TEST).otherwise(0))
        return F.when(decided != 0, decided).otherwise(F.lit(_default_code(spec)))

    if spec["split"] == "by_device":
        coded = chosen.withColumn("split_code", code(
            lambda names: F.lit(True) if "all" in names else F.col("device").isin(names)))
        return coded.where("split_code <> 0")

    def in_networks(names):
        if "all" in names:
            return F.lit(True)
        with_bs = F.concat(F.col("network"), F.lit("_bs"), F.col("bs").cast("string"))
        return F.col("network").isin(names) | with_bs.isin(names)

    coded = chosen.join(networks, "task_id").withColumn("split_code", code(in_networks))
    return (
        coded.groupBy("device", "task_id").agg(F.bit_or("split_code").alias("split_code")).where("split_code <> 0")
    )


# ------------------------------------------------------------------- shards

def assign_shards(tasks: DataFrame, keys: Sequence[str], per_shard: int = FILES_PER_SHARD, seed: str = "0") -> DataFrame:
    """Shuffle the task files and deal them into ``ceil(n / per_shard)`` shards
    whose sizes differ by at most one; the first shards get the extra file."""
    keys = list(keys)
    name = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    ranked = add_rank(
        tasks.select(*keys).distinct().withColumn("__name", name),
        [hash_order("__name", seed), "__name"], (), "__r", "__n",
    )
    n = F.col("__n")
    shards = F.ceil(n / per_shard)
    small, extra = F.floor(n / shards), n % shards
    at = F.col("__r") - 1
    in_large = at < extra * (small + 1)
    shard = F.when(in_large, F.floor(at / (small + 1))).otherwise(
        extra + F.floor((at - extra * (small + 1)) / small)
    )
    return ranked.withColumn("shard_id", shard.cast("int")).drop("__r", "__n", "__name")


def upsample(df: DataFrame, cls: str, id_col: str) -> DataFrame:
    """Repeat the rows of every class up to the size of the largest one: all
    equally often, and the first by ``id_col`` once more."""
    sizes = materialize(df.groupBy(F.col(cls).alias("__cls")).agg(F.count(F.lit(1)).alias("__n")))
    top = sizes.agg(F.max("__n").alias("n")).first()["n"] or 0
    some = sizes.orderBy("__cls").limit(CUT_CLASSES + 1).collect()
    if len(some) > CUT_CLASSES:
        ranked = add_rank(df, [id_col], [cls], "__r", "__n")
        times = F.floor((top - F.col("__r")) / F.col("__n")) + 1
    else:
        # in order of class and id, the rows repeated once more end at these places
        starts = [0, *accumulate(r["__n"] for r in some)]
        places = [at + top % r["__n"] for at, r in zip(starts, some)]
        by_class = Window.orderBy("__cls")
        known = sizes.withColumn("__i", F.row_number().over(by_class) - 1)
        cut = add_segment(df, [cls, id_col], places, "__s")
        ranked = cut.join(F.broadcast(known), cut[cls].eqNullSafe(known["__cls"]))
        times = F.floor(F.lit(top) / F.col("__n")) + F.when(F.col("__s") <= F.col("__i"), 1).otherwise(0)
    copies = ranked.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    return copies.select(*df.columns)


def downsample(df: DataFrame, cls: str, id_col: str, seed: str = "0") -> DataFrame:
    """Keep as many rows of every class, by hash order, as the smallest has."""
    ranked = add_rank(df, [hash_order(id_col, seed), id_col], [cls], "__r", "__n")
    least = ranked.agg(F.min("__n").alias("n")).first()["n"] or 0
    return ranked.where(F.col("__r") <= least).drop("__r", "__n")


def grid_configs(spark, space: dict[str, Sequence], valid: Column | None = None, workers: int = 1) -> DataFrame:
    """Every combination of the listed values, numbered in mixed radix with the
    last dimension fastest; invalid ones go, the rest are dealt round robin.

    Rows come from a range of indexes, so nothing is joined.
    """
    total = math.prod(len(v) for v in space.values())
    out = spark.range(total).withColumnRenamed("id", "config_id")
    step = 1
    for name, values in reversed(space.items()):
        digit = F.pmod(F.floor(F.col("config_id") / step), F.lit(len(values))).cast("int")
        out = out.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), digit + 1))
        step *= len(values)
    if valid is not None:
        out = out.where(valid)
    return out.withColumn("worker", (F.col("config_id") % workers).cast("int"))


def grid_of_columns(spark, space: dict[str, DataFrame], valid: Column | None = None, workers: int = 1) -> DataFrame:
    """As ``grid_configs`` with the distinct values of a column of a table for
    each dimension, in their order; only their numbers reach the driver."""
    dims = {}
    for name, table in space.items():
        values = table.select(name).distinct().where(F.col(name).isNotNull())
        dims[name] = materialize(add_rank(values, [name], [], "__r").select(name, (F.col("__r") - 1).alias("__d")))
    sizes = {name: dim.count() for name, dim in dims.items()}
    out = spark.range(math.prod(sizes.values())).withColumnRenamed("id", "config_id")
    step = 1
    for name in reversed(space):
        digit = F.pmod(F.floor(F.col("config_id") / step), F.lit(sizes[name]))
        out = out.withColumn("__d", digit).join(small_side(dims[name]), "__d").drop("__d")
        step *= max(sizes[name], 1)
    out = out.select("config_id", *space)
    if valid is not None:
        out = out.where(valid)
    return out.withColumn("worker", (F.col("config_id") % workers).cast("int"))


# ------------------------------------------------------------ set operations

def union_samples(parts: Sequence[DataFrame], logged: Sequence[bool] | None = None) -> DataFrame:
    """Concatenate row sets; all must agree on whether the label is in logs."""
    if logged and len(set(logged)) > 1:
        raise ValueError("the parts differ in their log flag")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def new_tasks(found: DataFrame, selected: DataFrame, key: str = "task_id") -> DataFrame:
    return found.join(selected.select(F.col(key).alias(key)), key, "left_anti")


def common_tasks(a: DataFrame, b: DataFrame, key: str = "workload_key") -> DataFrame:
    """Per key whether it is in the first, in the second, in both sets."""
    marked = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    ).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return marked.select(key, (F.col("a") == 1).alias("in_a"), (F.col("b") == 1).alias("in_b"),
                         ((F.col("a") == 1) & (F.col("b") == 1)).alias("common"))


def common_sizes(marked: DataFrame) -> DataFrame:
    """One row: sizes of both sets and of what they share."""
    return marked.agg(*[F.count_if(c).alias(c) for c in ("in_a", "in_b", "common")])


def complement(df: DataFrame, group: str, value) -> DataFrame:
    """Rows of all other groups."""
    return df.where(F.col(group) != F.lit(value))


def remove_samples(df: DataFrame, ids: DataFrame, id_col: str, keep: bool = False) -> DataFrame:
    """Drop the listed rows, or keep only them."""
    return df.join(ids.select(F.col(id_col).alias(id_col)), id_col, "left_semi" if keep else "left_anti")
