"""Derived columns: features, operator geometry, kernel names, trees, scopes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfspark.functions.numbers import ratio
from perfspark.functions import arrays
from perfspark.functions.text import with_groups
from perfspark.runtime import lookup

# Bytes per element by type.
DTYPE_BYTES = {"fp16": 2, "fp32": 4}
# Sequence and feature lengths.
MAX_SEQ_LEN = 16
FEATURE_LEN = 164


# ---------------------------------------------------------------- features

def feature_slice(df: DataFrame, row: str, n_pre: int) -> DataFrame:
    """Split a flat row array into label, the other leading values, features."""
    r = F.col(row)
    return df.withColumns({
        "label": F.element_at(r, 1),
        "pre_dims": F.slice(r, 2, n_pre - 1) if n_pre > 1 else F.array().cast("array<double>"),
        "features": F.slice(r, n_pre + 1, F.size(r)),
    })


def binary_descriptor(x: str, ops: int, dims: int, threshold: float = 1.0) -> Column:
    """0/1 per operation: is the mean of its ``dims`` values above the bound?"""
    block = lambda i: F.slice(F.col(x), i * dims + 1, dims)
    return F.transform(
        F.sequence(F.lit(0), F.lit(ops - 1)),
        lambda i: F.when(arrays.mean(block(i)) > threshold, 1.0).otherwise(0.0),
    )


def constant_features(df: DataFrame, x: str) -> DataFrame:
    """Per entry: value range; constant entries have ``min = max``."""
    return (
        arrays.entries(df, x)
        .groupBy("pos")
        .agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
        .withColumn("is_constant", F.col("low") == F.col("high"))
        .withColumn("is_nonzero_constant", F.col("is_constant") & (F.col("low") != 0))
        .drop("high")
    )


def prune_entries(x: str, drop: Sequence[int]) -> Column:
    """``x`` without the listed 0-based entries."""
    if not drop:
        return F.col(x)
    return F.filter(F.col(x), lambda v, i: ~i.isin([int(j) for j in drop]))


def prune_constant(df: DataFrame, x: str) -> DataFrame:
    """Drop entries that never change (the list is bounded by the row width)."""
    drop = [r["pos"] for r in constant_features(df, x).where("is_constant").select("pos").collect()]
    return df.withColumn(x, prune_entries(x, drop))


def leaf_collapse(x: Column, how: str = "sum") -> Column:
    """One vector from a matrix of leaves: entry-wise sum or mean."""
    zero = F.transform(F.element_at(x, 1), lambda v: F.lit(0.0))
    summed = F.aggregate(x, zero, lambda a, r: F.zip_with(a, r, lambda p, q: p + q))
    return summed if how == "sum" else F.transform(summed, lambda v: v / F.size(x))


def pad_sequence(x: Column, width: int, length: int = MAX_SEQ_LEN) -> Column:
    """Append an end row of ones, then zero rows up to ``length`` rows."""
    ones = F.array(arrays.literal([1.0] * width))
    zeros = F.array_repeat(arrays.literal([0.0] * width), F.lit(length) - 1 - F.size(x))
    return F.concat(x, ones, zeros)


def tree_position(tree: Column, node: Column) -> Column:
    """0-based place of a node in the serialized tree."""
    return F.array_position(tree, node) - 1


def positional_encoding(tree: str, node_ids: str, width: int) -> Column:
    """Per leaf a vector: sine at even, cosine at odd entries, of the leaf's
    pre-order place scaled by 10000^(2k/width)."""

    def encode(node):
        place = tree_position(F.col(tree), node).cast("double")
        return F.array(*[
            (F.sin if k % 2 == 0 else F.cos)(place / (10000.0 ** (2.0 * k / width)))
            for k in range(width)
        ])

    return F.transform(F.col(node_ids), encode)


def tree_nodes(df: DataFrame, tree: str, keep: Sequence[str]) -> DataFrame:
    """One row per node: parent (null for the root), depth, leaf flag.

    The walk is a fold inside the row, so no shuffle is needed.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("stack"),
        F.array().cast("array<struct<node:int,parent:int,depth:int>>").alias("out"),
    )

    def step(acc, token):
        stack, out = acc["stack"], acc["out"]
        depth = F.size(stack)
        node = F.struct(
            token.alias("node"),
            F.when(depth > 0, F.element_at(stack, depth)).alias("parent"),
            depth.alias("depth"),
        )
        return F.when(
            token == -1, F.struct(F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0))).alias("stack"), out.alias("out"))
        ).otherwise(
            F.struct(F.concat(stack, F.array(token)).alias("stack"), F.concat(out, F.array(node)).alias("out"))
        )

    nodes = F.aggregate(F.col(tree).cast("array<int>"), start, step, lambda acc: acc["out"])
    rows = df.select(*keep, nodes.alias("__nodes")).withColumn(
        "__parents", F.transform("__nodes", lambda n: n["parent"])
    )
    return rows.select(*keep, "__parents", F.explode("__nodes").alias("n")).select(
        *keep, "n.node", "n.parent", "n.depth",
        (~F.array_contains(F.array_compact("__parents"), F.col("n.node"))).alias("is_leaf"),
    )


def tree_signature(tree: str) -> Column:
    return F.array_join(F.col(tree).cast("array<string>"), ",")


# --------------------------------------------------------- operator geometry

def gemm_dims(kind: str = "conv_kind") -> dict[str, Column]:
    """Sides m, n, k of the matrix product a convolution equals."""
    c, f = F.col, F.col("R") * F.col("S")
    image, grad = c("bs") * c("P") * c("Q"), c("bs") * c("H") * c("W")
    sides = {
        "m": {"fprop": image, "dgrad": grad, "wgrad": c("K")},
        "n": {"fprop": c("K"), "dgrad": c("C"), "wgrad": f * c("C")},
        "k": {"fprop": f * c("C"), "dgrad": f * c("K"), "wgrad": image},
    }
    return {
        side: F.when(c(kind) == "fprop", by["fprop"]).when(c(kind) == "dgrad", by["dgrad"]).when(c(kind) == "wgrad", by["wgrad"])
        for side, by in sides.items()
    }


def gemm_size(kind: str = "conv_kind") -> Column:
    """The same as a struct (m, n, k)."""
    return F.struct(*[v.alias(n) for n, v in gemm_dims(kind).items()])


def op_features(df: DataFrame) -> DataFrame:
    """flops, size in bytes, transform, arithmetic intensity, performance."""
    c = F.col
    bytes_per = F.lit(None).cast("int")
    for name, n in DTYPE_BYTES.items():
        bytes_per = F.when(c("dtype") == name, n).otherwise(bytes_per)
    g = df.withColumns({f"__{n}": v for n, v in gemm_dims().items()})
    m, n, k = c("__m"), c("__n"), c("__k")
    rows_in = c("bs_mult") * c("bs")
    conv, mat, unary = (c("op_type") == "Conv2D"), (c("op_type") == "MatMul"), c("op_type").isin("Relu", "Tanh")
    unary_n = c("bs") * c("R")
    flops = (
        F.when(conv, m * n * k * 2 + m * n * 2)
        .when(mat, rows_in * c("C_in") * c("C_out"))
        .when(unary, unary_n)
    )
    floats = (
        F.when(conv, m * n + n * k + m * n)
        .when(mat, rows_in * c("C_in") + c("C_in") * c("C_out") + rows_in * c("C_out"))
        .when(unary, 2 * unary_n)
    )
    transform = F.when(conv, c("bs") * c("Q") * c("P") * c("R") * c("S") * c("C")).otherwise(F.lit(1))
    return (
        g.withColumn("op_flops", flops)
        .withColumn("size", floats * bytes_per)
        .withColumn("transform", transform)
        .withColumn("ai", ratio(c("op_flops"), c("size")))
        .withColumn("perf", F.when(c("ave") != 0, c("op_flops") / (c("ave") * 1e-3)).otherwise(F.lit(-1.0)))
        .drop("__m", "__n", "__k")
    )


def shapes_to_params(meta: DataFrame) -> DataFrame:
    """Operator parameters from tensor shapes.

    Columns in: ``op``, ``inputs`` and ``outputs`` (arrays of shape arrays).
    The layout is taken from the output: equal 2nd and 3rd size means NHWC.
    """
    conv, mat = F.col("op") == "Conv2D", F.col("op") == "MatMul"
    o, a, b = F.col("outputs")[0], F.col("inputs")[0], F.col("inputs")[1]
    nhwc = o[1] == o[2]
    side = a[2]
    first = o[0] == a[0]
    second = o[0] == b[0]
    return meta.select(
        "*",
        F.when(conv, side).alias("H"), F.when(conv, side).alias("W"),
        F.when(conv, F.when(nhwc, a[3]).otherwise(a[1])).alias("C"),
        F.when(conv, b[0]).alias("R"), F.when(conv, b[1]).alias("S"),
        F.when(conv, o[2]).alias("P"), F.when(conv, o[2]).alias("Q"),
        F.when(conv, F.when(nhwc, o[3]).otherwise(o[1])).alias("K"),
        F.when(conv, F.bround(ratio(side, o[2])).cast("bigint")).alias("stride"),
        F.when(mat, F.when(first, a[1]).when(second, b[1]).otherwise(o[0])).alias("C_in"),
        F.when(mat, o[1]).alias("C_out"),
        F.when(mat, F.when(first | second, o[0]).otherwise(a[0])).alias("bs_prime"),
    )


def conv_config(df: DataFrame) -> DataFrame:
    """Stride and padding mode of convolutions; ``error`` when neither fits."""
    c = F.col
    stride = F.bround(ratio(c("H"), c("P"))).cast("bigint")
    pad = F.bround(((c("P") - 1) * c("cfg_stride") + c("R") - c("H")) / 2).cast("bigint")
    return (
        df.where(c("op_type") == "Conv2D")
        .withColumn("cfg_stride", stride)
        .withColumn("pad", pad)
        .withColumn(
            "padding",
            F.when(c("pad") == 0, "valid").when(c("pad") == F.floor(c("R") / 2), "same").otherwise("error"),
        )
    )


# ------------------------------------------------------------------ kernels

# Parts of a kernel name in order (name, pattern, weight).
KERNEL_PARTS = [
    ("provider", r"(cutlass)", 1000),
    ("tensor_core_or_not", r"_(tensorop|simt)", 1000),
    ("dtype_out", r"(?:_(f16|f32))?", 1000),
    ("dtype_accum", r"_(s|h|d|i|c|z|gc|gz)", 1000),
    ("tensor_core_size", r"(\d+)?", 1),
    ("kernel_kind", r"(gemm|spgemm|fprop|dgrad|wgrad|fprop3d|dgrad3d|wgrad3d)", 1000),
    ("iter_algo", r"(?:_(analytic|optimized))?", 1000),
    ("dtype_in", r"(?:_(f16|f32))?", 1000),
    ("threadblock_m", r"_(\d+)", 1),
    ("threadblock_n", r"x(\d+)", 10),
    ("threadblock_k", r"_(\d+)", 1),
    ("pipeline_stage", r"x(\d+)", 1),
    ("layout", r"_((?:t|n){2}|nhwc|nchw)", 0.001),
    ("align", r"(?:_align(\d))?", 10),
    ("suffix", r"(?:_(.+))?", 1000),
]
# code = place in the list.
KERNEL_CODES = {
    "provider": ["cutlass"],
    "tensor_core_or_not": ["tensorop", "simt"],
    "dtype_out": ["f16", "f32"],
    "dtype_accum": ["s", "h", "d", "i", "c", "z", "gc", "gz"],
    "kernel_kind": ["gemm", "spgemm", "fprop", "dgrad", "wgrad", "fprop3d", "dgrad3d", "wgrad3d"],
    "iter_algo": ["analytic", "optimized"],
    "dtype_in": ["f16", "f32"],
    "layout": ["tt", "nn", "tn", "nt", "nhwc", "nchw"],
}
# Parts that must agree before one kernel may stand for another.
KERNEL_BLOCK = ["provider", "tensor_core_or_not", "dtype_out", "dtype_accum", "kernel_kind", "iter_algo", "dtype_in"]


def kernel_parts(df: DataFrame, kernel: str = "kernel", codes: bool = False) -> DataFrame:
    """Text parts of a kernel name, optionally with their codes; missing
    optional parts are null.

    Names repeat, so each distinct name is parsed once and joined back.
    """
    pattern = "".join(p for _, p, _ in KERNEL_PARTS)
    names = with_groups(df.select(kernel).distinct(), kernel, pattern, [name for name, _, _ in KERNEL_PARTS])
    return df.join(lookup(kernel_codes(names) if codes else names), kernel, "left")


def kernel_codes(df: DataFrame) -> DataFrame:
    """Weighted numeric code ``k_<part>`` of every part.

    The suffix is its sha1 modulo 1e8, folded over the hex digits.
    """
    digits = F.filter(F.split(F.sha1(F.coalesce("suffix", F.lit(""))), ""), lambda s: s != "")
    sha = F.aggregate(
        digits, F.lit(0).cast("bigint"),
        lambda a, s: F.pmod(a * 16 + F.conv(s, 16, 10).cast("bigint"), F.lit(10**8).cast("bigint")),
    )
    cols = {}
    for name, _, weight in KERNEL_PARTS:
        if name == "suffix":
            code = sha
        elif name in KERNEL_CODES:
            code = F.lit(-1)
            for i, text in enumerate(KERNEL_CODES[name]):
                code = F.when(F.col(name) == text, i).otherwise(code)
        else:
            code = F.coalesce(F.col(name).cast("bigint"), F.lit(-1))
        cols["k_" + name] = (code * weight).cast("double")
    return df.withColumns(cols)


def fine_kernel_id(kernel: str = "kernel") -> Column:
    scale = F.when(F.col("ave") >= 1, F.lit("scale>=1ms")).otherwise(F.lit("scale<1ms"))
    conv = F.concat_ws(
        "_", F.col(kernel), F.concat(F.lit("H="), F.col("H").cast("string")), scale,
        F.concat(F.lit("R="), F.col("R").cast("string")),
    )
    return F.when(F.col("op_type") == "Conv2D", conv).otherwise(F.col(kernel))


def enrich_device_pair(
    df: DataFrame, devices: DataFrame, source: str, target: str, compat: bool = False
) -> DataFrame:
    """Add device facts of both sides, tile sizes, blocks, waves, stages.

    ``devices`` is the device catalog.  With ``compat`` the tile height is
    replaced by the tile width.
    """
    wanted = ["SM_count", "BW_gbps", "clock_MHz", "fp32_au_per_sm", "tensor_core_au_per_sm"]
    short = {"SM_count": "sm_num", "BW_gbps": "bw", "clock_MHz": "clock"}

    def side(prefix):
        return catalog.select(
            F.col("device_name").alias(prefix),
            *[F.col(w).alias(f"{prefix}_{short.get(w, w)}") for w in wanted],
        )

    c = F.col
    catalog = lookup(devices.select("device_name", *wanted))  # written once, broadcast if small
    out = df.join(side(source), source).join(side(target), target)
    tensor = (c("dtype") == "fp16") & (c("tensor_core_or_not") == "tensorop")
    for p in (source, target):
        out = out.withColumn(
            f"{p}_core_num",
            F.when(tensor, c(f"{p}_tensor_core_au_per_sm")).otherwise(c(f"{p}_fp32_au_per_sm")),
        ).drop(f"{p}_tensor_core_au_per_sm", f"{p}_fp32_au_per_sm")
    g = gemm_dims()
    conv = c("op_type") == "Conv2D"
    tile_n = c("threadblock_n").cast("bigint")
    tile_m = tile_n if compat else c("threadblock_m").cast("bigint")
    tile_k = c("threadblock_k").cast("bigint")
    return (
        out.withColumn("gemm_m", F.when(conv, g["m"]).otherwise(c("bs") * c("bs_mult")))
        .withColumn("gemm_n", F.when(conv, g["n"]).otherwise(c("C_out")))
        .withColumn("gemm_k", F.when(conv, g["k"]).otherwise(c("C_in")))
        .withColumn("tb_num", F.ceil(c("gemm_m") / tile_m) * F.ceil(c("gemm_n") / tile_n))
        .withColumn("wave_num", F.ceil(ratio(c("tb_num"), c(f"{target}_sm_num"))))
        .withColumn("pipeline_num", c("wave_num") * F.ceil(c("gemm_k") / tile_k))
        .withColumn("tile_size_in", tile_m * tile_k + tile_k * tile_n)
        .withColumn("tile_size_out", tile_m * tile_n)
        .withColumn("tile_flop", tile_m * tile_k * tile_n)
    )


# ------------------------------------------------------------------ devices

# Short device names and their longer spellings.
DEVICE_ALIASES = {
    "A100": ["A100-SXM4-40GB", "A100_Graphics_Device", "A100-SXM-80GB"],
    "V100": ["Tesla_V100-SXM2-32GB", "Tesla_V100-PCIE-32GB"],
    "T4": ["Tesla_T4"],
    "A10": ["NVIDIA_A10"],
    "P100": ["Tesla_P100-PCIE-12GB"],
}
# The row every device is scaled by.
DEVICE_MAX = {
    "clock_MHz": 2000, "memory_gb": 64, "shm_L3_kb": 256, "L2cache_mb": 64,
    "L1cache_kb": 256, "BW_gbps": 2048, "fp32_tflops": 12,
}
DEVICE_LOG_DIMS = ["memory_gb", "shm_L3_kb", "L2cache_mb", "L1cache_kb", "BW_gbps"]


def short_device_name(name: Column) -> Column:
    short = name
    for s, aliases in DEVICE_ALIASES.items():
        short = F.when(name.isin(aliases), F.lit(s)).otherwise(short)
    return short


def device_feature_vector(top: dict[str, float] = DEVICE_MAX) -> Column:
    """Eight numbers per device: 1, clock, five log ratios, peak rate.

    Sizes are cut to whole numbers before the logarithm, the bandwidth is not.
    """
    ratio = [F.col("clock_MHz") / F.lit(float(top["clock_MHz"]))]
    for d in DEVICE_LOG_DIMS:
        value = F.col(d).cast("double") if d == "BW_gbps" else F.col(d).cast("bigint").cast("double")
        ratio.append(F.log2(value) / F.lit(math.log2(top[d])))
    ratio.append(F.col("fp32_tflops") / F.lit(float(top["fp32_tflops"])))
    return F.array(F.lit(1.0), *[r.cast("double") for r in ratio])


# --------------------------------------------------------- tensor attributes

# The types a tensor's text may name, and the words before its
# numbers; sizes kept of a shape.
TENSOR_TYPES = ["float8", "float16", "float32", "int8", "int16", "int32"]
ZERO_POINT, SCALE, PARAMETER = "zp = ", ", scale = ", "ModelParam = "
TENSOR_DIMS = 6
MAX_INPUTS = 3


def tensor_numbers(text: Column) -> Column:
    """12 numbers of one tensor: count, zero point, scale, parameter flag, float
    flag, bytes, then the shape padded with zeros."""

    def numbers(parts: Column) -> Column:
        sizes, dtype, scaled, param = (F.get(parts, i) for i in (1, 2, 3, 4))
        shape = F.split(F.substring(sizes, F.lit(2), F.length(sizes) - 2), ",").try_cast("array<double>")
        count = F.aggregate(shape, F.lit(1.0), lambda a, v: a * v)
        point = F.substring_index(F.substring(scaled, len(ZERO_POINT) + 1, 1 << 20), SCALE, 1).try_cast("bigint")
        scale = F.substring_index(scaled, SCALE, -1).try_cast("double")
        is_param = F.when(param == PARAMETER + "1", 1.0).when(param == PARAMETER + "0", 0.0)
        is_float = dtype.startswith("float")
        bits = F.substring(dtype, F.when(is_float, 6).otherwise(4), F.lit(2)).cast("double")
        head = F.array(count, point.cast("double"), scale, is_param, F.when(is_float, 1.0).otherwise(0.0), bits / 8)
        said = (
            (F.size(parts) > 5) & sizes.startswith("[") & sizes.endswith("]") & dtype.isin(TENSOR_TYPES) & scaled.startswith(ZERO_POINT)
            & (F.size(shape) <= TENSOR_DIMS) & count.isNotNull() & point.isNotNull() & scale.isNotNull() & is_param.isNotNull())
        return F.when(said, F.concat(head, shape, F.array_repeat(F.lit(0.0), F.lit(TENSOR_DIMS) - F.size(shape))))

    # the lambda binds the parts once, so the text is not split per number
    return F.transform(F.array(F.split(text, r"  \|  ")), numbers)[0]


def tensor_attr_features(
    inputs: Column, output: Column, extra: Sequence[Column] = (), length: int = FEATURE_LEN, most: int = MAX_INPUTS
) -> Column:
    """Numbers of up to ``most`` inputs and one output, then ``extra``, zero
    padded to ``length``.  Null where the inputs or the numbers do not fit."""
    per_tensor = 6 + TENSOR_DIMS
    if (most + 1) * per_tensor + len(extra) > length:
        raise ValueError(f"{most} inputs and {len(extra)} numbers do not fit into {length}")
    got = F.flatten(F.transform(inputs, tensor_numbers))
    missing = (F.lit(most) - F.size(inputs)) * per_tensor
    row = F.concat(
        got, F.array_repeat(F.lit(0.0), missing), tensor_numbers(output), F.array(*[e.cast("double") for e in extra]),
        F.array_repeat(F.lit(0.0), length - (most + 1) * per_tensor - len(extra)),
    )
    return F.when(F.size(inputs) <= most, row)
