"""Operator databases, kernel profiler tables and the device catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfspark.operators.derive import short_device_name
from perfspark.sources.files import path_part

# Operator parameters by type, longest accepted time in ms.
OP_PARAMS = {
    "Conv2D": ["H", "W", "C", "R", "S", "P", "Q", "K", "stride"],
    "MatMul": ["C_in", "C_out", "bs_mult"],
    "Relu": ["R"],
    "Tanh": ["R"],
}
MAX_OP_MS = 100.0
GEMM_COLUMNS = ["m", "n", "k", "beta"]
CONV_COLUMNS = ["n", "h", "w", "c", "k", "r", "s", "p", "q", "stride_h", "stride_w", "conv_kind"]

DEVICE_SCHEMA = (
    "device_name string, clock_MHz double, capability double, SM_count double, fp32_au_per_sm double, "
    "tensor_core_au_per_sm double, max_block double, max_warp double, memory_gb double, shm_L3_kb double, "
    "L2cache_mb double, L1cache_kb double, BW_gbps double, max_reg double, fp32_tflops double, fp16_tflops double"
)


def split_rows(text: Column) -> Column:
    """``[['a', b], [c, d]]`` text as an array of rows; quotes are dropped."""
    inner = F.regexp_replace(F.trim(text), r"^\[\[?|\]?\]$|['\"]", "")
    return F.split(inner, r"\], \[")


def op_database(lines: DataFrame, dtypes: Sequence[str] = (), op_types: Sequence[str] = ()) -> DataFrame:
    """Operator rows from ``<device>/<op>.json`` or ``<device>/<op>_op.txt``.

    A cell row is time, type, operator, batch size, parameters.  Slow rows go;
    convolutions are forward ones.
    """
    rows = lines.select("path", F.explode(split_rows(F.col("value"))).alias("r")).select(
        "path", F.split("r", ", ").alias("c"))
    out = rows.select(
        "path", F.col("c")[0].try_cast("double").alias("ave"), F.col("c")[1].alias("dtype"),
        F.lit("None").alias("model"), F.col("c")[2].alias("op_type"), F.col("c")[3].try_cast("bigint").alias("bs"), "c",
    ).where(F.col("ave") <= MAX_OP_MS)
    if dtypes:
        out = out.where(F.col("dtype").isin(list(dtypes)))
    if op_types:
        out = out.where(F.col("op_type").isin(list(op_types)))
    cols = {"gpu_model": short_device_name(F.element_at(F.split("path", "/"), -2))}
    for op, names in OP_PARAMS.items():
        for i, n in enumerate(names):
            value = F.when(F.col("op_type") == op, F.get("c", F.lit(4 + i)).try_cast("bigint"))
            cols[n] = F.coalesce(cols[n], value) if n in cols else value
    cols["conv_kind"] = F.when(F.col("op_type") == "Conv2D", "fprop")
    return out.withColumns(cols).drop("c", "path")


def remap_header(df: DataFrame, foreign: Sequence[str], header: Sequence[str]) -> DataFrame:
    """Columns in a foreign order renamed and reordered to the header."""
    named = df.toDF(*foreign)
    return named.select(*[F.col(h) if h in foreign else F.lit(None).alias(h) for h in header])


def kernel_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Kernel profiler CSV (``gemm`` or ``conv2d``) as operator rows.

    Matrix products need beta = 1; the accumulator gives the type.  Rows that
    do not fit are listed by ``kernel_rejects``.
    """
    raw = spark.read.option("header", True).csv(path)
    device = path_part(F.col("_metadata.file_path"), r"cutlass_test_([^/]+)/")
    i = lambda c: F.col(c).cast("bigint")
    base = [
        F.col("Operation").alias("kernel"), F.col("Runtime").cast("double").alias("ave"),
        short_device_name(device).alias("gpu_model"),
        F.concat(F.lit("fp"), F.regexp_replace("accum", "f", "")).alias("dtype"), F.lit("None").alias("model"),
    ]
    if kind == "gemm":
        return raw.where(i("beta") == 1).select(
            *base, F.lit("MatMul").alias("op_type"), i("m").alias("bs"), i("k").alias("C_in"), i("n").alias("C_out"),
            F.lit(1).cast("bigint").alias("bs_mult"))
    if kind != "conv2d":
        raise ValueError(f"unknown kernel table {kind!r}")
    return raw.where(F.col("stride_h") == F.col("stride_w")).select(
        *base, F.lit("Conv2D").alias("op_type"), i("n").alias("bs"), i("h").alias("H"), i("w").alias("W"), i("c").alias("C"),
        i("r").alias("R"), i("s").alias("S"), i("p").alias("P"), i("q").alias("Q"), i("k").alias("K"),
        i("stride_h").alias("stride"), "conv_kind")


def kernel_rejects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a kernel CSV that ``kernel_table`` leaves out: kernel, reason."""
    raw = spark.read.option("header", True).csv(path)
    if kind == "gemm":
        bad, reason = F.col("beta").try_cast("bigint") != 1, "beta"
    else:
        bad, reason = F.col("stride_h") != F.col("stride_w"), "strides"
    return raw.where(F.coalesce(bad, F.lit(True))).select(F.col("Operation").alias("kernel"), F.lit(reason).alias("reason"))


def device_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Device CSV with clean names; blanks, ``N/A`` and -1 become null."""
    rows = spark.read.option("header", False).csv(path)
    names = [f.split(" ")[0] for f in DEVICE_SCHEMA.split(", ")]
    rows = rows.toDF(*names).where(~F.col("device_name").contains("device_name"))
    numbers = {n: F.nullif(F.trim(n).try_cast("double"), F.lit(-1.0)) for n in names[1:]}
    return rows.withColumns(numbers).withColumn("device_name", F.trim("device_name"))


def device_facts(catalog: DataFrame, names: DataFrame, alias: str) -> DataFrame:
    """Facts of devices given by any of their names."""
    return names.withColumn("device_name", short_device_name(F.col(alias))).join(catalog, "device_name")
