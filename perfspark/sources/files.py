"""Paths and numbered text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfspark.operators.ranking import add_rank


def task_id_from_path(path: Column) -> Column:
    """Number before the extension (``..._12.npy`` or ``task_id=12/``), else a
    hash of three parts of the file name."""
    number = F.nullif(F.regexp_extract(path, r"_(\d+)\.npy", 1), F.lit(""))
    folder = F.nullif(F.regexp_extract(path, r"task_id=(\d+)/", 1), F.lit(""))
    name = F.split(F.element_at(F.split(path, "/"), -1), "_")
    part = lambda i: F.get(name, F.lit(i))
    last = F.split(F.element_at(name, -1), r"\.")[0]
    return F.coalesce(number.cast("bigint"), folder.cast("bigint"), F.xxhash64(part(1), part(4), last))


def read_lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Text lines with their file; ``numbered`` adds the 0-based ``line_no``.

    Rows of one file block are read in order by one task, so (block start,
    running id) orders the lines of a file however it is split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), "value"
    )
    if not numbered:
        return lines.drop("__block")
    lines = lines.withColumn("__seq", F.monotonically_increasing_id())
    ranked = add_rank(lines, ["__block", "__seq"], ["path"], "line_no")
    return ranked.withColumn("line_no", F.col("line_no") - 1).drop("__block", "__seq")


def path_part(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
