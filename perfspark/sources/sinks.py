"""Sharded data sets with a manifest, and result tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from perfspark.operators.split import TEST, TRAIN, hash_order

MANIFEST = (
    "mode string, shard_size int, shards int, input_method string, output_method string, cross_device boolean, "
    "schema string"
)


def write_shards(rows: DataFrame, path: str, manifest: dict, id_col: str = "sample_id", seed: str = "0") -> None:
    """Write train and test rows by split and shard, in hash order, with the
    manifest.  A row may be in both splits.  An existing data set is an error."""
    sides = F.array_compact(F.array(
        F.when(F.col("split_code").bitwiseAND(TRAIN) != 0, F.lit("train")),
        F.when(F.col("split_code").bitwiseAND(TEST) != 0, F.lit("test")),
    ))
    both = rows.withColumn("split", F.explode(sides)).drop("split_code")
    # Writers are balanced by size: a hot shard has several.
    (
        both.hint("rebalance", "split", "shard_id")
        .sortWithinPartitions("split", "shard_id", hash_order(id_col, seed))
        .write.mode("errorifexists").partitionBy("split", "shard_id").parquet(f"{path}/data")
    )
    spark = rows.sparkSession
    manifest = {**manifest, "schema": both.schema.json()}
    spark.createDataFrame([manifest], MANIFEST).write.mode("errorifexists").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").first().asDict()


def load_shards(
    spark: SparkSession, path: str, input_method: str | None = None, output_method: str | None = None
) -> tuple[dict, DataFrame]:
    """Manifest and rows; asking for another method than stored is an error."""
    manifest = read_manifest(spark, path)
    for name, wanted in (("input_method", input_method), ("output_method", output_method)):
        if wanted is not None and manifest[name] != wanted:
            raise ValueError(f"{name} is {manifest[name]}, not {wanted}")
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    return manifest, spark.read.schema(schema).parquet(f"{path}/data")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
