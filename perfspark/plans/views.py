"""Domain views over the given tables, as DataFrames and as SQL text.

Every demonstration query reads these views, so its work grows with the
tables.  The SQL text is used only by the check that runs both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark, sf_dir) -> DataFrame:
    """Measured programs: label ``avg`` in seconds, its spread, work, features."""
    avg = F.col("l_extendedprice") / 1e5
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_id"),
        F.concat(F.lit("d"), (F.col("l_suppkey") % 5).cast("string")).alias("device"),
        (F.col("l_partkey") % 50).alias("task_id"),
        avg.alias("avg"),
        (avg * F.col("l_discount") / 5).alias("std"),
        F.when(F.col("l_linenumber") == 7, -1.0)
        .otherwise(F.col("l_quantity") * 1e8)
        .alias("flops"),
        F.array("l_quantity", "l_discount", "l_tax", avg).alias("features"),
        F.col("l_linenumber").alias("leaves"),
    )


def coarse_samples(spark, sf_dir) -> DataFrame:
    """Samples on a coarse grid, so that equal feature vectors are common."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_id"),
        F.concat(F.lit("d"), (F.col("l_suppkey") % 5).cast("string")).alias("device"),
        (F.col("l_partkey") % 50).alias("task_id"),
        (F.floor(F.col("l_extendedprice") / 5000) + 1).cast("double").alias("y"),
        F.array(
            F.floor(F.col("l_quantity") / 10).cast("double"),
            F.floor(F.col("l_discount") * 50 + 0.5).cast("double"),
            F.floor(F.col("l_tax") * 50 + 0.5).cast("double"),
            F.lit(1.0),
        ).alias("x"),
    )


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").alias("domain"),
        (F.col("vec_id") % 5).alias("split"),
    )


def predictions(spark, sf_dir) -> DataFrame:
    label = F.col("l_extendedprice") / 1e5
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_id"),
        F.concat(F.lit("d"), (F.col("l_suppkey") % 5).cast("string")).alias("device"),
        (F.col("l_partkey") % 50).alias("task_id"),
        label.alias("label"),
        (label * (1 + (F.col("l_tax") - 0.04) * 5)).alias("pred"),
        (label * (1 + (F.col("l_discount") - 0.05) * 4)).alias("pred2"),
    )


def trace(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("name"),
        (F.col("user_id") % 4).alias("pid"),
        F.col("user_id").alias("tid"),
        F.col("ts"),
        F.col("value").alias("dur"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def training_log(spark, sf_dir) -> DataFrame:
    """One loss series per user; the time stamp gives the order."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series"), F.col("event_id").alias("id"), "ts",
        F.col("value").alias("loss"),
    )


def network_tasks(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .select(
            F.regexp_replace("p_brand", "#", "_").alias("network"),
            F.col("p_size").alias("bs"),
            (F.col("p_partkey") % 50).alias("task_id"),
        )
        .distinct()
    )


def task_stat(spark, sf_dir) -> DataFrame:
    """One row per part: the networks it serves as text, its size or an error."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("task_id"),
        F.concat_ws("/", "p_type", "p_size").alias("workload_key"),
        F.array(
            F.format_string(
                "(%s,[(%d,3,224,224)]),cuda", F.regexp_replace("p_brand", "#", "_"), F.col("p_size")
            ),
            F.format_string("(%s,[(1,3,224,224)]),cuda", F.regexp_replace("p_name", " ", "_")),
        ).alias("networks"),
        F.when(F.col("p_size") < 46, F.col("p_size") * 10).alias("n_rows"),
        F.when(F.col("p_size") >= 46, F.lit("Time out 300")).alias("error"),
    )


def ops(spark, sf_dir) -> DataFrame:
    """Operator measurements: convolutions and matrix products on two devices."""
    li = table(spark, sf_dir, "lineitem")
    size = (F.col("l_quantity") % 7).cast("bigint") + 1
    conv = F.col("l_linestatus") == "O"
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("op_id"),
        F.concat(F.lit("g"), (F.col("l_suppkey") % 2).cast("string")).alias("gpu_model"),
        F.when(F.col("l_returnflag") == "A", "fp16").otherwise("fp32").alias("dtype"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 3).cast("string")).alias("model"),
        F.when(conv, "Conv2D").otherwise("MatMul").alias("op_type"),
        (F.col("l_extendedprice") / 1e3).alias("ave"),
        (F.col("l_linenumber").cast("bigint") * 2).alias("bs"),
        F.when(conv, 7 * size).alias("H"),
        F.when(conv, 7 * size).alias("W"),
        F.when(conv, F.lit(16).cast("bigint")).alias("C"),
        F.when(conv, (F.col("l_partkey") % 2) * 2 + 1).alias("R"),
        F.when(conv, (F.col("l_partkey") % 2) * 2 + 1).alias("S"),
        F.when(conv, F.ceil(7 * size / (F.col("l_suppkey") % 2 + 1))).alias("P"),
        F.when(conv, F.ceil(7 * size / (F.col("l_suppkey") % 2 + 1))).alias("Q"),
        F.when(conv, F.lit(32).cast("bigint")).alias("K"),
        F.when(conv, F.col("l_suppkey") % 2 + 1).alias("stride"),
        F.when(conv, F.element_at(F.array(*[F.lit(k) for k in ("fprop", "dgrad", "wgrad")]),
                                  (F.col("l_partkey") % 3 + 1).cast("int"))).alias("conv_kind"),
        F.when(~conv, 64 * size).alias("C_in"),
        F.when(~conv, F.lit(128).cast("bigint")).alias("C_out"),
        F.when(~conv, F.lit(1).cast("bigint")).alias("bs_mult"),
    )


def kernels(spark, sf_dir) -> DataFrame:
    """Operator rows with a kernel name put together from their columns."""
    half, mat = F.col("dtype") == "fp16", F.col("op_type") == "MatMul"
    tile = [64 * (1 + F.col("bs") % 3), 32 * (1 + F.col("bs") % 4), 16 * (1 + F.col("bs") % 2)]
    return ops(spark, sf_dir).withColumn("kernel", F.concat(
        F.lit("cutlass_"), F.when(half, "tensorop").otherwise("simt"),
        F.lit("_h"), F.when(half, "1688").otherwise(""),
        F.when(mat, "gemm").otherwise(F.col("conv_kind")),
        F.when(mat, "").otherwise("_optimized"),
        F.lit("_"), tile[0].cast("string"), F.lit("x"), tile[1].cast("string"),
        F.lit("_"), tile[2].cast("string"), F.lit("x2_nn"), F.when(half, "_align8").otherwise(""),
    ))


def trees(spark, sf_dir) -> DataFrame:
    """One pre-order tree per conversation: a root with one leaf per turn;
    ``-1`` goes back to the parent."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max(F.col("turn") + 1).cast("int").alias("n")
    )
    walk = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array(i, F.lit(-1))))
    return turns.select(
        F.col("conv_id").alias("sample_id"),
        F.concat(F.array(F.lit(0)), walk, F.array(F.lit(-1))).alias("tree"),
        F.sequence(F.lit(1), F.col("n")).alias("node_ids"),
    )


def devices(spark, sf_dir) -> DataFrame:
    """Device catalog with one row per supplier class, used as g0..g4 / d0..d4."""
    k = F.col("s_suppkey") % 5
    n = F.col("k").cast("double")
    return (
        table(spark, sf_dir, "supplier").groupBy(k.alias("k")).agg(F.max("s_nationkey").alias("top"))
        .select(
            F.concat(F.lit("d"), F.col("k").cast("string")).alias("device_name"),
            (1000 + 20.0 * F.col("top") + n).alias("clock_MHz"),
            (40 + 10 * F.col("k")).alias("SM_count"),
            (64 + 0 * F.col("k")).alias("fp32_au_per_sm"),
            (8 + F.col("k")).alias("tensor_core_au_per_sm"),
            (8 * (n + 1)).alias("memory_gb"), (64 * (n + 1)).alias("shm_L3_kb"),
            (4 * (n + 2)).alias("L2cache_mb"), (32 * (n + 1)).alias("L1cache_kb"),
            (300 * (n + 1)).alias("BW_gbps"), (8 + 2 * n).alias("fp32_tflops"),
        )
    )


_ID = "concat_ws('-',l_orderkey,l_linenumber,l_partkey,l_suppkey)"

SQL_VIEWS = {
    "samples": f"""
        SELECT {_ID} AS sample_id, 'd' || (l_suppkey % 5) AS device, l_partkey % 50 AS task_id,
               l_extendedprice/1e5 AS avg, l_extendedprice/1e5*l_discount/5 AS std,
               CASE WHEN l_linenumber = 7 THEN -1.0::DOUBLE ELSE l_quantity*1e8 END AS flops,
               [l_quantity, l_discount, l_tax, l_extendedprice/1e5] AS features,
               l_linenumber AS leaves
        FROM lineitem""",
    "coarse_samples": f"""
        SELECT {_ID} AS sample_id, 'd' || (l_suppkey % 5) AS device, l_partkey % 50 AS task_id,
               (floor(l_extendedprice/5000) + 1)::DOUBLE AS y,
               floor(l_quantity/10)::DOUBLE AS x0, floor(l_discount*50 + 0.5::DOUBLE)::DOUBLE AS x1,
               floor(l_tax*50 + 0.5::DOUBLE)::DOUBLE AS x2, 1.0::DOUBLE AS x3
        FROM lineitem""",
    "vectors": """
        SELECT vec_id AS id, embedding::DOUBLE[] AS x, label AS domain, vec_id % 5 AS split
        FROM embeddings""",
    "vector_entries": """
        SELECT vec_id AS id, label AS domain, vec_id % 5 AS split,
               generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding::DOUBLE[]) AS v
        FROM embeddings""",
    "predictions": f"""
        SELECT {_ID} AS sample_id, 'd' || (l_suppkey % 5) AS device, l_partkey % 50 AS task_id,
               l_extendedprice/1e5 AS label,
               l_extendedprice/1e5*(1 + (l_tax - 0.04::DOUBLE)*5) AS pred,
               l_extendedprice/1e5*(1 + (l_discount - 0.05::DOUBLE)*4) AS pred2
        FROM lineitem""",
    "trace": """
        SELECT event_id AS id, event_type AS name, user_id % 4 AS pid, user_id AS tid, ts,
               value AS dur, (props::JSON->>'$.k')::BIGINT AS k
        FROM events""",
    "training_log": """
        SELECT user_id AS series, event_id AS id, ts, value AS loss FROM events""",
    "network_tasks": """
        SELECT DISTINCT replace(p_brand, '#', '_') AS network, p_size AS bs,
               p_partkey % 50 AS task_id FROM part""",
    "task_stat": """
        SELECT p_partkey AS task_id, p_type || '/' || p_size AS workload_key,
               [format('({},[({},3,224,224)]),cuda', replace(p_brand, '#', '_'), p_size),
                format('({},[(1,3,224,224)]),cuda', replace(p_name, ' ', '_'))] AS networks,
               CASE WHEN p_size < 46 THEN p_size*10 END AS n_rows,
               CASE WHEN p_size >= 46 THEN 'Time out 300' END AS error
        FROM part""",
    "ops": f"""
        SELECT op_id, 'g' || (l_suppkey % 2) AS gpu_model,
               CASE WHEN l_returnflag = 'A' THEN 'fp16' ELSE 'fp32' END AS dtype,
               'm' || (l_partkey % 3) AS model,
               CASE WHEN conv THEN 'Conv2D' ELSE 'MatMul' END AS op_type,
               l_extendedprice/1e3 AS ave, l_linenumber::BIGINT*2 AS bs,
               CASE WHEN conv THEN 7*size END AS H, CASE WHEN conv THEN 7*size END AS W,
               CASE WHEN conv THEN 16 END AS C,
               CASE WHEN conv THEN (l_partkey % 2)*2 + 1 END AS R,
               CASE WHEN conv THEN (l_partkey % 2)*2 + 1 END AS S,
               CASE WHEN conv THEN ceil(7*size/(l_suppkey % 2 + 1))::BIGINT END AS P,
               CASE WHEN conv THEN ceil(7*size/(l_suppkey % 2 + 1))::BIGINT END AS Q,
               CASE WHEN conv THEN 32 END AS K,
               CASE WHEN conv THEN l_suppkey % 2 + 1 END AS stride,
               CASE WHEN conv THEN ['fprop','dgrad','wgrad'][l_partkey % 3 + 1] END AS conv_kind,
               CASE WHEN NOT conv THEN 64*size END AS C_in,
               CASE WHEN NOT conv THEN 128 END AS C_out, CASE WHEN NOT conv THEN 1 END AS bs_mult
        FROM (SELECT *, {_ID} AS op_id, (l_quantity % 7)::BIGINT + 1 AS size,
                     l_linestatus = 'O' AS conv FROM lineitem)""",
    "devices": """
        SELECT 'd' || k AS device_name, (1000 + 20*top + k)::DOUBLE AS clock_MHz,
               40 + 10*k AS SM_count, 64 AS fp32_au_per_sm, 8 + k AS tensor_core_au_per_sm,
               (8*(k+1))::DOUBLE AS memory_gb, (64*(k+1))::DOUBLE AS shm_L3_kb,
               (4*(k+2))::DOUBLE AS L2cache_mb, (32*(k+1))::DOUBLE AS L1cache_kb,
               (300*(k+1))::DOUBLE AS BW_gbps, (8 + 2*k)::DOUBLE AS fp32_tflops
        FROM (SELECT s_suppkey % 5 AS k, max(s_nationkey) AS top FROM supplier GROUP BY 1)""",
    "kernels": f"""
        SELECT *, 'cutlass_' || CASE WHEN dtype = 'fp16' THEN 'tensorop' ELSE 'simt' END
               || '_h' || CASE WHEN dtype = 'fp16' THEN '1688' ELSE '' END
               || CASE WHEN op_type = 'MatMul' THEN 'gemm' ELSE conv_kind END
               || CASE WHEN op_type = 'MatMul' THEN '' ELSE '_optimized' END
               || '_' || tm || 'x' || tn || '_' || tk || 'x2_nn'
               || CASE WHEN dtype = 'fp16' THEN '_align8' ELSE '' END AS kernel
        FROM (SELECT *, 64*(1 + bs % 3) AS tm, 32*(1 + bs % 4) AS tn, 16*(1 + bs % 2) AS tk FROM ops)""",
}
