"""Queries: row filters and routing."""

from pyspark.sql import functions as F

from perfspark.operators import filters, router
from perfspark.plans import views
from perfspark.plans.registry import query

_COLS = "sample_id, avg"


@query("filter_min_latency", "samples", f"SELECT {_COLS} FROM samples WHERE avg >= 0.3::DOUBLE")
def _(spark, d):
    return filters.min_latency(views.samples(spark, d), 0.3).select("sample_id", "avg")


@query("filter_unstable", "samples", f"SELECT {_COLS} FROM samples WHERE std/avg <= 0.01::DOUBLE")
def _(spark, d):
    return filters.unstable(views.samples(spark, d)).select("sample_id", "avg")


_BOUNDS = "SELECT quantile_cont(avg, 0.1) AS lo, quantile_cont(avg, 0.9) AS hi FROM samples"


@query(
    "filter_percentile_range", "samples",
    f"SELECT {_COLS} FROM samples, b WHERE avg >= lo AND avg < hi", b=_BOUNDS,
)
def _(spark, d):
    return filters.percentile_range(views.samples(spark, d)).select("sample_id", "avg")


@query(
    "filter_chain", "samples",
    f"SELECT {_COLS} FROM k, b WHERE avg >= lo AND avg < hi",
    k="SELECT * FROM samples WHERE avg >= 0.02::DOUBLE AND std/avg <= 0.01::DOUBLE",
    b="SELECT quantile_cont(avg, 0.1) AS lo, quantile_cont(avg, 0.9) AS hi FROM k",
)
def _(spark, d):
    return filters.chain(views.samples(spark, d), "111", 0.02).select("sample_id", "avg")


@query(
    "filter_chain_mask", "samples",
    """SELECT sample_id, (avg >= 0.02::DOUBLE AND std/avg <= 0.01::DOUBLE AND avg >= lo AND avg < hi)::INT AS kept
       FROM samples, b""", b=_BOUNDS,
)
def _(spark, d):
    s = views.samples(spark, d)
    bounds = filters.percentile_bounds(s, "avg", 0.1, 0.9)
    return filters.chain_mask(s, "111", 0.02, bounds).select(
        "sample_id", F.col("kept").cast("int").alias("kept")
    )


@query("filter_leaf_count", "samples", "SELECT sample_id, leaves FROM samples WHERE leaves = 5")
def _(spark, d):
    return filters.leaf_count(views.samples(spark, d)).select("sample_id", "leaves")


@query(
    "filter_flop_bound", "samples",
    "SELECT sample_id, flops FROM samples WHERE flops <> -1 AND flops >= 5e8 AND flops < 3e9",
)
def _(spark, d):
    return filters.flop_bound(views.samples(spark, d), 5e8, 3e9).select("sample_id", "flops")


@query(
    "filter_cost_range", "samples",
    f"SELECT {_COLS} FROM samples WHERE avg BETWEEN 0.2::DOUBLE AND 0.8::DOUBLE AND std/avg <= 0.01::DOUBLE",
)
def _(spark, d):
    return filters.cost_range(views.samples(spark, d), 0.2, 0.8).select("sample_id", "avg")


@query(
    "filter_min_group_size", "",
    """SELECT user_id AS task, event_id FROM events WHERE user_id IN
       (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 48)""",
)
def _(spark, d):
    rows = views.table(spark, d, "events").select(F.col("user_id").alias("task"), "event_id")
    return filters.min_group_size(rows, "task")


@query(
    "filter_dims", "ops",
    """SELECT op_id, 'dtype_fp16-op_type_Conv2D_MatMul' AS filter_name FROM ops
       WHERE dtype IN ('fp16') AND op_type IN ('Conv2D','MatMul')""",
)
def _(spark, d):
    keep = {"op_type": ["MatMul", "Conv2D"], "dtype": ["fp16"], "model": []}
    return filters.dims(views.ops(spark, d), keep).select(
        "op_id", F.lit(filters.dims_name(keep)).alias("filter_name")
    )


@query(
    "filter_train_envelope", "vectors vector_entries",
    """SELECT t.id FROM vector_entries t JOIN b USING (pos) WHERE t.split = 4 GROUP BY t.id
       HAVING bool_and(lo = hi OR (v >= lo AND v <= hi))""",
    b="""SELECT pos, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi
         FROM vector_entries WHERE split <> 4 GROUP BY pos""",
)
def _(spark, d):
    # Over 64 entries the usual range leaves no row, so a wider one is asked.
    v = views.vectors(spark, d).select("id", "split", "x")
    return filters.train_envelope(v.where("split = 4"), v.where("split <> 4"), "x", (0.005, 0.995)).select("id")


_Z = """SELECT id, max(abs(v-m)/(s+1e-6)) AS zmax, avg(abs(v-m)/(s+1e-6)) AS zavg
        FROM vector_entries JOIN (SELECT pos, avg(v) AS m, stddev_pop(v) AS s
        FROM vector_entries GROUP BY pos) USING (pos) GROUP BY id"""


@query(
    "filter_zscore_band", "vector_entries",
    """SELECT id, CASE WHEN zmax <= 2.2::DOUBLE THEN 2.2::DOUBLE WHEN zmax <= 2.5::DOUBLE THEN 2.5::DOUBLE
       ELSE 3.0::DOUBLE END AS band FROM z WHERE zmax <= 3""", z=_Z,
)
def _(spark, d):
    return filters.zscore_band(views.vectors(spark, d), [2.2, 2.5, 3.0], "x").select("id", "band")


@query(
    "filter_zscore_band_mean", "vector_entries",
    "SELECT id, 0.8::DOUBLE AS band FROM z WHERE zavg <= 0.8::DOUBLE", z=_Z,
)
def _(spark, d):
    v = views.vectors(spark, d)
    return filters.zscore_band(v, [0.8], "x", check="l1norm").select("id", "band")


RULES = {
    "filter_dim": "leaf_node_no",
    "filter_entries": [
        {"rule": "=5", "entry": {"filter_dim": "FLOPs", "filter_entries": [
            {"rule": ">=1e9", "entry": "large"}, {"rule": "default", "entry": "small"}]}},
        {"rule": "in[1, 2]", "entry": {"filter_dim": "FLOPs", "filter_entries": [
            {"rule": "<2e9", "entry": "light"}]}},
    ],
}


@query(
    "rule_router", "samples",
    """SELECT sample_id, CASE WHEN leaves = 5 THEN CASE WHEN flops >= 1e9 THEN 'large' ELSE 'small' END
       WHEN leaves IN (1,2) THEN CASE WHEN flops < 2e9 THEN 'light' END END AS target FROM samples""",
)
def _(spark, d):
    target = router.route(RULES, {"leaf_node_no": "leaves", "FLOPs": "flops"})
    return views.samples(spark, d).select("sample_id", target.alias("target"))
