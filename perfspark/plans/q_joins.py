"""Queries: joins between devices, operators, networks, graphs, reports."""

from pyspark.sql import functions as F

from perfspark.operators import derive, joins
from perfspark.plans import views
from perfspark.plans.registry import query


@query(
    "join_device_features", "samples devices",
    """SELECT sample_id, device, round(clock_MHz/2000, 6) AS f1, round(log2(BW_gbps)/log2(2048), 6) AS f6
       FROM samples JOIN devices ON device = device_name""",
)
def _(spark, d):
    dev = views.devices(spark, d).select(
        F.col("device_name").alias("device"), derive.device_feature_vector().alias("v")
    )
    s = joins.device_features(views.samples(spark, d).select("sample_id", "device"), dev)
    return s.select("sample_id", "device", F.round(F.col("v")[1], 6).alias("f1"), F.round(F.col("v")[6], 6).alias("f6"))


DIMS = ["dtype", "model", "op_type", "bs", "H", "R", "stride", "conv_kind", "C_in"]
_KEY = ", ".join(DIMS)
_LAST = f"""SELECT {_KEY}, {{extra}}
    max_by(ave, op_id) FILTER (WHERE gpu_model = 'g0') AS source_time,
    max_by(ave, op_id) FILTER (WHERE gpu_model = 'g1') AS target_time
    FROM {{src}} WHERE ave >= 5 {{cond}} GROUP BY ALL"""


@query(
    "join_cross_device_pairs", "ops",
    f"""SELECT {_KEY}, source_time, target_time FROM l
        WHERE source_time IS NOT NULL AND target_time IS NOT NULL""",
    l=_LAST.format(extra="", src="ops", cond=""),
)
def _(spark, d):
    pairs = joins.cross_device_pairs(views.ops(spark, d).drop("stride0"), "g0", "g1", DIMS, "op_id", time_lb=5)
    return pairs.drop("op_key")


@query(
    "join_cross_device_same_gpu", "ops",
    f"""SELECT {_KEY}, 1.0::DOUBLE AS source_time, max_by(ave, op_id) AS target_time FROM ops
        WHERE gpu_model = 'g1' GROUP BY ALL""",
)
def _(spark, d):
    return joins.cross_device_pairs(views.ops(spark, d), "g1", "g1", DIMS, "op_id").drop("op_key")


@query(
    "join_cross_device_kernel_pairs", "ops kernels",
    f"""SELECT {_KEY}, kernel, source_time, target_time,
            kernel || '_H=' || H || '_scale' || CASE WHEN target_time >= 1 THEN '>=1ms' ELSE '<1ms' END || '_R=' || R AS fine_id
        FROM l WHERE source_time IS NOT NULL AND target_time IS NOT NULL""",
    l=_LAST.format(extra="kernel,", src="kernels", cond="AND op_type='Conv2D' AND conv_kind='fprop'"),
)
def _(spark, d):
    k = views.kernels(spark, d).where("op_type = 'Conv2D' AND conv_kind = 'fprop'")
    pairs = joins.cross_device_pairs(k, "g0", "g1", [*DIMS, "kernel"], "op_id", time_lb=5).drop("op_key")
    fine = pairs.withColumn("ave", F.col("target_time")).withColumn("fine_id", derive.fine_kernel_id())
    return fine.drop("ave")


@query(
    "tasks_on_all_devices", "samples",
    """SELECT task_id, round(avg(avg), 9) AS mean FROM samples WHERE task_id IN
       (SELECT task_id FROM samples GROUP BY 1 HAVING count(DISTINCT device) = 5)
       GROUP BY task_id""",
)
def _(spark, d):
    s = views.samples(spark, d)
    tasks = joins.tasks_on_all(s, 5)
    return s.join(tasks, "task_id", "left_semi").groupBy("task_id").agg(F.round(F.avg("avg"), 9).alias("mean"))


_ID = "dtype || ',' || op_type || ',' || bs || ',' || coalesce(H::VARCHAR,'?') || ',' || coalesce(C_in::VARCHAR,'?')"


@query(
    "join_in_model_vs_standalone", "ops",
    """SELECT count(*) AS n, round(avg((y - x)/x), 6) AS mpe FROM
       (SELECT id, max_by(ave, op_id) AS x FROM o WHERE model <> 'm0' GROUP BY 1) a
       JOIN (SELECT id, max_by(ave, op_id) AS y FROM o WHERE model = 'm0' GROUP BY 1) b USING (id)""",
    o=f"SELECT *, {_ID} AS id FROM ops",
)
def _(spark, d):
    o = views.ops(spark, d).withColumn("id", joins.op_key(["dtype", "op_type", "bs", "H", "C_in"]))
    out = joins.in_model_vs_standalone(o.where("model <> 'm0'"), o.where("model = 'm0'"), "id", "op_id")
    return out.withColumn("mpe", F.round("mpe", 6))


def _named_stats(spark, d):
    stats = views.table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.round(F.avg("l_extendedprice"), 6).alias("avg"), F.count(F.lit(1)).alias("cnt"))
    return stats.select(
        F.concat(F.lit("while/body/resnet50/part_"), F.col("l_partkey").cast("string")).alias("name"),
        F.lit("ResNet50").alias("model"), "cnt")


def _metadata(spark, d):
    return views.table(spark, d, "part").where("p_size < 40").select(
        F.concat(F.lit("resnet50/part_"), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_size").alias("size"))


_STATS = """SELECT 'resnet50/part_' || l_partkey AS name, 'ResNet50' AS model, count(*) AS cnt
            FROM lineitem GROUP BY l_partkey"""
_META = "SELECT 'resnet50/part_' || p_partkey AS name, p_size AS size FROM part WHERE p_size < 40"


@query("join_trace_metadata", "", "SELECT name, model, cnt, size FROM s JOIN m USING (name)", s=_STATS, m=_META)
def _(spark, d):
    return joins.trace_metadata(_named_stats(spark, d), _metadata(spark, d))[0]


@query("join_trace_metadata_misses", "", "SELECT * FROM s WHERE name NOT IN (SELECT name FROM m)", s=_STATS, m=_META)
def _(spark, d):
    return joins.trace_metadata(_named_stats(spark, d), _metadata(spark, d))[1]


@query(
    "zip_logs", "",
    """SELECT event_id AS line_no, '[' || user_id || ', ' || value || ']' AS op_line,
              round(value*100/1e6, 9) AS system_ms, event_type AS system_kernel, event_type AS kernel, value AS kernel_ms
       FROM events WHERE event_id % 7 <> 0""",
)
def _(spark, d):
    e = views.table(spark, d, "events").withColumn("line_no", F.col("event_id"))
    v = F.col("value").cast("string")
    op = e.select("line_no", F.concat(F.lit("["), F.col("user_id"), F.lit(", "), v, F.lit("]")).alias("value"))
    system = e.select("line_no", F.when(F.col("event_id") % 7 == 0, F.lit("[]")).otherwise(F.concat(
        F.lit("{'Average': '"), (F.col("value") * 100).cast("string"), F.lit("', 'Operation': '"),
        F.col("event_type"), F.lit("'}"))).alias("value"))
    kernel = e.select("line_no", F.concat_ws(",", "event_type", F.lit("a"), F.lit("b"), v).alias("value"))
    return joins.zip_by_line(op, system, kernel).withColumn("system_ms", F.round("system_ms", 9))


@query(
    "join_network_tasks", "network_tasks task_stat",
    """SELECT network, bs, task_id FROM network_tasks
       WHERE (network = 'Brand_3' OR (network = 'Brand_5' AND bs = 7))
         AND task_id IN (SELECT task_id FROM task_stat WHERE n_rows IS NOT NULL)""",
)
def _(spark, d):
    wanted = [("Brand_3", None), ("Brand_5", 7)]
    out = joins.network_tasks(views.network_tasks(spark, d), views.task_stat(spark, d), wanted)
    return out.select("network", "bs", "task_id")


_MAP = "SELECT workload_key, min(task_id) + 100000 AS new_id FROM task_stat GROUP BY 1"


@query("remap_task_ids", "task_stat", """SELECT m.new_id AS task_id, t.workload_key, n_rows, error
       FROM task_stat t JOIN m USING (workload_key)""", m=_MAP)
def _(spark, d):
    t = views.task_stat(spark, d).drop("networks")
    mapping = t.groupBy("workload_key").agg((F.min("task_id") + 100000).alias("new_id"))
    return joins.remap_ids(t, mapping)


_LEFT = "SELECT l_partkey AS task, round(min(l_discount), 6) AS error FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1"
_RIGHT = "SELECT l_partkey AS task, round(min(l_tax), 6) AS error FROM lineitem WHERE l_suppkey % 3 = 1 GROUP BY 1"


def _errors(spark, d, part, col):
    li = views.table(spark, d, "lineitem").where(F.col("l_suppkey") % 3 == part)
    return li.groupBy(F.col("l_partkey").alias("task")).agg(F.round(F.min(col), 6).alias("error"))


@query("merge_error_cache", "", "SELECT task, least(a.error, b.error) AS error FROM a FULL JOIN b USING (task)",
       a=_LEFT, b=_RIGHT)
def _(spark, d):
    return joins.merge_errors(_errors(spark, d, 0, "l_discount"), _errors(spark, d, 1, "l_tax"), "task")


@query(
    "upsert_runs", "",
    """SELECT task, coalesce(b.error, a.error) AS mape_train, b.error AS mape_val,
              b.error IS NOT NULL AS complete FROM a FULL JOIN b USING (task)""",
    a=_LEFT, b=_RIGHT,
)
def _(spark, d):
    old = _errors(spark, d, 0, "l_discount").select(
        "task", F.col("error").alias("mape_train"), F.lit(None).cast("double").alias("mape_val"))
    new = _errors(spark, d, 1, "l_tax").select(
        "task", F.col("error").alias("mape_train"), F.col("error").alias("mape_val"))
    return joins.upsert_runs(old, new, "task", ["mape_train", "mape_val"])


@query(
    "group_names", "samples",
    """SELECT device, min(lpad(task_id::VARCHAR, 2, '0')) || '-to-' || max(lpad(task_id::VARCHAR, 2, '0')) AS group_id
       FROM samples GROUP BY device""",
)
def _(spark, d):
    s = views.samples(spark, d).withColumn("name", F.lpad(F.col("task_id").cast("string"), 2, "0"))
    return joins.group_names(s, "device", "name")


@query(
    "pick_record_per_task", "task_stat",
    """SELECT task_id, workload_key, record, coalesce(cost, 1e10::DOUBLE) AS cost,
              CASE WHEN record IS NULL THEN 'random' ELSE 'recorded' END AS src
       FROM task_stat LEFT JOIN r USING (workload_key)""",
    r="""SELECT p_type || '/' || p_size AS workload_key,
                min_by(p_partkey, md5('0' || p_partkey)) AS record, min_by(p_retailprice, md5('0' || p_partkey)) AS cost
         FROM part WHERE p_size < 40 GROUP BY 1""",
)
def _(spark, d):
    tasks = views.task_stat(spark, d).select("task_id", "workload_key")
    records = views.table(spark, d, "part").where("p_size < 40").select(
        F.concat_ws("/", "p_type", "p_size").alias("workload_key"), F.col("p_partkey").alias("id"),
        F.col("p_retailprice").alias("cost"))
    return joins.pick_record(tasks, records, "workload_key", "id")


_REPLAY = """SELECT l_partkey AS task_id, avg(l_extendedprice)/1e3 AS a, avg(l_extendedprice*(1 - l_discount))/1e3 AS b,
             min(l_linenumber) AS weight, max(l_linenumber) AS n_leaf,
             CASE WHEN l_partkey % 4 = 0 THEN 'random' ELSE 'recorded' END AS src FROM lineitem GROUP BY l_partkey"""


@query(
    "replay_vs_profile", "",
    """SELECT round(avg(abs(a-b)/b) FILTER (WHERE n_leaf = 7 AND src <> 'random' AND task_id % 11 <> 0 AND task_id % 13 <> 0)*100, 6) AS mape,
              round(abs(sum(b*(weight + task_id % 3 // 2)) FILTER (WHERE task_id % 13 <> 0) - sum(a*weight) FILTER (WHERE task_id % 11 <> 0))
                    / sum(b*(weight + task_id % 3 // 2)) FILTER (WHERE task_id % 13 <> 0)*100, 6) AS end2end_error,
              count(*) FILTER (WHERE task_id % 11 <> 0 AND task_id % 13 <> 0 AND task_id % 3 = 2) AS mismatches,
              count(*) FILTER (WHERE (task_id % 11 = 0) <> (task_id % 13 = 0)) AS unmatched FROM r""",
    r=_REPLAY,
)
def _(spark, d):
    r = views.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("task_id")).agg(
        (F.avg("l_extendedprice") / 1e3).alias("a"),
        (F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e3).alias("b"),
        F.min("l_linenumber").alias("weight"), F.max("l_linenumber").alias("n_leaf"),
    ).withColumn("src", F.when(F.col("task_id") % 4 == 0, "random").otherwise("recorded")).withColumn(
        "workload_key", F.col("task_id").cast("string"))
    # Each report lacks some tasks, and some weights differ.
    replay = r.where("task_id % 11 <> 0").withColumnRenamed("a", "cost")
    profile = r.where("task_id % 13 <> 0").withColumnRenamed("b", "cost").withColumn(
        "weight", F.col("weight") + (F.col("task_id") % 3 == 2).cast("int"))
    out = joins.replay_vs_profile(replay, profile, leaves=7)
    return out.select(F.round("mape", 6).alias("mape"), F.round("end2end_error", 6).alias("end2end_error"), "mismatches", "unmatched")


def graph_nodes(spark, d):
    """Node = (order, line); its input is the line before it."""
    g = views.table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("node_id")
    ).agg(F.min("l_partkey").alias("func"), F.min("l_linestatus").alias("s"))
    return g.select(
        "graph", "node_id", "func",
        F.when(F.col("s") == "O", "tvm_op").otherwise("null").alias("op"),
        F.concat(F.lit("n"), F.col("node_id").cast("string")).alias("name"),
        F.array(F.array(F.col("node_id") - 1, F.lit(0), F.lit(0))).alias("inputs"),
    )


_NODES = """SELECT l_orderkey AS graph, l_linenumber AS node_id, min(l_partkey) AS func, min(l_linestatus) AS s
            FROM lineitem GROUP BY 1, 2"""


@query(
    "graph_edges", "",
    """SELECT a.graph, 'Comp.n' || a.node_id AS src, 'Comp.n' || b.node_id AS dst
       FROM n a JOIN n b ON a.graph = b.graph AND a.node_id = b.node_id - 1 WHERE a.s = 'O' AND b.s = 'O'""",
    n=_NODES,
)
def _(spark, d):
    return joins.graph_edges(graph_nodes(spark, d), ["graph"])


@query(
    "node_cost", "",
    """SELECT graph, node_id, func, coalesce(p_retailprice, 0) AS cost, p_retailprice IS NULL AS missing
       FROM n LEFT JOIN (SELECT * FROM part WHERE p_size < 40) ON func = p_partkey""",
    n=_NODES,
)
def _(spark, d):
    costs = views.table(spark, d, "part").where("p_size < 40").select(
        F.col("p_partkey").alias("func"), F.col("p_retailprice").alias("cost"))
    return joins.node_cost(graph_nodes(spark, d).select("graph", "node_id", "func"), costs, "func")


@query(
    "missing_task_ids", "task_stat",
    """SELECT i AS task_id FROM (SELECT unnest(generate_series((SELECT min(task_id) FROM p), (SELECT max(task_id) FROM p))) AS i)
       WHERE i NOT IN (SELECT task_id FROM p) AND i NOT IN (SELECT task_id FROM task_stat WHERE error IS NOT NULL)""",
    p="SELECT task_id FROM task_stat WHERE n_rows < 400",
)
def _(spark, d):
    t = views.task_stat(spark, d)
    return joins.missing_ids(t.where("n_rows < 400").select("task_id"), t.where("error IS NOT NULL").select("task_id"))


@query(
    "reverse_query", "trace",
    """SELECT name, count(*) AS calls, round(sum(dur), 6) AS total FROM trace
       WHERE NOT regexp_matches(name, '^cl') AND NOT regexp_matches(name, 'up$') GROUP BY name""",
)
def _(spark, d):
    rest = joins.unmatched(views.trace(spark, d), "name", ["^cl", "up$"])
    return rest.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("dur"), 6).alias("total"))


@query(
    "pick_best_kernel", "ops kernels",
    """SELECT model, op_type, bs, kernel, predicted, error FROM
       (SELECT *, row_number() OVER (PARTITION BY model, op_type, bs ORDER BY predicted, kernel, error) AS r FROM
        (SELECT model, op_type, bs, kernel, round(avg(ave), 6) AS predicted, round(min(ave), 6) AS error
         FROM kernels GROUP BY ALL)) WHERE r = 1""",
)
def _(spark, d):
    c = views.kernels(spark, d).groupBy("model", "op_type", "bs", "kernel").agg(
        F.round(F.avg("ave"), 6).alias("predicted"), F.round(F.min("ave"), 6).alias("error"))
    return joins.best_kernel(c, ["model", "op_type", "bs"])
