"""Queries: scans and sinks, over files that Spark writes from the tables."""

from pyspark.sql import functions as F

from perfspark import runtime
from perfspark.operators import derive, series, stats
from perfspark.operators import transforms as tf
from perfspark.plans import dataset, views
from perfspark.plans.q_split import _PICKED, _READY, _TASKS, _MODE, _select
from perfspark.plans.q_stats import rounded
from perfspark.plans.registry import query
from perfspark.sources import files, logs, records, sinks, tables, traces


def scratch(spark):
    return f"{runtime.new_folder(spark)}/files"


def text_file(df, spark, name=""):
    """Write the column ``value`` as text; the last folder can carry a name."""
    path = f"{scratch(spark)}/{name}".rstrip("/")
    df.select("value").write.text(path)
    return path


def sample_files(spark, d):
    path = scratch(spark)
    records.write_samples(views.samples(spark, d), path)
    return path


@query("scan_samples", "samples",
       "SELECT device, task_id, sample_id, avg, flops, leaves FROM samples WHERE device = 'd1' AND task_id < 10")
def _(spark, d):
    path = sample_files(spark, d)
    wanted = spark.range(10).select(F.lit("d1").alias("device"), F.col("id").alias("task_id"))
    rows = records.scan_samples(spark, path, 4, wanted)
    return records.check_unique(rows).select("device", "task_id", "sample_id", "avg", "flops", "leaves")


@query("task_id_from_path", "samples", "SELECT task_id, count(*) AS n, true AS agrees FROM samples GROUP BY task_id")
def _(spark, d):
    rows = spark.read.schema(records.SAMPLE).parquet(sample_files(spark, d))
    found = rows.select("task_id", files.task_id_from_path(F.col("_metadata.file_path")).alias("from_path"))
    return found.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("from_path") == F.col("task_id")).alias("agrees"))


def record_lines(spark, d):
    """One tuning record per order line: three costs around its price."""
    li = views.table(spark, d, "lineitem")
    p = F.col("l_extendedprice")
    costs = F.to_json(F.array(p, p * 2, p * 3))
    value = F.concat(
        F.lit('{"i": [["'), F.concat_ws("/", F.lit("w"), F.col("l_partkey") % 997), F.lit('", "cuda"], []], "r": ['),
        costs, F.lit(", "), F.when(F.col("l_linenumber") == 7, 6).otherwise(0).cast("string"),
        F.lit(', 0.2, 1], "flops": '), F.when(F.col("l_returnflag") == "A", -1).otherwise(F.col("l_quantity")).cast("string"), F.lit("}"))
    return text_file(li.select(value.alias("value")), spark)


_REC = """SELECT 'w/' || l_partkey % 997 AS workload_key, l_extendedprice AS p, l_linenumber = 7 AS bad,
          CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS flops FROM lineitem"""


def _records(spark, d):
    return records.parse_records(files.read_lines(spark, record_lines(spark, d)))


@query(
    "scan_measure_records", "",
    """SELECT workload_key, round(p*2, 2) AS avg, round(p*sqrt(2.0::DOUBLE/3), 4) AS std, flops FROM r
       WHERE NOT bad AND workload_key IN (SELECT workload_key FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE NOT bad) >= 48)""",
    r=_REC,
)
def _(spark, d):
    good, _ = records.measure_records(_records(spark, d))
    return good.select("workload_key", F.round("avg", 2).alias("avg"), F.round("std", 4).alias("std"), "flops")


@query(
    "scan_measure_rejects", "",
    """SELECT workload_key, count(*) FILTER (WHERE NOT bad) AS valid,
              CASE WHEN count(*) FILTER (WHERE NOT bad) = 0 THEN 'No valid data' ELSE 'Too few samples' END AS reason
       FROM r GROUP BY 1 HAVING valid < 48""", r=_REC,
)
def _(spark, d):
    return records.measure_records(_records(spark, d))[1]


@query(
    "repeat_costs_to_label", "",
    """SELECT event_id, round(value + 0.5::DOUBLE, 6) AS avg, 0.5::DOUBLE AS std FROM events WHERE 0.5::DOUBLE/(value + 0.5::DOUBLE) <= 0.01::DOUBLE""",
)
def _(spark, d):
    v = F.col("value")
    costs = F.concat(F.array_repeat(v * 100, 10), F.array(v, v + 1, v, v + 1))
    e = views.table(spark, d, "events").select("event_id", F.lit(0).alias("error_no"), costs.alias("costs"))
    return records.cost_label(e).select("event_id", F.round("avg", 6).alias("avg"), F.round("std", 6).alias("std"))


@query(
    "task_eligibility", "",
    """SELECT task_idx FROM (SELECT o_custkey AS task_idx, count(*)*10 AS total_num,
         count(*) FILTER (WHERE o_orderstatus = 'F')*10 AS valid FROM orders GROUP BY 1)
       WHERE valid/total_num >= 0.25 AND (valid > 100 OR total_num < 100)""",
)
def _(spark, d):
    stat = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("task_idx")).agg(
        (F.count(F.lit(1)) * 10).alias("total_num"),
        F.array(F.count_if(F.col("o_orderstatus") == "F") * 10, F.lit(0).cast("bigint")).alias("counter"))
    return records.eligible_tasks(stat).select("task_idx")


@query(
    "task_stat_report", "",
    """SELECT task_id, workload_key, networks, n_rows, n_cols, error FROM (SELECT l_partkey AS task_id, 'old' AS workload_key, 'net' AS networks, 7 AS n_rows, 3 AS n_cols, NULL AS error FROM lineitem WHERE l_partkey % 10 = 0 GROUP BY 1)
       UNION ALL SELECT l_partkey, 'w' || l_partkey, (SELECT string_agg(DISTINCT 's' || l_suppkey % 4, ',' ORDER BY 's' || l_suppkey % 4) FROM lineitem i WHERE i.l_partkey = o.l_partkey), CASE WHEN n >= 24 THEN n END, CASE WHEN n >= 24 THEN 164 END, CASE WHEN n < 24 THEN 'No valid data' END
       FROM (SELECT l_partkey, count(*) FILTER (WHERE l_linenumber <> 7) AS n FROM lineitem WHERE l_partkey % 10 <> 0 GROUP BY 1) o""",
)
def _(spark, d):
    r = views.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("task_id"), F.concat(F.lit("w"), F.col("l_partkey")).alias("workload_key"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("network"), F.when(F.col("l_linenumber") == 7, 6).otherwise(0).alias("error_no"))
    done = r.where("task_id % 10 = 0").select("task_id").distinct().select(
        "task_id", F.lit("old").alias("workload_key"), F.array(F.lit("net")).alias("networks"), F.lit(7).cast("bigint").alias("n_rows"), F.lit(3).alias("n_cols"), F.lit(None).cast("string").alias("error"))
    out = records.task_stat(r, 164, done, 24, r.select("task_id", "network"))
    return out.withColumn("networks", F.array_join("networks", ","))


@query(
    "build_network_tasks", "task_stat",
    """SELECT regexp_extract(t, '^\\((\\w+),', 1) AS network, regexp_extract(t, '\\[\\((\\d+),', 1)::INT AS bs, count(DISTINCT task_id) AS n,
       min(task_id) AS first_task FROM (SELECT task_id, unnest(networks) AS t FROM task_stat) GROUP BY ALL""",
)
def _(spark, d):
    nested = records.network_map(records.parse_networks(views.task_stat(spark, d)))
    return nested.select("network", F.explode("by_bs").alias("bs", "tasks")).select(
        "network", "bs", F.size("tasks").cast("bigint").alias("n"), F.element_at("tasks", 1).alias("first_task"))


def trace_file(spark, d, phases=False):
    """One trace document per process and 8192 events, names first."""
    e = views.trace(spark, d)
    us = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    nothing = F.lit(None).cast("string")
    if phases:
        ph, name = F.when(F.col("id") % 2 == 0, "B").otherwise("E"), F.col("name")
        long = nothing
    else:
        ph, name = F.lit("X"), F.col("name")
        long = F.concat(F.lit("StatefulPartitionedCall/net/"), "name", F.lit(":x"))
    event = F.struct(
        ph.alias("ph"), name.alias("name"), "pid", "tid", us.alias("ts"), F.col("dur"),
        F.struct(nothing.alias("name"), F.floor(F.col("id") / 50).cast("string").alias("group_id"), long.alias("long_name")).alias("args"))

    def meta(kind, text, tid):
        return F.struct(
            F.lit("M").alias("ph"), F.lit(kind).alias("name"), F.col("pid"), tid.alias("tid"), F.lit(0.0).alias("ts"), F.lit(0.0).alias("dur"),
            F.struct(text.alias("name"), nothing.alias("group_id"), nothing.alias("long_name")).alias("args"))

    core = F.when(F.col("pid") == 0, "*MME").when(F.col("pid") == 1, "*TPC").otherwise("host") if phases else (
        F.when(F.col("pid") < 2, "/device:GPU:0").otherwise("/host:CPU"))
    part = F.floor(F.col("id") / 8192).alias("part")
    names = e.select("pid", "tid", part).distinct().select("pid", "part", F.explode(F.array(
        meta("process_name", core, F.lit(0).cast("bigint")),
        meta("thread_name", F.when(F.col("tid") % 3 == 0, "TensorFlow Ops").otherwise("Steps"), F.col("tid")))).alias("e"))
    both = names.select("pid", "part", F.lit(-1).cast("bigint").alias("o"), "e").unionByName(
        e.select("pid", part, us.cast("bigint").alias("o"), event.alias("e")))
    doc = both.groupBy("pid", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "e"))), lambda s: s["e"]).alias("traceEvents"))
    path = scratch(spark)
    doc.select("traceEvents", "pid", "part").write.partitionBy("pid", "part").option("compression", "gzip").json(path)
    return path


@query(
    "scan_trace_complete", "trace",
    """SELECT 'net/' || name AS op_name, name AS op_type, count(*) AS cnt, round(sum(dur), 4) AS total, min(id//50) AS first_step
       FROM trace WHERE pid < 2 AND tid % 3 = 0 AND name IN ('click', 'view') GROUP BY name""",
)
def _(spark, d):
    ops = traces.complete_events(traces.read_trace(spark, trace_file(spark, d)), ["click", "view"])
    return ops.groupBy("op_name", "op_type").agg(
        F.count(F.lit(1)).alias("cnt"), F.round(F.sum("dur"), 4).alias("total"), F.min("step").alias("first_step"))


@query(
    "scan_trace_begin_end", "trace",
    """SELECT name, round(sum(dur)/1e3, 3) AS dur, min(pid) AS core_type FROM
       (SELECT pid, tid, name, ph, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dur, lag(name) OVER w AS pn, lag(ph) OVER w AS pp
        FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'B' ELSE 'E' END AS ph FROM trace WHERE pid < 2)
        WINDOW w AS (PARTITION BY pid, tid, id // 8192 ORDER BY ts)) WHERE ph = 'E' AND pp = 'B' AND pn = name GROUP BY name""",
)
def _(spark, d):
    per_file = traces.begin_end_stats(traces.read_trace(spark, trace_file(spark, d, True)))
    return per_file.groupBy("name").agg(F.round(F.sum("dur"), 3).alias("dur"), F.min("core_type").alias("core_type"))


@query(
    "scan_profile_tree", "ops",
    """SELECT model AS network, gpu_model AS device, dtype, bs, count(*) AS n, round(sum(ave), 4) AS total FROM ops GROUP BY ALL""",
)
def _(spark, d):
    path = scratch(spark)
    o = views.ops(spark, d).select("model", "gpu_model", "dtype", "bs", "ave")
    folder = o.withColumns({"network": F.col("model"), "device": F.col("gpu_model"), "type": F.col("dtype"), "size": F.col("bs")})
    folder.select("network", "device", "type", "size", "ave").repartition("network", "device", "type", "size").write.partitionBy("network", "device", "type", "size").parquet(path)
    rows = spark.read.schema("ave double").parquet(path).select("ave", F.col("_metadata.file_path").alias("path"))
    as_tree = rows.withColumn("path", F.replace(F.replace(F.replace(F.replace(
        "path", F.lit("network="), F.lit("")), F.lit("device="), F.lit("")), F.lit("type="), F.lit("dtype_")), F.lit("size="), F.lit("BS_")))
    return traces.profile_tree(as_tree).groupBy("network", "device", "dtype", "bs").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("ave"), 4).alias("total"))


@query(
    "scan_op_database", "ops",
    """SELECT op_type, dtype, gpu, count(*) AS n, round(sum(ave), 4) AS total, sum(H) AS h, sum(K) AS k, sum(C_in) AS c_in, max(conv_kind2) AS conv_kind
       FROM (SELECT *, CASE gpu_model WHEN 'g0' THEN 'T4' ELSE 'V100' END AS gpu, CASE WHEN op_type = 'Conv2D' THEN 'fprop' END AS conv_kind2 FROM ops)
       WHERE ave <= 100 AND dtype = 'fp32' GROUP BY op_type, dtype, gpu""",
)
def _(spark, d):
    o = views.ops(spark, d)
    cells = lambda *c: F.concat_ws(", ", *[F.col(x).cast("string") for x in c])
    quote = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    head = F.concat_ws(", ", F.col("ave").cast("string"), quote("dtype"), quote("op_type"), F.col("bs").cast("string"))
    row = F.when(F.col("op_type") == "Conv2D", F.concat_ws(", ", head, cells("H", "W", "C", "R", "S", "P", "Q", "K", "stride"))).otherwise(
        F.concat_ws(", ", head, cells("C_in", "C_out", "bs_mult")))
    base = scratch(spark)
    text = o.select(F.concat(F.lit("[["), row, F.lit("]]")).alias("value"), "gpu_model")
    for gpu, folder in (("g0", "Tesla_T4"), ("g1", "Tesla_V100-SXM2-32GB")):
        text.where(F.col("gpu_model") == gpu).select("value").write.text(f"{base}/{folder}")
    db = tables.op_database(files.read_lines(spark, f"{base}/*"), ["fp32"])
    return db.groupBy("op_type", "dtype", F.col("gpu_model").alias("gpu")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("ave"), 4).alias("total"), F.sum("H").alias("h"), F.sum("K").alias("k"),
        F.sum("C_in").alias("c_in"), F.max("conv_kind").alias("conv_kind"))


@query(
    "scan_kernel_csv", "ops kernels",
    """SELECT op_type, dtype, gpu_model, count(*) AS n, round(sum(ave), 4) AS total, sum(bs) AS bs, sum(k) AS k FROM
       (SELECT op_type, CASE WHEN dtype = 'fp16' THEN 'fp16' ELSE 'fp32' END AS dtype, 'A100' AS gpu_model, ave, bs, coalesce(K, C_out) AS k
        FROM kernels WHERE op_type = 'Conv2D' OR bs % 4 = 0) GROUP BY ALL""",
)
def _(spark, d):
    k = views.kernels(spark, d)
    accum = F.when(F.col("dtype") == "fp16", "f16").otherwise("f32").alias("accum")
    base = f"{scratch(spark)}/cutlass_test_A100-SXM4-40GB"
    last = [accum, F.lit(0).alias("Bytes"), F.lit(0).alias("Flops"), F.col("ave").alias("Runtime")]
    first = [F.lit(1).alias("Problem"), F.lit("x").alias("Provider"), F.col("op_type").alias("OperationKind"), F.col("kernel").alias("Operation")]
    gemm = k.where("op_type = 'MatMul'").select(
        *first, F.col("bs").alias("m"), F.col("C_out").alias("n"), F.col("C_in").alias("k"),
        F.when(F.col("bs") % 4 == 0, 1).otherwise(0).alias("beta"), *last)
    conv = k.where("op_type = 'Conv2D'").select(
        *first, F.col("bs").alias("n"), F.col("H").alias("h"), F.col("W").alias("w"), F.col("C").alias("c"), F.col("K").alias("k"),
        F.col("R").alias("r"), F.col("S").alias("s"), F.col("P").alias("p"), F.col("Q").alias("q"),
        F.col("stride").alias("stride_h"), F.col("stride").alias("stride_w"), "conv_kind", *last)
    sinks.write_csv(gemm, f"{base}/x.gemm.csv")
    sinks.write_csv(conv, f"{base}/x.conv2d.csv")
    rows = tables.kernel_table(spark, f"{base}/x.gemm.csv", "gemm").withColumn("k", F.col("C_out")).select(
        "op_type", "dtype", "gpu_model", "ave", "bs", "k").unionByName(
        tables.kernel_table(spark, f"{base}/x.conv2d.csv", "conv2d").withColumn("k", F.col("K")).select(
            "op_type", "dtype", "gpu_model", "ave", "bs", "k"))
    return rows.groupBy("op_type", "dtype", "gpu_model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("ave"), 4).alias("total"), F.sum("bs").alias("bs"), F.sum("k").alias("k"))


@query(
    "scan_kernel_rejects", "ops kernels",
    """SELECT kernel, reason, count(*) AS n FROM (SELECT kernel, CASE WHEN op_type = 'Conv2D' THEN 'strides' ELSE 'beta' END AS reason, op_type, bs FROM kernels)
       WHERE CASE WHEN op_type = 'Conv2D' THEN bs % 5 = 0 ELSE bs % 4 <> 0 END GROUP BY ALL""",
)
def _(spark, d):
    k = views.kernels(spark, d)
    base = scratch(spark)
    gemm = k.where("op_type = 'MatMul'").select(F.col("kernel").alias("Operation"), F.when(F.col("bs") % 4 == 0, 1).otherwise(0).alias("beta"))
    conv = k.where("op_type = 'Conv2D'").select(
        F.col("kernel").alias("Operation"), F.lit(1).alias("stride_h"), F.when(F.col("bs") % 5 == 0, 2).otherwise(1).alias("stride_w"))
    sinks.write_csv(gemm, f"{base}/gemm")
    sinks.write_csv(conv, f"{base}/conv2d")
    bad = tables.kernel_rejects(spark, f"{base}/gemm", "gemm").unionByName(tables.kernel_rejects(spark, f"{base}/conv2d", "conv2d"))
    return bad.groupBy("kernel", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("remap_header", "",
       "SELECT c_custkey AS id, c_acctbal AS balance, NULL AS note, c_mktsegment AS segment FROM customer")
def _(spark, d):
    """A table whose header is in another order and lacks a column."""
    c = views.table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    out = tables.remap_header(c, ["segment", "id", "balance"], ["id", "balance", "note", "segment"])
    return out.withColumn("note", F.col("note").cast("string"))


@query("device_facts", "devices",
       """SELECT s_suppkey, device_name, clock_MHz, SM_count FROM supplier JOIN
          (SELECT CASE device_name WHEN 'd0' THEN 'T4' WHEN 'd1' THEN 'V100' ELSE device_name END AS device_name, clock_MHz, SM_count FROM devices)
          ON device_name = CASE s_suppkey % 5 WHEN 0 THEN 'T4' WHEN 1 THEN 'V100' ELSE 'd' || s_suppkey % 5 END""")
def _(spark, d):
    names = F.when(F.col("device_name") == "d0", "T4").when(F.col("device_name") == "d1", "V100").otherwise(F.col("device_name"))
    catalog = views.devices(spark, d).withColumn("device_name", names).select("device_name", "clock_MHz", "SM_count")
    kind = F.col("s_suppkey") % 5
    alias = F.when(kind == 0, "Tesla_T4").when(kind == 1, "Tesla_V100-SXM2-32GB").otherwise(F.concat(F.lit("d"), kind))
    found = tables.device_facts(catalog, views.table(spark, d, "supplier").select("s_suppkey", alias.alias("alias")), "alias")
    return found.select("s_suppkey", "device_name", "clock_MHz", "SM_count")


@query("trace_model_version", "trace",
       "SELECT 'Net' || k % 3 AS model, (tid % 4) || '.' || (pid % 3) AS version, count(*) AS n FROM trace GROUP BY ALL")
def _(spark, d):
    t = views.trace(spark, d)
    name = F.concat_ws("_", F.lit("TF"), (F.col("tid") % 4).cast("string"), (F.col("pid") % 3).cast("string"), F.concat(F.lit("Net"), F.col("k") % 3))
    model, version = traces.model_and_version("folder")
    return t.select(name.alias("folder")).select(model.alias("model"), version.alias("version")).groupBy("model", "version").agg(
        F.count(F.lit(1)).alias("n"))


@query("duration_seconds", "trace",
       """SELECT id, CASE k % 4 WHEN 0 THEN k*3600 WHEN 1 THEN k*60 WHEN 2 THEN k ELSE k*3600 + tid*60 + pid END AS seconds FROM trace""")
def _(spark, d):
    k, part = F.col("k").cast("string"), F.col("k") % 4
    text = F.when(part == 0, F.concat(k, F.lit("h"))).when(part == 1, F.concat(k, F.lit("m"))).when(part == 2, F.concat(k, F.lit("s"))).otherwise(
        F.concat(k, F.lit("h"), F.col("tid"), F.lit("m"), F.col("pid"), F.lit("s")))
    return views.trace(spark, d).withColumn("text", text).select("id", series.duration_seconds("text").alias("seconds"))


@query(
    "scan_report_section", "",
    """SELECT name, calls, total FROM (SELECT event_type || '_' || user_id AS name, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY 1)""",
)
def _(spark, d):
    sums = views.table(spark, d, "events").groupBy(F.concat_ws("_", "event_type", "user_id").alias("name")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"))
    # A report is one file; there are as many as rows ask for, each of some thousand lines.
    reports = sums.count() // 4000 + 1
    body = sums.select(
        F.pmod(F.xxhash64("name"), F.lit(reports)).alias("report"), F.lit(1).alias("o"),
        F.concat_ws(",", F.concat(F.lit('"'), "name", F.lit('"')), "calls", "total").alias("value"))
    fixed = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(v).alias("value")) for o, v in (
        (-4, "Another table"), (-3, "a,b"), (-2, " "), (-1, "GPU summary (ns):"), (0, "-----"), (0, "Name, Calls, Total"),
        (2, " "), (3, "Tail,1,2"))])
    frame = spark.range(reports).select(F.col("id").alias("report"), F.explode(fixed).alias("l")).select("report", "l.*")
    path = scratch(spark)
    frame.unionByName(body).repartition("report").sortWithinPartitions("report", "o", F.length("value"), "value").select("report", "value").write.partitionBy(
        "report").text(path)
    lines = files.read_lines(spark, f"{path}/*", numbered=True)
    return logs.report_section(lines, "GPU summary", "name string, calls bigint, total double").select("name", "calls", "total")


def training_lines(spark, d):
    e = views.trace(spark, d)
    return e.select(F.format_string(
        "Time %s s - Epoch %d step %d bs 600 - loss_train=%s, {'mape': %s, 'rmse': 0.001, '20%%accuracy': 1.0, '10%%accuracy': 0.5, '5%%accuracy': 0.25}",
        F.col("dur").cast("string"), F.col("k"), F.col("id"), F.col("dur").cast("string"),
        F.when(F.col("k") % 50 == 0, "nan").otherwise((F.col("k") / 1000).cast("string"))).alias("value"), "id").select(
        F.when(F.col("id") % 9 == 0, "noise line").otherwise(F.col("value")).alias("value"))


@query(
    "scan_regex_log", "trace",
    """SELECT id AS step, dur AS time, k AS epoch, 600 AS bs, dur AS loss_train, CASE WHEN k % 50 = 0 THEN 1e8::DOUBLE ELSE round(k/10, 6) END AS mape,
       1.0::DOUBLE AS rmse, 0.5::DOUBLE AS acc10 FROM trace WHERE id % 9 <> 0""",
)
def _(spark, d):
    log = logs.training_log(files.read_lines(spark, text_file(training_lines(spark, d), spark)))
    return log.select("step", "time", "epoch", "bs", "loss_train", F.round("mape", 6).alias("mape"), "rmse", "acc10")


@query(
    "scan_replay_log", "trace",
    """SELECT id AS task_id, 'key' || tid AS workload_key, dur AS cost, pid AS weight, CASE WHEN k % 2 = 0 THEN -1 ELSE k END AS n_leaf,
       CASE k % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'tenset' ELSE 'old_random' END AS src FROM trace""",
)
def _(spark, d):
    src = F.when(F.col("k") % 3 == 0, ", src=random").when(F.col("k") % 3 == 1, ", src=tenset").otherwise("")
    line = F.concat(F.format_string(
        "Task %d (workload key: [\"key%d...): T'=%s, W=%d, N_leaf=%d", "id", "tid", F.col("dur").cast("string"), "pid",
        F.when(F.col("k") % 2 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("k"))), src)
    path = text_file(views.trace(spark, d).select(line.alias("value")), spark)
    return logs.replay_log(files.read_lines(spark, path)).drop("path")


@query("scan_replay_total", "trace", "SELECT 'net' || tid AS network, round(sum(dur), 2) AS iter_time FROM trace GROUP BY tid")
def _(spark, d):
    sums = views.trace(spark, d).groupBy("tid").agg(F.round(F.sum("dur"), 2).alias("s"))
    line = F.format_string("Estimated total latency of net%d: %s ms", "tid", F.col("s").cast("string"))
    path = text_file(sums.select(line.alias("value")), spark)
    return logs.parse_lines(files.read_lines(spark, path), "replay_total").drop("path")


@query(
    "scan_search_log", "trace",
    """SELECT 'resnet_50' AS model, 4 AS bs, 't4' AS device, 'xgb' AS method, id AS elapsed, dur - min(dur) OVER () AS aligned FROM trace WHERE k % 10 <> 0""",
)
def _(spark, d):
    from perfspark.operators.series import align_to_min

    latency = F.when(F.col("k") % 10 == 0, "N/A").otherwise(F.col("dur").cast("string"))
    line = F.concat(F.lit("ElapsedTime(s)\t"), F.col("id").cast("string"), F.lit("\tEstimatedLatency(ms)\t"), latency, F.lit("\tend"))
    path = text_file(views.trace(spark, d).select(line.alias("value")), spark, "resnet_50-B4-cuda-t4-xgb.tsv")
    log = logs.search_log(files.read_lines(spark, path))
    return align_to_min(log, ["model", "bs", "device", "method"], "latency").select(
        "model", "bs", "device", "method", "elapsed", "aligned")


@query(
    "scan_selection_log", "trace",
    """SELECT 2 AS task_num, id AS a, tid AS b, 'random' AS method, dur AS diff FROM trace""",
)
def _(spark, d):
    line = F.format_string("Selected 2 tasks: %d,%d (%d,%d) using the 'random' method, with the diff2origin of %s",
                           "id", "tid", "tid", "id", F.col("dur").cast("string"))
    path = text_file(views.trace(spark, d).select(line.alias("value")), spark)
    log = logs.selection_log(files.read_lines(spark, path))
    return log.select("task_num", F.col("ids")[0].alias("a"), F.col("names")[0].alias("b"), "method", "diff")


@query(
    "scan_cluster_log", "trace",
    """SELECT 'cluster' AS kind, tid AS id, round(sum(dur), 4) AS error FROM trace GROUP BY tid
       UNION ALL SELECT 'task', id, dur FROM trace UNION ALL SELECT 'all', 0, round(avg(dur), 4) FROM trace""",
)
def _(spark, d):
    t = views.trace(spark, d)
    per = t.groupBy("tid").agg(F.round(F.sum("dur"), 4).alias("s"))
    parts = per.select(F.format_string("Cluster %d, error=%s", "tid", F.col("s").cast("string")).alias("value")).unionByName(
        t.select(F.format_string("file .workspace/t4_%d.npy, error=%s", "id", F.col("dur").cast("string")).alias("value"))).unionByName(
        t.agg(F.format_string("Cross-task, error=%s", F.round(F.avg("dur"), 4).cast("string")).alias("value")))
    lines = files.read_lines(spark, text_file(parts, spark))
    one = lambda kind, name, key: logs.parse_lines(lines, name).select(
        F.lit(kind).alias("kind"), key.cast("bigint").alias("id"), "error")
    return one("cluster", "cluster", F.col("cluster_id")).unionByName(one("task", "task_error", F.col("task_id"))).unionByName(
        one("all", "cross_task", F.lit(0)))


@query("scan_bracketed_lines", "trace",
       "SELECT id, name AS operation, dur AS average, k AS size FROM trace")
def _(spark, d):
    v = F.concat(F.lit("[{'Average': '"), F.col("dur").cast("string"), F.lit("', 'Operation': '"), "name", F.lit("'}]|"),
                 F.concat(F.lit("id="), F.col("id").cast("string"), F.lit(",size="), F.col("k").cast("string")))
    lines = files.read_lines(spark, text_file(views.trace(spark, d).select(v.alias("value")), spark))
    halves = lines.select(F.split("value", r"\|")[0].alias("dict"), F.split("value", r"\|")[1].alias("config"))
    m = halves.select(logs.bracketed_dict("dict").alias("d"), logs.config_map("config").alias("c"))
    return m.select(F.col("c")["id"].cast("bigint").alias("id"), F.col("d")["Operation"].alias("operation"),
                    F.col("d")["Average"].cast("double").alias("average"), F.col("c")["size"].cast("bigint").alias("size"))


@query("scan_tune_log", "trace",
       "SELECT k % 2 AS state, dur AS target, 'u' || tid AS unit FROM trace WHERE id % 11 <> 0")
def _(spark, d):
    t = views.trace(spark, d)
    row = F.to_json(F.struct((F.col("k") % 2).cast("int").alias("state"), F.lit("2024-01-01 00:00:00").alias("time"),
                             F.lit(1.0).alias("best_target"), F.col("dur").alias("target"),
                             F.create_map(F.lit("unit"), F.concat(F.lit("u"), F.col("tid").cast("string"))).alias("config")))
    path = text_file(t.select(F.when(F.col("id") % 11 == 0, '{"state": ').otherwise(row).alias("value")), spark)
    return logs.tune_log(spark, path).select("state", "target", F.col("config")["unit"].alias("unit"))


@query("scan_devices", "devices",
       """SELECT device_name, clock_MHz, CASE WHEN SM_count = 50 THEN NULL ELSE SM_count END AS SM_count, memory_gb, BW_gbps, NULL::DOUBLE AS fp16_tflops FROM devices""")
def _(spark, d):
    dev = views.devices(spark, d)
    names = [f.split(" ")[0] for f in tables.DEVICE_SCHEMA.split(", ")]
    have = dict.fromkeys(dev.columns)
    cols = [F.col(n).cast("string") if n in have else F.lit("N/A") for n in names]
    line = F.concat_ws(",", *[F.when(F.col("SM_count") == 50, "-1").otherwise(c) if n == "SM_count" else c for n, c in zip(names, cols)])
    header = spark.createDataFrame([(",".join(f'" {n}"' for n in names),)], "value string")
    path = text_file(header.unionByName(dev.select(line.alias("value"))), spark)
    return tables.device_catalog(spark, path).select("device_name", "clock_MHz", "SM_count", "memory_gb", "BW_gbps", "fp16_tflops")


@query(
    "sink_sharded_dataset", "samples network_tasks",
    """SELECT split, count(*) AS n, count(DISTINCT task_id) AS tasks, round(avg((avg - m)/s), 4) AS mean_y, 4 AS width, 8 AS device_width FROM
       (SELECT *, CASE WHEN device = 'd2' THEN 'test' ELSE 'train' END AS split, count(*) OVER (PARTITION BY device, task_id) AS size
        FROM samples JOIN p USING (device, task_id)),
       (SELECT avg(avg) AS m, stddev_pop(avg) AS s FROM samples JOIN p USING (device, task_id))
       WHERE avg >= 0.02::DOUBLE AND std/avg <= 0.01::DOUBLE AND size >= 48 GROUP BY split""",
    t=_TASKS, ready=_READY, p=_PICKED,
)
def _(spark, d):
    tasks = _select(spark, d, _MODE + ".by_device:test-d2")
    dev = views.devices(spark, d).select(F.col("device_name").alias("device"), derive.device_feature_vector().alias("device_vector"))
    path = scratch(spark)
    dataset.make_dataset(
        views.samples(spark, d), tasks, path, "by_device", 0.02, devices=dev, output_method="std", per_shard=16)
    _, out = sinks.load_shards(spark, path, "min-max", "std")
    return out.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("task_id").alias("tasks"), F.round(F.avg("y"), 4).alias("mean_y"),
        F.max(F.size("x")).alias("width"), F.max(F.size("device_vector")).alias("device_width"))


@query(
    "load_shards", "samples",
    """SELECT count(*) FILTER (WHERE r % 5 <> 0) AS train, count(*) FILTER (WHERE r % 5 = 0) AS test, 'None' AS output_method FROM
       (SELECT *, row_number() OVER (ORDER BY avg, sample_id) AS r, count(*) OVER () AS n FROM
         (SELECT *, count(*) OVER (PARTITION BY device, task_id) AS size FROM samples)
        WHERE avg >= 0.02::DOUBLE AND std/avg <= 0.01::DOUBLE) WHERE r <= 5*(n//5) AND size >= 48 AND leaves IN (3, 5)""",
)
def _(spark, d):
    s = views.samples(spark, d)
    path = scratch(spark)
    dataset.make_dataset(s, s.select("device", "task_id").distinct(), path, "default", 0.02, leaves=[3, 5], output_method="None")
    manifest, out = sinks.load_shards(spark, path)
    return out.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"),
                   F.lit(manifest["output_method"]).alias("output_method"))


@query("transform_params_io", "samples",
       """SELECT 'std' AS method, round(avg(avg), 6) AS a, round(stddev_pop(avg), 6) AS b, true AS selected FROM samples""")
def _(spark, d):
    params = tf.select(tf.fit_all(views.samples(spark, d), "avg", "y", ["min-max", "std", "log"]), "y", "std")
    path = scratch(spark)
    tf.save(params, path)
    back = tf.load(spark, path)
    return back.where("selected").select(
        "method", F.round(F.col("params")["avg"], 6).alias("a"), F.round(F.col("params")["std"], 6).alias("b"), "selected")


@query("sink_stat_csv", "samples",
       "SELECT device, task_id, round(avg(avg), 6) AS mean FROM samples GROUP BY ALL")
def _(spark, d):
    path = scratch(spark)
    sinks.write_csv(rounded(stats.device_task_means(views.samples(spark, d)), 6, "mean"), path)
    return spark.read.option("header", True).schema("device string, task_id bigint, mean double").csv(path)
