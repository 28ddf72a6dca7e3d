"""Queries: corpus facts, box plots, device and task aggregations, reports."""

from pyspark.sql import functions as F

from perfspark.operators import filters, metrics, stats
from perfspark.plans import views
from perfspark.plans.registry import query


def rounded(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "feature_stats", "",
    """SELECT pos, min(v) + 1e-6::DOUBLE AS min, max(v) + 1e-6::DOUBLE AS max FROM
       (SELECT unnest([0,1,2,3]) AS pos, unnest([l_quantity, l_discount, l_tax, l_extendedprice/1e5]) AS v FROM lineitem)
       GROUP BY pos""",
)
def _(spark, d):
    return stats.feature_stats(views.samples(spark, d), eps=1e-6)


_PCT = ", ".join(f"round(quantile_cont(avg, {p / 100}), 9) AS p{p}" for p in stats.LABEL_PERCENTILES)


@query("label_stats", "samples",
       f"SELECT round(avg(avg), 9) AS mean, round(stddev_pop(avg), 9) AS std, count(*) AS n, {_PCT} FROM samples")
def _(spark, d):
    out = stats.label_stats(views.samples(spark, d))
    return rounded(out, 9, "mean", "std", *[f"p{p}" for p in stats.LABEL_PERCENTILES])


@query("label_range", "samples",
       "SELECT round(avg(avg), 9) AS mean, min(avg) AS min, max(avg) AS max FROM samples")
def _(spark, d):
    return rounded(stats.label_range(views.samples(spark, d), "avg"), 9, "mean")


@query("entry_profile", "vector_entries",
       """SELECT domain, pos, round(greatest(avg(v), 0), 9) AS mean, round(stddev_pop(v), 9) AS std, count(*) AS n
          FROM vector_entries GROUP BY ALL""")
def _(spark, d):
    return rounded(stats.entry_profile(views.vectors(spark, d), "domain", "x"), 9, "mean", "std")


@query(
    "histogram", "samples",
    """SELECT bin, count(*) AS n FROM (SELECT least(floor(avg/(q/20)), 19)::INT AS bin, avg, q FROM samples, b) 
       WHERE avg >= 0 AND avg <= q GROUP BY bin""",
    b="SELECT quantile_cont(avg, 0.75) AS q FROM samples",
)
def _(spark, d):
    return stats.histogram(views.samples(spark, d), "avg", 20)


@query(
    "histogram_2d", "predictions",
    """SELECT least(floor(label/(1.0::DOUBLE/100)), 99)::INT AS xbin, least(floor(ape/(0.2::DOUBLE/100)), 99)::INT AS ybin, count(*) AS n
       FROM (SELECT label, round(abs((label-pred)/label), 9) + 1e-6::DOUBLE AS ape FROM predictions)
       WHERE label BETWEEN 0 AND 1 AND ape BETWEEN 0 AND 0.2::DOUBLE GROUP BY ALL""",
)
def _(spark, d):
    p = views.predictions(spark, d).withColumn("ape", F.round(metrics.ape(), 9) + 1e-6)
    return stats.histogram_2d(p, "label", "ape", (0.0, 1.0), (0.0, 0.2))


@query(
    "hist_equalize", "samples",
    """SELECT sample_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('0' || sample_id), sample_id) AS r
         FROM bins) WHERE r <= (SELECT least((SELECT n FROM cnt ORDER BY bin LIMIT 1),
              (SELECT min(n) FROM (SELECT * FROM cnt ORDER BY bin OFFSET 1) WHERE n > 100)))
         AND bin IN (SELECT bin FROM cnt WHERE n >= (SELECT least((SELECT n FROM cnt ORDER BY bin LIMIT 1),
              (SELECT min(n) FROM (SELECT * FROM cnt ORDER BY bin OFFSET 1) WHERE n > 100))))""",
    bins="""SELECT sample_id, floor((avg - lo)/((hi - lo)/10))::BIGINT AS bin FROM samples,
            (SELECT min(avg) AS lo, max(avg) AS hi FROM samples)""",
    cnt="SELECT bin, count(*) AS n FROM bins GROUP BY bin",
)
def _(spark, d):
    return stats.hist_equalize(views.samples(spark, d), "avg", "sample_id").select("sample_id", "bin")


_BOX = """SELECT {k}, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, min({v}) AS min, max({v}) AS max,
    min({v}) FILTER (WHERE {v} >= q1 - 1.5::DOUBLE*(q3-q1)) AS low_whisker, max({v}) FILTER (WHERE {v} <= q3 + 1.5::DOUBLE*(q3-q1)) AS high_whisker,
    count(*) AS n FROM {t} JOIN (SELECT {k}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
    quantile_cont({v}, 0.75) AS q3 FROM {t} GROUP BY 1) USING ({k}) GROUP BY {k}, q1, median, q3"""


@query("box_stats", "samples", _BOX.format(k="device", v="avg", t="samples"))
def _(spark, d):
    return rounded(stats.box_stats(views.samples(spark, d), "avg", ["device"]), 9, "q1", "median", "q3")


@query(
    "network_box_stats", "samples network_tasks", _BOX.format(k="network", v="avg", t="r"),
    r="""SELECT unnest([network, 'ALL']) AS network, avg FROM samples
         JOIN (SELECT DISTINCT network, task_id FROM network_tasks) USING (task_id)""",
)
def _(spark, d):
    out = stats.network_box_stats(views.samples(spark, d), views.network_tasks(spark, d), "avg")
    return rounded(out, 9, "q1", "median", "q3")


@query("device_task_means", "samples",
       "SELECT device, task_id, round(avg(avg), 9) AS mean FROM samples GROUP BY ALL")
def _(spark, d):
    return rounded(stats.device_task_means(views.samples(spark, d)), 9, "mean")


@query(
    "device_ratio", "samples",
    """SELECT a.device, a.task_id, round(a.mean/(1e-6::DOUBLE + b.mean), 6) AS ratio FROM m a JOIN m b
       ON b.device = 'd0' AND a.task_id = b.task_id""",
    b="SELECT quantile_cont(avg, 0.1) AS lo, quantile_cont(avg, 0.9) AS hi FROM samples WHERE avg >= 0.02::DOUBLE AND std/avg <= 0.01::DOUBLE",
    m="""SELECT device, task_id, avg(avg) AS mean FROM samples, b
         WHERE avg >= 0.02::DOUBLE AND std/avg <= 0.01::DOUBLE AND avg >= lo AND avg < hi GROUP BY ALL""",
)
def _(spark, d):
    clean = filters.chain(views.samples(spark, d), "111", 0.02)
    out = stats.device_ratio(stats.device_task_means(clean), "d0")
    return out.select("device", "task_id", F.round("ratio", 6).alias("ratio"))


_ERR = "abs((label-pred)/label)"


@query(
    "per_task_report", "",
    """SELECT task_id, mean, flops, error, place FROM (SELECT *, row_number() OVER (ORDER BY error, task_id) AS place,
         count(*) OVER () AS n FROM t) WHERE place <= 10 OR place > n - 10""",
    t="""SELECT l_partkey AS task_id, round(avg(l_extendedprice), 6) AS mean,
                CASE WHEN min(l_linenumber) = max(l_linenumber) THEN min(l_linenumber) END AS flops,
                round(avg(abs(l_tax - 0.04::DOUBLE)*5), 9) AS error FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    rows = views.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("task_id"), F.col("l_linenumber").alias("flops"),
        F.col("l_extendedprice").alias("label"), "l_tax")
    # One task's error is rounded before ranking so that both engines break ties alike.
    per = rows.groupBy("task_id").agg(F.round(F.avg(F.abs(F.col("l_tax") - 0.04) * 5), 9).alias("e"))
    rows = rows.join(per, "task_id")
    out = stats.per_task_report(rows.withColumn("one", F.col("e")), F.col("e"), 10)
    return rounded(out, 6, "mean").withColumn("error", F.round("error", 9))


@query(
    "network_task_errors", "samples predictions network_tasks",
    """SELECT t.task_id, error, CASE WHEN coalesce(in_range, 0) = 0 THEN 'cost_range'
              WHEN fits = 0 THEN 'leaf_count' END AS reason
       FROM (SELECT DISTINCT task_id FROM network_tasks WHERE network = 'Brand_1') t LEFT JOIN
         (SELECT task_id, count(*) FILTER (WHERE avg BETWEEN 1.0475::DOUBLE AND 1.06::DOUBLE) AS in_range,
                 count(*) FILTER (WHERE avg BETWEEN 1.0475::DOUBLE AND 1.06::DOUBLE AND leaves = 5) AS fits,
                 round(avg(abs((label-pred)/label)) FILTER (WHERE avg BETWEEN 1.0475::DOUBLE AND 1.06::DOUBLE AND leaves = 5), 9) AS error
          FROM samples s JOIN predictions p USING (sample_id, task_id) GROUP BY task_id) USING (task_id)""",
)
def _(spark, d):
    rows = views.samples(spark, d).join(views.predictions(spark, d).select("sample_id", "label", "pred"), "sample_id")
    tasks = views.network_tasks(spark, d).where("network = 'Brand_1'").select("task_id").distinct()
    out = stats.network_task_errors(tasks, rows, metrics.ape(), [5], 1.0475, 1.06)
    return rounded(out, 9, "error")


@query(
    "scaler_max", "ops",
    """SELECT op_id, round(ave/greatest(1, max(ave) OVER ()), 9) AS ave, round(bs/greatest(1, max(bs) OVER ()), 9) AS bs,
              round(ave, 5) AS back FROM ops""",
)
def _(spark, d):
    o = views.ops(spark, d).select("op_id", "ave", F.col("bs").cast("double").alias("bs"))
    bounds = stats.combine_bounds(
        stats.scaler_bounds(o.where("bs < 8"), ["ave", "bs"]), stats.scaler_bounds(o.where("bs >= 8"), ["ave", "bs"]))
    s = stats.scale_columns(o, ["ave", "bs"], bounds)
    back = stats.scale_columns(s.select("op_id", F.col("ave").alias("back")), ["back"], {"back": bounds["ave"]}, back=True)
    return rounded(s.join(back, "op_id"), 9, "ave", "bs").withColumn("back", F.round("back", 5))


@query(
    "group_by_dims", "ops",
    """SELECT 'dtype=' || dtype || '/op_type=' || op_type || '/ave//32=' || floor(ave/32)::BIGINT AS group_id,
              count(*) AS n, round(avg(ave), 6) AS mean FROM ops GROUP BY 1""",
)
def _(spark, d):
    gid = stats.group_id(["dtype", "op_type", ("ave", "//", 32)])
    return views.ops(spark, d).groupBy(gid.alias("group_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ave"), 6).alias("mean"))


@query(
    "op_time_stats", "trace",
    """SELECT name, cnt, round(median, 6) AS median, round(CASE WHEN noisy THEN a2 ELSE a1 END, 6) AS avg,
              round(CASE WHEN noisy THEN s2 ELSE s1 END, 6) AS std
       FROM (SELECT name, count(*) AS cnt, median(dur) AS median, avg(dur) AS a1, stddev_pop(dur) AS s1,
                    avg(dur) FILTER (WHERE r > 1) AS a2, stddev_pop(dur) FILTER (WHERE r > 1) AS s2,
                    stddev_pop(dur)/avg(dur) > 0.1 AND count(*) > 1 AS noisy
             FROM (SELECT name || '/' || pid AS name, dur, row_number() OVER (PARTITION BY name, pid ORDER BY ts, id) AS r FROM trace)
             GROUP BY name)""",
)
def _(spark, d):
    t = views.trace(spark, d).withColumn("name", F.concat_ws("/", "name", "pid"))
    return rounded(stats.op_time_stats(t, "name", "dur", ["ts", "id"]), 6, "median", "avg", "std")


@query(
    "iteration_time", "trace",
    """SELECT round(avg((e - s)/1000) FILTER (WHERE step > 0 OR n > 1), 6) AS iter_time, count(*) AS steps FROM
       (SELECT step, min_by(epoch_us(ts), id) AS s, max_by(epoch_us(ts) + dur, id) AS e, count(*) AS n
        FROM (SELECT *, id // 100 AS step FROM trace) GROUP BY step) WHERE step < (SELECT max(id // 100) FROM trace)""",
)
def _(spark, d):
    t = views.trace(spark, d).withColumns({"step": F.floor(F.col("id") / 100), "ts_us": F.unix_micros(F.col("ts").cast("timestamp"))})
    return rounded(stats.iteration_time(t, "step", "ts_us", "dur", ["id"]), 6, "iter_time")


@query(
    "cost_cdf", "",
    """SELECT bound, round(n/sum(n) OVER (), 9) AS share_n, round(t/sum(t) OVER (), 9) AS share_t,
              round(sum(n) OVER (ORDER BY bound)/sum(n) OVER (), 9) AS cum_n, round(sum(t) OVER (ORDER BY bound)/sum(t) OVER (), 9) AS cum_t
       FROM (SELECT bound, count(value) AS n, coalesce(sum(value), 0) AS t FROM
             (SELECT unnest(list_zip([0.01,0.05,0.06,0.1,0.5,1,5,10,100,1000]::DOUBLE[], [-1,0.01,0.05,0.06,0.1,0.5,1,5,10,100]::DOUBLE[]), recursive := false) AS b)
             CROSS JOIN LATERAL (SELECT b[1] AS bound, b[2] AS low)
             LEFT JOIN events ON value <= bound AND value > low GROUP BY bound)""",
)
def _(spark, d):
    out = stats.cost_cdf(views.table(spark, d, "events"), "value")
    return rounded(out, 9, "share_n", "share_t", "cum_n", "cum_t")


CATEGORIES = {"Clicks": "^click", "Errors": "err|sign", "Sales": "purchase|signup"}
_CAT = " UNION ALL ".join(
    f"SELECT '{c}' AS category, * FROM k WHERE regexp_matches(name, '{p}')" for c, p in CATEGORIES.items())


@query(
    "kernel_summary", "trace",
    f"""SELECT category, round(sum(percent), 1) AS percent, round(sum(total)/1000, 1) AS total_us, sum(calls) AS calls,
               round(sum(total)/sum(calls)/1000, 1) AS avg_us, round(min(low)/1000, 1) AS min_us,
               round(max(high)/1000, 1) AS max_us, count(*) AS kernels FROM ({_CAT}) GROUP BY category""",
    k="""SELECT name || '_' || pid AS name, sum((dur*100)::BIGINT)::BIGINT AS total, count(*) AS calls, min((dur*100)::BIGINT) AS low,
                max((dur*100)::BIGINT) AS high, round(count(*)*100.0/(SELECT count(*) FROM trace), 3) AS percent FROM trace GROUP BY 1""",
)
def _(spark, d):
    t = views.trace(spark, d)
    ns = F.round(F.col("dur") * 100).cast("bigint")
    total = t.count()
    k = t.groupBy(F.concat_ws("_", "name", "pid").alias("name")).agg(
        F.sum(ns).alias("total"), F.count(F.lit(1)).alias("calls"), F.min(ns).alias("low"), F.max(ns).alias("high"),
        F.round(F.count(F.lit(1)) * 100 / total, 3).alias("percent"))
    return stats.kernel_summary(k, CATEGORIES)


@query(
    "precision_detect", "ops kernels",
    """SELECT gpu_model, op_type, CASE WHEN bool_or(regexp_matches(kernel, '_h1688gemm_64x')) THEN 'FP16' ELSE 'FP32' END AS precision
       FROM kernels GROUP BY ALL""",
)
def _(spark, d):
    return stats.precision(views.kernels(spark, d), "_h1688gemm_64x", ["gpu_model", "op_type"], "kernel")


@query("single_task_check", "task_stat",
       """SELECT n_rows AS file, min(workload_key) = max(workload_key) AS single, count(*) AS n FROM task_stat
          WHERE n_rows IS NOT NULL GROUP BY 1""")
def _(spark, d):
    t = views.task_stat(spark, d).where("n_rows IS NOT NULL").withColumn("file", F.col("n_rows"))
    return stats.single_task_check(t, "file")


@query(
    "compare_two_sets", "",
    " UNION ALL ".join(
        f"""SELECT count(*) FILTER (WHERE a.l_quantity IS NULL OR b.l_quantity IS NULL) AS unmatched, '{c}' AS "column",
            round(avg(abs(a.{c} - b.{c})), 9) AS mean_abs_diff, round(abs(avg(a.{c}) - avg(b.{c})), 9) AS diff_of_means
            FROM a FULL JOIN b USING (r)""" for c in ("l_quantity", "l_discount")),
    a="SELECT l_orderkey AS r, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem WHERE l_linestatus='O' GROUP BY 1",
    b="SELECT l_orderkey AS r, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem WHERE l_linestatus='F' GROUP BY 1",
)
def _(spark, d):
    li = views.table(spark, d, "lineitem")

    def side(s):
        return li.where(F.col("l_linestatus") == s).groupBy(F.col("l_orderkey").alias("r")).agg(
            F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))

    out = stats.compare_two_sets(side("O"), side("F"), ["l_quantity", "l_discount"], "r")
    return rounded(out, 9, "mean_abs_diff", "diff_of_means")


@query("leaf_count_dist", "",
       """SELECT n::INT AS leaves, (n + 1)::INT AS nodes, count(*) AS n, 1 AS trees FROM
          (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY 1) GROUP BY n""")
def _(spark, d):
    t = views.trees(spark, d).withColumn("leaves", F.size("node_ids"))
    return stats.leaf_count_dist(t, "leaves", "tree")


@query("max_leaf", "", "SELECT max(turn) + 1 AS max_leaf FROM conversations")
def _(spark, d):
    return views.trees(spark, d).agg(F.max(F.size("node_ids")).alias("max_leaf"))


_LEARN = """SELECT device, (r - 1)//2 AS pair, count(*) AS n,
    max(f0) FILTER (WHERE r % 2 = 1) AS a0, max(f0) FILTER (WHERE r % 2 = 0) AS b0,
    max(f2) FILTER (WHERE r % 2 = 1) AS a2, max(f2) FILTER (WHERE r % 2 = 0) AS b2,
    max(avg) FILTER (WHERE r % 2 = 1) AS ya, max(avg) FILTER (WHERE r % 2 = 0) AS yb
    FROM (SELECT device, features[1] AS f0, features[3] AS f2, avg,
                 row_number() OVER (PARTITION BY device ORDER BY md5('0' || sample_id), sample_id) AS r FROM samples)
    GROUP BY ALL HAVING count(*) = 2"""


@query(
    "learnability", "samples",
    """SELECT device, pair, round(sqrt((abs(yb-ya)/(abs(b0-a0)+1e-6::DOUBLE))**2 + (abs(yb-ya)/(abs(b2-a2)+1e-6::DOUBLE))**2)/1e3, 6) AS norm FROM p""",
    p=_LEARN,
)
def _(spark, d):
    out = stats.learnability(views.samples(spark, d), "device", "sample_id", "features", "avg", skip=[1, 3])
    return out.withColumn("norm", F.round(F.col("norm") / 1e3, 6))


@query(
    "best_run", "training_log",
    """SELECT series AS file, min(loss) AS mape, min(id) FILTER (WHERE loss = low) AS step FROM
       (SELECT *, min(loss) OVER (PARTITION BY series) AS low FROM training_log) GROUP BY series""",
)
def _(spark, d):
    log = views.training_log(spark, d).select(
        F.col("series").alias("file"), F.col("id").alias("step"), F.col("loss").alias("mape"))
    return stats.best_run(log, "file")


@query(
    "result_pivot", "trace",
    """SELECT tid % 10 AS device, """ + ", ".join(
        f"coalesce(max(dur) FILTER (WHERE k % 8 = {m}), 0) AS \"{m}\"" for m in range(8))
    + " FROM trace WHERE pid = 2 GROUP BY 1",
)
def _(spark, d):
    runs = views.trace(spark, d).select(
        (F.col("tid") % 10).alias("device"), (F.col("k") % 8).alias("method"), "dur", F.col("pid").alias("sample_num"))
    return stats.result_pivot(runs, "device", "method", list(range(8)), "dur", 2)


_TASKS = """SELECT l_orderkey % 100 AS network, CASE WHEN l_linestatus='O' THEN 'T_predict' ELSE 'T_profile' END AS cost_src,
    l_extendedprice/1e9 AS cost, l_linenumber AS weight, CASE WHEN l_returnflag='A' THEN l_quantity ELSE 0 END AS t_record,
    l_quantity*(1+l_discount) AS t_profile FROM lineitem"""


def latency_tasks(spark, d):
    li = views.table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 100).alias("network"),
        F.when(F.col("l_linestatus") == "O", "T_predict").otherwise("T_profile").alias("cost_src"),
        (F.col("l_extendedprice") / 1e9).alias("cost"), F.col("l_linenumber").alias("weight"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(F.lit(0.0)).alias("t_record"),
        (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("t_profile"))


@query(
    "network_latency", "",
    """SELECT network, round(sum(cost*weight*CASE WHEN cost_src='T_predict' AND t_record > 0 AND t_profile > 0
       THEN t_profile/t_record ELSE 1 END)*1000, 6) AS latency_ms FROM t GROUP BY network""", t=_TASKS,
)
def _(spark, d):
    return rounded(stats.network_latency(latency_tasks(spark, d), ["network"]), 6, "latency_ms")


@query(
    "end2end_error", "",
    """SELECT network, round(abs(p - m)/m, 6) AS predicted_error, round(abs(q - m)/m, 6) AS profiled_error FROM
       (SELECT network, sum(cost) AS m, sum(cost*weight) AS p, sum(cost*t_profile) AS q FROM t GROUP BY network)""", t=_TASKS,
)
def _(spark, d):
    t = latency_tasks(spark, d).groupBy("network").agg(
        F.sum("cost").alias("measured"), F.sum(F.col("cost") * F.col("weight")).alias("predicted"),
        F.sum(F.col("cost") * F.col("t_profile")).alias("profiled"))
    out = stats.end2end_error(t, "measured", ["predicted", "profiled"])
    return rounded(out, 6, "predicted_error", "profiled_error").select("network", "predicted_error", "profiled_error")


_FLIP = " UNION ALL ".join(
    f"""SELECT {g}::DOUBLE AS good_below, {b}::DOUBLE AS bad_from,
        count(*) FILTER (WHERE e1 < {g}::DOUBLE) AS before_good, count(*) FILTER (WHERE e1 >= {g}::DOUBLE AND e1 < {b}::DOUBLE) AS before_mid,
        count(*) FILTER (WHERE e1 >= {b}::DOUBLE) AS before_bad, count(*) FILTER (WHERE e2 < {g}::DOUBLE) AS after_good,
        count(*) FILTER (WHERE e2 >= {g}::DOUBLE AND e2 < {b}::DOUBLE) AS after_mid, count(*) FILTER (WHERE e2 >= {b}::DOUBLE) AS after_bad,
        count(*) FILTER (WHERE e1 >= {b}::DOUBLE AND e2 < {g}::DOUBLE) AS flips,
        round(count(*) FILTER (WHERE e1 >= {b}::DOUBLE AND e2 < {g}::DOUBLE)/count(*), 9) AS flip_ratio FROM e"""
    for b, g in stats.FLIP_BOUNDS)


@query("flip_table", "predictions", _FLIP,
       e="SELECT round(abs((label-pred)/label), 6) AS e1, round(abs((label-pred2)/label), 6) AS e2 FROM predictions")
def _(spark, d):
    e = views.predictions(spark, d).select(
        F.round(metrics.ape(), 6).alias("e1"), F.round(metrics.ape(pred="pred2"), 6).alias("e2"))
    return rounded(stats.flip_table(e, "e1", "e2"), 9, "flip_ratio")


@query("cluster_error_summary", "predictions",
       """SELECT device AS k, round(avg(error), 9) AS average, round(max(error), 9) AS maximum, count(*) AS clusters FROM
          (SELECT device, task_id, avg(abs((label-pred)/label)) AS error FROM predictions GROUP BY ALL) GROUP BY 1""")
def _(spark, d):
    e = views.predictions(spark, d).groupBy(F.col("device").alias("k"), "task_id").agg(F.avg(metrics.ape()).alias("error"))
    return rounded(stats.cluster_error_summary(e, "k"), 9, "average", "maximum")


@query("invalid_flops_by_network", "task_stat",
       """SELECT network, count(DISTINCT task_id) AS invalid_tasks, string_agg(DISTINCT task_id::VARCHAR, ',' ORDER BY task_id::VARCHAR) AS tasks,
                 rank() OVER (ORDER BY count(DISTINCT task_id) DESC, network) AS place FROM
          (SELECT unnest(networks) AS network, task_id FROM task_stat WHERE error IS NOT NULL) GROUP BY network""")
def _(spark, d):
    t = views.task_stat(spark, d).withColumn("flops", F.when(F.col("error").isNotNull(), -1).otherwise(F.col("n_rows")))
    out = stats.invalid_flops_by_network(t)
    return out.withColumn("tasks", F.array_join(F.array_sort(F.col("tasks").cast("array<string>")), ","))


@query("log_flops", "samples", "SELECT sample_id, round(log10(greatest(flops, 1)), 9) AS log_flops FROM samples")
def _(spark, d):
    return views.samples(spark, d).select("sample_id", F.round(stats.log_flops(), 9).alias("log_flops"))


@query("op_type_coverage", "",
       """SELECT count(s) AS in_source, count(g) AS in_target, count(*) FILTER (WHERE s IS NULL) AS target_only,
          count(*) FILTER (WHERE s IS NOT NULL AND g IS NOT NULL) AS common FROM
          (SELECT DISTINCT p_name AS t, 1 AS s FROM part WHERE p_size < 8) FULL JOIN
          (SELECT DISTINCT p_name AS t, 1 AS g FROM part WHERE p_size > 40) USING (t)""")
def _(spark, d):
    p = views.table(spark, d, "part")
    return stats.op_type_coverage(p.where("p_size < 8"), p.where("p_size > 40"), "p_name")


@query("func_time_sum", "trace",
       """SELECT name, round(avg(dur), 6) AS mean, round(sum(avg(dur)) OVER (), 6) AS total FROM trace
          WHERE regexp_matches(name, 'click|view') GROUP BY name""")
def _(spark, d):
    means = stats.func_time(views.trace(spark, d), "name", "dur", ["click", "view"])
    total = means.agg(F.sum("mean").alias("total")).first()["total"]
    return rounded(means.withColumn("total", F.lit(total)), 6, "mean", "total")
