"""Queries: splits, task selection, sampling and set operations."""

from pyspark.sql import functions as F

from perfspark.operators import domain, split
from perfspark.plans import views
from perfspark.plans.registry import query


@query(
    "split_every_kth", "samples",
    """SELECT sample_id, CASE WHEN r > 5*(n//5) THEN 0 WHEN r % 5 = 0 THEN 2 ELSE 1 END AS split_code FROM
       (SELECT sample_id, row_number() OVER (ORDER BY avg, sample_id) AS r, count(*) OVER () AS n FROM samples)""",
)
def _(spark, d):
    s = views.samples(spark, d).select("sample_id", "avg")
    return split.every_kth(s, "avg", "sample_id").select("sample_id", "split_code")


@query("split_random", "samples",
       """SELECT sample_id, CASE WHEN ('0x' || substr(md5('0' || sample_id), 1, 8))::BIGINT/4294967296.0::DOUBLE < 0.8::DOUBLE
          THEN 1 ELSE 2 END AS split_code FROM samples""")
def _(spark, d):
    return split.random_split(views.samples(spark, d).select("sample_id"), "sample_id", 0.8)


def device_tasks(spark, d):
    return views.samples(spark, d).select("device", "task_id").distinct()


def ready_tasks(spark, d):
    """Task table with one row per task id of the samples."""
    return views.table(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("task_id")).agg(
        F.max(F.when(F.col("p_size") < 46, F.col("p_size"))).alias("n_rows"))


_TASKS = "SELECT DISTINCT device, task_id FROM samples"
_READY = "SELECT p_partkey % 50 AS task_id, max(CASE WHEN p_size < 46 THEN p_size END) AS n_rows FROM part GROUP BY 1"
_PICKED = """SELECT device, task_id FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY task_id) AS r FROM t)
    WHERE (device = 'd0' AND r <= 20) OR (device = 'd2' AND task_id IN (3, 7, 49))
    UNION SELECT 'd0', task_id FROM network_tasks JOIN (SELECT task_id FROM ready WHERE n_rows IS NOT NULL) USING (task_id)
          WHERE (network = 'Brand_3' AND bs = 7) OR (network = 'Brand_5' AND bs = 9)
    UNION SELECT 'd1', task_id FROM (SELECT task_id FROM t WHERE device = 'd1' ORDER BY md5('0' || task_id), task_id LIMIT 10)"""
_MODE = "d0:sample20+network-Brand_3_bs7-Brand_5_bs9,d1:cross+random10,d2:list-3-7-49"


def _select(spark, d, mode):
    return split.select_tasks(mode, device_tasks(spark, d), views.network_tasks(spark, d), ready_tasks(spark, d), "d0")


@query("select_tasks", "samples network_tasks", "SELECT device, task_id, 0 AS split_code FROM p", t=_TASKS, ready=_READY, p=_PICKED)
def _(spark, d):
    return _select(spark, d, _MODE)


@query("split_by_device", "samples network_tasks",
       "SELECT device, task_id, CASE WHEN device = 'd2' THEN 2 ELSE 1 END AS split_code FROM p", t=_TASKS, ready=_READY, p=_PICKED)
def _(spark, d):
    return _select(spark, d, _MODE + ".by_device:test-d2")


@query(
    "split_by_network", "samples network_tasks",
    """SELECT device, task_id, bit_or(CASE WHEN network IN ('Brand_1','Brand_2') OR (network = 'Brand_4' AND bs = 3) THEN 2 ELSE 1 END) AS split_code
       FROM p JOIN network_tasks USING (task_id) GROUP BY ALL""", t=_TASKS, ready=_READY, p=_PICKED,
)
def _(spark, d):
    return _select(spark, d, _MODE + ".by_net:test-Brand_1-Brand_2-Brand_4_bs3")


@query(
    "combine_split_codes", "samples network_tasks",
    """SELECT sample_id, CASE WHEN avg >= 0.3::DOUBLE AND std/avg <= 0.01::DOUBLE THEN code ELSE 0 END AS split_code FROM samples
       JOIN (SELECT device, task_id, bit_or(CASE WHEN device = 'd2' THEN 2 ELSE 1 END) AS code FROM p GROUP BY ALL) USING (device, task_id)""",
    t=_TASKS, ready=_READY, p=_PICKED,
)
def _(spark, d):
    tasks = _select(spark, d, _MODE + ".by_device:test-d2")
    rows = views.samples(spark, d).withColumn("kept", (F.col("avg") >= 0.3) & (F.try_divide("std", "avg") <= 0.01))
    return split.combine_codes(rows, tasks, ["device", "task_id"]).select("sample_id", "split_code")


@query(
    "assign_shards", "samples",
    """SELECT device, task_id, ntile(4) OVER (ORDER BY md5('0' || device || '_' || task_id), device || '_' || task_id) - 1 AS shard_id
       FROM (SELECT DISTINCT device, task_id FROM samples)""",
)
def _(spark, d):
    return split.assign_shards(device_tasks(spark, d), ["device", "task_id"])


def _classes(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "lang")


@query(
    "upsample_minority", "",
    """SELECT doc_id, lang, count(*) AS copies FROM
         (SELECT *, unnest(generate_series(0, (large + n - 1)//n - 1)) AS k FROM c) WHERE k*n + r <= large GROUP BY ALL""",
    c="""SELECT *, max(n) OVER () AS large FROM
         (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n
          FROM documents)""",
)
def _(spark, d):
    return split.upsample(_classes(spark, d), "lang", "doc_id").groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "downsample_majority", "",
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0' || doc_id), doc_id) AS r
         FROM documents)
       WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""",
)
def _(spark, d):
    return split.downsample(_classes(spark, d), "lang", "doc_id")


@query(
    "grid_configs", "",
    """SELECT ((i*nb + j)*ns + k)::BIGINT AS config_id, p_type, p_brand, p_size, (((i*nb + j)*ns + k) % 4)::INT AS worker FROM
       (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part)),
       (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS j, count(*) OVER () AS nb FROM (SELECT DISTINCT p_brand FROM part)),
       (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS k, count(*) OVER () AS ns FROM (SELECT DISTINCT p_size FROM part))
       WHERE p_size % 2 = 0 OR p_brand < 'Brand#2'""",
)
def _(spark, d):
    p = views.table(spark, d, "part")
    valid = (F.col("p_size") % 2 == 0) | (F.col("p_brand") < "Brand#2")
    return split.grid_of_columns(spark, {c: p for c in ("p_type", "p_brand", "p_size")}, valid, 4)


@query("union_samples", "samples predictions",
       """SELECT device, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT device, avg AS v FROM samples UNION ALL
          SELECT device, pred FROM predictions) GROUP BY device""")
def _(spark, d):
    a = views.samples(spark, d).select("device", F.col("avg").alias("v"))
    b = views.predictions(spark, d).select("device", F.col("pred").alias("v"))
    return split.union_samples([a, b], [False, False]).groupBy("device").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("new_tasks_only", "network_tasks",
       """SELECT DISTINCT task_id FROM network_tasks WHERE network = 'Brand_3' AND task_id NOT IN
          (SELECT task_id FROM network_tasks WHERE network = 'Brand_4')""")
def _(spark, d):
    n = views.network_tasks(spark, d)
    return split.new_tasks(n.where("network = 'Brand_3'").select("task_id").distinct(),
                           n.where("network = 'Brand_4'").select("task_id").distinct())


@query("common_tasks", "network_tasks",
       """SELECT k AS workload_key, bool_or(network = 'Brand_3') AS in_a, bool_or(network = 'Brand_4') AS in_b,
                 bool_or(network = 'Brand_3') AND bool_or(network = 'Brand_4') AS common
          FROM x WHERE network IN ('Brand_3', 'Brand_4') GROUP BY k""",
       x="SELECT network, bs || '/' || task_id % 5 AS k FROM network_tasks")
def _(spark, d):
    n = views.network_tasks(spark, d).withColumn(
        "workload_key", F.concat_ws("/", F.col("bs").cast("string"), (F.col("task_id") % 5).cast("string")))
    return split.common_tasks(n.where("network = 'Brand_3'"), n.where("network = 'Brand_4'"))


@query("domain_complement", "vector_entries",
       "SELECT pos, round(avg(v), 9) AS mean, count(*) AS n FROM vector_entries WHERE domain <> 3 GROUP BY pos")
def _(spark, d):
    rest = split.complement(views.vectors(spark, d), "domain", 3)
    return domain.power_sums(rest, [], "x", [0.0] * 64, 1).select(
        "pos", F.round(F.col("s1") / F.col("n"), 9).alias("mean"), "n")


@query("remove_samples", "samples",
       "SELECT device, count(*) AS n FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM samples WHERE std/avg > 0.01::DOUBLE) GROUP BY 1")
def _(spark, d):
    s = views.samples(spark, d)
    bad = s.where(F.try_divide("std", "avg") > 0.01).select("sample_id")
    return split.remove_samples(s, bad, "sample_id").groupBy("device").agg(F.count(F.lit(1)).alias("n"))
