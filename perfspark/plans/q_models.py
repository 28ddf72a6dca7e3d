"""Queries: clusters, task selection and fitted models."""

import numpy as np
from pyspark.sql import functions as F

from perfspark.operators import derive, domain, joins, metrics, models, router
from perfspark.operators.ranking import add_rank
from perfspark.plans import views
from perfspark.plans.q_filters import RULES
from perfspark.plans.q_metrics import _CMD, _moments
from perfspark.plans.q_stats import rounded
from perfspark.plans.registry import query
from perfspark.runtime import materialize


#: Steps that the SQL twins of the clusterings unroll.
KMEANS_STEPS = 2


def _lloyd(k: int) -> dict[str, str]:
    """Steps of the clustering as common table expressions; ``assigned`` has
    the rows with their cluster."""
    out = {"c0": f"""SELECT cluster, pos, v AS c FROM vector_entries JOIN
        (SELECT id, row_number() OVER (ORDER BY md5('0' || id), id) - 1 AS cluster FROM
          (SELECT arg_min(id, (md5('0' || id), id)) AS id FROM vectors GROUP BY x) QUALIFY cluster < {k}) USING (id)"""}
    gap = "SELECT id, cluster, sum((v-c)*(v-c)) AS d FROM vector_entries JOIN c{i} USING (pos) GROUP BY ALL"
    pick = "SELECT id, arg_min(cluster, (d, cluster)) AS cluster FROM ({}) GROUP BY id"
    for i in range(KMEANS_STEPS):
        out[f"a{i}"] = pick.format(gap.format(i=i))
        out[f"c{i + 1}"] = f"""SELECT o.cluster, o.pos, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN
            (SELECT cluster, pos, avg(v) AS c FROM vector_entries JOIN a{i} USING (id) GROUP BY ALL) n USING (cluster, pos)"""
    out["assigned"] = pick.format(gap.format(i=KMEANS_STEPS))
    return out


@query("kmeans_clusters", "vectors vector_entries",
       "SELECT cluster, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM assigned GROUP BY cluster", **_lloyd(10))
def _(spark, d):
    _, rows = models.kmeans(views.vectors(spark, d), "x", 10, steps=KMEANS_STEPS)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _settled(name: str, k: int):
    """Clusters after the default steps, or when the centres stand still."""
    @query(f"{name}_settled")
    def _(spark, d):
        if name == "select_tasks_kmeans":
            return models.select_kmeans(task_vectors(spark, d), k)
        _, rows = models.kmeans(views.vectors(spark, d), "x", k)
        if name == "cluster_mix_distance":
            return domain.cluster_mix_distance(rows, rows, "domain")
        return rows.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


for _name, _k in (("kmeans_clusters", 10), ("cluster_mix_distance", 20), ("select_tasks_kmeans", 4)):
    _settled(_name, _k)


@query(
    "di_clusters", "coarse_samples",
    """SELECT sample_id, dense_rank() OVER (ORDER BY f) - 1 AS cluster FROM
       (SELECT sample_id, min(sample_id) OVER (PARTITION BY x0, x1, x2, x3) AS f FROM coarse_samples)""",
)
def _(spark, d):
    s = views.coarse_samples(spark, d).select("sample_id", "x")
    return models.descriptor_clusters(s, F.col("x"), "sample_id").select("sample_id", "cluster")


@query("pca_2d", "vector_entries",
       """SELECT id, round(abs(p*cos(t) + q*sin(t)), 6) AS pc1, round(abs(q*cos(t) - p*sin(t)), 6) AS pc2,
              round((m + r)/(2*m), 6) AS explained1, round((m - r)/(2*m), 6) AS explained2
          FROM v, (SELECT (a + c)/2 AS m, sqrt(((a - c)/2)**2 + b*b) AS r, atan2(2*b, a - c)/2 AS t FROM
                   (SELECT var_samp(p) AS a, covar_samp(p, q) AS b, var_samp(q) AS c FROM v))""",
       v="""SELECT id, sum(v) FILTER (WHERE pos % 2 = 0) AS p, sum(v*pos) FILTER (WHERE pos % 2 = 1)/10 AS q
            FROM vector_entries GROUP BY id""")
def _(spark, d):
    # Two sums over the entries of a vector: their components have a closed form.
    entries = lambda odd, f: F.aggregate(F.filter(F.transform("x", f), lambda v, i: i % 2 == odd), F.lit(0.0), lambda s, v: s + v)
    v = views.vectors(spark, d).select("id", F.array(
        entries(0, lambda v, i: v), entries(1, lambda v, i: v * i) / 10).alias("x"))
    rows, share = models.pca(v, "x")
    return rows.select("id", *[F.round(F.abs(F.col("pc")[i]), 6).alias(f"pc{i + 1}") for i in range(2)],
                       *[F.lit(round(share[i], 6)).alias(f"explained{i + 1}") for i in range(2)])


@query("pca_vectors")
def _(spark, d):
    """Components of the whole vectors; their signs are arbitrary."""
    rows, share = models.pca(views.vectors(spark, d), "x")
    return rows.select("id", "domain", *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(2)],
                       *[F.lit(share[i]).alias(f"explained{i + 1}") for i in range(2)])


@query("cluster_mix_distance", "vectors vector_entries",
       """SELECT domain, round(sqrt(greatest(2 - 2*sum(g.n*t.n)/(sqrt(any_value(gn))*sqrt(any_value(tn))), 0)), 6) AS distance
          FROM g JOIN t USING (cluster) JOIN (SELECT domain, sum(n*n) AS gn FROM g GROUP BY 1) USING (domain),
               (SELECT sum(n*n) AS tn FROM t) GROUP BY domain""",
       **_lloyd(20),
       g="SELECT domain, cluster, count(*) AS n FROM assigned JOIN vectors USING (id) GROUP BY ALL",
       t="SELECT cluster, count(*) AS n FROM assigned GROUP BY ALL")
def _(spark, d):
    v = views.vectors(spark, d)
    _, rows = models.kmeans(v, "x", 20, steps=KMEANS_STEPS)
    return rounded(domain.cluster_mix_distance(rows, rows, "domain"), 6, "distance")


def task_vectors(spark, d):
    return views.vectors(spark, d).withColumn("task_id", F.col("domain").cast("bigint"))


def _choices(k: int) -> dict[str, str]:
    """Clusters from the largest, each with its nearest task that is free."""
    out = {
        "far": f"""SELECT cluster, domain AS task_id, avg(sqrt(d)) AS distance FROM
            (SELECT id, cluster, sum((v-c)*(v-c)) AS d FROM vector_entries JOIN c{KMEANS_STEPS} USING (pos) GROUP BY ALL)
            JOIN vectors USING (id) GROUP BY ALL""",
        "turns": """SELECT cluster, row_number() OVER (ORDER BY coalesce(n, 0) DESC, cluster) AS turn FROM (SELECT DISTINCT cluster FROM far)
            LEFT JOIN (SELECT cluster, count(*) AS n FROM assigned GROUP BY 1) USING (cluster)""",
    }
    gone = "false"
    for i in range(k):
        out[f"t{i}"] = f"""SELECT cluster, task_id, distance FROM far JOIN turns USING (cluster) WHERE turn = {i + 1} AND NOT ({gone})
            ORDER BY distance, task_id LIMIT 1"""
        gone += f" OR task_id = (SELECT task_id FROM t{i})"
    return out


@query("select_tasks_kmeans", "vectors vector_entries",
       " UNION ALL ".join(f"SELECT cluster, task_id, round(distance, 6) AS distance FROM t{i}" for i in range(4)),
       **_lloyd(4), **_choices(4))
def _(spark, d):
    return rounded(models.select_kmeans(task_vectors(spark, d), 4, steps=KMEANS_STEPS), 6, "distance")


@query(
    "select_tasks_center", "vector_entries",
    """SELECT domain AS task_id, round(sqrt(sum((a.m1-b.m1)**2)), 9) AS distance FROM
       (SELECT domain, pos, avg(v) AS m1 FROM vector_entries GROUP BY ALL) a JOIN
       (SELECT pos, avg(v) AS m1 FROM vector_entries GROUP BY ALL) b USING (pos) GROUP BY domain ORDER BY 2, 1 LIMIT 4""",
)
def _(spark, d):
    return rounded(models.select_center(task_vectors(spark, d), 4), 9, "distance")


@query(
    "select_tasks_cmd", "vector_entries",
    f"SELECT domain AS task_id, round({_CMD}, 9) AS cmd FROM a JOIN b USING (pos) GROUP BY domain ORDER BY 2, 1 LIMIT 4",
    a=_moments("vector_entries", "domain"), b=_moments("vector_entries", ""),
)
def _(spark, d):
    return rounded(models.select_cmd(task_vectors(spark, d), 4), 9, "cmd")


def _greedy(steps):
    out, gone = {}, "false"
    for i in range(steps):
        out[f"e{i}"] = f"SELECT * FROM vector_entries WHERE NOT ({gone})"
        out[f"a{i}"] = _moments(f"e{i}", "domain")
        out[f"b{i}"] = _moments(f"e{i}", "")
        out[f"p{i}"] = f"SELECT {i} AS step, domain AS task_id, {_CMD} AS cmd FROM a{i} a JOIN b{i} b USING (pos) GROUP BY domain ORDER BY 3, 2 LIMIT 1"
        gone += f" OR domain = (SELECT task_id FROM p{i})"
    return out


@query("select_tasks_cmd_rm", "vector_entries",
       " UNION ALL ".join(f"SELECT step, task_id, round(cmd, 6) AS cmd FROM p{i}" for i in range(3)), **_greedy(3))
def _(spark, d):
    return rounded(models.select_cmd_remove(task_vectors(spark, d), 3), 6, "cmd")


@query("select_tasks_random", "samples",
       "SELECT task_id FROM (SELECT DISTINCT task_id FROM samples) ORDER BY md5('0' || task_id), task_id LIMIT 10")
def _(spark, d):
    return models.select_random(views.samples(spark, d), 10)


@query(
    "selection_quality", "vector_entries", f"SELECT round({_CMD}, 9) AS cmd FROM a JOIN b USING (pos)",
    c="SELECT domain FROM (SELECT DISTINCT domain FROM vector_entries) ORDER BY md5('0' || domain), domain LIMIT 4",
    e="SELECT * FROM vector_entries WHERE domain IN (SELECT domain FROM c)",
    a=_moments("vector_entries", ""), b=_moments("e", ""),
)
def _(spark, d):
    t = task_vectors(spark, d)
    return rounded(models.selection_quality(t, models.select_random(t, 4)), 9, "cmd")


def planted(spark, d):
    """Rows whose label is a step function of two of their features, which a
    tree of depth 3 states exactly; train and test rows."""
    s = views.samples(spark, d).select(
        "sample_id", "leaves", F.array(F.col("leaves").cast("double"), F.round(F.col("features")[1] * 100), F.col("features")[0]).alias("x"))
    step = F.when(F.col("x")[0] > 3, 2.0).otherwise(1.0) + F.when(F.col("x")[1] > 5, 4.0).otherwise(0.0)
    s = s.withColumn("label", step)
    train = F.substring(F.md5("sample_id"), 1, 1) < "d"
    return s.where(train), s.where(~train)


_EXACT = """round(0.0::DOUBLE, 6) AS mape, round(0.0::DOUBLE, 6) AS rmse, round(1.0::DOUBLE, 6) AS r2,
    1.0::DOUBLE AS acc20, 1.0::DOUBLE AS acc10, 1.0::DOUBLE AS acc5, 0 AS undefined"""


@query("gbt_regression", "samples", f"SELECT loss, {_EXACT} FROM (SELECT unnest(['MSE', 'MSPE']) AS loss)")
def _(spark, d):
    train, test = planted(spark, d)
    out = None
    for loss in ("MSE", "MSPE"):
        scored = models.gbt(train, test, "x", "label", loss, rounds=5)
        row = rounded(metrics.regression(scored), 6, "mape", "rmse", "r2").withColumn("loss", F.lit(loss))
        out = row if out is None else out.unionByName(row)
    return out


@query("rf_good_bad", "samples",
       """SELECT CASE WHEN ('0x' || substr(md5('0' || sample_id), 1, 8))::BIGINT/4294967296.0::DOUBLE < 0.95::DOUBLE THEN 'val' ELSE 'test' END AS side,
                 CASE WHEN leaves > 3 THEN 'best' ELSE 'worst' END AS part, 1.0::DOUBLE AS accuracy, count(*) AS n FROM samples GROUP BY ALL""")
def _(spark, d):
    train, test = planted(spark, d)
    rows = train.unionByName(test).withColumn("part", F.when(F.col("leaves") > 3, "best").otherwise("worst"))
    return models.good_bad_forest(rows.withColumn("x", F.slice("x", 1, 1)), "x", "sample_id")


@query("rf_best_worst")
def _(spark, d):
    """The third of rows predicted best against the third predicted worst."""
    p = views.predictions(spark, d).select("sample_id", "label", "pred")
    x = views.samples(spark, d).select("sample_id", F.col("features").cast("array<double>").alias("x"))
    return models.good_bad_forest(
        lambda: metrics.best_worst(joins.join_in_rounds(p, x, "sample_id"), "sample_id", thirds=True, place=False), "x", "sample_id")


@query(
    "per_group_models", "samples",
    """SELECT task_id, round(avg(abs((avg - (a*features[1] + b))/avg)), 6) AS mape, count(*) AS n FROM
       (SELECT * FROM samples WHERE NOT substr(md5(sample_id), 1, 1) < 'd') LEFT JOIN
       (SELECT task_id, regr_slope(avg, features[1]) AS a, regr_intercept(avg, features[1]) AS b FROM samples
        WHERE substr(md5(sample_id), 1, 1) < 'd' GROUP BY task_id) USING (task_id) GROUP BY task_id""",
)
def _(spark, d):
    s = views.samples(spark, d).select("sample_id", "task_id", F.col("avg").alias("label"), F.col("features")[0].alias("quantity"))
    train = F.substring(F.md5("sample_id"), 1, 1) < "d"
    out = models.per_group_models(s.where(train), s.where(~train), "task_id", {"quantity": F.col("quantity")}, "label")
    return rounded(out, 6, "mape")


@query(
    "grouped_least_squares", "samples",
    """SELECT task_id, round(regr_slope(avg, features[1]), 6) AS slope, round(regr_intercept(avg, features[1]), 6) AS one,
              count(*) AS n FROM samples GROUP BY task_id""",
)
def _(spark, d):
    fit = models.least_squares(
        views.samples(spark, d), ["task_id"], {"slope": F.col("features")[0], "one": F.lit(1.0)}, "avg")
    return fit.select("task_id", *[F.round(F.col("coef")[c], 6).alias(c) for c in ("slope", "one")], "n")


def cost_rows(spark, d):
    """Kernel rows of one device with the facts the cost models use."""
    k = derive.kernel_parts(views.kernels(spark, d))
    unit = F.substring("gpu_model", 2, 1).cast("int")
    k = k.withColumn("source", F.concat(F.lit("d"), unit.cast("string"))).withColumn(
        "target", F.concat(F.lit("d"), ((unit + 2) % 5).cast("string")))
    # names and tiles are written apart: all steps in one plan take half as long again
    k = materialize(k.select(
        *[c for c in views.ops(spark, d).columns if c != "model"], "kernel", "source", "target", "tensor_core_or_not",
        "threadblock_m", "threadblock_n", "threadblock_k"))
    e = derive.op_features(derive.enrich_device_pair(k, views.devices(spark, d), "source", "target"))
    # The planted cost is one that the model with repeated reading states exactly.
    time = F.col("tile_size_in") / F.col("target_bw") * F.col("pipeline_num") + F.col("transform") * 1e-6 + 0.1
    return e.select(
        "op_id", "kernel", F.col("ave").alias("source_time"), time.alias("time"), "op_flops", "size", "transform", "ai",
        (F.col("perf") / 1e9).alias("perf"), "tile_size_in", "tile_size_out", "tile_flop", "pipeline_num",
        "target_bw", "target_clock", "target_core_num")


def _cost_fit(spark, d):
    rows = materialize(cost_rows(spark, d))
    return rows, *models.cost_fit(rows, rows, "kernel", "time")


_NOISE = "('0x' || substr(md5(op_id::VARCHAR), 1, 6))::BIGINT % 100"


@query("grouped_cost_fit", "ops kernels",
       f"""SELECT kernel, 1 AS method, n, round(CASE WHEN s < 0 THEN 0 WHEN i < 0 THEN xy/xx ELSE s END, 6) AS time,
              round(CASE WHEN s < 0 THEN my WHEN i < 0 THEN 0 ELSE i END, 6) AS one FROM
           (SELECT kernel, count(*) AS n, regr_slope(y, ave) AS s, regr_intercept(y, ave) AS i, sum(ave*y) AS xy, sum(ave*ave) AS xx, avg(y) AS my
            FROM (SELECT kernel, ave, ave*(1 + ({_NOISE})/100.0::DOUBLE) + ({_NOISE})/10.0::DOUBLE AS y FROM kernels) GROUP BY kernel
            HAVING var_pop(ave) > 0)""")
def _(spark, d):
    noise = F.pmod(F.conv(F.substring(F.md5(F.col("op_id").cast("string")), 1, 6), 16, 10).cast("bigint"), F.lit(100))
    k = views.kernels(spark, d).select("kernel", F.col("ave").alias("source_time"), (
        F.col("ave") * (1 + noise / 100) + noise / 10).alias("time"))
    varied = k.groupBy("kernel").agg(F.var_pop("source_time").alias("v"), F.count(F.lit(1)).alias("n")).where("v > 0").select("kernel", "n")
    # only the first method's facts are known here
    features, positive = models.cost_methods()[1][0]
    fit = models.least_squares(k, ["kernel"], features, "time", positive)
    return fit.drop("n").join(varied, "kernel").select("kernel", F.lit(1).alias("method"), "n", *[
        F.round(F.col("coef")[c], 6).alias(c) for c in ("time", "one")])


@query("grouped_cost_fit_all")
def _(spark, d):
    """Every method and variant of every kernel: coefficients from the train
    rows, error on the test rows; null where a kernel has none of them."""
    rows = materialize(cost_rows(spark, d))
    train = F.substring(F.md5(F.col("op_id").cast("string")), 1, 1) < "d"
    params, errors = models.cost_fit_all(rows.where(train), rows.where(~train), "kernel", "time")
    counts = rows.groupBy("kernel").agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"))
    return counts.join(params, "kernel", "left").join(errors, ["kernel", "method", "variant"], "left").select(
        "kernel", "n_train", "n_test", "method", "variant", "coef", "mape")


@query("fit_table", "ops kernels", "SELECT kernel, 0.0::DOUBLE AS m6, 0.0::DOUBLE AS best_mape FROM kernels GROUP BY kernel")
def _(spark, d):
    out = models.fit_table(_cost_fit(spark, d)[2], "kernel")
    return out.select("kernel", F.round("6", 3).alias("m6"), F.round("best_mape", 3).alias("best_mape"))


@query("parameter_table", "ops kernels",
       "SELECT kernel, 1.0::DOUBLE AS ratio FROM kernels WHERE starts_with(kernel, 'cutlass_tensorop') GROUP BY kernel")
def _(spark, d):
    """The tabled parameters, applied to the rows, give back the planted cost."""
    rows, params, _ = _cost_fit(spark, d)
    table = models.parameter_table(params, "kernel", "cutlass_tensorop")
    features = models.cost_methods()[6][0][0]
    predicted = sum((F.coalesce(F.col(f"m6_{n}"), F.lit(0.0)) * f for n, f in features.items()), F.lit(0.0))
    return rows.join(table, "kernel").groupBy("kernel").agg(F.round(F.sum(predicted) / F.sum("time"), 6).alias("ratio"))


_W = [0.01, 1.0, 2.0, 0.5]
_CASES = [(f, s) for f in models.NOISE_FORMS for s in models.NOISE_SCALES]
_MOVE = {"+": "v + {s}", "-": "v - {s}", "*": "v*(1 + {s})", "/": "v*(1 - {s})"}


def _changes_sql():
    parts = []
    for e in range(4):
        for f, s in _CASES:
            v = _MOVE[f].format(s=f"{s}::DOUBLE").replace("v", f"features[{e + 1}]", 1)
            parts.append(
                f"SELECT {e} AS entry, '{f}' AS form, {s}::DOUBLE AS scale, "
                f"avg(abs((avg - (p + ({v} - features[{e + 1}])*{_W[e]!r}::DOUBLE))/avg)) - avg(abs((avg - p)/avg)) AS change FROM q")
    return " UNION ALL ".join(parts)


_SENS = dict(
    q="SELECT *, features[1]*0.01::DOUBLE + features[2]*1 + features[3]*2 + features[4]*0.5::DOUBLE AS p FROM samples",
    c=_changes_sql(),
)


def _sensitivity(spark, d):
    weights = np.array(_W)
    return models.entry_sensitivity(
        views.samples(spark, d), "features", "avg", 4, lambda m: m @ weights, lambda p, y: np.abs((y - p) / y))


@query("entry_sensitivity", "samples", "SELECT entry, form, scale, round(change, 6) AS change FROM c", **_SENS)
def _(spark, d):
    return rounded(_sensitivity(spark, d), 6, "change")


@query("entry_importance", "samples",
       """SELECT entry, round(avg(abs(change)/total), 6) AS importance FROM c JOIN
          (SELECT form, scale, sum(abs(change)) AS total FROM c GROUP BY ALL) USING (form, scale) GROUP BY entry""", **_SENS)
def _(spark, d):
    return rounded(models.entry_importance(_sensitivity(spark, d)), 6, "importance")


@query(
    "routed_scoring", "samples",
    """SELECT sample_id, CASE WHEN std > 0.01::DOUBLE THEN '-inf'::DOUBLE WHEN flops < 0 OR t IS NULL THEN -1.0::DOUBLE
         ELSE round(1/CASE t WHEN 'large' THEN flops/1e9 WHEN 'small' THEN avg + 1 ELSE avg + 2 END, 6) END AS score
       FROM (SELECT *, CASE WHEN leaves = 5 THEN CASE WHEN flops >= 1e9 THEN 'large' ELSE 'small' END
             WHEN leaves IN (1,2) THEN CASE WHEN flops < 2e9 THEN 'light' END END AS t FROM samples)""",
)
def _(spark, d):
    target = router.route(RULES, {"leaf_node_no": "leaves", "FLOPs": "flops"})
    preds = {"large": F.col("flops") / 1e9, "small": F.col("avg") + 1, "light": F.col("avg") + 2}
    out = models.routed_score(views.samples(spark, d), target, preds, F.lit(-1.0), F.col("std") <= 0.01)
    return out.select("sample_id", F.round("score", 6).alias("score"))


@query("routed_models", "samples",
       """SELECT CASE WHEN leaves < 4 THEN 'few' WHEN leaves < 6 THEN 'many' END AS target, count(*) AS n,
                 round(avg(CASE WHEN leaves < 6 THEN 0 ELSE abs((label - 0.5::DOUBLE)/label) END), 6) AS mape FROM
          (SELECT leaves, CASE WHEN leaves > 3 THEN 2 ELSE 1 END + CASE WHEN round(features[2]*100) > 5 THEN 4 ELSE 0 END AS label
           FROM samples WHERE NOT substr(md5(sample_id), 1, 1) < 'd') GROUP BY 1""")
def _(spark, d):
    train, test = planted(spark, d)
    test = test.withColumn("flops", F.lit(1.0))
    target = F.when(F.col("x")[0] < 4, "few").when(F.col("x")[0] < 6, "many")

    def model(cond):
        return lambda rows: models.gbt(train.where(cond), rows, "x", "label", rounds=3)

    out = models.routed_transform(
        test, target, {"few": model(F.col("x")[0] < 4), "many": model(F.col("x")[0].between(4, 5))},
        lambda rows: rows.withColumn("pred", F.lit(0.5)))
    return rounded(out.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg(metrics.ape()).alias("mape")), 6, "mape")


def _curve(grid: str) -> str:
    """Best shift and limit per series among the shifts of a grid."""
    return f"""SELECT series, arg_min(b, (sse, b)) AS b, arg_min(c, (sse, b)) AS c FROM
       (SELECT *, n*(vy - 2*a*cuy + a*a*vu + (my - a*mu - c)**2) AS sse FROM
         (SELECT *, CASE WHEN flat THEN 0 WHEN fc < 0 THEN greatest((cuy + mu*my)/(vu + mu*mu), 0) ELSE fa END AS a,
                 CASE WHEN flat THEN greatest(my, 0) WHEN fc < 0 THEN 0 ELSE fc END AS c FROM
           (SELECT *, cuy/nullif(vu, 0) AS fa, my - cuy/nullif(vu, 0)*mu AS fc, coalesce(cuy/nullif(vu, 0) < 0, true) AS flat FROM
             (SELECT series, b, count(*) AS n, avg(1/(r+b)) AS mu, avg(loss) AS my, var_pop(1/(r+b)) AS vu,
                     covar_pop(1/(r+b), loss) AS cuy, var_pop(loss) AS vy FROM o JOIN ({grid}) USING (series) GROUP BY ALL)))) GROUP BY series"""


@query(
    "forecast_convergence", "training_log", "SELECT series, round(c, 4) AS forecast FROM f2",
    o="SELECT series, loss, row_number() OVER (PARTITION BY series ORDER BY ts, id) AS r FROM training_log",
    f0=_curve(f"SELECT series, s*g AS b FROM (SELECT series, (max(r) - min(r))::DOUBLE AS s FROM o GROUP BY 1), (SELECT unnest({models.SHIFT_GRID}::DOUBLE[]) AS g)"),
    **{f"f{i + 1}": _curve(f"SELECT series, b*g AS b FROM f{i}, (SELECT unnest({steps}::DOUBLE[]) AS g)") for i, steps in enumerate(models.SHIFT_STEPS)},
)
def _(spark, d):
    ranked = add_rank(views.training_log(spark, d), ["ts", "id"], ["series"], "step")
    out = models.forecast(ranked, ["series"], "step", "loss")
    return out.select("series", F.round("forecast", 4).alias("forecast"))


@query(
    "forecast_convergence_smoothed", "training_log", "SELECT series, round(c, 4) AS forecast FROM f2",
    raw="SELECT series, loss, row_number() OVER (PARTITION BY series ORDER BY ts, id) AS r FROM training_log",
    o="""SELECT series, r, loss FROM raw WHERE r = 1 UNION ALL
         SELECT raw.series, raw.r, 0.6::DOUBLE*o.loss + (1-0.6::DOUBLE)*raw.loss FROM o JOIN raw ON raw.series = o.series AND raw.r = o.r + 1""",
    f0=_curve(f"SELECT series, s*g AS b FROM (SELECT series, (max(r) - min(r))::DOUBLE AS s FROM o GROUP BY 1), (SELECT unnest({models.SHIFT_GRID}::DOUBLE[]) AS g)"),
    **{f"f{i + 1}": _curve(f"SELECT series, b*g AS b FROM f{i}, (SELECT unnest({steps}::DOUBLE[]) AS g)") for i, steps in enumerate(models.SHIFT_STEPS)},
)
def _(spark, d):
    ranked = add_rank(views.training_log(spark, d), ["ts", "id"], ["series"], "step")
    out = models.forecast(ranked, ["series"], "step", "loss", weight=0.6)
    return out.select("series", F.round("forecast", 4).alias("forecast"))
