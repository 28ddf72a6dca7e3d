"""Queries: scores of predictions, distances between groups, series."""

from pyspark.sql import functions as F

from perfspark.operators import domain, metrics, series
from perfspark.plans import views
from perfspark.plans.q_stats import rounded
from perfspark.plans.registry import query

_E = "abs((label-pred)/label)"


@query(
    "metrics_regression", "predictions",
    f"""SELECT task_id, round(avg({_E}), 9) AS mape, round(sqrt(avg((label-pred)*(label-pred))), 9) AS rmse,
        round(1 - sum((label-pred)*(label-pred))/(var_pop(label)*count(*)), 9) AS r2,
        count(*) FILTER (WHERE {_E} <= 0.2::DOUBLE)/count(*) AS acc20, count(*) FILTER (WHERE {_E} <= 0.1::DOUBLE)/count(*) AS acc10,
        count(*) FILTER (WHERE {_E} <= 0.05::DOUBLE)/count(*) AS acc5, count(*) FILTER (WHERE label = 0) AS undefined
        FROM (SELECT task_id, label, pred + label*1e-9::DOUBLE AS pred FROM predictions) GROUP BY task_id""",
)
def _(spark, d):
    # A tiny shift keeps errors off the exact bounds, where engines may round apart.
    p = views.predictions(spark, d).withColumn("pred", F.col("pred") + F.col("label") * 1e-9)
    return rounded(metrics.regression(p, ["task_id"]), 9, "mape", "rmse", "r2")


@query(
    "error_columns", "predictions",
    """SELECT sample_id, round(abs(label-pred), 9) AS abs_diff, round(sqrt((label-pred)*(label-pred)), 9) AS rmse,
              round(abs(label-pred)/label*100, 6) AS mape FROM predictions""",
)
def _(spark, d):
    out = metrics.error_columns(views.predictions(spark, d)).select("sample_id", "abs_diff", "rmse", "mape")
    return rounded(rounded(out, 9, "abs_diff", "rmse"), 6, "mape")


@query(
    "error_describe", "predictions",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS count, round(avg({e}), 9) AS mean, round(stddev_samp({e}), 9) AS std,
        round(min({e}), 9) AS min, round(max({e}), 9) AS max FROM predictions"""
                       for c, e in (("abs_diff", "abs(label-pred)"), ("mape", "abs(label-pred)/label*100"))),
)
def _(spark, d):
    out = metrics.describe(metrics.error_columns(views.predictions(spark, d)), ["abs_diff", "mape"])
    return rounded(out, 9, "mean", "std", "min", "max")


@query(
    "loss_report", "predictions",
    """SELECT device, round(avg(w*g*g), 9) AS mse, round(avg(w*r*r), 9) AS mspe, round(avg(w*r), 9) AS mape,
       round(1000*avg(w*g*g) + avg(w*r), 6) AS mse_mape, round(0.5*avg(w*g*g) + 0.5*avg(w*r), 9) AS mixed,
       round(avg(w*g)*avg(w*g), 9) AS mean_error_sq, round(avg(w*g**4), 9) AS k_power, count(*) FILTER (WHERE label = 0) AS undefined
       FROM (SELECT device, label, pred-label AS g, abs((pred-label)/label) AS r, 1/(1+exp(-label)) AS w FROM predictions) GROUP BY device""",
)
def _(spark, d):
    out = metrics.loss_report(views.predictions(spark, d), keys=["device"], weighted=True)
    return rounded(rounded(out, 9, "mse", "mspe", "mape", "mixed", "mean_error_sq", "k_power"), 6, "mse_mape")


@query(
    "pairwise_order_accuracy", "predictions",
    """SELECT a.g, max(n) AS n, round(coalesce(avg(((a.label > b.label) = (a.pred > b.pred))::INT), 0.5), 9) AS accuracy
       FROM p a JOIN p b ON a.g = b.g AND a.pos < b.pos JOIN (SELECT g AS gg, count(*) AS n FROM p GROUP BY 1) ON gg = a.g GROUP BY a.g""",
    p="""SELECT task_id AS g, row_number() OVER (PARTITION BY task_id ORDER BY sample_id, label, pred) AS pos, round(label, 2) AS label, round(pred, 2) AS pred FROM predictions""",
)
def _(spark, d):
    # a sample may be listed twice: labels and predictions settle the order
    p = views.predictions(spark, d).select(
        F.col("task_id").alias("g"), F.struct("sample_id", "label", "pred").alias("pos"), F.round("label", 2).alias("label"), F.round("pred", 2).alias("pred"))
    return rounded(metrics.pairwise_order_accuracy(p, ["g"], "pos"), 9, "accuracy")


_TOP = """SELECT task_id, sample_id, label, pred, row_number() OVER (PARTITION BY task_id ORDER BY label DESC, sample_id) AS rl,
    row_number() OVER (PARTITION BY task_id ORDER BY pred DESC, sample_id) AS rp FROM predictions"""


@query("topk_recall", "predictions",
       "SELECT task_id, count(*) FILTER (WHERE rl <= 50 AND rp <= 50)/50 AS recall FROM t GROUP BY task_id", t=_TOP)
def _(spark, d):
    return metrics.topk_recall(views.predictions(spark, d), ["task_id"], 50, "sample_id")


@query(
    "peak_score", "predictions",
    """SELECT task_id, round(avg(m)/max(top), 9) AS score FROM (SELECT task_id, rp, max(label) OVER (PARTITION BY task_id) AS top,
       max(label) OVER (PARTITION BY task_id ORDER BY rp ROWS UNBOUNDED PRECEDING) AS m FROM t) WHERE rp <= 20 GROUP BY task_id""",
    t=_TOP,
)
def _(spark, d):
    return rounded(metrics.peak_score(views.predictions(spark, d), ["task_id"], 20, "sample_id"), 9, "score")


_RANKED = f"""SELECT *, row_number() OVER (ORDER BY ape, sample_id) AS r, count(*) OVER () AS n FROM
    (SELECT sample_id, round({_E}, 9) AS ape FROM predictions)"""


def _scored(spark, d):
    """Labels and predictions whose error is a rounded number."""
    e = F.round(metrics.ape(), 9)
    return views.predictions(spark, d).select("sample_id", "device", e.alias("err")).select(
        "sample_id", "device", F.lit(1.0).alias("label"), (1 + F.col("err")).alias("pred"))


@query(
    "best_worst_split", "predictions",
    """SELECT count(*) AS rows, round(avg(ape), 9) AS mape, round(avg(ape) FILTER (WHERE r <= 100), 9) AS best,
       round(avg(ape) FILTER (WHERE r > n - 100), 9) AS worst, round(avg(ape) FILTER (WHERE r <= n - 100), 9) AS without_worst FROM k""",
    k=_RANKED,
)
def _(spark, d):
    parts = metrics.best_worst(_scored(spark, d), "sample_id")
    return rounded(metrics.best_worst_report(parts), 9, "mape", "best", "worst", "without_worst")


@query(
    "best_worst_thirds", "predictions",
    """SELECT count(*) AS rows, round(avg(ape), 9) AS mape, round(avg(ape) FILTER (WHERE r <= n//3), 9) AS best,
       round(avg(ape) FILTER (WHERE r > n - n//3), 9) AS worst, round(avg(ape) FILTER (WHERE r <= n - n//3), 9) AS without_worst FROM k""",
    k=_RANKED,
)
def _(spark, d):
    parts = metrics.best_worst(_scored(spark, d), "sample_id", thirds=True)
    return rounded(metrics.best_worst_report(parts), 9, "mape", "best", "worst", "without_worst")


@query(
    "augment_with_worst", "predictions",
    """SELECT device, count(*) AS n FROM (SELECT device FROM predictions WHERE device <> 'd0'
         UNION ALL SELECT device FROM k WHERE r > n - n//3) GROUP BY device""",
    k=f"""SELECT *, row_number() OVER (ORDER BY ape, sample_id) AS r, count(*) OVER () AS n FROM
          (SELECT sample_id, device, round({_E}, 9) AS ape FROM predictions WHERE device = 'd0')""",
)
def _(spark, d):
    s = _scored(spark, d)
    both = metrics.augment_with_worst(s.where("device <> 'd0'"), s.where("device = 'd0'"), "sample_id")
    return both.groupBy("device").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ group distance

def _moments(src, group, where="true"):
    g = f"{group}, " if group else ""
    by = f"USING ({g}pos)"
    powers = ", ".join(f"avg(pow(v-m1, {i})) AS m{i}" for i in range(2, 6))
    return f"""SELECT {g}pos, any_value(m1) AS m1, {powers} FROM {src} JOIN
        (SELECT {g}pos, avg(v) AS m1 FROM {src} WHERE {where} GROUP BY ALL) {by} WHERE {where} GROUP BY {g}pos"""


_CMD = " + ".join(f"sqrt(sum((a.m{i}-b.m{i})**2))" for i in range(1, 6))


@query("centroid_distance", "vector_entries",
       "SELECT round(sqrt(sum((a.m1-b.m1)**2)), 9) AS centroid FROM a JOIN b USING (pos)",
       a="SELECT pos, avg(v) AS m1 FROM vector_entries WHERE split <> 0 GROUP BY 1",
       b="SELECT pos, avg(v) AS m1 FROM vector_entries WHERE split = 0 GROUP BY 1")
def _(spark, d):
    v = views.vectors(spark, d)
    return rounded(domain.cmd(v.where("split <> 0"), v.where("split = 0")), 9, "centroid").select("centroid")


@query("cmd", "vector_entries", f"SELECT round({_CMD}, 9) AS cmd FROM a JOIN b USING (pos)",
       a=_moments("vector_entries", "", "split <> 0"), b=_moments("vector_entries", "", "split = 0"))
def _(spark, d):
    v = views.vectors(spark, d)
    return rounded(domain.cmd(v.where("split <> 0"), v.where("split = 0")), 9, "cmd").select("cmd")


@query("cmd_by_group", "vector_entries",
       f"SELECT domain, round({_CMD}, 9) AS cmd FROM a JOIN b USING (pos) GROUP BY domain",
       a=_moments("vector_entries", "domain"), b=_moments("vector_entries", ""))
def _(spark, d):
    v = views.vectors(spark, d)
    return rounded(domain.cmd_by_group(v, v, "domain"), 9, "cmd").select("domain", "cmd")


_DK = ", ".join(f"avg(pow(v-m1, {i})) AS m{i}" for i in range(2, 6))


@query(
    "domain_vs_rest", "vector_entries",
    f"SELECT domain, round({_CMD}, 6) AS cmd, round(sqrt(sum((a.m1-b.m1)**2)), 6) AS centroid FROM a JOIN b USING (domain, pos) GROUP BY domain",
    a=_moments("vector_entries", "domain"),
    o="SELECT g.domain, e.pos, e.v FROM vector_entries e JOIN (SELECT DISTINCT domain FROM vector_entries) g ON e.domain <> g.domain",
    b=_moments("o", "domain"),
)
def _(spark, d):
    return rounded(domain.domain_vs_rest(views.vectors(spark, d), "domain"), 6, "cmd", "centroid")


@query("mmd", "vectors",
       f"""SELECT round(sum(ps * qs * ({" + ".join(f"exp(-{g!r} * d2)" for g in domain.RBF_SCALES)})), 6) AS mmd FROM (
             SELECT p.s AS ps, q.s AS qs, list_sum(list_transform(list_zip(p.x, q.x), lambda z: (z[1]-z[2])*(z[1]-z[2]))) AS d2 FROM sided p, sided q)""",
       sided="""SELECT x, CASE WHEN domain < 5 THEN 1.0::DOUBLE / count(*) FILTER (domain < 5) OVER ()
                               ELSE -1.0::DOUBLE / count(*) FILTER (domain >= 5) OVER () END AS s FROM vectors""")
def _(spark, d):
    v = views.vectors(spark, d)
    value = domain.mmd(v.where("domain < 5"), v.where("domain >= 5"))
    return v.agg(F.round(F.lit(value), 6).alias("mmd"))


@query(
    "cluster_mix", "trace",
    """SELECT domain, round(sqrt(greatest(2 - 2*sum(c.n*t.n)/(sqrt(any_value(cn))*sqrt(any_value(tn))), 0)), 6) AS distance
       FROM c JOIN t USING (cluster) JOIN (SELECT domain, sum(n*n) AS cn FROM c GROUP BY 1) USING (domain),
            (SELECT sum(n*n) AS tn FROM t) GROUP BY domain""",
    c="SELECT pid AS domain, k % 7 AS cluster, count(*) AS n FROM trace WHERE k >= pid GROUP BY ALL",
    t="SELECT k % 7 AS cluster, count(*) AS n FROM trace GROUP BY ALL",
)
def _(spark, d):
    t = views.trace(spark, d).select(F.col("pid").alias("domain"), (F.col("k") % 7).alias("cluster"), "k")
    return rounded(domain.cluster_mix_distance(t.where("k >= domain"), t, "domain"), 6, "distance")


# ---------------------------------------------------------------------- series

@query(
    "running_best", "training_log",
    """SELECT id, coalesce(loss < prev, true) AS improved, least(loss, coalesce(prev, loss)) AS best FROM
       (SELECT *, min(loss) OVER (PARTITION BY series ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM training_log)""",
)
def _(spark, d):
    out = series.running_best(views.training_log(spark, d), ["series"], ["ts", "id"], "loss")
    return out.select("id", "improved", "best")


@query(
    "convergence_flag", "training_log",
    """SELECT id, coalesce(n = 10 AND m < 40 AND s/m < 0.5::DOUBLE, false) AS converged FROM
       (SELECT id, count(*) OVER w AS n, avg(loss) OVER w AS m, stddev_pop(loss) OVER w AS s FROM training_log
        WINDOW w AS (PARTITION BY series ORDER BY ts, id ROWS 9 PRECEDING))""",
)
def _(spark, d):
    out = series.convergence(views.training_log(spark, d), ["series"], ["ts", "id"], "loss", 10, 40.0, 0.5)
    return out.select("id", "converged")


@query(
    "ema", "training_log",
    "SELECT id, round(s, 6) AS ema FROM r",
    o="SELECT series, id, loss, row_number() OVER (PARTITION BY series ORDER BY ts, id) AS n FROM training_log",
    r="""SELECT series, id, n, loss AS s FROM o WHERE n = 1 UNION ALL
         SELECT o.series, o.id, o.n, 0.9::DOUBLE*r.s + (1-0.9::DOUBLE)*o.loss FROM r JOIN o ON o.series = r.series AND o.n = r.n + 1""",
)
def _(spark, d):
    out = series.ema(views.training_log(spark, d), ["series"], ["ts", "id"], "loss", 0.9)
    return out.select("id", F.round("ema", 6).alias("ema"))


@query(
    "trim_after_last_spike", "training_log",
    """SELECT id, loss FROM training_log t LEFT JOIN (SELECT series, max(id) AS spike FROM training_log
         WHERE loss > 60 AND id > (SELECT min(id) FROM training_log f WHERE f.series = training_log.series) GROUP BY 1) USING (series)
       WHERE spike IS NULL OR id > spike""",
)
def _(spark, d):
    out = series.trim_after_spike(views.training_log(spark, d), ["series"], "id", "loss", 60.0)
    return out.select("id", "loss")


@query("align_to_min", "training_log",
       "SELECT id, round(loss - min(loss) OVER (PARTITION BY series), 6) AS aligned FROM training_log")
def _(spark, d):
    out = series.align_to_min(views.training_log(spark, d), ["series"], "loss")
    return out.select("id", F.round("aligned", 6).alias("aligned"))


_BUCKETS = f"""SELECT *, (r - 1) // (n // 100) AS bucket FROM (SELECT *, row_number() OVER (ORDER BY ape, sample_id) AS r,
    count(*) OVER () AS n FROM (SELECT sample_id, round({_E}, 9) AS ape FROM predictions)) WHERE (r - 1) // (n // 100) < 100"""


@query("ape_quantile_buckets", "predictions",
       "SELECT bucket, round(avg(ape), 9) AS mape, count(*) AS n FROM k GROUP BY bucket", k=_BUCKETS)
def _(spark, d):
    b = series.ape_buckets(_scored(spark, d), "sample_id")
    return b.groupBy("bucket").agg(F.round(F.avg("ape"), 9).alias("mape"), F.count(F.lit(1)).alias("n"))


_VPRED = """SELECT id, bucket, e FROM (SELECT *, (r-1)//(n//20) AS bucket FROM (SELECT *, row_number() OVER (ORDER BY e, id) AS r,
    count(*) OVER () AS n FROM (SELECT vec_id AS id, round(abs(embedding[1]::DOUBLE), 9) AS e FROM embeddings WHERE vec_id % 5 = 0))) WHERE bucket < 20"""


def _vector_buckets(spark, d):
    v = views.vectors(spark, d).withColumn("e", F.round(F.abs(F.col("x")[0]), 9))
    test = v.where("split = 0").withColumns({"label": F.lit(1.0), "pred": 1 + F.col("e")})
    test = series.ape_buckets(test, "id", 20)
    return series.mape_vs_shift(test, v.where("split <> 0"), "x")


_SHIFT = dict(
    k=_VPRED,
    t="SELECT bucket, pos, v, e FROM k JOIN vector_entries USING (id)",
    a=_moments("t", "bucket"), b=_moments("vector_entries", "", "split <> 0"),
    s=f"""SELECT bucket, {_CMD} AS cmd, sqrt(sum((a.m1-b.m1)**2)) AS centroid FROM a JOIN b USING (pos) GROUP BY bucket""",
    z="SELECT s.*, mape, n FROM s JOIN (SELECT bucket, avg(e) AS mape, count(*) AS n FROM k GROUP BY 1) USING (bucket)",
)


@query("mape_distribution_shift", "vector_entries",
       "SELECT bucket, round(mape, 6) AS mape, n, round(cmd, 6) AS cmd, round(centroid, 6) AS centroid FROM z", **_SHIFT)
def _(spark, d):
    return rounded(_vector_buckets(spark, d), 6, "mape", "cmd", "centroid")


@query("mape_shift_line_fit", "vector_entries",
       "SELECT round(regr_slope(mape, cmd), 6) AS slope, round(regr_intercept(mape, cmd), 6) AS intercept FROM z", **_SHIFT)
def _(spark, d):
    return rounded(series.line_fit(_vector_buckets(spark, d), "cmd", "mape"), 6, "slope", "intercept")


@query(
    "begin_end_pairs", "trace",
    """SELECT tid, name, round(sum(dur)/1e6, 6) AS total, count(*) AS n FROM (SELECT tid, name, ph, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dur,
         lag(name) OVER w AS pn, lag(ph) OVER w AS pp
         FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'B' ELSE 'E' END AS ph FROM trace) WINDOW w AS (PARTITION BY pid, tid ORDER BY ts, id))
       WHERE ph = 'E' AND pp = 'B' AND pn = name GROUP BY ALL""",
)
def _(spark, d):
    t = views.trace(spark, d).withColumns({
        "ph": F.when(F.col("id") % 2 == 0, "B").otherwise("E"), "us": F.unix_micros(F.col("ts").cast("timestamp"))})
    pairs = series.pair_begin_end(t, ["pid", "tid"], ["ts", "id"], ts="us")
    return pairs.groupBy("tid", "name").agg(
        F.round(F.sum("dur") / 1e6, 6).alias("total"), F.count(F.lit(1)).alias("n"))
