"""Queries: copies, almost-copies and nearest neighbours."""

from pyspark.sql import functions as F

from perfspark.operators import derive, joins, neighbors, similarity
from perfspark.operators.stats import scale_columns
from perfspark.plans import views
from perfspark.plans.registry import query


@query(
    "conflicting_duplicates", "coarse_samples",
    """SELECT sample_id, y FROM (SELECT *, max(y) OVER (PARTITION BY x0, x1, x2, x3, device, task_id) AS top
       FROM coarse_samples) WHERE NOT 2*(top - y)/(top + y) >= 0.05::DOUBLE""",
)
def _(spark, d):
    s = views.coarse_samples(spark, d).withColumn(
        "x", F.concat("x", F.array(F.substring("device", 2, 1).cast("double"), F.col("task_id").cast("double"))))
    return similarity.conflicting(s).select("sample_id", "y")


@query(
    "conflicting_between_sets", "coarse_samples",
    """SELECT sample_id, y FROM coarse_samples LEFT JOIN
         (SELECT x0, x1, x2, task_id, max(y) AS top FROM coarse_samples WHERE device = 'd0' GROUP BY ALL)
         USING (x0, x1, x2, task_id)
       WHERE device = 'd1' AND NOT coalesce(2*(top - y)/(top + y) >= 0.05::DOUBLE, false)""",
)
def _(spark, d):
    s = views.coarse_samples(spark, d).withColumn("x", F.concat("x", F.array(F.col("task_id").cast("double"))))
    out = similarity.conflicting_between(s.where("device = 'd0'"), s.where("device = 'd1'"))
    return out.select("sample_id", "y")


_SHIFTED = "SELECT x0, x1, x2, x3, task_id, y - min(y) OVER () AS y FROM coarse_samples"


@query(
    "duplicate_groups", "coarse_samples",
    """SELECT x0, x1, x2, task_id, sum(n)::BIGINT AS rows, count(*) AS labels, sum(n*(n-1)/2)::BIGINT AS same_y_pairs,
              (sum(n)*(sum(n)-1)/2 - sum(n*(n-1)/2))::BIGINT AS diff_y_pairs,
              round(CASE WHEN count(*) > 1 THEN 2*(max(y)-min(y))/(max(y)+min(y)) END, 6) AS max_ratio
       FROM (SELECT x0, x1, x2, task_id, y, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL HAVING sum(n) > 1""",
    s=_SHIFTED,
)
def _(spark, d):
    s = views.coarse_samples(spark, d).withColumn("x", F.concat("x", F.array(F.col("task_id").cast("double"))))
    g = similarity.duplicate_groups(s)
    return g.select(
        *[F.col("x")[i].alias(f"x{i}") for i in range(3)], F.col("x")[4].cast("bigint").alias("task_id"),
        "rows", "labels", "same_y_pairs", "diff_y_pairs", F.round("max_ratio", 6).alias("max_ratio"))


_MEAN_GAPS = """SELECT a.x0, a.x1, a.x2, a.task_id, count(*) AS diff_y_pairs, avg(2*abs(a.y-b.y)/(a.y+b.y)) AS mean_gap
    FROM (SELECT x0, x1, x2, task_id, y, count(*) AS n FROM coarse_samples GROUP BY ALL) a
    JOIN (SELECT x0, x1, x2, task_id, y, count(*) AS n FROM coarse_samples GROUP BY ALL) b
      ON a.x0 = b.x0 AND a.x1 = b.x1 AND a.x2 = b.x2 AND a.task_id = b.task_id AND a.y < b.y
    JOIN r ON i < a.n*b.n GROUP BY ALL"""


def _gaps(spark, d):
    s = views.coarse_samples(spark, d).withColumn("x", F.concat("x", F.array(F.col("task_id").cast("double"))))
    return similarity.mean_gaps(s)


@query("duplicate_mean_gaps", "coarse_samples",
       "SELECT x0, x1, x2, task_id, diff_y_pairs, round(mean_gap, 6) AS mean_gap FROM g",
       r="SELECT unnest(range(10000)) AS i", g=_MEAN_GAPS)
def _(spark, d):
    return _gaps(spark, d).select(
        *[F.col("x")[i].alias(f"x{i}") for i in range(3)], F.col("x")[4].cast("bigint").alias("task_id"),
        "diff_y_pairs", F.round("mean_gap", 6).alias("mean_gap"))


@query("duplicate_gap_distribution", "coarse_samples",
       "SELECT " + ", ".join(f"round(quantile_cont(mean_gap, {p}), 6) AS {n}" for n, p in (
           ("low", 0), *((f"p{p}", p / 100) for p in similarity.GAP_PERCENTILES), ("high", 1))) + " FROM g",
       r="SELECT unnest(range(10000)) AS i", g=_MEAN_GAPS)
def _(spark, d):
    out = similarity.gap_distribution(_gaps(spark, d))
    return out.select([F.round(c, 6).alias(c) for c in out.columns])


@query(
    "duplicate_label_gaps", "coarse_samples",
    """SELECT a.x0, a.x1, a.x2, round(sum(CASE WHEN a.y <> b.y THEN 2*abs(a.y-b.y)/(a.y+b.y) ELSE 0 END)/2, 3) AS gap_sum
       FROM coarse_samples a JOIN coarse_samples b ON a.x0=b.x0 AND a.x1=b.x1 AND a.x2=b.x2
       GROUP BY ALL""",
)
def _(spark, d):
    s = views.coarse_samples(spark, d).select(*[F.col("x")[i].alias(f"x{i}") for i in range(3)], "y")
    return similarity.label_gap_sums(s, ["x0", "x1", "x2"], "y", block=8).withColumn("gap_sum", F.round("gap_sum", 3))


_PAIRED = """SELECT {j} AS entry, count(*) AS pairs, count(*) FILTER (WHERE a.y = b.y) AS same_label_pairs,
    round(sum((a.y-b.y)*(a.x{j}-b.x{j}))/sum((a.x{j}-b.x{j})*(a.x{j}-b.x{j})), 6) AS slope
    FROM s a JOIN s b ON {on} AND a.sample_id < b.sample_id AND a.x{j} <> b.x{j}
    """


@query(
    "one_entry_differs", "coarse_samples",
    " UNION ALL ".join(
        _PAIRED.format(j=j, on=" AND ".join(f"a.x{i}=b.x{i}" for i in range(4) if i != j)) for j in range(4)
    ),
    s="SELECT sample_id, y, x0, x1, x2, task_id::DOUBLE AS x3 FROM coarse_samples",
)
def _(spark, d):
    s = views.coarse_samples(spark, d).select(
        "sample_id", "y", F.concat(F.slice("x", 1, 3), F.array(F.col("task_id").cast("double"))).alias("x"))
    out = similarity.one_entry_differs(s)
    return out.withColumn("slope", F.round("slope", 6))


@query(
    "entry_neighbour_slopes", "coarse_samples",
    """SELECT * FROM (SELECT x0, x2, x1 AS v, lead(x1) OVER w AS v2,
         round((lead(y) OVER w - y)/(lead(x1) OVER w - x1), 6) AS slope
         FROM (SELECT x0, x1, x2, avg(y) AS y FROM coarse_samples GROUP BY ALL)
         WINDOW w AS (PARTITION BY x0, x2 ORDER BY x1)) WHERE v2 IS NOT NULL""",
)
def _(spark, d):
    out = similarity.neighbour_slopes(views.coarse_samples(spark, d), 1)
    return out.select(F.col("rest")[0].alias("x0"), F.col("rest")[1].alias("x2"), "v", "v2", F.round("slope", 6).alias("slope"))


@query(
    "same_x_diff_y_across_devices", "coarse_samples",
    """SELECT a.task_id, a.x0, a.x1, a.x2, a.device AS a_device, b.device AS b_device,
              count(*) FILTER (WHERE a.y <> b.y) AS diff_pairs, min(a.y) AS a_low, max(b.y) AS b_high
       FROM coarse_samples a JOIN coarse_samples b ON a.task_id=b.task_id AND a.x0=b.x0 AND a.x1=b.x1
            AND a.x2=b.x2 AND a.device < b.device GROUP BY ALL HAVING diff_pairs > 0""",
)
def _(spark, d):
    g = similarity.same_x_across_devices(views.coarse_samples(spark, d), 5)
    return g.select("task_id", *[F.col("x")[i].alias(f"x{i}") for i in range(3)],
                    "a_device", "b_device", "diff_pairs", "a_low", "b_high")


_D = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1]-z[2])*(z[1]-z[2]))))"


@query(
    "nearest_train_distance", "vectors",
    f"""SELECT a.id, round(min({_D}), 6) AS dist FROM vectors a, vectors b
        WHERE a.split = 0 AND b.split <> 0 GROUP BY a.id""",
)
def _(spark, d):
    v = views.vectors(spark, d)
    out = neighbors.train_distance(v.where("split = 0"), v.where("split <> 0"))
    return out.withColumn("dist", F.round("dist", 6))


_WD = ("sqrt(list_sum(list_transform(list_zip(a.x, b.x, range(64)), "
       "lambda z: (z[1]-z[2])*(z[1]-z[2])*(1 + z[3] % 3))))")


@query(
    "nearest_train_distance_weighted", "vectors",
    f"""SELECT a.id, round(min({_WD}), 6) AS dist FROM vectors a, vectors b
        WHERE a.split = 0 AND b.split <> 0 GROUP BY a.id""",
)
def _(spark, d):
    w = neighbors.weighted("x", [1 + i % 3 for i in range(64)])
    v = views.vectors(spark, d).withColumn("x", w)
    out = neighbors.train_distance(v.where("split = 0"), v.where("split <> 0"))
    return out.withColumn("dist", F.round("dist", 6))


@query(
    "two_nn_angle", "vectors",
    f"""SELECT n1.q AS id, round((n2.dist*n2.dist + n1.dist*n1.dist
              - list_sum(list_transform(list_zip(n1.px, n2.px), lambda z: (z[1]-z[2])*(z[1]-z[2]))))/(2*n1.dist*n2.dist), 6) AS cos,
              round(n1.dist, 6) AS min_dist, round(rms, 6) AS rms_dist
        FROM n n1 JOIN n n2 ON n1.q = n2.q AND n1.r = 1 AND n2.r = 2
        JOIN (SELECT q, sqrt(avg(dist*dist)) AS rms FROM p GROUP BY q) m ON m.q = n1.q""",
    p=f"SELECT a.id AS q, b.id AS i, b.x AS px, {_D} AS dist FROM vectors a, vectors b WHERE a.split = 0 AND b.split <> 0",
    n="SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, i) AS r FROM p",
)
def _(spark, d):
    v = views.vectors(spark, d)
    out = neighbors.two_nearest_angle(v.where("split = 0"), v.where("split <> 0"))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("cos", "min_dist", "rms_dist")])


_KNN_DIMS = ["threadblock_m", "threadblock_n", "threadblock_k", "align"]
_KERNEL_X = """SELECT kernel, regexp_replace(kernel, '_[0-9]+x.*$', '') AS blk, [tm/mtm, tn*10/mtn, tk/mtk, al/mal] AS x, mean
    FROM (SELECT *, greatest(1, max(tm) OVER ()) AS mtm, greatest(1, max(tn*10) OVER ()) AS mtn,
                 greatest(1, max(tk) OVER ()) AS mtk, greatest(1, max(al) OVER ()) AS mal
          FROM (SELECT kernel, tm, tn, tk, CASE WHEN dtype='fp16' THEN 80 ELSE -10 END AS al, avg(ave) AS mean
                FROM kernels GROUP BY ALL))"""
_KD = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1]-z[2])*(z[1]-z[2]))))"
_KNN = f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) AS nth FROM
    (SELECT a.kernel AS qid, b.kernel AS pid, {_KD} AS dist, b.mean AS mean FROM kx a JOIN kx b ON a.blk = b.blk)"""


def kernel_points(spark, d):
    """Distinct kernels: scaled weighted features and their mean time."""
    k = views.kernels(spark, d).groupBy("kernel").agg(F.avg("ave").alias("mean"))
    k = derive.kernel_codes(derive.kernel_parts(k))
    cols = ["k_" + c for c in _KNN_DIMS]
    scaled = scale_columns(k, cols)
    return scaled.select("kernel", "mean", *derive.KERNEL_BLOCK, F.array(*cols).alias("x"))


def nearest_kernels(spark, d, k):
    p = kernel_points(spark, d)
    same = [F.coalesce(c, F.lit("")).alias(c) for c in derive.KERNEL_BLOCK]
    p = p.select("kernel", "mean", "x", *same)
    return p, neighbors.nearest(p, p, k, "x", "kernel", derive.KERNEL_BLOCK)


@query(
    "knn_kernels", "ops kernels", "SELECT qid, pid, round(dist, 6) AS dist, nth FROM n WHERE nth <= 3",
    kx=_KERNEL_X, n=_KNN,
)
def _(spark, d):
    return nearest_kernels(spark, d, 3)[1].select("qid", "pid", F.round("dist", 6).alias("dist"), "nth")


@query(
    "cross_kernel_predict", "ops kernels",
    """SELECT qid AS kernel, round(sum(mean/(dist+1))/sum(1/(dist+1)), 6) AS predicted
       FROM n WHERE nth <= 3 AND qid <> pid GROUP BY qid""",
    kx=_KERNEL_X, n=_KNN,
)
def _(spark, d):
    points, found = nearest_kernels(spark, d, 3)
    others = found.where("qid <> pid").join(points.select(F.col("kernel").alias("pid"), "mean"), "pid")
    out = joins.idw(others, ["qid"], "mean", "dist")
    return out.select(F.col("qid").alias("kernel"), F.round("predicted", 6).alias("predicted"))


_OPS_X = """SELECT event_id AS id, event_type, [value, (props::JSON->>'$.k')::DOUBLE] AS x, value AS ave,
            user_id % 5 = 0 AS target FROM events"""


def _op_points(spark, d):
    t = views.trace(spark, d)
    return t.select("id", "name", F.array(F.col("dur"), F.col("k").cast("double")).alias("x"),
                    F.col("dur").alias("ave"), (F.col("tid") % 5 == 0).alias("target"))


@query(
    "knn_latency", "",
    """SELECT q AS id, round(sum(ave/(dist+1))/sum(1/(dist+1)), 6) AS predicted FROM
       (SELECT a.id AS q, b.ave, sqrt((a.x[1]-b.x[1])**2 + (a.x[2]-b.x[2])**2) AS dist,
               row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x[1]-b.x[1])**2 + (a.x[2]-b.x[2])**2), b.id) AS r
        FROM o a JOIN o b ON a.event_type = b.event_type AND a.target AND NOT b.target) WHERE r <= 2 GROUP BY q""",
    o=_OPS_X,
)
def _(spark, d):
    o = _op_points(spark, d)
    source = o.where(~F.col("target"))
    found = neighbors.nearest(o.where("target"), source, 2, "x", "id", ["name"])
    rows = found.join(source.select(F.col("id").alias("pid"), "ave"), "pid")
    out = joins.idw(rows, ["qid"], "ave", "dist")
    return out.select(F.col("qid").alias("id"), F.round("predicted", 6).alias("predicted"))


@query(
    "idw", "trace",
    """SELECT tid, round(sum(dur/(k+1))/sum(1/(k+1))/count(*), 9) AS predicted FROM trace GROUP BY tid""",
)
def _(spark, d):
    out = joins.idw(views.trace(spark, d), ["tid"], "dur", "k", compat=True)
    return out.withColumn("predicted", F.round("predicted", 9))
