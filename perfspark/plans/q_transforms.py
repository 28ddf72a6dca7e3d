"""Queries: fitting, applying and undoing the distribution transforms."""

from pyspark.sql import functions as F

from perfspark.operators import transforms as tf
from perfspark.operators.split import every_kth, is_test, is_train
from perfspark.plans import views
from perfspark.plans.registry import query

#: Rounds of the twins' grid search, each a digit of lambda.
DIGITS = 5


def _label(spark, d):
    return views.samples(spark, d).select("sample_id", "avg")


def _apply(spark, d, method, digits=7):
    s = _label(spark, d)
    t = tf.Transform.load(tf.fit(s, "avg", method), "y", method)
    out = s.withColumn("z", t.forward("avg")).withColumn("back", t.inverse("z"))
    return out.select("sample_id", F.round("z", digits).alias("z"), F.round("back", 7).alias("back"))


def _sql(z):
    return f"SELECT sample_id, round({z}, 7) AS z, round(avg, 7) AS back FROM samples"


_MM = "(SELECT min(avg) + 1e-6::DOUBLE AS lo, max(avg) + 1e-6::DOUBLE AS hi FROM samples)"


@query("tf_minmax", "samples", _sql("(avg-lo)/(hi-lo+1e-6::DOUBLE)") + f", {_MM}")
def _(spark, d):
    return _apply(spark, d, "min-max")


@query("tf_std", "samples", _sql("(avg-m)/s") + ", (SELECT avg(avg) AS m, stddev_pop(avg) AS s FROM samples)")
def _(spark, d):
    return _apply(spark, d, "std")


@query("tf_log", "samples", _sql("ln(avg)"))
def _(spark, d):
    return _apply(spark, d, "log")


@query("tf_none", "samples", _sql("avg"))
def _(spark, d):
    return _apply(spark, d, 7)


def _search(value, log_term):
    """The same grid search, written out round by round."""
    steps = {"r0": "SELECT 0.0::DOUBLE AS best, 5.0::DOUBLE AS half"}
    for i in range(DIGITS):
        steps[f"r{i + 1}"] = f"""SELECT arg_max(l, ll) AS best, any_value(half)/10 AS half FROM
            (SELECT l, half, -count(*)/2.0::DOUBLE*ln(var_pop({value})) + (l - 1)*sum({log_term}) AS ll
             FROM samples, (SELECT best - half + j*(half/10) AS l, half FROM r{i}, (SELECT unnest(range(21)) AS j))
             GROUP BY l, half)"""
    # Newton's steps on the likelihood give the digits that its flat top hides
    last = f"r{DIGITS}"
    for i in range(2):
        first, second = f"({log_term}*exp(l*{log_term}) - z)/l", f"({log_term}*{log_term}*exp(l*{log_term}) - 2*z1)/l"
        steps[f"n{i}"] = f"""SELECT any_value(l) - (sum(u)/count(*) - covar_pop(z, z1)/var_pop(z)) / (
              2*(covar_pop(z, z1)/var_pop(z))**2 - (var_pop(z1) + covar_pop(z, z2))/var_pop(z)) AS best
            FROM (SELECT *, {second} AS z2 FROM (SELECT *, {first} AS z1 FROM (
              SELECT avg, l, {value} AS z, {log_term} AS u FROM samples, (SELECT best AS l FROM {last}))))"""
        last = f"n{i}"
    steps["f"] = f"SELECT l, avg({value}) AS m, stddev_pop({value}) AS s FROM samples, (SELECT best AS l FROM {last}) GROUP BY l"
    return steps


_BOX = "CASE WHEN abs(l) < 1e-12 THEN ln({t}) ELSE (exp(l*ln({t})) - 1)/l END"


@query("tf_boxcox", "samples", _sql(f"({_BOX.format(t='avg')} - m)/s").replace("7) AS z", "4) AS z") + ", f",
       **_search(_BOX.format(t="avg"), "ln(avg)"))
def _(spark, d):
    return _apply(spark, d, 0, 4)


@query("tf_yeojohnson", "samples", _sql(f"({_BOX.format(t='(avg+1)')} - m)/s").replace("7) AS z", "4) AS z") + ", f",
       **_search(_BOX.format(t="(avg+1)"), "ln(1+avg)"))
def _(spark, d):
    return _apply(spark, d, 1, 4)


_GRID = """SELECT unnest(range(500)) AS i, unnest(quantile_cont(avg, [""" + ", ".join(
    f"{i / 499!r}" for i in range(500)) + """])) AS q FROM samples"""
_INTERP = """SELECT sample_id, avg, CASE WHEN b.q IS NULL THEN 1.0::DOUBLE WHEN avg <= a.q THEN a.i/499.0::DOUBLE
    ELSE (a.i + (avg - a.q)/(b.q - a.q))/499.0::DOUBLE END AS u
    FROM samples ASOF JOIN g a ON avg >= a.q LEFT JOIN g b ON b.i = a.i + 1"""


@query("tf_quantile_uniform", "samples",
       "SELECT sample_id, round(u, 7) AS z, round(avg, 7) AS back FROM n", g=_GRID, n=_INTERP)
def _(spark, d):
    return _apply(spark, d, 3)


def _poly(c, x):
    out = repr(c[-1])
    for v in reversed(c[:-1]):
        out = f"({out}*{x} + {v!r})"
    return out


def _probit_sql():
    mid = f"q*{_poly(tf._A, '(0.180625::DOUBLE-q*q)')}/{_poly(tf._B, '(0.180625::DOUBLE-q*q)')}"
    near = f"{_poly(tf._C, '(r-1.6::DOUBLE)')}/{_poly(tf._D, '(r-1.6::DOUBLE)')}"
    far = f"{_poly(tf._E, '(r-5)')}/{_poly(tf._F, '(r-5)')}"
    return f"CASE WHEN abs(q) <= 0.425::DOUBLE THEN {mid} ELSE sign(q)*CASE WHEN r <= 5 THEN {near} ELSE {far} END END"


@query("tf_quantile_normal", "samples",
       f"""SELECT sample_id, round({_probit_sql()}, 5) AS z, round(avg, 7) AS back FROM
           (SELECT *, p - 0.5::DOUBLE AS q, sqrt(-ln(least(p, 1-p))) AS r FROM
            (SELECT *, least(greatest(u, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p FROM n))""", g=_GRID, n=_INTERP)
def _(spark, d):
    return _apply(spark, d, 2, 5)


@query(
    "tf_select", "samples",
    """SELECT 'y' AS target, 'std' AS method, 0 AS pos, round(avg(avg), 6) AS a, round(stddev_pop(avg), 6) AS b FROM samples""",
)
def _(spark, d):
    s = _label(spark, d)
    params = tf.fit_all(s, "avg", "y", ["min-max", "std", "log", "None"])
    used = tf.select(params, "y", 5).where("selected")
    return used.select("target", "method", "pos", F.round(F.col("params")["avg"], 6).alias("a"),
                       F.round(F.col("params")["std"], 6).alias("b"))


_ENT = """SELECT sample_id, unnest([0,1,2,3]) AS pos, unnest(features) AS v FROM samples"""


@query(
    "renormalize_x", "samples",
    """SELECT sample_id, max(z) FILTER (WHERE pos = 0) AS z0, max(z) FILTER (WHERE pos = 1) AS z1,
              max(z) FILTER (WHERE pos = 2) AS z2, max(z) FILTER (WHERE pos = 3) AS z3 FROM
       (SELECT sample_id, pos, round((v - m)/s, 5) AS z FROM e JOIN (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY pos) USING (pos))
       GROUP BY sample_id""", e=_ENT,
)
def _(spark, d):
    s = views.samples(spark, d).select("sample_id", "features")
    old, new = tf.Transform.fitted(s, "features", "min-max"), tf.Transform.fitted(s, "features", "std")
    stored = s.select("sample_id", old.forward("features", True).alias("x"))
    out = tf.renormalize(stored, "x", old, new, "x_std")
    return out.select("sample_id", *[F.round(F.col("x_std")[i], 5).alias(f"z{i}") for i in range(4)])


@query("renormalize_y", "samples",
       f"SELECT sample_id, round(ln(avg), 6) AS y_log FROM samples")
def _(spark, d):
    s = _label(spark, d)
    old, new = tf.Transform.fitted(s, "avg", "std"), tf.Transform("log", [])
    stored = s.select("sample_id", old.forward("avg").alias("y"))
    return tf.renormalize(stored, "y", old, new, "y_log").select("sample_id", F.round("y_log", 6).alias("y_log"))


@query("method_roundtrip_check", "",
       "SELECT unnest(['Box-Cox','Yeo-Johnson','Quantile','Quantile-Uniform','min-max','std','log','None']) AS method, true AS same")
def _(spark, d):
    s = _label(spark, d)
    fitted = [tf.Transform.load(tf.fit(s, "avg", m), "y", m) for m in range(8)]
    return tf.roundtrip_error(s, "avg", fitted).select("method", (F.col("max_gap") < 1e-6).alias("same"))


@query("split_sizes", "samples",
       "SELECT (count(*)//5)*4 AS train, count(*)//5 AS test FROM samples")
def _(spark, d):
    coded = every_kth(_label(spark, d), "avg", "sample_id")
    return coded.agg(F.count_if(is_train()).alias("train"), F.count_if(is_test()).alias("test"))
