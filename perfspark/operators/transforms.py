"""Invertible distribution transforms, fitted per column.

Fitting gives a small parameter table (one row per entry); applying one is a
column expression with the parameters as literals.  The quantile methods use
vectorised interpolation on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfspark.functions.numbers import scale_of
from perfspark.functions import arrays
from perfspark.operators.ranking import quantile_grid
from perfspark.runtime import materialize

# Method ids are places in this list; the last two need no fit.
METHODS = ["Box-Cox", "Yeo-Johnson", "Quantile", "Quantile-Uniform", "min-max", "std", "log", "None"]
NO_FIT = ["log", "None"]
# Small shift, replacement for undefined and for infinite results.
EPS, NAN_TO, INF_TO = 1e-6, 1e-6, 1e6
QUANTILES = 500

PARAMS = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("quantiles", T.ArrayType(T.DoubleType())),
    T.StructField("selected", T.BooleanType()),
])


def method_name(method: str | int) -> str:
    if isinstance(method, int) or method.isdigit():
        return METHODS[int(method)]
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    return method


# ------------------------------------------------------------------- powers

def _power(method: str, v: Column, lam: Column) -> Column:
    """Box-Cox or Yeo-Johnson of ``v`` without the final scaling."""
    def box(t: Column, l: Column) -> Column:  # noqa: E741
        return F.when(F.abs(l) < 1e-12, F.ln(t)).otherwise(F.expm1(l * F.ln(t)) / l)

    if method == "Box-Cox":
        return box(v, lam)
    return F.when(v >= 0, box(v + 1, lam)).otherwise(-box(1 - v, 2 - lam))


def _power_inverse(method: str, z: Column, lam: Column) -> Column:
    def box(t: Column, l: Column) -> Column:  # noqa: E741
        return F.when(F.abs(l) < 1e-12, F.exp(t)).otherwise(F.pow(l * t + 1, 1 / l))

    if method == "Box-Cox":
        return box(z, lam)
    return F.when(z >= 0, box(z, lam) - 1).otherwise(1 - box(-z, 2 - lam))


def _power_of_log(method: str, t: Column, lam: Column) -> Column:
    """As ``_power`` from the prepared logarithm: ``ln v`` for Box-Cox, the
    signed ``ln(1 + |v|)`` for Yeo-Johnson."""
    def box(u: Column, l: Column) -> Column:  # noqa: E741
        return F.when(F.abs(l) < 1e-12, u).otherwise(F.expm1(l * u) / l)

    if method == "Box-Cox":
        return box(t, lam)
    return F.when(t >= 0, box(t, lam)).otherwise(-box(-t, 2 - lam))


def _power_slopes(method: str, t: Column, lam: Column) -> tuple[Column, Column]:
    """First and second derivative of ``_power_of_log`` by lambda."""
    def slopes(u: Column, l: Column) -> tuple[Column, Column]:  # noqa: E741
        x = l * u
        near = F.abs(x) < 0.01  # there the quotients lose digits, their series do not
        safe = F.when(near, F.lit(1.0)).otherwise(l)
        e = F.exp(x)
        first = F.when(near, u * u * (1 / 2 + x * (1 / 3 + x * (1 / 8 + x * (1 / 30 + x / 144))))).otherwise(
            (u * e - F.expm1(x) / safe) / safe)
        second = F.when(near, u * u * u * (1 / 3 + x * (1 / 4 + x * (1 / 10 + x * (1 / 36 + x / 168))))).otherwise(
            (u * u * e - 2 * first) / safe)
        return first, second

    up = slopes(t, lam)
    if method == "Box-Cox":
        return up
    down = slopes(-t, 2 - lam)
    return F.when(t >= 0, up[0]).otherwise(down[0]), F.when(t >= 0, up[1]).otherwise(-down[1])


class _Climb:
    """Newton's way to the lambda of one entry, kept between places where the
    likelihood rises and falls."""

    def __init__(self, n: int, s: float):
        self.n, self.s = n, s
        self.at, self.low, self.high, self.good, self.done = 0.0, -math.inf, math.inf, None, False

    def take(self, m: dict[str, float]) -> None:
        """Go on from the means of the transformed values and their slopes."""
        if any(not math.isfinite(v) for v in m.values()):  # too far out
            if self.good is None:
                self.done = True
            else:
                self.at = (self.at + self.good) / 2
            return
        var = m["dd"] - m["d"] ** 2
        if var <= 0:  # nothing varies, or no more than rounding
            self.done = True
            return
        rise = 2 * (m["de"] - m["d"] * m["e"]) / var
        bend = 2 * (m["ee"] + m["df"] - m["e"] ** 2 - m["d"] * m["f"]) / var
        slope, curve = self.s / self.n - rise / 2, (rise * rise - bend) / 2
        if slope > 0:
            self.low = self.at
        else:
            self.high = self.at
        self.good, bounded = self.at, math.isfinite(self.low) and math.isfinite(self.high)
        far = 2.0 + abs(self.at)
        step = -slope / curve if curve < 0 else math.copysign(far, slope)
        new = self.at + max(-far, min(far, step))
        if bounded and not self.low < new < self.high:
            new = (self.low + self.high) / 2
        # Newton squares a small error
        self.done = slope == 0 or abs(new - self.at) <= 1e-6 * (1 + abs(new)) or new == self.at
        self.at = new


def fit_power(values: DataFrame, method: str, passes: int = 100) -> DataFrame:
    """Maximum-likelihood lambda per ``pos`` from rows (pos, v).

    The logarithms are taken and stored once.  A pass sums, for all entries
    that still move, the transformed values, their slopes and their products,
    from which Newton's step on the likelihood follows; it is kept between the
    places known to lie on either side, so it can't run off.  Some 5 to 7 passes
    give lambda to 1e-9 (``passes`` only ends a climb that never settles).
    Where nothing varies every lambda is as good, and 0 is taken.
    """
    v = F.col("v")
    log = F.ln(v) if method == "Box-Cox" else F.signum(v) * F.log1p(F.abs(v))
    logs = materialize(values.select("pos", log.alias("t"), (v <= 0).alias("bad")))
    facts = logs.groupBy("pos").agg(F.bool_or("bad").alias("bad"), F.sum("t").alias("s"), F.count("t").alias("n")).collect()
    if method == "Box-Cox" and any(r["bad"] for r in facts):
        raise ValueError("Box-Cox needs positive values")
    spark = values.sparkSession
    climbs = {r["pos"]: _Climb(r["n"], r["s"]) for r in facts if r["n"]}
    for _ in range(passes):
        open_ = [p for p, c in climbs.items() if not c.done]
        if not open_:
            break
        # one row per entry of a vector
        places = spark.createDataFrame([(p, climbs[p].at, climbs[p].s / climbs[p].n) for p in open_], "pos int, lambda double, middle double")
        rows = logs.join(F.broadcast(places), "pos")
        lam, t, c = F.col("lambda"), F.col("t"), F.col("middle")
        own, centre = _power_slopes(method, t, lam), _power_slopes(method, c, lam)
        rows = rows.select("pos", (_power_of_log(method, t, lam) - _power_of_log(method, c, lam)).alias("d"),
                           (own[0] - centre[0]).alias("e"), (own[1] - centre[1]).alias("f"))
        sums = rows.groupBy("pos").agg(
            F.avg("d").alias("d"), F.avg("e").alias("e"), F.avg("f").alias("f"), F.avg(F.col("d") * F.col("d")).alias("dd"),
            F.avg(F.col("d") * F.col("e")).alias("de"), F.avg(F.col("e") * F.col("e")).alias("ee"), F.avg(F.col("d") * F.col("f")).alias("df"))
        for r in sums.collect():
            climbs[r["pos"]].take({k: x for k, x in r.asDict().items() if k != "pos"})
    lams = spark.createDataFrame([(p, c.at) for p, c in climbs.items()], "pos int, lambda double")
    moved = logs.join(F.broadcast(lams), "pos").withColumn("z", _power_of_log(method, F.col("t"), F.col("lambda")))
    return moved.groupBy("pos", "lambda").agg(F.avg("z").alias("avg"), F.stddev_pop("z").alias("std"))


# ---------------------------------------------------------------------- fit

def fit(
    df: DataFrame, column: str, method: str | int, target: str = "y", eps: float = EPS
) -> DataFrame:
    """Parameter rows of one method for a scalar or an array column."""
    method = method_name(method)
    is_array = isinstance(df.schema[column].dataType, T.ArrayType)
    values = arrays.entries(df, column) if is_array else df.select(F.lit(0).alias("pos"), F.col(column).cast("double").alias("v"))
    none = F.lit(None).cast("array<double>")
    empty = F.create_map().cast("map<string,double>")
    if method in ("Box-Cox", "Yeo-Johnson"):
        rows = fit_power(values, method).select(
            "pos", F.create_map(F.lit("lambda"), "lambda", F.lit("avg"), "avg", F.lit("std"), "std").alias("params"),
            none.alias("quantiles"))
    elif method in ("Quantile", "Quantile-Uniform"):
        rows = quantile_grid(values, "v", QUANTILES, ["pos"]).select("pos", empty.alias("params"), "quantiles")
    elif method == "min-max":
        rows = values.groupBy("pos").agg((F.min("v") + eps).alias("a"), (F.max("v") + eps).alias("b")).select(
            "pos", F.create_map(F.lit("min"), "a", F.lit("max"), "b").alias("params"), none.alias("quantiles"))
    elif method == "std":
        rows = values.groupBy("pos").agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("b")).select(
            "pos", F.create_map(F.lit("avg"), "a", F.lit("std"), "b").alias("params"), none.alias("quantiles"))
    else:
        rows = values.select("pos").distinct().select("pos", empty.alias("params"), none.alias("quantiles"))
    return rows.select(
        F.lit(target).alias("target"), F.lit(method).alias("method"), F.col("pos").cast("int").alias("pos"),
        "params", "quantiles", F.lit(False).alias("selected"))


class Transform:
    """A fitted method: ``forward`` and ``inverse`` give column expressions."""

    def __init__(self, method: str, params: Sequence[dict], quantiles: Sequence[Sequence[float]] | None = None):
        self.method, self.params, self.quantiles = method_name(method), list(params), quantiles

    @staticmethod
    def load(params: DataFrame, target: str, method: str | int) -> Transform:
        """From a parameter table; at most one row per entry is read."""
        method = method_name(method)
        if method in NO_FIT:
            return Transform(method, [])
        rows = params.where((F.col("target") == target) & (F.col("method") == method)).collect()
        if not rows:
            raise ValueError(f"no parameters of {method} for {target}")
        rows.sort(key=lambda r: r["pos"])
        return Transform(method, [dict(r["params"]) for r in rows], [r["quantiles"] for r in rows])

    @staticmethod
    def fitted(df: DataFrame, column: str, method: str | int, eps: float = EPS) -> Transform:
        return Transform.load(fit(df, column, method, "t", eps), "t", method)

    def forward(self, column: str, is_array: bool = False) -> Column:
        return self._apply(column, is_array, self._forward, True)

    def inverse(self, column: str, is_array: bool = False) -> Column:
        return self._apply(column, is_array, self._inverse, False)

    def _apply(self, column, is_array, expr, forward):
        if self.method.startswith("Quantile"):
            return self._quantile(column, is_array, forward)
        if not is_array:
            return expr(F.col(column), {k: F.lit(v) for k, v in (self.params[0] if self.params else {}).items()})
        if not self.params:
            return F.transform(column, lambda v: expr(v, {}))
        names = list(self.params[0])
        table = F.array(*[F.struct(*[F.lit(float(p[n])).alias(n) for n in names]) for p in self.params])
        return F.zip_with(column, table, lambda v, p: expr(v, {n: p[n] for n in names}))

    def _forward(self, v: Column, p: dict[str, Column]) -> Column:
        if self.method == "min-max":
            return (v - p["min"]) / (p["max"] - p["min"] + EPS)
        if self.method == "std":
            return (v - p["avg"]) / scale_of(p["std"])
        if self.method == "log":
            return F.ln(v)
        if self.method == "None":
            return v
        return (_power(self.method, v, p["lambda"]) - p["avg"]) / scale_of(p["std"])

    def _inverse(self, v: Column, p: dict[str, Column]) -> Column:
        if self.method == "min-max":
            return v * (p["max"] - p["min"] + EPS) + p["min"]
        if self.method == "std":
            return v * scale_of(p["std"]) + p["avg"]
        if self.method == "log":
            return F.exp(v)
        if self.method == "None":
            return v
        raw = _power_inverse(self.method, v * scale_of(p["std"]) + p["avg"], p["lambda"])
        # Undefined and unbounded results get fixed stand-ins.
        return F.when(raw.isNull() | F.isnan(raw), NAN_TO).when(raw == float("inf"), INF_TO).otherwise(raw)

    def _quantile(self, column: str, is_array: bool, forward: bool) -> Column:
        grids = [np.array(q, dtype=float) for q in self.quantiles]
        normal = self.method == "Quantile"
        one = quantile_forward if forward else quantile_inverse

        if not is_array:
            @F.pandas_udf("double")
            def scalar(v: pd.Series) -> pd.Series:
                return pd.Series(one(v.to_numpy(dtype=float), grids[0], normal))

            return scalar(F.col(column))

        @F.pandas_udf("array<double>")
        def vector(v: pd.Series) -> pd.Series:
            m = np.stack(v.to_numpy()).astype(float)
            cols = [one(m[:, i], grids[i], normal) for i in range(m.shape[1])]
            return pd.Series(list(np.stack(cols, axis=1)))

        return vector(F.col(column))


# ---------------------------------------------------------------- quantiles

# Coefficients of Wichura's inverse normal (algorithm AS 241).
_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
      4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
      2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
      1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
      2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]
_CLIP = 1e-7


def _ratio(top: list, bottom: list, r: np.ndarray) -> np.ndarray:
    return np.polyval(top[::-1], r) / np.polyval(bottom[::-1], r)


def probit(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function."""
    q = p - 0.5
    tail = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    centre = q * _ratio(_A, _B, 0.180625 - q * q)
    outer = np.where(tail <= 5, _ratio(_C, _D, tail - 1.6), _ratio(_E, _F, tail - 5.0))
    return np.where(np.abs(q) <= 0.425, centre, np.sign(q) * outer)


# Coefficients of Cody's rational approximations of the error
# function below 0.46875, of its complement below 4 and beyond.
_NEAR = ([1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3],
         [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3])
_MIDDLE = ([2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
            8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
           [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
            3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3])
_FAR = ([1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
         1.60837851487422766e-2, 6.58749161529837803e-4],
        [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3])


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of an array."""
    y = np.abs(np.asarray(x, dtype=float))
    small = y * y
    near = 1 - np.sign(x) * y * np.polyval(_NEAR[0], np.minimum(small, 1)) / np.polyval(_NEAR[1], np.minimum(small, 1))
    capped = np.clip(y, 0.46875, 26.0)
    mid = np.minimum(capped, 4.0)
    inverse = 1 / (np.maximum(capped, 4.0) ** 2)
    far = (1 / math.sqrt(math.pi) - inverse * np.polyval(_FAR[0], inverse) / np.polyval(_FAR[1], inverse)) / np.maximum(capped, 4.0)
    tail = np.exp(-capped * capped) * np.where(capped <= 4, np.polyval(_MIDDLE[0], mid) / np.polyval(_MIDDLE[1], mid), far)
    return np.where(y <= 0.46875, near, np.where(np.asarray(x) < 0, 2 - tail, tail))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(z, dtype=float) / math.sqrt(2))


def quantile_forward(x: np.ndarray, grid: np.ndarray, normal: bool) -> np.ndarray:
    """Rank of ``x`` in the grid as a number in 0..1, or its normal score.
    Runs of equal grid values take the mean of both interpolation directions."""
    ref = np.linspace(0, 1, len(grid))
    u = 0.5 * (np.interp(x, grid, ref) - np.interp(-x, -grid[::-1], -ref[::-1]))
    edge = _CLIP if normal else 0.0
    u = np.where(x - edge < grid[0], 0.0, np.where(x + edge > grid[-1], 1.0, u))
    u = np.where(x == grid[0], 0.0, np.where(x == grid[-1], 1.0, u))
    return probit(np.clip(u, _CLIP, 1 - _CLIP)) if normal else u


def quantile_inverse(u: np.ndarray, grid: np.ndarray, normal: bool) -> np.ndarray:
    p = normal_cdf(u) if normal else u
    out = np.interp(p, np.linspace(0, 1, len(grid)), grid)
    out = np.where(p <= _CLIP if normal else p <= 0, grid[0], np.where(p >= (1 - _CLIP if normal else 1), grid[-1], out))
    return np.nan_to_num(out, nan=NAN_TO, posinf=INF_TO)


# ---------------------------------------------------------------------- hub

def select(params: DataFrame, target: str, method: str | int) -> DataFrame:
    """Mark one method of a target as the one in use."""
    mine = F.col("target") == target
    return params.withColumn(
        "selected", F.when(mine, F.col("method") == method_name(method)).otherwise(F.col("selected")))


def selected(params: DataFrame, target: str) -> Transform:
    """The method in use; ``x0`` falls back to ``x``."""
    row = params.where((F.col("target") == target) & F.col("selected")).select("method").first()
    if row is None and target == "x0":
        return selected(params, "x")
    if row is None:
        raise ValueError(f"no method selected for {target}")
    return Transform.load(params, target, row["method"])


def fit_all(df: DataFrame, column: str, target: str, methods: Sequence[str | int] = tuple(range(8))) -> DataFrame:
    out = None
    for m in methods:
        rows = fit(df, column, m, target)
        out = rows if out is None else out.unionByName(rows)
    return out


def save(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").partitionBy("target").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMS).parquet(path).select(*PARAMS.fieldNames())


def renormalize(df: DataFrame, column: str, old: Transform, new: Transform, into: str) -> DataFrame:
    """Undo the old method, apply the new one; the old column stays."""
    is_array = isinstance(df.schema[column].dataType, T.ArrayType)
    raw = df.withColumn("__raw", old.inverse(column, is_array))
    return raw.withColumn(into, new.forward("__raw", is_array)).drop("__raw")


def roundtrip_error(df: DataFrame, column: str, transforms: Sequence[Transform]) -> DataFrame:
    """Largest gap between a value and its restored value, per method."""
    there = df.select(column, *[t.forward(column).alias(f"__t{i}") for i, t in enumerate(transforms)])
    back = there.select(column, *[t.inverse(f"__t{i}").alias(f"__b{i}") for i, t in enumerate(transforms)])
    one = back.agg(*[
        F.max(F.abs(F.col(f"__b{i}") - F.col(column))).alias(f"g{i}") for i in range(len(transforms))
    ])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(t.method).alias("method"), F.col(f"g{i}").alias("max_gap")) for i, t in enumerate(transforms)
    ])))
