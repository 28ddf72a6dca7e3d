"""Transforms, fitted models, data sets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perfspark.operators import models, split
from perfspark.operators import transforms as tf
from perfspark.plans import dataset
from perfspark.sources import sinks


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame(pd.DataFrame({"v": rng.lognormal(size=2000)})).cache()


def test_boxcox_lambda_is_the_likelihood_maximum(spark, values):
    x = values.toPandas()["v"].to_numpy()

    def score(lam):
        z = np.expm1(lam * np.log(x)) / lam
        return -len(x) / 2 * np.log(z.var()) + (lam - 1) * np.log(x).sum()

    lam = tf.fit(values, "v", 0).first()["params"]["lambda"]
    assert score(lam) >= max(score(l) for l in np.arange(-0.2, 0.2, 0.001) if abs(l) > 1e-9) - 1e-9
    with pytest.raises(ValueError):
        tf.fit(values.selectExpr("v - 10 AS v"), "v", 0)


def test_every_method_restores_its_input(values):
    fitted = [tf.Transform.fitted(values, "v", m) for m in range(8)]
    gaps = {r["method"]: r["max_gap"] for r in tf.roundtrip_error(values, "v", fitted).collect()}
    assert set(gaps) == set(tf.METHODS) and max(gaps.values()) < 1e-6


def test_power_transform_is_standardised(values):
    t = tf.Transform.fitted(values, "v", "Yeo-Johnson")
    r = values.select(t.forward("v").alias("z")).agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).first()
    assert r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1)


def test_probit():
    assert tf.probit(np.array([0.5, 0.975, 0.025])) == pytest.approx([0, 1.959963984540054, -1.959963984540054])
    p = np.linspace(1e-7, 1 - 1e-7, 1001)
    assert np.allclose(tf.normal_cdf(tf.probit(p)), p, atol=1e-14)


def test_minmax_shift(spark):
    p = tf.fit(spark.createDataFrame([(0.0,), (10.0,)], "v double"), "v", "min-max").first()["params"]
    assert p["min"] == pytest.approx(1e-6) and p["max"] == pytest.approx(10.000001)


def test_hub_selection(spark, values):
    params = tf.select(tf.fit_all(values, "v", "x", ["std", "min-max"]), "x", "std")
    assert tf.selected(params, "x0").method == "std"
    with pytest.raises(ValueError):
        tf.selected(params, "y")


def test_nonnegative_least_squares():
    rng = np.random.default_rng(6)
    a = rng.random((200, 4))
    y = a @ np.array([1.0, 0.0, 2.0, 0.0]) - 0.3 * a[:, 1]
    w = models._solve(a.T @ a, a.T @ y, [True] * 4)
    assert (w >= 0).all() and w[1] == 0
    residual = y - a @ w
    assert (a.T @ residual <= 1e-8).all()  # no allowed direction improves it


def test_linear_data_is_recovered(spark):
    rows = [(i % 3, float(a), float(b), 3.2 * a + 2.4 * b + 12) for i, (a, b) in enumerate((a, b) for a in range(30) for b in range(30))]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    fit = models.least_squares(df, ["k"], {"a": F.col("a"), "b": F.col("b"), "one": F.lit(1.0)}, "y").collect()
    for r in fit:
        assert r["coef"] == pytest.approx({"a": 3.2, "b": 2.4, "one": 12.0})


@pytest.mark.parametrize("b", [0.5, 37.0, 900.0])
def test_forecast_finds_the_curve(spark, b):
    df = spark.createDataFrame([(0, float(x), 7 * b / (x + b) + 3) for x in range(1, 60)], "s int, x double, y double")
    r = models.forecast(df, ["s"], "x", "y").first()
    assert r["b"] == pytest.approx(b, rel=0.02) and r["forecast"] == pytest.approx(3, rel=0.02)


@pytest.mark.parametrize("weight", [0.0, 0.6])
def test_forecast_of_smoothed_values(spark, weight):
    rng = np.random.default_rng(5)
    x = np.arange(1, 80, dtype=float)
    y = 40 / (x + 3) + 2 + rng.normal(size=len(x)) * 0.05
    s, smoothed = y[0], []
    for v in y:
        s = weight * s + (1 - weight) * v
        smoothed.append(float(s))
    frame = lambda values: spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, values)], "s int, x double, y double")
    got, want = models.forecast(frame(y), ["s"], "x", "y", weight=weight).first(), models.forecast(frame(smoothed), ["s"], "x", "y").first()
    assert tuple(got[c] for c in "abc") == pytest.approx(tuple(want[c] for c in "abc"), rel=1e-9)


def test_kmeans_rows_are_at_their_nearest_centre(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "x": rng.normal(size=(200, 4)).tolist()}))
    centres, rows = models.kmeans(df, "x", 5)
    centres = np.array(centres)
    for r in rows.collect():
        assert r["cluster"] == ((centres - np.array(r["x"])) ** 2).sum(axis=1).argmin()


def test_sensitivity_of_a_linear_model(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0)], "x array<double>, y double")
    out = models.entry_sensitivity(df, "x", "y", 2, lambda m: m @ np.array([10.0, 1.0]), lambda p, y: p)
    got = {(r["entry"], r["form"], r["scale"]): r["change"] for r in out.collect()}
    assert got[0, "+", 0.1] == pytest.approx(1.0) and got[1, "/", 0.5] == pytest.approx(-1.0)


def test_dataset_round_trip(spark, tmp_path):
    rows = [(f"s{i}", "d0" if i % 2 else "d1", i % 4, 1.0 + i, 0.001, 1e9, [float(i), 1.0], 5) for i in range(400)]
    samples = spark.createDataFrame(
        rows, "sample_id string, device string, task_id bigint, avg double, std double, flops double, features array<double>, leaves int")
    tasks = samples.select("device", "task_id").distinct().withColumn("split_code", F.lit(0))
    path = str(tmp_path / "set")
    dataset.make_dataset(samples, tasks, path, output_method="log", per_shard=1)
    manifest, out = sinks.load_shards(spark, path, output_method="log")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 320, "test": 80} and manifest["shards"] == 4
    with pytest.raises(ValueError):
        sinks.load_shards(spark, path, output_method="std")
    with pytest.raises(Exception):
        dataset.make_dataset(samples, tasks, path, output_method="log")


def test_good_rows_are_told_from_bad(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    parts = pd.DataFrame({"id": np.arange(400), "x": x.tolist(), "part": np.where(x[:, 0] > 0, "best", "worst")})
    out = models.good_bad_forest(spark.createDataFrame(parts), "x", "id").collect()
    assert all(r["accuracy"] > 0.8 for r in out if r["n"] > 5)


def test_greedy_selection_takes_each_task_once(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "task_id": np.arange(300) % 6, "x": rng.normal(size=(300, 3)).tolist()}))
    assert len({r["task_id"] for r in models.select_cmd_remove(df, 3).collect()}) == 3
    assert models.select_kmeans(df, 4).count() == 4
    assert models.selection_quality(df, df.select("task_id").limit(0)).first()["cmd"] == -1
    assert split.hash_order("task_id") is not None


def test_a_forest_is_fitted_on_bounded_partitions(spark, monkeypatch):
    seen = []
    fit = models.RandomForestClassifier.fit
    monkeypatch.setattr(models, "FOREST_ROWS", 50)
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    parts = pd.DataFrame({"id": np.arange(400), "x": x.tolist(), "part": np.where(x[:, 0] > 0, "best", "worst")})
    out = models.good_bad_forest(spark.createDataFrame(parts), "x", "id").collect()
    assert seen[0] >= 7 and sum(r["n"] for r in out) == 400


def test_shared_features_are_summed_once(spark, monkeypatch):
    """A feature of several models is one column, and rows with a null or NaN stay out."""
    df = spark.createDataFrame([("k", 1.0, 3.0), ("k", 2.0, 5.0), ("k", None, 9.0), ("k", 4.0, float("nan")), (None, 1.0, 1.0), ("e", None, 1.0)], "k string, x double, y double")
    widths = []
    whole = np.triu_indices
    monkeypatch.setattr(models.np, "triu_indices", lambda n: (widths.append(n), whole(n))[1])
    one = {"x": F.col("x"), "one": F.lit(1.0)}
    got = models.least_squares_many(df, ["k"], {"a": (one, []), "b": (dict(one), ["x"])}, "y").collect()
    assert widths == [3] and {(r["k"], r["model"], r["n"]) for r in got} == {("k", "a", 2), ("k", "b", 2)}
    assert all(r["coef"]["x"] == pytest.approx(2) and r["coef"]["one"] == pytest.approx(1) for r in got)


def test_first_rows_are_chosen_by_their_leading_bytes(spark):
    rows = [("a", "x1"), ("a", "x"), ("b", "x0000000b"), ("b", "x0000000a"), ("b", "y"), (None, "0"), ("n", None), ("e", "é"), ("e", "z"), ("a", "x")]
    df = spark.createDataFrame(rows, "k string, id string")
    assert sorted(map(tuple, models._first_rows(df, "k", "id").select("k", "id").collect()), key=str) == sorted(
        [("a", "x"), ("a", "x"), ("b", "x0000000a"), ("b", "x0000000b"), (None, "0"), ("n", None), ("e", "z")], key=str)
    got = {(r["k"], r["id"]): r["cluster"] for r in models.descriptor_clusters(df, F.col("k"), "id").collect()}
    # no id comes first, then the ids in their order; a row without a descriptor has no cluster
    assert got == {("n", None): 0, ("a", "x"): 2, ("a", "x1"): 2, ("b", "x0000000a"): 3, ("b", "x0000000b"): 3, ("b", "y"): 3, ("e", "z"): 4, ("e", "é"): 4}
