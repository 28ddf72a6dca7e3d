"""Undefined values, many classes and groups, and values beyond the usual range."""

import math
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from perfspark import runtime
from perfspark.operators import domain, joins, metrics, models, series, similarity, split, stats
from perfspark.operators import transforms as tf


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([(1, "a", 0.0, 1.0), (2, "a", 2.0, 1.0), (3, "b", 4.0, 4.0), (4, "b", 0.0, 0.0)],
                                 "id long, k string, label double, pred double")


def test_label_zero(scores):
    one = metrics.regression(scores).first()
    assert one["mape"] == 0.25 and one["undefined"] == 2 and one["acc20"] == 0.25
    assert metrics.loss_report(scores, keys=["k"]).count() == 2
    assert metrics.error_columns(scores).where("mape IS NULL").count() == 2
    parts = {r["id"]: r["part"] for r in metrics.best_worst(scores, "id").collect()}
    assert parts == {1: "undefined", 4: "undefined", 3: "best", 2: "worst"}
    assert series.ape_buckets(scores, "id", 100).count() == 2  # fewer rows than buckets
    assert metrics.peak_score(scores.withColumn("label", F.lit(0.0)), ["k"], 1, "id").where("score IS NULL").count() == 2


def test_values_that_do_not_vary(spark):
    same = spark.createDataFrame([(i, "k", float(i), 0.0, 3.0) for i in range(20)], "id long, k string, t double, zero double, v double")
    assert series.convergence(same, ["k"], ["t"], "zero").where("converged").count() == 0
    assert stats.hist_equalize(same, "v", "id").count() == 20
    assert stats.histogram(same, "v", 4, None).first()["n"] == 20
    assert stats.op_time_stats(same, "k", "zero", ["t"]).first()["std"] == 0
    for method in ("std", "min-max", "Yeo-Johnson", "Box-Cox"):
        made = tf.Transform.fitted(same, "v", method)
        row = same.withColumn("z", made.forward("v")).withColumn("b", made.inverse("z")).first()
        assert math.isfinite(row["z"]) and row["b"] == pytest.approx(3.0, abs=1e-5)


def test_copies_with_zero_labels(spark):
    rows = spark.createDataFrame([([1.0], 0.0), ([1.0], 0.0), ([2.0], 0.0), ([2.0], 1.0)], "x array<double>, y double")
    assert similarity.conflicting(rows).count() == 3


@pytest.mark.parametrize("lam", [20.0, -12.0, 0.5])
def test_power_range_is_free(spark, lam):
    rng = np.random.default_rng(1)
    x = (1 + 0.15 * rng.normal(size=4000)) ** (1 / lam)
    values = spark.createDataFrame(pd.DataFrame({"v": x}))
    found = tf.fit(values, "v", "Box-Cox").first()["params"]["lambda"]

    def score(l):  # noqa: E741
        t = np.expm1(l * np.log(x)) / l
        return -len(x) / 2 * np.log(t.var()) + (l - 1) * np.log(x).sum()

    assert all(score(found) >= score(found + d) - 1e-6 for d in (-0.05, 0.05, -1, 1))


def test_normal_distribution_function():
    z = np.concatenate([np.linspace(-9, 9, 4001), [-40.0, 40.0, 0.0]])
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    assert np.allclose(tf.normal_cdf(z), want, rtol=1e-13, atol=1e-290)
    # a driver-side call leaves nothing behind that tasks could not take
    assert len(cloudpickle.dumps(tf.quantile_inverse)) and pickle.loads(cloudpickle.dumps(tf.normal_cdf))(0.0) == 0.5


def test_discrepancy_of_all_rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(300, 5)), rng.normal(0.8, 1.3, size=(200, 5))
    frames = [spark.createDataFrame([(v.tolist(),) for v in m], "x array<double>") for m in (a, b)]

    def kernel(p, q):
        d2 = ((p[:, None] - q[None]) ** 2).sum(axis=2)
        return sum(np.exp(-g * d2) for g in domain.RBF_SCALES).mean()

    exact = kernel(a, a) - 2 * kernel(a, b) + kernel(b, b)
    assert domain.mmd(*frames) == pytest.approx(exact, abs=1e-9)
    assert domain.mmd(frames[0], frames[0]) == 0 and domain.mmd(frames[0].limit(0), frames[1]) == 0


def test_three_classes(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate("aabbccccc")], "id long, c string")
    assert {r["c"]: r["count"] for r in split.upsample(rows, "c", "id").groupBy("c").count().collect()} == dict(a=5, b=5, c=5)
    assert {r["c"]: r["count"] for r in split.downsample(rows, "c", "id").groupBy("c").count().collect()} == dict(a=2, b=2, c=2)
    assert split.upsample(rows.limit(0), "c", "id").count() == 0


def test_hundred_groups(spark):
    rows = spark.range(3000).select((F.col("id") % 100).alias("g"), (F.col("id") % 7).cast("double").alias("v")).withColumn(
        "label", F.col("v") * (F.col("g") + 1) + 5)
    out = models.per_group_models(rows, rows, "g", {"v": F.col("v")}, "label").collect()
    assert len(out) == 100 and all(r["mape"] < 1e-9 and r["n"] == 30 for r in out)


def test_replay_of_different_tasks(spark):
    schema = "task_id long, workload_key string, cost double, weight int, n_leaf int, src string"
    a = spark.createDataFrame([(1, "k", 1.0, 1, 5, "recorded"), (2, "k", 3.0, 1, 5, "recorded")], schema)
    b = spark.createDataFrame([(1, "k", 2.0, 2, 5, "recorded"), (3, "k", 0.0, 1, 5, "recorded")], schema)
    one = joins.replay_vs_profile(a, b).first()
    assert (one["mape"], one["mismatches"], one["unmatched"], one["end2end_error"]) == (50.0, 1, 2, 0.0)


def test_closed_scope_leaves_nothing(spark, tmp_path):
    with runtime.scope(spark):
        table = runtime.materialize(spark.range(5))
        path = table.inputFiles()[0]
        assert table.count() == 5
    from urllib.parse import urlparse
    from pathlib import Path

    assert not Path(urlparse(path).path).parent.exists()


def test_no_intermediate_tables_on_the_drivers_own_disk():
    class Fake:
        def __init__(self, master, **conf):
            self.sparkContext, self.conf = type("C", (), {"master": master}), conf

    def root(master, **conf):
        fake = Fake(master)
        fake.conf = type("Conf", (), {"get": staticmethod(lambda k, *d: conf.get(k.split(".")[1], d[0] if d else conf.get("sql")))})
        return runtime.checkpoint_root(fake)

    assert root("yarn", checkpoint="hdfs://c/x/") == "hdfs://c/x"
    assert root("yarn", sql="hdfs://c/w") == "hdfs://c/w/_intermediate" and root("local[4]", sql="file:/w") == "file:/w/_intermediate"
    for path in ("file:/w", "file:///w", "/w"):
        with pytest.raises(ValueError):
            root("spark://host:7077", sql=path)
