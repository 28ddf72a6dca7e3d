"""Ranks, percentiles and scans against pandas, with hot keys and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perfspark.operators import ranking, series, split


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    n = 3000
    return pd.DataFrame({
        "id": np.arange(n),
        "k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n)),
        "v": np.round(rng.normal(size=n), 1) + 5,
    })


def test_add_rank_with_hot_key(spark, frame):
    out = ranking.add_rank(spark.createDataFrame(frame), ["v", "id"], ["k"], "r", "n").toPandas()
    want = frame.sort_values(["v", "id"]).assign(r=lambda d: d.groupby("k").cumcount() + 1)
    got = out.set_index("id")
    assert (got.loc[want["id"], "r"].to_numpy() == want["r"].to_numpy()).all()
    assert (got.groupby("k")["n"].first() == frame.groupby("k").size()).all()


def test_rank_plan_has_no_single_partition(spark, frame):
    out = split.every_kth(spark.createDataFrame(frame), "v", "id")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_percentiles_equal_numpy(spark, frame):
    probs = {"a": 0.1, "b": 0.5, "c": 0.99}
    out = ranking.percentiles(spark.createDataFrame(frame), "v", probs, ["k"]).toPandas().set_index("k")
    for k, part in frame.groupby("k"):
        for n, p in probs.items():
            assert out.loc[k, n] == pytest.approx(np.percentile(part["v"], p * 100))


@pytest.mark.parametrize("rows", [1, 3, 700, 3000])
def test_quantile_grid_equals_numpy(spark, frame, rows):
    part = frame.head(rows)
    grid = ranking.quantile_grid(spark.createDataFrame(part), "v", 500).first()["quantiles"]
    assert np.allclose(grid, np.quantile(part["v"], np.linspace(0, 1, 500)))


def test_running_min_and_sum(spark, frame):
    out = ranking.running(
        spark.createDataFrame(frame), ["k"], ["id"], {"low": ("min", "v"), "total": ("sum", "v")}
    ).toPandas().sort_values("id")
    g = frame.groupby("k")["v"]
    assert np.allclose(out["low"], g.cummin())
    assert np.allclose(out["total"], g.cumsum())


def test_blocked_window_equals_plain_one(spark, frame):
    ranked = ranking.add_rank(spark.createDataFrame(frame), ["id"], ["k"], "r")
    blocks, w = ranking.in_blocks(ranked, ["k"], "r", before=3, after=1, rows=16)
    out = ranking.drop_halo(blocks.withColumns({
        "m": F.sum("v").over(w.rowsBetween(-3, 0)), "next": F.lead("v").over(w)})).toPandas().sort_values("id")
    g = frame.groupby("k")["v"]
    assert len(out) == len(frame)
    assert np.allclose(out["m"], g.transform(lambda s: s.rolling(4, min_periods=1).sum()))
    assert np.allclose(out["next"].fillna(-1), g.shift(-1).fillna(-1))


@pytest.mark.parametrize("block", [7, 65536])
def test_ema_chains_over_blocks(spark, frame, block):
    out = series.ema(spark.createDataFrame(frame), ["k"], ["id"], "v", 0.9, block).toPandas().sort_values("id")
    want = frame.groupby("k")["v"].transform(lambda s: s.ewm(alpha=0.1, adjust=False).mean())
    assert np.allclose(out["ema"], want)


def test_convergence_at_the_tenth_equal_loss(spark):
    df = spark.createDataFrame([(0, i, 1.0) for i in range(12)], "s int, i int, loss double")
    out = series.convergence(df, ["s"], ["i"], "loss").orderBy("i").toPandas()
    assert out["converged"].tolist() == [False] * 9 + [True] * 3


def test_every_kth_drops_the_open_period(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 13)], "id int, y double")
    codes = {r["id"]: r["split_code"] for r in split.every_kth(df, "y", "id").collect()}
    assert [i for i, c in codes.items() if c == 2] == [5, 10]
    assert sorted(i for i, c in codes.items() if c == 0) == [11, 12]
    kept = {r["id"]: r["split_code"] for r in split.every_kth(df, "y", "id", keep_tail=True).collect()}
    assert kept[11] == kept[12] == 1
    small = split.every_kth(df.where("id < 4"), "y", "id").collect()
    assert {r["split_code"] for r in small} == {3}


def test_linear_data_split_sizes(spark):
    rows = [(f"{a}-{b}", 3.2 * a + 2.4 * b + 12) for a in range(30) for b in range(30)]
    out = split.every_kth(spark.createDataFrame(rows, "id string, y double"), "y", "id")
    assert out.where(split.is_test()).count() == 180


def test_mode_grammar():
    spec = split.parse_mode("t4:sample200+list-1-2,v100:cross.by_device:test-v100", "t4")
    assert spec["devices"] == [("t4", ["sample200", "list-1-2"]), ("v100", ["cross"])]
    assert spec["test"] == ["v100"] and spec["train"] is None
    assert split.parse_mode("sample5", "a100")["devices"] == [("a100", ["sample5"])]
    with pytest.raises(ValueError):
        split.parse_mode("t4:cross.by_moon:test-x", "t4")


def test_shards_are_near_equal(spark):
    tasks = spark.createDataFrame([("d", i) for i in range(130)], "device string, task_id int")
    sizes = sorted(r["count"] for r in split.assign_shards(tasks, ["device", "task_id"]).groupBy("shard_id").count().collect())
    assert sizes == [43, 43, 44]


def test_upsample(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "id int, c string")
    out = split.upsample(df, "c", "id").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in out} == {"a": 7, "b": 7}
