"""Metrics, group distances and similarity against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perfspark.operators import domain, filters, joins, metrics, neighbors, router, similarity, stats


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.09), (2.0, 1.5)], "label double, pred double")
    r = metrics.regression(df).first()
    assert r["mape"] == pytest.approx(0.17)
    assert (r["acc20"], r["acc10"], r["acc5"]) == (0.5, 0.5, 0.0)


def test_topk_and_order_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 2.0, 3.0), (0, 2, 3.0, 2.0)], "g int, id int, label double, pred double")
    assert metrics.topk_recall(df, ["g"], 1, "id").first()["recall"] == 0.0
    assert metrics.pairwise_order_accuracy(df, ["g"], "id").first()["accuracy"] == pytest.approx(2 / 3)
    assert metrics.pairwise_order_accuracy(df.where("id = 0"), ["g"], "id").first()["accuracy"] == 0.5


@pytest.mark.parametrize("block", [4, 4096])
def test_pairwise_order_with_ties(spark, block):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        "g": rng.integers(0, 2, 240), "id": np.arange(240), "label": rng.integers(0, 9, 240).astype(float),
        "pred": rng.integers(0, 9, 240).astype(float)})
    out = metrics.pairwise_order_accuracy(spark.createDataFrame(pdf), ["g"], "id", least_block=block).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        a, b = part["label"].to_numpy(), part["pred"].to_numpy()
        same = (a[:, None] > a[None, :]) == (b[:, None] > b[None, :])
        i = np.triu_indices(len(a), 1)
        assert out.loc[g, "accuracy"] == pytest.approx(same[i].mean())


def test_cmd_and_rest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1, 2, 3] + 1
    pdf = pd.DataFrame({"g": np.arange(300) % 3, "x": x.tolist()})
    df = spark.createDataFrame(pdf)

    def cmd(a, b):
        total = np.linalg.norm(a.mean(0) - b.mean(0))
        for k in range(2, 6):
            total += np.linalg.norm(((a - a.mean(0)) ** k).mean(0) - ((b - b.mean(0)) ** k).mean(0))
        return total

    assert domain.cmd(df, df).first()["cmd"] == pytest.approx(0, abs=1e-9)
    out = domain.domain_vs_rest(df, "g").toPandas().set_index("g")
    for g in range(3):
        mine = np.arange(300) % 3 == g
        assert out.loc[g, "cmd"] == pytest.approx(cmd(x[mine], x[~mine]), rel=1e-6)


@pytest.mark.parametrize("k,block", [(1, 2048), (3, 5)])
def test_nearest_equals_brute_force(spark, k, block):
    rng = np.random.default_rng(3)
    p = np.round(rng.normal(size=(400, 3)), 1)
    p[:130] = p[0]  # one point holds a third of the rows
    pts = pd.DataFrame({"id": np.arange(400), "b": np.arange(400) % 2, "x": p.tolist()})
    q = pd.DataFrame({"id": np.arange(60), "b": np.arange(60) % 2, "x": np.round(rng.normal(size=(60, 3)), 1).tolist()})
    out = neighbors.nearest(
        spark.createDataFrame(q), spark.createDataFrame(pts), k, same=["b"], block=block).toPandas()
    assert len(out) == 60 * k
    for i, row in q.iterrows():
        mine = pts[pts["b"] == row["b"]]
        d = np.sqrt(((np.stack(mine["x"].to_numpy()) - row["x"]) ** 2).sum(axis=1))
        order = np.lexsort((mine["id"].to_numpy(), d))[:k]
        got = out[out["qid"] == row["id"]].sort_values("nth")
        assert np.allclose(got["dist"], d[order])
        assert got["pid"].tolist() == mine["id"].to_numpy()[order].tolist()


def test_conflicts(spark):
    rows = [(1, [1.0], 1.1), (2, [1.0], 1.0), (3, [2.0], 1.0), (4, [2.0], 1.02)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y double")
    assert sorted(r["id"] for r in similarity.conflicting(df).collect()) == [1, 3, 4]


def test_label_gaps_and_entry_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, size=(120, 2)).astype(float)
    y = rng.integers(1, 6, size=120).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"sample_id": np.arange(120), "x": x.tolist(), "y": y}))
    i, j = np.triu_indices(120, 1)
    out = similarity.one_entry_differs(df).toPandas().set_index("entry")
    for e in range(2):
        hit = (x[i, 1 - e] == x[j, 1 - e]) & (x[i, e] != x[j, e])
        dx, dy = x[i, e][hit] - x[j, e][hit], y[i][hit] - y[j][hit]
        assert out.loc[e, "pairs"] == hit.sum()
        assert out.loc[e, "same_label_pairs"] == (dy == 0).sum()
        assert out.loc[e, "slope"] == pytest.approx((dx * dy).sum() / (dx * dx).sum())
    keyed = df.withColumn("k", F.col("x")[0])
    gaps = similarity.label_gap_sums(keyed, ["k"], "y", block=2, few=1).toPandas().set_index("k")["gap_sum"]
    for k in range(3):
        hit = (x[i, 0] == k) & (x[j, 0] == k)
        assert gaps[float(k)] == pytest.approx((2 * abs(y[i] - y[j]) / (y[i] + y[j]))[hit].sum())


def test_idw_and_error_merge(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, 3.0, 1.0)], "k int, y double, d double")
    assert joins.idw(df, ["k"], "y", "d").first()["predicted"] == pytest.approx(5 / 3)
    assert joins.idw(df, ["k"], "y", "d", compat=True).first()["predicted"] == pytest.approx(5 / 6)
    a = spark.createDataFrame([("a", 0.2), ("b", 0.3)], "k string, error double")
    b = spark.createDataFrame([("a", 0.1)], "k string, error double")
    assert {r["k"]: r["error"] for r in joins.merge_errors(a, b, "k").collect()} == {"a": 0.1, "b": 0.3}


def test_network_latency(spark):
    df = spark.createDataFrame([("n", 0.01, 2, "T_predict", 0.01, 0.02)],
                               "network string, cost double, weight int, cost_src string, t_record double, t_profile double")
    assert stats.network_latency(df, ["network"]).first()["latency_ms"] == pytest.approx(40)


def test_filters_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0.01), (1.0, 0.011), (0.0, 0.0)], "avg double, std double")
    assert filters.unstable(df).count() == 1
    hundred = spark.range(101).select(F.col("id").cast("double").alias("avg"))
    assert filters.percentile_range(hundred).count() == 80


def test_router(spark):
    spec = {"filter_dim": "leaf", "filter_entries": [{"rule": "==5", "entry": {
        "filter_dim": "flops", "filter_entries": [{"rule": ">=1e9", "entry": "large"}, {"rule": "default", "entry": "small"}]}}]}
    df = spark.createDataFrame([(5, 1e9), (5, 1e8), (4, 1e9)], "leaf int, flops double")
    assert [r[0] for r in df.select(router.route(spec)).collect()] == ["large", "small", None]
    bounded = router.spec_from_config("m", [5], (1e8, 5e8))
    assert [r[0] for r in df.select(router.route(bounded, {"leaf_node_no": "leaf", "FLOPs": "flops"})).collect()] == [None, "m", None]


def test_flip_table_counts(spark):
    df = spark.createDataFrame([(0.6, 0.01), (0.15, 0.5), (0.01, 0.01)], "e1 double, e2 double")
    r = stats.flip_table(df, "e1", "e2").where("bad_from = 0.2 AND good_below = 0.1").first()
    assert (r["before_good"], r["before_mid"], r["before_bad"], r["flips"]) == (1, 1, 1, 1)


def test_scopes_of_a_program(spark):
    from perfspark.operators import scopes

    text = """
// attr [iter_var(blockIdx.x, , blockIdx.x)] thread_extent = 8
unrolled (i, 0, 1) {
  for (j, 0, 3) {
    a[ramp(j, 1, 4)] = b[i]
    if (i < 3) {
      c[i] = (a[i] + (b[i] / d[i]))
    }
  }
}
// attr [iter_var(threadIdx.y, , threadIdx.y)] thread_extent = 5
T_relu(a)
T_unknown(a)
"""
    got = {r["op"]: r for r in scopes.scope_features(spark.createDataFrame([(1, text), (2, None)], "id int, text string")).collect()}
    at = scopes.MARKS.index
    assert set(got) == {"assign", "add", "divide", "relu"}
    assert got["assign"]["loop_steps"] == 32 and got["assign"]["loop_cnt"] == 2
    assert got["assign"]["marks"][at("blockIdx.x")] == 8 and got["assign"]["marks"][at("unroll")] == 2
    assert got["add"]["loop_steps"] == 8 and got["divide"]["marks"][at("none")] == 1
    assert got["relu"]["loop_steps"] == 1 and got["relu"]["marks"][at("threadIdx.y")] == 5


def test_softmax_and_stamps(spark):
    from perfspark.functions import arrays, numbers

    df = spark.createDataFrame([([1.0, 2.0, 1000.0], 86_400.5), ([0.0, 0.0], -1.0), ([], None)], "x array<double>, s double")
    got = df.select(arrays.softmax(F.col("x")).alias("p"), numbers.log_stamp(F.col("s")).alias("t")).collect()
    assert got[0]["p"] == pytest.approx([0, 0, 1]) and got[1]["p"] == [0.5, 0.5] and got[2]["p"] == []
    assert [r["t"] for r in got] == ["1970-01-02 00:00:00", "1969-12-31 23:59:59", None]


@pytest.mark.parametrize("bins", [2, 7, 2000])
def test_shared_box_statistics(spark, bins):
    """Parts in several groups, a weight, ties, and values at the whiskers' bounds."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"task_id": rng.integers(0, 6, 400), "v": np.concatenate([rng.normal(size=250).round(1), rng.normal(size=130) * 50, np.full(20, 3.0)])})
    shares = [("a", 0, 1), ("a", 1, 1), ("b", 1, 1), ("b", 2, 1), ("c", 5, 1), *[("ALL", t, w) for t, w in ((0, 1), (1, 2), (2, 1), (5, 1))]]
    out = stats.shared_box_stats(spark.createDataFrame(pdf), "v", "task_id", spark.createDataFrame(shares, "network string, task_id long, weight long"), "network", bins)
    got = {r["network"]: r for r in out.collect()}
    assert set(got) == {"a", "b", "c", "ALL"}
    for g, r in got.items():
        v = np.concatenate([np.repeat(pdf.v[pdf.task_id == t], w) for n, t, w in shares if n == g])
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        reach = 1.5 * (q3 - q1)
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx([q1, q2, q3])
        assert (r["min"], r["max"], r["n"]) == (v.min(), v.max(), len(v))
        assert (r["low_whisker"], r["high_whisker"]) == (v[v >= r["q1"] - reach].min(), v[v <= r["q3"] + reach].max())


def test_samples_are_not_repeated_for_their_networks(spark):
    samples = spark.createDataFrame([(i % 2, float(i)) for i in range(40)], "task_id int, avg double")
    tasks = spark.createDataFrame([(f"n{j}", t) for j in range(30) for t in (0, 1)] + [(None, 0)], "network string, task_id int")
    out = stats.network_box_stats(samples, tasks, "avg")
    assert "explode" not in out._jdf.queryExecution().toString()
    got = {r["network"]: r["n"] for r in out.collect()}
    assert got == {**{f"n{j}": 40 for j in range(30)}, "ALL": 31 * 20 + 30 * 20}


def test_inversions_are_counted_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TASK_ROWS", 20)
    rows, seen = 400, []
    deal = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, n, *c: (seen.append(n), deal(df, n, *c))[1])
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": 0, "id": np.arange(rows), "label": rng.normal(size=rows), "pred": rng.normal(size=rows)})
    got = metrics.pairwise_order_accuracy(spark.createDataFrame(pdf), ["g"], "id", least_block=8).first()["accuracy"]
    a, b = pdf["label"].to_numpy(), pdf["pred"].to_numpy()
    i = np.triu_indices(rows, 1)
    assert got == pytest.approx(((a[:, None] > a) == (b[:, None] > b))[i].mean())
    assert seen and min(seen) == rows // 20


def test_program_lines_are_typed_once(spark):
    """One branch reads the lines, and columns of any kind come back."""
    from perfspark.operators import scopes

    text = "for (i, 0, 3) {\n  T_add(a, b)\n}\n"
    rows = spark.createDataFrame([(1, {"k": 1}, text), (2, None, text)], "id int, m map<string,int>, text string")
    out = scopes.scope_features(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    assert {(r["id"], str(r["m"]), r["op"], r["loop_steps"], r["loop_cnt"]) for r in out.collect()} == {
        (1, "{'k': 1}", "add", 4.0, 1), (2, "None", "add", 4.0, 1)}
