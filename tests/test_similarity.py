import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perfspark.operators import similarity


@pytest.mark.parametrize("ratio", [1.0, 7.0, 1e3, 1e9])
def test_quadrature(ratio):
    t, w = similarity.quadrature(ratio)
    s = np.geomspace(1, ratio, 400)
    assert np.abs(np.exp(-np.outer(s, t)) @ w * s - 1).max() < 2e-10


def gaps(y, n):
    total = 0.0
    for i in range(len(y)):
        total += (2 * np.abs(y[i] - y[i + 1:]) / (y[i] + y[i + 1:]) * n[i] * n[i + 1:]).sum()
    return total


def test_gap_sums_are_exact(spark):
    """Keys of wide and of very narrow spread, with a label 0, with negative
    labels, and repeated ones; several levels of merging."""
    rng = np.random.default_rng(0)
    keys = {"wide": rng.lognormal(0, 4, 900), "narrow": 5 + rng.random(700) * 1e-4, "zero": np.append(rng.random(300), 0.0),
            "below": rng.normal(size=60) + 0.3, "copies": rng.integers(1, 400, 2000) / 7}
    rows = [(k, float(v)) for k, values in keys.items() for v in values]
    df = spark.createDataFrame(rows, "k string, y double")
    got = similarity.label_gap_sums(df, ["k"], "y", block=3, few=8).toPandas().set_index("k")["gap_sum"]
    assert len(got) == len(keys)
    for k, values in keys.items():
        y, n = np.unique(values, return_counts=True)
        assert got[k] == pytest.approx(gaps(y, n), rel=1e-9), k


def test_a_key_with_a_million_labels(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), (F.col("id") + 1).cast("double").alias("y"))
    begun = time.perf_counter()
    got = similarity.label_gap_sums(df, ["k"], "y").first()["gap_sum"]
    assert time.perf_counter() - begun < 240
    # of 1..m: the sum over b of 2 * sum over a < b of (2b / (a + b) - 1), by harmonic numbers
    m = 1_000_000
    h = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, 2 * m + 1))])
    b = np.arange(1, m + 1)
    assert got == pytest.approx(float((2 * (2 * b * (h[2 * b - 1] - h[b]) - (b - 1))).sum()), rel=1e-8)


@pytest.mark.parametrize("hashes", ["own", "all equal"])
def test_one_entry_differs(spark, monkeypatch, hashes):
    """As by comparing all pairs, also if different vectors share a key."""
    if hashes == "all equal":
        monkeypatch.setattr(similarity.F, "xxhash64", lambda *c: F.lit(0).cast("bigint"))
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 3, (150, 4)).astype(float), rng.integers(1, 5, 150).astype(float)
    x[:50] = x[0]
    df = spark.createDataFrame(pd.DataFrame({"sample_id": np.arange(150), "x": x.tolist(), "y": y}))
    out = similarity.one_entry_differs(df).toPandas().set_index("entry")
    i, j = np.triu_indices(150, 1)
    for e in range(4):
        others = [c for c in range(4) if c != e]
        hit = (x[i][:, others] == x[j][:, others]).all(axis=1) & (x[i, e] != x[j, e])
        dx, dy = (x[i, e] - x[j, e])[hit], (y[i] - y[j])[hit]
        assert out.loc[e, "pairs"] == hit.sum() and out.loc[e, "same_label_pairs"] == (dy == 0).sum()
        assert out.loc[e, "slope"] == pytest.approx((dx * dy).sum() / (dx * dx).sum())


def test_shuffled_keys_hold_no_vectors(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(50)], 1.0)], "sample_id int, x array<double>, y double")
    assert similarity.one_entry_differs(df).count() == 0
