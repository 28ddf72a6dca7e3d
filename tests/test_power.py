import numpy as np
import pytest

from perfspark.operators import transforms as tf


def likelihood(method, v, lam):
    with np.errstate(all="ignore"):
        if method == "Box-Cox":
            u = np.log(v) - np.log(v).mean()  # a factor of the values only moves the likelihood
            z = u if abs(lam) < 1e-12 else np.expm1(lam * u) / lam
            return -len(v) / 2 * np.log(z.var())
        if (v > 0).all():
            return likelihood("Box-Cox", v + 1, lam)
        up, down = np.maximum(v, 0), np.maximum(-v, 0)
        a = np.log1p(up) if abs(lam) < 1e-12 else ((up + 1) ** lam - 1) / lam
        b = np.log1p(down) if abs(2 - lam) < 1e-12 else ((down + 1) ** (2 - lam) - 1) / (2 - lam)
        return -len(v) / 2 * np.log((a - b).var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()


def best(method, v):
    low, high = -40.0, 40.0
    for _ in range(12):
        grid = np.linspace(low, high, 401)
        at = grid[np.nanargmax([likelihood(method, v, x) for x in grid])]
        low, high = at - (high - low) / 200, at + (high - low) / 200
    return at


@pytest.mark.parametrize("method", ["Box-Cox", "Yeo-Johnson"])
def test_lambda_of_many_entries_at_once(spark, method, monkeypatch):
    rng = np.random.default_rng(0)
    entries = [rng.lognormal(0, 1, 400), rng.gamma(2, 3, 400), rng.random(400) + 5, rng.normal(50, 1, 400), rng.lognormal(3, 2, 400) * 1e4,
               np.full(400, 3.0), rng.random(400) ** 0.1, rng.integers(1, 4, 400).astype(float)]
    if method == "Yeo-Johnson":
        entries += [rng.normal(size=400), -rng.lognormal(0, 1, 400), rng.normal(size=400) ** 3]
    passes = []
    monkeypatch.setattr(tf._Climb, "take", lambda self, m, take=tf._Climb.take: (passes.append(self), take(self, m)))
    rows = spark.createDataFrame([(p, float(x)) for p, v in enumerate(entries) for x in v], "pos int, v double")
    got = {r["pos"]: r["lambda"] for r in tf.fit_power(rows, method).collect()}
    assert got[5] == 0.0
    for p, v in enumerate(entries):
        if p != 5:
            want = best(method, v)
            assert got[p] == pytest.approx(want, abs=2e-5 * (1 + abs(want))), p
            assert likelihood(method, v, got[p]) >= likelihood(method, v, want) - 1e-7
    assert len(passes) <= 9 * len(entries)
