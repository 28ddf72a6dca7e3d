import numpy as np
import pytest

from perfspark.operators import kernel_sums


def exact(x, s, scales):
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    return float(s @ sum(np.exp(-g * square) for g in scales) @ s)


@pytest.mark.parametrize("dims, scales, tolerance, leaf", [(1, [1.0, 0.01], 1e-9, 16), (3, [0.5], 1e-4, 20), (6, [1.0, 0.1, 0.001], 1e-7, 64)])
def test_error_is_within_the_tolerance(spark, dims, scales, tolerance, leaf):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(size=(400, dims)), 30 + rng.normal(size=(200, dims)), np.zeros((300, dims))]).round(3)
    s = rng.normal(size=len(x))
    points = spark.createDataFrame([(v, float(w)) for v, w in zip(x.tolist(), s)], "px array<double>, s double")
    got = kernel_sums.rbf_sum(points, scales, tolerance, leaf)
    assert abs(got - exact(x, s, scales)) <= tolerance * np.abs(s).sum() ** 2 + 1e-9


def test_far_cells_are_not_opened(spark, monkeypatch):
    """Two far clusters: no pair of points from both meets."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 2)), 1e4 + rng.normal(size=(500, 2))])
    seen = []
    whole = kernel_sums._leaf_sums
    monkeypatch.setattr(kernel_sums, "_leaf_sums", lambda tree, pairs, *rest: (seen.append((tree, pairs.collect())), whole(tree, pairs, *rest))[1])
    points = spark.createDataFrame([(v, 1.0) for v in x.tolist()], "px array<double>, s double")
    got = kernel_sums.rbf_sum(points, [1.0], 1e-12, 100)
    assert got == pytest.approx(exact(x, np.ones(1000), [1.0]), rel=1e-9)
    tree, pairs = seen[0]
    side = {r["cell"]: r["px"][0] > 5000 for r in tree.leaves.collect()}
    assert pairs and all(side[p["a_cell"]] == side[p["b_cell"]] for p in pairs)


def test_large_values_and_none(spark):
    x = np.array([[1e8, 0.0], [1e8 + 1, 0.5], [1e8 + 2, 0.25], [-3e8, 1.0]])
    points = spark.createDataFrame([(v, 1.0) for v in x.tolist()], "px array<double>, s double")
    assert kernel_sums.rbf_sum(points, [0.3], 1e-9) == pytest.approx(exact(x, np.ones(4), [0.3]), abs=1e-9)
    assert kernel_sums.rbf_sum(points.where("s < 0"), [0.3], 1e-9) == 0.0


def test_points_are_sent_once_a_group(spark):
    """However many leaves meet, a point goes to as many tasks as there are groups at most."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 12))
    points = spark.createDataFrame([(v, 1.0) for v in x.tolist()], "px array<double>, s double")
    tree = kernel_sums.Tree(points.selectExpr("'' AS g", "xxhash64(px) AS pid", "px", "s"), 1, 16)
    cells = tree.leaves.select("cell").distinct()
    pairs = cells.toDF("a_cell").crossJoin(cells.toDF("b_cell")).where("a_cell <= b_cell").selectExpr("*", "IF(a_cell = b_cell, 1D, 2D) AS both")
    sent = kernel_sums._dealt(tree, pairs, 3)[1]
    assert cells.count() > 30 and sent.count() <= 3 * len(x)
    assert kernel_sums._leaf_sums(tree, pairs, [0.1], 1e-9) == pytest.approx(exact(x, np.ones(600), [0.1]), rel=1e-9)
