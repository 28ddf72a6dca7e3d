"""Registered queries that no SQL twin can express, beside numpy."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from perfspark.operators import models
from perfspark.plans import catalog, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    """Ids, vectors and domains by id."""
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pandas().sort_values("vec_id")
    return t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float), t["label"].to_numpy()


def test_pca_reduces_whole_vectors(spark, vectors):
    ids, x, _ = vectors
    got = {r["id"]: r for r in catalog.QUERIES["pca_vectors"](spark, SF).collect()}
    assert len(got) == len(ids)
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    share = s**2 / (s**2).sum()
    for i in range(2):
        want = x @ v[i]
        mine = np.array([got[k][f"pc{i + 1}"] for k in ids])
        assert np.allclose(mine * np.sign(mine @ want), want, atol=1e-6)
        assert got[ids[0]][f"explained{i + 1}"] == pytest.approx(share[i])


def test_every_cost_model_is_fitted_and_tested(spark):
    rng = np.random.default_rng(8)
    facts = ("source_time op_flops size transform ai perf tile_size_in tile_size_out tile_flop pipeline_num target_bw "
             "target_clock target_core_num").split()
    rows = [(f"k{i % 3}", i, *map(float, rng.uniform(0.5, 3, len(facts))), float(rng.uniform(1, 5))) for i in range(180)]
    df = spark.createDataFrame(rows, "kernel string, i int, " + ", ".join(f"{f} double" for f in facts) + ", time double")
    train, test = df.where("i < 120"), df.where("i >= 120")
    params, errors = models.cost_fit_all(train, test, "kernel", "time")
    coef = {(r["kernel"], r["method"], r["variant"]): r["coef"] for r in params.collect()}
    mape = {(r["kernel"], r["method"], r["variant"]): r["mape"] for r in errors.collect()}
    spec = {(m, v): f for m, fs in models.cost_methods().items() for v, f in enumerate(fs)}
    assert set(coef) == set(mape) == {(f"k{i}", *s) for i in range(3) for s in spec}

    for s, (features, positive) in spec.items():
        names = list(features)
        got = df.select("kernel", "i", "time", *[f.cast("double").alias(f"f{j}") for j, f in enumerate(features.values())]).toPandas()
        for k, part in got.groupby("kernel"):
            a, y = part[[f"f{j}" for j in range(len(names))]].to_numpy(), part["time"].to_numpy()
            w = np.array([coef[(k, *s)].get(n, 0.0) for n in names])
            fit = (part["i"] < 120).to_numpy()
            gradient = a[fit].T @ (y[fit] - a[fit] @ w)
            free = np.array([n not in positive for n in names]) | (w > 0)
            scale = np.linalg.norm(a[fit], axis=0) * np.linalg.norm(y[fit])
            assert (w[[n in positive for n in names]] >= 0).all()
            assert (np.abs(gradient[free]) <= 1e-6 * scale[free]).all() and (gradient <= 1e-6 * scale).all()
            if not positive:
                assert np.allclose(w, np.linalg.lstsq(a[fit], y[fit], rcond=None)[0], rtol=1e-5, atol=1e-7)
            assert mape[(k, *s)] == pytest.approx(np.mean(np.abs((a[~fit] @ w - y[~fit]) / y[~fit])))


def test_every_kernel_has_every_cost_model(spark):
    got = catalog.QUERIES["grouped_cost_fit_all"](spark, SF).collect()
    kernels = {r["kernel"] for r in views.kernels(spark, SF).select("kernel").distinct().collect()}
    models_ = sum(map(len, models.cost_methods().values()))
    assert {r["kernel"] for r in got} == kernels
    fitted = {r["kernel"] for r in got if r["n_train"]}
    assert len(got) == len(fitted) * models_ + len(kernels - fitted)
    assert all(r["coef"] for r in got if r["n_train"]) and any(r["mape"] is not None for r in got)


def lloyd(ids, x, k, steps=20):
    """Centres and clusters, from the first vectors in hash order."""
    chosen, seen = [], set()
    for i in sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"0{ids[i]}".encode()).hexdigest(), ids[i])):
        if x[i].tobytes() not in seen and len(chosen) < k:
            seen.add(x[i].tobytes())
            chosen.append(x[i])
    c = np.array(chosen)
    near = lambda c: ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    for _ in range(steps):
        at = near(c)
        c = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
    return c, near(c)


def test_settled_clusters(spark, vectors):
    ids, x, domains = vectors
    _, at = lloyd(ids, x, 10)
    assert (at != lloyd(ids, x, 10, 2)[1]).any()  # two steps do not settle
    got = {r["cluster"]: (r["n"], r["first_id"], r["last_id"]) for r in catalog.QUERIES["kmeans_clusters_settled"](spark, SF).collect()}
    assert got == {j: ((at == j).sum(), ids[at == j].min(), ids[at == j].max()) for j in set(at)}

    _, at = lloyd(ids, x, 20)
    count = lambda rows: np.bincount(at[rows], minlength=20) / np.linalg.norm(np.bincount(at[rows], minlength=20))
    whole = count(np.ones(len(ids), bool))
    got = {r["domain"]: r["distance"] for r in catalog.QUERIES["cluster_mix_distance_settled"](spark, SF).collect()}
    assert set(got) == set(domains)
    assert all(got[d] == pytest.approx(np.linalg.norm(count(domains == d) - whole), abs=1e-6) for d in got)

    c, at = lloyd(ids, x, 4)
    gaps = np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(axis=2))
    taken = {}
    for j in sorted(range(4), key=lambda j: (-(at == j).sum(), j)):
        far = {int(d): gaps[domains == d, j].mean() for d in set(domains) if int(d) not in taken}
        if far:
            task = min(far, key=lambda d: (far[d], d))
            taken[task] = (j, pytest.approx(far[task]))
    got = {r["task_id"]: (r["cluster"], r["distance"]) for r in catalog.QUERIES["select_tasks_kmeans_settled"](spark, SF).collect()}
    assert got == taken


def test_forest_tells_best_from_worst_rows(spark):
    n = views.predictions(spark, SF).count()
    got = {(r["side"], r["part"]): r for r in catalog.QUERIES["rf_best_worst"](spark, SF).collect()}
    assert set(got) == {(s, p) for s in ("val", "test") for p in ("best", "worst")}
    for part in ("best", "worst"):
        assert sum(got[s, part]["n"] for s in ("val", "test")) == n // 3
        assert got["test", part]["accuracy"] > 0.8
