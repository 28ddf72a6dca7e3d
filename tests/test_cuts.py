"""Rows told apart by a few places of an order, without ranking or keeping the whole table."""

import collections
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perfspark import runtime
from perfspark.operators import joins, metrics, models, ranking, split
from perfspark.plans import catalog


@pytest.fixture
def large(monkeypatch):
    """Small tables take the way of large ones; gives the rows of every table that was ranked."""
    ranked = []
    chunked = ranking.chunked
    monkeypatch.setattr(ranking, "RANKED_ROWS", 100)
    monkeypatch.setattr(ranking, "SAMPLED_OF", 2)
    monkeypatch.setattr(ranking, "chunked", lambda df, *a: (ranked.append(df.count()), chunked(df, *a))[1])
    return ranked


def lineitem(folder, n: int, twice: int = 0) -> str:
    rng = np.random.default_rng(5)
    price, tax = rng.uniform(900, 90000, n).round(2), rng.integers(0, 9, n) / 100
    rows = pd.DataFrame({
        "l_orderkey": np.arange(n) // 7, "l_linenumber": np.arange(n, dtype="int32") % 7 + 1, "l_partkey": rng.integers(1, 50, n),
        "l_suppkey": rng.integers(1, 9, n), "l_quantity": rng.integers(1, 50, n) * 1.0, "l_extendedprice": price,
        "l_discount": rng.integers(0, 11, n) / 100, "l_tax": tax})
    rows.loc[3, "l_extendedprice"] = None  # no error and no place
    rows = pd.concat([rows, rows.tail(twice)])
    rows.to_parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_segments_are_cut_exactly(spark, large):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v) if v else None, f"i{i}") for i, v in enumerate(rng.integers(0, 5, 3000))], "v double, id string")
    df = runtime.materialize(df.union(spark.createDataFrame([(float("nan"), "n"), (3.0, None)], "v double, id string")).repartition(5))
    rank = {r["id"]: r["r"] for r in ranking.add_rank(df, ["v", "id"], (), "r").collect()}
    for places in ([1000, 2001], [0], [3002], [5, 7, 1500, 1501], [3001, 9000], []):
        got = {r["id"]: r["segment"] for r in ranking.add_segment(df, ["v", "id"], places).collect()}
        assert got == {i: sum(r > p for p in places) for i, r in rank.items()}


def test_only_rows_near_a_place_are_ranked(spark, large):
    df = runtime.materialize(spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("id")))
    got = ranking.add_segment(df, ["id"], [66_666, 133_334]).groupBy("segment").count().collect()
    assert {r["segment"]: r["count"] for r in got} == {0: 66_666, 1: 66_668, 2: 66_666}
    assert len(large) == 2 and max(large) < 120_000 and large[-1] < 15_000  # the sample, and the rows of the brackets


def test_equal_rows_at_a_place_are_cut(spark, large):
    df = spark.createDataFrame([("a",)] * 300 + [("b",)] * 900 + [("c",)] * 300, "id string")
    got = ranking.add_segment(df, ["id"], [500, 1000]).groupBy("id", "segment").count().collect()
    assert {(r["id"], r["segment"]): r["count"] for r in got} == {("a", 0): 300, ("b", 0): 200, ("b", 1): 500, ("b", 2): 200, ("c", 2): 300}


def test_a_sample_that_misses_the_place_is_noticed(spark, large, monkeypatch):
    df = runtime.materialize(spark.range(5000))
    monkeypatch.setattr(type(df), "sample", lambda self, *a, **k: self.where("id < 400"))
    got = ranking.add_segment(df, ["id"], [2500]).groupBy("segment").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r["segment"], r["a"], r["n"]) for r in got} == {(0, 0, 2500), (1, 2500, 2500)}


@pytest.mark.parametrize("classes", (16, 0))
def test_upsampled_rows_are_the_first_by_id(spark, large, monkeypatch, classes):
    monkeypatch.setattr(split, "CUT_CLASSES", classes)
    n = {None: 3, "a": 70, "b": 300, "c": 200, "d": 300}
    df = spark.createDataFrame([(c, f"{c}{i:03}") for c, k in n.items() for i in range(k)], "c string, id string")
    got = split.upsample(df, "c", "id")
    assert got.columns == ["c", "id"]
    copies = {(r["c"], r["id"]): r["count"] for r in got.groupBy("c", "id").count().collect()}
    assert copies == {(c, f"{c}{i:03}"): 300 // k + (i < 300 % k) for c, k in n.items() for i in range(k)}


@pytest.mark.parametrize("thirds", (True, False))
def test_parts_do_not_depend_on_places(spark, large, thirds):
    rows = [(f"i{i}", float(i % 11), float(i % 7)) for i in range(900)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "id string, label double, pred double")
    with_place, without = (metrics.best_worst(df, "id", thirds=thirds, place=p) for p in (True, False))
    assert set(with_place.columns) - set(without.columns) == {"place"}
    part = lambda df: {r["id"]: (r["part"], r["ape"]) for r in df.collect()}
    assert part(without) == part(with_place)


def test_a_join_in_rounds_has_the_rows_of_a_join(spark, monkeypatch):
    left = spark.createDataFrame([(f"k{i % 40}" if i % 9 else None, i) for i in range(90)], "k string, a int")
    right = spark.createDataFrame([(f"k{i}" if i % 7 else None, i) for i in range(60)] + [("k1", 99)], "k string, b int")
    want = collections.Counter(map(tuple, left.join(right, "k").collect()))
    for rows in (1000, 30):
        monkeypatch.setattr(joins, "ROUND_ROWS", rows)
        assert collections.Counter(map(tuple, joins.join_in_rounds(left, right, "k").collect())) == want


def test_written_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get(runtime.SHUFFLE_CLEANUP)
    found = lambda: {f for d in jvm_folders(spark) for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}
    kept = found()
    pair = [spark.range(5000).withColumn("k", F.col("id") % n).repartition(3, "k") for n in (5, 6)]
    out = runtime.materialize_each(pair)
    last = runtime.materialize_last(lambda: runtime.materialize(out).repartition(4, "k"))
    data = lambda: {f for f in found() - kept if f.endswith(".data")}
    end = time.time() + 20
    while data() and time.time() < end:  # they are deleted by other threads
        time.sleep(0.1)
    assert not data()
    assert out.count() == last.count() == 10_000 and spark.conf.get(runtime.SHUFFLE_CLEANUP) == before


def jvm_folders(spark) -> list[str]:
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return [f.getPath() for f in manager.localDirs()]


def test_tables_made_on_the_way_are_deleted(spark):
    root = runtime._app_folder(spark)
    made = []
    with runtime.scope(spark):
        got = runtime.materialize_last(lambda: made.append(runtime.materialize(spark.range(9))) or made[0].where("id > 2"))
        assert got.count() == 6
        folders = {p.rsplit("/", 1)[1] for p in runtime._SCOPES[-1]}
        assert len(folders) == 2 and len(folders & set(os.listdir(root))) == 1
    assert not folders & set(os.listdir(root))


def test_best_worst_forest_neither_ranks_nor_keeps_all_rows(spark, tmp_path, large, monkeypatch):
    n = 9000
    folder = lineitem(tmp_path, n, twice=50)
    monkeypatch.setattr(joins, "ROUND_ROWS", 7000)
    monkeypatch.setattr(models, "FOREST_ROWS", 1000)
    seen = []
    fit = models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    got = {(r["side"], r["part"]): r for r in catalog.QUERIES["rf_best_worst"](spark, folder).collect()}
    third = (n - 1 - 50 + 50 * 4) // 3  # ids that come twice meet twice twice
    for part in ("best", "worst"):
        assert sum(got[s, part]["n"] for s in ("val", "test")) == third
        assert got["test", part]["accuracy"] > 0.9
    assert large and max(large) < n and seen[0] >= 6
