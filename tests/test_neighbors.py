import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perfspark.operators import neighbors


def brute(queries, points, k):
    out = []
    for q, x in queries:
        d = [(float(np.sqrt(((np.array(x) - np.array(p)) ** 2).sum())), i) for i, p in points]
        out += [(q, i, round(dist, 9), n + 1) for n, (dist, i) in enumerate(sorted(d)[:k])]
    return sorted(out)


@pytest.mark.parametrize("dims, k, leaf", [(1, 1, 8), (2, 3, 16), (8, 2, 32), (3, 40, 20)])
def test_tree_finds_what_brute_force_finds(spark, dims, k, leaf):
    """Clusters, ties, copies of one point, entries without spread, few points for k."""
    rng = np.random.default_rng(dims)
    x = np.round(np.concatenate([rng.normal(size=(300, dims)), 100 + rng.normal(size=(200, dims)), np.full((150, dims), 7.0)]), 1)
    x[:, 0] = np.where(np.arange(len(x)) % 3 == 0, 5.0, x[:, 0])
    points = list(zip(range(len(x)), x.tolist()))
    queries = [(1000 + i, v) for i, v in enumerate(np.round(rng.normal(size=(40, dims)) * 60, 1).tolist() + x[:5].tolist())]
    as_df = lambda rows: spark.createDataFrame(rows, "id long, x array<double>")
    got = neighbors.nearest(as_df(queries), as_df(points), k, leaf=leaf).collect()
    assert sorted((r["qid"], r["pid"], round(r["dist"], 9), r["nth"]) for r in got) == brute(queries, points, k)


def test_no_points_and_no_queries(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0])], "id long, x array<double>")
    assert neighbors.nearest(rows, rows.where("id < 0"), 2).count() == 0
    assert neighbors.nearest(rows.where("id < 0"), rows, 2).count() == 0
    other = rows.select((F.col("id") + 1).alias("id"), "x", F.lit("b").alias("g"))
    assert neighbors.nearest(rows.withColumn("g", F.lit("a")), other, 1, same=["g"]).count() == 0


def test_work_of_a_query_stays_flat(spark):
    """Distances measured per query over 10^4 and over 10^6 points."""
    queries = spark.range(200).select("id", F.array(F.rand(1), F.rand(2), F.rand(3)).alias("x"))
    each = []
    for n in (10_000, 1_000_000):
        points = spark.range(n).select("id", F.array(F.rand(4), F.rand(5), F.rand(6)).alias("x"))
        search = neighbors.Search(queries, points, 3)
        assert search.found().select("qid").distinct().count() == 200
        sizes = search.tree.leaves.groupBy("cell").count()
        assert sizes.agg(F.max("count")).first()[0] <= neighbors.LEAF and sizes.agg(F.sum("count")).first()[0] == n
        each.append(search.compared() / 200)
    assert each[1] < 1.5 * each[0] and each[1] < 20_000


def test_visits_are_few(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(4000), "x": rng.normal(size=(4000, 2)).tolist()}))
    assert neighbors.visited_share(rows.limit(100), rows, 2, leaf=64) < 0.1
