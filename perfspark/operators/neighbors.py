"""Exact nearest neighbours by a tree of cells.

Passes over the points cut every cell that holds more than ``LEAF`` of them
along its widest entry, into up to ``FAN`` parts at its quantiles, until all
cells are small or hold copies of one point.  A node knows the box around its
points.  A query goes down to the leaf whose box is nearest, which bounds its
k-th distance, and then down to all leaves whose boxes lie within that bound.
If these are many, it visits the best ones first and the others only as far as
the new bound reaches.  Depth grows with the logarithm of the points, and a
task holds the points of one leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfspark.runtime import materialize, small_side

#: Points of a leaf, unless they are copies of one point.
LEAF = 1024
#: Parts of a cell that is cut.
FAN = 16
#: Queries that a task compares with a leaf's points at once.
BLOCK = 2048
#: Leaves that a query visits before its bound is looked at again.
FIRST = 4
#: Bytes of a level of the tree that are broadcast at most; beyond, it is joined by shuffling.
LEVEL_BYTES = 64 << 20


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _closest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``a`` the places and distances of its ``k`` nearest rows of
    ``b``, ties by place.  A matrix product ranks roughly; what it cannot tell
    apart is measured exactly."""
    k = min(k, len(b))
    rough = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    slack = 1e-9 * (1 + (a * a).sum(axis=1) + (b * b).sum(axis=1).max())
    bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
    places, found = np.empty((len(a), k), np.int64), np.empty((len(a), k))
    for i in range(len(a)):
        near = np.flatnonzero(rough[i] <= bound[i])
        d = np.sqrt(((a[i] - b[near]) ** 2).sum(axis=1))
        best = np.argsort(d, kind="stable")[:k]
        places[i], found[i] = near[best], d[best]
    return places, found


def _nearest(block: int, k: int):
    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "pid", "dist"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in cols})
        right = right.sort_values("pid", kind="stable")
        points, ids = _matrix(right["px"]), right["pid"].to_numpy()
        out = []
        for i in range(0, len(left), block):
            part = left.iloc[i : i + block]
            best, dist = _closest(_matrix(part["qx"]), points, k)
            out.append(pd.DataFrame({
                "qid": np.repeat(part["qid"].to_numpy(), best.shape[1]), "pid": ids[best.ravel()], "dist": dist.ravel(),
            }))
        return pd.concat(out, ignore_index=True)

    return find


def _side(level: DataFrame) -> DataFrame:
    return small_side(level, max_bytes=LEVEL_BYTES)


class Tree:
    """Cells of ``points(g, pid, px, ...)``: ``leaves`` (their rows with the
    cell), ``levels`` of nodes (g, cell, parent, points, lo, hi, leaf), from the
    root on."""

    def __init__(self, points: DataFrame, k: int, leaf: int = LEAF):
        first = points.select(F.size("px")).first()
        self.levels: list[DataFrame] = []
        own = points.columns
        self.leaves = points.withColumn("cell", F.lit(0).cast("long"))
        if first is None:
            return
        dims = range(first[0])
        rows = materialize(self.leaves.withColumn("parent", F.lit(None).cast("long")))
        closed = []
        while True:
            boxes = rows.groupBy("g", "cell").agg(
                F.first("parent").alias("parent"), F.count(F.lit(1)).alias("points"),
                F.array(*[F.min(F.col("px")[i]) for i in dims]).alias("lo"), F.array(*[F.max(F.col("px")[i]) for i in dims]).alias("hi"))
            spread = F.zip_with("hi", "lo", lambda h, l: h - l)
            wide = F.array_max(spread) if dims else F.lit(0.0)
            boxes = materialize(boxes.withColumn("wide", wide).withColumn("dim", F.array_position(spread, wide).cast("int")).withColumn(
                "leaf", (F.col("points") <= leaf) | ~(F.col("wide") > 0)))
            self.levels.append(boxes)
            cut = boxes.where(~F.col("leaf")).select("g", "cell", "dim", F.element_at("lo", F.col("dim")).alias("low"), "wide")
            ready = boxes.where("leaf").select("g", "cell", (F.col("points") > leaf).alias("copies"))
            closed.append(rows.join(_side(ready), ["g", "cell"]))
            if cut.isEmpty():
                break
            valued = rows.join(_side(cut), ["g", "cell"]).withColumn("value", F.element_at("px", F.col("dim")))
            # the middle makes sure that a cell with two different points is cut
            shares = [i / FAN for i in range(1, FAN)]
            quantiles = valued.groupBy("g", "cell").agg(
                F.percentile_approx("value", shares, 1000).alias("q"), F.first(F.col("low") + F.col("wide") / 2).alias("middle"),
                F.first("dim").alias("dim"))
            cuts = materialize(quantiles.select("g", "cell", "dim", F.array_distinct(F.concat("q", F.array("middle"))).alias("cuts")))
            part = F.size(F.filter("cuts", lambda c: c < F.element_at("px", F.col("dim"))))
            rows = materialize(rows.drop("parent").join(_side(cuts), ["g", "cell"]).select(
                *own, F.xxhash64("cell", part, F.lit(len(closed))).alias("cell"), F.col("cell").alias("parent")))
        # of many copies of one point only the k smallest ids can matter
        every = reduce(DataFrame.unionByName, closed)
        order = Window.partitionBy("g", "cell").orderBy("pid")
        few = every.where("copies").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
        self.leaves = materialize(every.where(~F.col("copies")).unionByName(few).select(*own, "cell"))

    def children(self, level: int) -> DataFrame:
        """(g, cell, below): the nodes below a node, at most ``FAN + 1``."""
        node = F.struct("cell", "lo", "hi")
        return self.levels[level].groupBy("g", F.col("parent").alias("cell")).agg(F.collect_list(node).alias("below"))


def _box_distance(x: Column, lo: Column, hi: Column) -> Column:
    """Distance from a point to the nearest place in a box."""
    zero = F.lit(0.0)
    under = F.zip_with(x, lo, lambda v, l: F.greatest(l - v, zero))
    over = F.zip_with(x, hi, lambda v, h: F.greatest(v - h, zero))
    return F.sqrt(F.aggregate(F.zip_with(under, over, lambda a, b: a + b), zero, lambda s, v: s + v * v))


class Search:
    """The ``k`` nearest points of all queries, in rounds; ``visits`` lists the
    (query, leaf) pairs of every round."""

    def __init__(self, queries: DataFrame, points: DataFrame, k: int, x: str = "x", id_col: str = "id", same: Sequence[str] = (),
                 leaf: int = LEAF, block: int = BLOCK):
        group: Column = F.to_json(F.struct(*same)) if same else F.lit("")
        pid = points.schema[id_col].dataType
        self.k, self.block = k, block
        self.schema = T.StructType([T.StructField("qid", queries.schema[id_col].dataType), T.StructField("pid", pid),
                                    T.StructField("dist", T.DoubleType())])
        pts = points.select(group.alias("g"), F.col(id_col).alias("pid"), F.col(x).cast("array<double>").alias("px"))
        self.tree = Tree(pts, k, leaf)
        self.queries = queries.select(group.alias("g"), F.col(id_col).alias("qid"), F.col(x).cast("array<double>").alias("qx"))
        self.visits: list[DataFrame] = []

    def _visit(self, visits: DataFrame) -> DataFrame:
        """(qid, pid, dist) of the k nearest points in each visited leaf.  A
        leaf with very many queries is shown to several tasks."""
        self.visits.append(visits)
        asks = visits.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / (4 * self.block)).cast("int").alias("lanes"))
        lanes = small_side(materialize(asks))
        left = visits.join(lanes, ["g", "cell"]).withColumn("lane", F.pmod(F.xxhash64("qid"), F.col("lanes")).cast("int"))
        right = self.tree.leaves.join(lanes, ["g", "cell"]).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
        keys = ["g", "cell", "lane"]
        return materialize(
            left.select(*keys, "qid", "qx").groupBy(*keys).cogroup(right.select(*keys, "pid", "px").groupBy(*keys))
            .applyInPandas(_nearest(self.block, self.k), self.schema))

    def _limits(self, found: DataFrame) -> DataFrame:
        """(qid, limit): the k-th distance found so far."""
        order = Window.partitionBy("qid").orderBy("dist", "pid")
        kth = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == self.k)
        return kth.select("qid", (F.col("dist") * (1 + 1e-9) + 1e-12).alias("limit"))

    def found(self) -> DataFrame:
        """(qid, pid, dist) that hold the k nearest points of every query."""
        tree = self.tree
        if not tree.levels:
            return self.queries.sparkSession.createDataFrame([], self.schema)
        below = [_side(materialize(tree.children(i))) for i in range(1, len(tree.levels))]
        far = lambda c: _box_distance(F.col("qx"), c["lo"], c["hi"])
        own = self.queries.withColumn("cell", F.lit(0).cast("long"))
        for level in below:
            best = F.array_min(F.transform("below", lambda c: F.struct(far(c).alias("far"), c["cell"].alias("cell"))))
            own = own.join(level, ["g", "cell"], "left").select("g", "qid", "qx", F.coalesce(best["cell"], F.col("cell")).alias("cell"))
        own = materialize(own)
        found = self._visit(own)
        if not below:
            return found
        # all other leaves within the bound, by way of the nodes above them
        limit = F.coalesce(F.col("limit"), F.lit(float("inf")))
        near = own.withColumnRenamed("cell", "own").join(self._limits(found), "qid", "left").select(
            "g", "qid", "qx", "own", limit.alias("limit"), F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("far"))
        ends = []
        for level, nodes in zip(below, tree.levels[1:]):
            inside = F.filter(F.transform("below", lambda c: F.struct(c["cell"].alias("cell"), far(c).alias("far"))), lambda c: c["far"] <= F.col("limit"))
            near = near.join(level, ["g", "cell"]).select("g", "qid", "qx", "own", "limit", F.explode(inside).alias("c")).select(
                "g", "qid", "qx", "own", "limit", "c.cell", "c.far")
            ends.append(near.join(_side(nodes.where("leaf").select("g", "cell")), ["g", "cell"], "left_semi"))
        order = Window.partitionBy("qid").orderBy("far", "cell")
        others = materialize(reduce(DataFrame.unionByName, ends).where("cell <> own").withColumn("nth", F.row_number().over(order)))
        if others.isEmpty():
            return found
        columns = ["g", "qid", "qx", "cell"]
        if others.where(F.col("nth") > FIRST).isEmpty():
            return found.unionByName(self._visit(others.select(*columns)))
        found = found.unionByName(self._visit(others.where(F.col("nth") <= FIRST).select(*columns)))
        rest = others.where(F.col("nth") > FIRST).drop("limit").join(self._limits(found), "qid", "left").where(F.col("far") <= limit)
        return found.unionByName(self._visit(materialize(rest.select(*columns))))

    def compared(self) -> int:
        """Distances that the rounds measured."""
        sizes = self.tree.leaves.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"))
        return sum(v.join(sizes, ["g", "cell"]).agg(F.sum("n")).first()[0] or 0 for v in self.visits)


def visited_share(queries: DataFrame, points: DataFrame, k: int, **options) -> float:
    """Share of the (query, leaf) pairs that a search visits."""
    search = Search(queries, points, k, **options)
    search.found()
    leaves = sum(level.where("leaf").count() for level in search.tree.levels)
    every = queries.count() * leaves
    return sum(v.count() for v in search.visits) / every if every else 0.0


def nearest(queries: DataFrame, points: DataFrame, k: int, x: str = "x", id_col: str = "id", same: Sequence[str] = (),
            leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest points of every query: ``qid, pid, dist, nth``.

    ``same`` lists columns that must be equal on both sides.  Ties go to the
    smaller point id.  Queries without a point give no row.
    """
    found = Search(queries, points, k, x, id_col, same, leaf, block).found()
    order = Window.partitionBy("qid").orderBy("dist", "pid")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def weighted(x: str, weights: Sequence[float]) -> Column:
    """Scale entries so that plain L2 equals L2 with these weights."""
    roots = F.array(*[F.lit(float(w) ** 0.5) for w in weights])
    return F.zip_with(F.col(x), roots, lambda v, w: v * w)


def train_distance(test: DataFrame, train: DataFrame, x: str = "x", id_col: str = "id") -> DataFrame:
    """Distance from every test row to its closest train row."""
    return nearest(test, train, 1, x, id_col).select(F.col("qid").alias(id_col), "dist")


def two_nearest_angle(test: DataFrame, train: DataFrame, x: str = "x", id_col: str = "id") -> DataFrame:
    """Cosine at the test row between its two nearest train rows, the smallest
    distance, and the root mean square distance to all train rows.

    The mean square needs only the train means, so no pairs are formed.
    """
    found = nearest(test, train, 2, x, id_col)
    near = found.join(train.select(F.col(id_col).alias("pid"), F.col(x).alias("px")), "pid")
    pair = near.groupBy("qid").agg(
        F.max(F.when(F.col("nth") == 1, F.col("dist"))).alias("b"),
        F.max(F.when(F.col("nth") == 2, F.col("dist"))).alias("a"),
        F.max(F.when(F.col("nth") == 1, F.col("px"))).alias("x1"),
        F.max(F.when(F.col("nth") == 2, F.col("px"))).alias("x2"),
    )
    c2 = F.aggregate(F.zip_with("x1", "x2", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    a, b = F.col("a"), F.col("b")
    means = (
        train.select(F.posexplode(x).alias("pos", "v"))
        .groupBy("pos").agg(F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("m2")).collect()
    )
    means.sort(key=lambda r: r["pos"])
    centre = F.array(*[F.lit(r["m"]) for r in means])
    second = sum(r["m2"] for r in means)
    mean_sq = F.aggregate(
        F.zip_with(F.col(x), centre, lambda v, m: v * v - 2 * v * m), F.lit(float(second)), lambda s, v: s + v
    )
    rms = test.select(F.col(id_col).alias("qid"), F.sqrt(mean_sq).alias("rms_dist"))
    return pair.join(rms, "qid").select(
        F.col("qid").alias(id_col),
        F.try_divide(a * a + b * b - c2, 2 * a * b).alias("cos"),
        b.alias("min_dist"),
        "rms_dist",
    )
