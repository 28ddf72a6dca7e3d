"""Sums of a kernel over all pairs of weighted points, to a stated error.

Both points of a pair are looked for in one tree of cells.  A pair of cells is
bounded by the least and the greatest distance between their boxes.  Where the
kernel's values at both differ by no more than the tolerance allows, the middle
stands for all pairs of points; else the cells are opened, and leaves that must
be opened meet in a task that has the points of two groups of leaves.  Frontiers of cell pairs are tables, a level of the
tree a pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfspark.operators.neighbors import Tree
from perfspark.runtime import lookup, materialize, small_side

#: Points of a leaf.
LEAF = 512
#: Bytes of a table of cells that is broadcast at most.
CELL_BYTES = 64 << 20
#: Groups into which leaves are dealt at least, and bytes of the points of one.
GROUPS, GROUP_BYTES = 16, 32 << 20


def _nodes(tree: Tree) -> list[DataFrame]:
    """Per level the cells that cover all points: cell, up (the cell of the
    level above that holds it), leaf, lo, hi, s (sum of weights)."""
    sums = tree.leaves.groupBy("cell").agg(F.sum("s").alias("s"))
    below, levels = materialize(sums), []
    for level in reversed(tree.levels):
        boxes = level.select("cell", "parent", "leaf", "lo", "hi").join(small_side(below, max_bytes=CELL_BYTES), "cell")
        boxes = materialize(boxes)
        levels.insert(0, boxes)
        below = sums.unionByName(boxes.groupBy(F.col("parent").alias("cell")).agg(F.sum("s").alias("s")))
        below = materialize(below)
    covers, ended = [], None
    for boxes in levels:
        own = boxes.withColumnRenamed("parent", "up")
        kept = own if ended is None else own.unionByName(ended.withColumn("up", F.col("cell")))
        covers.append(materialize(kept))
        ended = covers[-1].where("leaf")
    return covers


def _squares(gap):
    return F.aggregate(gap, F.lit(0.0), lambda t, v: t + v * v)


def rbf_sum(points: DataFrame, scales: Sequence[float], tolerance: float, leaf: int = LEAF) -> float:
    """Sum of ``s_p s_q k(p, q)`` over all ordered pairs of ``points(px, s)``,
    a point with itself included, for ``k(p, q)`` the sum of ``exp(-g |p - q|^2)``
    over the scales.

    The error is at most ``tolerance`` times the square of the sum of ``|s|``,
    besides the rounding of doubles.  Equal points are merged first.
    """
    merged = points.groupBy("px").agg(F.sum("s").alias("s")).where("s <> 0")
    merged = materialize(merged.select(F.lit("").alias("g"), F.xxhash64("px").alias("pid"), "px", "s"))
    tree = Tree(merged, 1, leaf)
    if not tree.levels:
        return 0.0
    covers = _nodes(tree)
    total, leaves = 0.0, []
    pairs = None
    for i, cover in enumerate(covers):
        named = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("cell", "up", "leaf", "lo", "hi", "s")]
        side = lambda x: cover.select(*named(x))  # noqa: B023,E731
        if i == 0:
            met = cover.select(*named("a"), *named("b"))  # the root with itself
        else:
            met = pairs.join(small_side(side("a"), max_bytes=CELL_BYTES), F.col("u") == F.col("a_up")).join(
                small_side(side("b"), max_bytes=CELL_BYTES), F.col("v") == F.col("b_up"))
            met = met.where((F.col("u") != F.col("v")) | (F.col("a_cell") <= F.col("b_cell")))
        apart = F.zip_with(F.zip_with("a_lo", "b_hi", lambda p, q: p - q), F.zip_with("b_lo", "a_hi", lambda p, q: p - q),
                           lambda p, q: F.greatest(p, q, F.lit(0.0)))
        across = F.zip_with(F.zip_with("a_hi", "b_lo", lambda p, q: p - q), F.zip_with("b_hi", "a_lo", lambda p, q: p - q),
                            lambda p, q: F.greatest(p, q))
        met = met.withColumn("near", _squares(apart)).withColumn("far", _squares(across))
        value = lambda d: reduce(lambda p, q: p + q, [F.exp(-F.lit(float(g)) * F.col(d)) for g in scales])
        both = F.when(F.col("a_cell") == F.col("b_cell"), 1.0).otherwise(2.0)
        met = materialize(met.select(
            "a_cell", "b_cell", (F.col("a_leaf") & F.col("b_leaf")).alias("ended"), (value("near") - value("far") <= 2 * tolerance).alias("told"),
            (both * F.col("a_s") * F.col("b_s") * (value("near") + value("far")) / 2).alias("part"), both.alias("both")))
        total += met.where("told").agg(F.sum("part")).first()[0] or 0.0
        leaves.append(met.where("ended AND NOT told").select("a_cell", "b_cell", "both"))
        pairs = met.where("NOT ended AND NOT told").select(F.col("a_cell").alias("u"), F.col("b_cell").alias("v"))
    return total + _leaf_sums(tree, reduce(DataFrame.unionByName, leaves), scales, tolerance)


def _dealt(tree: Tree, pairs: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of leaves with the two groups ``i <= j`` of their leaves, and
    per two groups the points of the leaves that their pairs name, once each."""
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    met = pairs.select("a_cell", "b_cell", "both", F.least(of("a_cell"), of("b_cell")).alias("i"), F.greatest(of("a_cell"), of("b_cell")).alias("j"))
    asked = met.select("i", "j", F.explode(F.array("a_cell", "b_cell")).alias("cell")).distinct()
    return met, tree.leaves.select("cell", "px", "s").join(lookup(asked), "cell")


def _leaf_sums(tree: Tree, pairs: DataFrame, scales: Sequence[float], tolerance: float) -> float:
    """Exact sums over pairs of leaves.  Leaves are dealt into groups of bounded
    size, and a task takes the pairs between two groups: a point is sent once a
    group at most, however many leaves its own meets."""
    facts = tree.leaves.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("px")).alias("dims"), F.countDistinct("cell").alias("cells")).first()
    wanted = max(GROUPS, -(-8 * facts["n"] * facts["dims"] // GROUP_BYTES))
    groups = max(1, min(wanted, facts["cells"]))
    met, points = _dealt(tree, pairs, groups)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        total = 0.0
        if left.num_rows:
            cells, s = right["cell"].to_numpy(), right["s"].to_numpy()
            x = right["px"].combine_chunks()
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            order = np.argsort(cells, kind="stable")
            cells, s, x = cells[order], s[order], x[order]
            ends = lambda c: (np.searchsorted(cells, c, "left"), np.searchsorted(cells, c, "right"))
            a, b = ends(left["a_cell"].to_numpy()), ends(left["b_cell"].to_numpy())
            for p0, p1, q0, q1, both in zip(*a, *b, left["both"].to_numpy()):
                total += both * _pair_sum(x[p0:p1], s[p0:p1], x[q0:q1], s[q0:q1], scales, tolerance)
        return pa.table({"part": pa.array([total], pa.float64())})

    # so many tasks as there are two groups: their data may be small, their work is not
    deal = lambda df: df.repartition(groups * (groups + 1) // 2, "i", "j").groupBy("i", "j")
    return deal(met).cogroup(deal(points)).applyInArrow(summed, "part double").agg(F.sum("part")).first()[0] or 0.0


def _pair_sum(p: np.ndarray, s: np.ndarray, q: np.ndarray, t: np.ndarray, scales: Sequence[float], tolerance: float) -> float:
    middle = (p.mean(axis=0) + q.mean(axis=0)) / 2
    p, q = p - middle, q - middle
    size = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :]
    square = np.maximum(size - 2 * (p @ q.T), 0)
    if size.max() * max(scales) * 1e-15 > tolerance:  # the difference of large squares is too rough
        for i in range(len(p)):
            square[i] = ((p[i] - q) ** 2).sum(axis=1)
    return float(s @ sum(np.exp(-g * square) for g in scales) @ t)
