"""Scores of predictions against labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfspark.functions.numbers import ratio
from perfspark.operators.ranking import add_rank, add_segment
from perfspark.runtime import materialize

# Error bounds of the accuracy shares.
ACCURACY_BOUNDS = {"acc20": 0.20, "acc10": 0.10, "acc5": 0.05}


def ape(label: str = "label", pred: str = "pred") -> Column:
    """Relative error; null (undefined) where the label is 0."""
    return F.abs(ratio(F.col(label) - F.col(pred), F.col(label)))


def regression(df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """MAPE, RMSE, R2 and the shares of rows within each error bound; rows
    whose label is 0 have no relative error and are counted as ``undefined``."""
    err = (F.col(label) - F.col(pred)) * (F.col(label) - F.col(pred))
    s_tot = F.var_pop(label) * F.count(label)
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.avg(ape(label, pred)).alias("mape"),
        F.sqrt(F.avg(err)).alias("rmse"),
        F.when(s_tot < 1e-6, 1.0).otherwise(1 - F.sum(err) / s_tot).alias("r2"),
        *[(F.count_if(ape(label, pred) <= b) / n).alias(a) for a, b in ACCURACY_BOUNDS.items()],
        F.count_if(F.col(label) == 0).alias("undefined"),
    )


def error_columns(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Absolute difference, root of the squared difference, error in percent."""
    gap = F.col(label) - F.col(pred)
    return df.withColumns({
        "abs_diff": F.abs(gap), "rmse": F.sqrt(gap * gap), "mape": ratio(F.abs(gap), F.col(label)) * 100,
    })


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, max of columns, one row per column."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(c + "_n"), F.avg(c).alias(c + "_m"), F.stddev(c).alias(c + "_s"),
                 F.min(c).alias(c + "_l"), F.max(c).alias(c + "_h")]
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c + "_n").alias("count"), F.col(c + "_m").alias("mean"),
                 F.col(c + "_s").alias("std"), F.col(c + "_l").alias("min"), F.col(c + "_h").alias("max"))
        for c in cols
    ])))


def loss_report(
    df: DataFrame, label: str = "label", pred: str = "pred", keys: Sequence[str] = (),
    weighted: bool = False, mix: float = 0.5, power: int = 4,
) -> DataFrame:
    """The loss functions side by side; ``weighted`` multiplies every term by
    the sigmoid of the label."""
    gap = F.col(pred) - F.col(label)
    w = 1 / (1 + F.exp(-F.col(label))) if weighted else F.lit(1.0)
    rel = F.abs(ratio(gap, F.col(label)))
    mse, mape = F.avg(w * gap * gap), F.avg(w * rel)
    mspe = F.avg(w * rel * rel)
    return df.groupBy(*keys).agg(
        mse.alias("mse"), mspe.alias("mspe"), mape.alias("mape"),
        (1000 * mse + mape).alias("mse_mape"),
        (mix * mse + (1 - mix) * mape).alias("mixed"),
        (F.avg(w * gap) * F.avg(w * gap)).alias("mean_error_sq"),
        F.avg(w * F.pow(F.abs(gap), F.lit(power))).alias("k_power"),
        F.count_if(F.col(label) == 0).alias("undefined"),
    )


# ------------------------------------------------------------------ ranking

def _count_inversions(v: np.ndarray) -> int:
    """Pairs i < j with v[i] > v[j], by halves."""
    if len(v) <= 64:
        return int(np.triu(v[:, None] > v[None, :], 1).sum())
    mid = len(v) // 2
    left, right = v[:mid], v[mid:]
    cross = len(left) * len(right) - int(np.searchsorted(np.sort(left), right, side="right").sum())
    return cross + _count_inversions(left) + _count_inversions(right)


def _block_inversions(keys: Sequence[str], sort_by: Sequence[str]):
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(list(sort_by))["b"].to_numpy()
        return pd.DataFrame([[*key[: len(keys)], _count_inversions(values)]], columns=[*keys, "inv"])

    return count


#: Rows of a task that counts inversions.
TASK_ROWS = 500_000


def inversions(df: DataFrame, keys: Sequence[str], least_block: int = 4096) -> DataFrame:
    """Per key the number of row pairs ordered differently by ``a`` and ``b``,
    two permutations 1..size.

    Both orders are cut into blocks of about ``sqrt(size)``.  Pairs that share
    an a-block or a b-block are counted inside that block; all other pairs are
    counted on the grid of block counts with two running sums.  No task holds
    more than a block or a grid line, and no pair is formed.
    """
    keys = list(keys)
    width = F.greatest(F.ceil(F.sqrt("size")), F.lit(least_block))
    rows = materialize(df.select(
        *keys, "size", "a", "b",
        F.floor((F.col("a") - 1) / width).alias("ab"), F.floor((F.col("b") - 1) / width).alias("bb"),
        F.ceil(F.col("size") / width).alias("blocks"),
    ))
    types = dict(rows.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "inv bigint"
    # rows of a task are bounded, as many as there may be; a grid has no more cells than its key has rows or one block has
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    by_a = rows.select(*keys, "ab", "bb", "a", "b").repartition(tasks, *keys, "ab")
    in_a = by_a.groupBy(*keys, "ab").applyInPandas(_block_inversions(keys, ["a"]), schema)
    # Sorted by (a-block, b), rows of one a-block add nothing.
    by_b = rows.select(*keys, "ab", "bb", "b").repartition(tasks, *keys, "bb")
    in_b = by_b.groupBy(*keys, "bb").applyInPandas(_block_inversions(keys, ["ab", "b"]), schema)

    filled = by_a.groupBy(*keys, "ab", "bb").agg(F.count(F.lit(1)).alias("h"))
    line = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    cell = [*keys, "ab", "bb"]
    grid = (
        rows.where("a = 1 AND blocks > 1").select(*keys, "blocks")
        .withColumn("ab", F.explode(line)).repartition(tasks, *keys, "ab").withColumn("bb", F.explode(line))
        .repartition(tasks, *cell).join(filled.repartition(tasks, *cell), cell, "left").na.fill(0, ["h"])
    )
    before = Window.partitionBy(*keys, "bb").orderBy("ab").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys, "ab").orderBy(F.desc("bb")).rowsBetween(Window.unboundedPreceding, -1)
    apart = (
        grid.repartition(tasks, *keys, "bb").withColumn("c", F.coalesce(F.sum("h").over(before), F.lit(0)))
        .repartition(tasks, *keys, "ab").withColumn("s", F.coalesce(F.sum("c").over(above), F.lit(0)))
        .groupBy(*keys).agg(F.sum(F.col("h") * F.col("s")).alias("inv"))
    )
    return in_a.unionByName(in_b).unionByName(apart).groupBy(*keys).agg(F.sum("inv").alias("inversions"))


def pairwise_order_accuracy(
    df: DataFrame, keys: Sequence[str], order: str, label: str = "label", pred: str = "pred", least_block: int = 4096
) -> DataFrame:
    """Share of row pairs whose strict order by label and by prediction agrees.

    ``order`` gives the row order that settles ties: ranks by (label, order)
    and (prediction, order) disagree exactly where the strict tests disagree.
    Groups of one row score 0.5.
    """
    keys = list(keys)
    by_label = add_rank(df.select(*keys, order, label, pred), [label, order], keys, "a", "size")
    both = add_rank(by_label, [pred, order], keys, "b")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    inv = inversions(both, keys, least_block)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(inv, keys, "left").select(
        *keys, "n", F.when(F.col("n") <= 1, 0.5).otherwise(1 - F.col("inversions") / pairs).alias("accuracy")
    )


def _top(df: DataFrame, keys: Sequence[str], value: str, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(value), id_col)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)


def topk_recall(df: DataFrame, keys: Sequence[str], k: int, id_col: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Overlap of the top k by label and by prediction, over k."""
    keys = list(keys)
    real = _top(df, keys, label, id_col, k).select(*keys, id_col)
    guess = _top(df, keys, pred, id_col, k).select(*keys, F.col(id_col).alias(id_col)).withColumn("hit", F.lit(1))
    return real.join(guess, [*keys, id_col], "left").groupBy(*keys).agg(
        (F.count("hit") / F.lit(k)).alias("recall")
    )


def peak_score(df: DataFrame, keys: Sequence[str], k: int, id_col: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Mean of the running best label over the first k rows by prediction,
    relative to the best label of the group."""
    keys = list(keys)
    first = _top(df, keys, pred, id_col, k)
    best = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    curve = first.withColumn("__m", F.max(label).over(best)).groupBy(*keys).agg(F.avg("__m").alias("__c"))
    top = df.groupBy(*keys).agg(F.max(label).alias("__t"))
    return curve.join(top, keys).select(*keys, ratio(F.col("__c"), F.col("__t")).alias("score"))


# ------------------------------------------------------------- best / worst

def best_worst(
    df: DataFrame, id_col: str, label: str = "label", pred: str = "pred", thirds: bool = False, place: bool = True
) -> DataFrame:
    """Rows with ``ape`` and ``part``: best, worst or middle by error; rows
    without an error are ``undefined`` and have no place.

    Takes 100 rows per side (half of a small set), or a third of all rows.
    Without ``place`` only the rows near the two cuts are ranked.
    """
    scored = df.withColumn("ape", ape(label, pred))
    none = scored.where("ape IS NULL").withColumn("part", F.lit("undefined"))
    known = scored.where("ape IS NOT NULL")
    if not place:
        n = known.count()
        size = n // 3 if thirds else 100 if n > 200 else n // 2
        cut = add_segment(known, ["ape", id_col], [size, n - size], "__s")
        part = F.when(F.col("__s") == 0, "best").when(F.col("__s") == 2, "worst").otherwise("middle")
        return cut.withColumn("part", part).drop("__s").unionByName(none)
    ranked = add_rank(known, ["ape", id_col], (), "place", "__n")
    n = F.col("__n")
    size = F.floor(n / 3) if thirds else F.when(n > 200, 100).otherwise(F.floor(n / 2))
    part = F.when(F.col("place") <= size, "best").when(F.col("place") > n - size, "worst").otherwise("middle")
    return ranked.withColumn("part", part).drop("__n").unionByName(none.withColumn("place", F.lit(None).cast("bigint")))


def best_worst_report(parts: DataFrame) -> DataFrame:
    """Error over all rows, of the best, of the worst, without the worst."""
    at = lambda p: F.avg(F.when(F.col("part") == p, F.col("ape")))
    return parts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("ape").alias("mape"),
        at("best").alias("best"),
        at("worst").alias("worst"),
        F.avg(F.when(F.col("part") != "worst", F.col("ape"))).alias("without_worst"),
    )


def augment_with_worst(train: DataFrame, test: DataFrame, id_col: str) -> DataFrame:
    """Train rows plus the worst third of the test rows."""
    worst = best_worst(test, id_col, thirds=True).where("part = 'worst'")
    return train.unionByName(worst.select(*train.columns))
