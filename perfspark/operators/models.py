"""Clustering, task selection and fitted cost models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfspark.functions.numbers import ratio
from perfspark.functions import arrays
from perfspark.operators import domain, series
from perfspark.operators.metrics import ape
from perfspark.operators.ranking import add_rank
from perfspark.operators.split import hash_order, upsample
from perfspark.runtime import lookup, materialize, materialize_last, shuffled_once, small_side

MAX_OPEN_KEYS = 2048
#: Rows of a partition that a forest is fitted on.
FOREST_ROWS = 200_000


# ---------------------------------------------------------------- clusters

def with_vector(df: DataFrame, x: str, into: str = "vec") -> DataFrame:
    return df.withColumn(into, array_to_vector(x))


def kmeans(df: DataFrame, x: str, k: int = 10, id_col: str = "id", steps: int = 20) -> tuple[list[list[float]], DataFrame]:
    """Centres, and the rows with a ``cluster`` label.

    Lloyd's steps from the first ``k`` different vectors in hash order of their
    ids, so results repeat on any cluster.  A step is one aggregation: a batch
    leaves one row per cluster.  An empty cluster keeps its centre; ties go to
    the lower number.
    """
    first = df.groupBy(F.col(x).alias("x")).agg(F.min(F.struct(hash_order(id_col), F.col(id_col))).alias("o"))
    centres = np.array([r["x"] for r in first.orderBy("o").limit(k).collect()], dtype=float)
    if not len(centres):
        return [], df.withColumn("cluster", F.lit(None).cast("int"))
    for _ in range(steps):
        sums = _cluster_sums(df, x, centres).groupBy("cluster").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(centres.shape[1])])
        moved = centres.copy()
        for r in sums.collect():  # one row per cluster
            moved[r["cluster"]] = [r[f"s{i}"] / r["n"] for i in range(centres.shape[1])]
        if np.array_equal(moved, centres):
            break
        centres = moved
    table = F.array(*[arrays.literal(c) for c in centres.tolist()])
    gaps = F.transform(table, lambda c: arrays.distance(F.col(x), c))
    nearest = F.array_position(gaps, F.array_min(gaps)) - 1
    return centres.tolist(), df.withColumn("cluster", nearest.cast("int"))


def _cluster_sums(df: DataFrame, x: str, centres: np.ndarray) -> DataFrame:
    def sums(batches):
        for batch in batches:
            if not len(batch):
                continue
            m = np.stack(batch[x].to_numpy()).astype(float)
            gaps = np.stack([((m - c) ** 2).sum(axis=1) for c in centres], axis=1)
            nearest = gaps.argmin(axis=1)
            found = np.unique(nearest)
            yield pd.DataFrame({"cluster": found, "n": [int((nearest == c).sum()) for c in found],
                                "s": [m[nearest == c].sum(axis=0) for c in found]})

    return df.select(x).mapInPandas(sums, "cluster int, n bigint, s array<double>")


def _first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows that can be first of their key.

    The smallest text of a group is found by sorting, the smallest number by
    hashing: of a text order only rows with the smallest leading bytes stay.
    With too many keys to broadcast, all rows do.
    """
    if dict(df.dtypes)[order] != "string":
        return df
    lead = F.conv(F.rpad(F.hex(F.substring(F.encode(order, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    least = materialize(df.select(key, lead.alias("__l")).groupBy(key).agg(F.min("__l").alias("__least")))
    few = least.withColumnRenamed(key, "__k")
    marked = small_side(few)
    if marked is few:
        return df
    return df.join(marked, F.col(key).eqNullSafe(F.col("__k")) & lead.eqNullSafe(F.col("__least"))).drop("__k", "__least")


def descriptor_clusters(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows with equal descriptors share an id, numbered by first appearance."""
    keyed = df.withColumn("__key", key)
    first = _first_rows(keyed, "__key", order).groupBy("__key").agg(F.min(order).alias("__first"))
    ids = add_rank(first, ["__first"], (), "cluster").select("__key", (F.col("cluster") - 1).alias("cluster"))
    return keyed.join(lookup(ids), "__key").drop("__key")


def pca(df: DataFrame, x: str, k: int = 2):
    """Projected rows (array ``pc``) and the explained variance shares."""
    rows = with_vector(df, x)
    model = PCA(k=k, inputCol="vec", outputCol="pcv").fit(rows)
    out = model.transform(rows).withColumn("pc", vector_to_array("pcv")).drop("vec", "pcv")
    return out, [float(v) for v in model.explainedVariance]


# ---------------------------------------------------------- task selection

def select_center(df: DataFrame, n: int, x: str = "x", task: str = "task_id") -> DataFrame:
    """Tasks whose mean vector is nearest to the overall mean."""
    sums = domain.power_sums(df, [task], x, domain.centre_of(df, x), 1)
    gap = F.sqrt(F.sum((F.col("s1") / F.col("n")) ** 2))
    return sums.groupBy(task).agg(gap.alias("distance")).orderBy("distance", task).limit(n)


def select_cmd(df: DataFrame, n: int, x: str = "x", task: str = "task_id") -> DataFrame:
    """Tasks with the smallest moment discrepancy to all rows."""
    return domain.cmd_by_group(df, df, task, x).select(task, "cmd").orderBy("cmd", task).limit(n)


def select_cmd_remove(df: DataFrame, n: int, x: str = "x", task: str = "task_id", k: int = domain.MOMENTS) -> DataFrame:
    """Greedy: take the closest task, remove its rows, compare the others with
    what is left.  Rows are read once; each step works on the power sums."""
    sums = materialize(domain.power_sums(df, [task], x, domain.centre_of(df, x), k))
    powers = [f"s{i}" for i in range(1, k + 1)]
    taken: list[tuple] = []
    left = sums
    for step in range(n):
        total = left.groupBy("pos").agg(F.sum("n").alias("tn"), *[F.sum(s).alias("t_" + s) for s in powers])
        both = left.join(F.broadcast(total), "pos")  # one row per entry
        mine = domain._from_sums("a", F.col("n"), [F.col(s) for s in powers])
        rest = domain._from_sums("b", F.col("tn"), [F.col("t_" + s) for s in powers])
        best = domain._norms(both.select(task, "pos", *mine, *rest), [task], k, 1.0).orderBy("cmd", task).first()
        if best is None:
            break
        taken.append((step, best[task], best["cmd"]))
        left = left.where(F.col(task) != F.lit(best[task]))
    kind = dict(df.dtypes)[task]
    return df.sparkSession.createDataFrame(taken, f"step int, {task} {kind}, cmd double")


def select_random(df: DataFrame, n: int, task: str = "task_id", seed: str = "0") -> DataFrame:
    return df.select(task).distinct().orderBy(hash_order(task, seed), task).limit(n)


def cluster_task_distance(df: DataFrame, centers: Sequence[Sequence[float]], x: str, task: str) -> DataFrame:
    """Mean distance of every task's rows to every cluster centre."""
    table = F.array(*[arrays.literal(c) for c in centers])
    gaps = F.transform(table, lambda c: arrays.distance(F.col(x), c))
    return df.select(task, F.posexplode(gaps).alias("cluster", "d")).groupBy("cluster", task).agg(
        F.avg("d").alias("distance")
    )


def select_kmeans(df: DataFrame, n: int, x: str = "x", task: str = "task_id", id_col: str = "id", steps: int = 20) -> DataFrame:
    """One cluster per wanted task: larger clusters choose first, each takes
    its nearest free task.  At most ``n`` candidates per cluster can matter."""
    centers, labelled = kmeans(df, x, n, id_col, steps)
    sizes = {r["cluster"]: r["count"] for r in labelled.groupBy("cluster").count().collect()}
    near = Window.partitionBy("cluster").orderBy("distance", task)
    table = cluster_task_distance(df, centers, x, task)
    rows = table.withColumn("r", F.row_number().over(near)).where(F.col("r") <= n).collect()
    taken: dict = {}
    for cluster in sorted(range(len(centers)), key=lambda c: (-sizes.get(c, 0), c)):
        for r in sorted((r for r in rows if r["cluster"] == cluster), key=lambda r: r["r"]):
            if r[task] not in taken:
                taken[r[task]] = (cluster, r["distance"])
                break
    kind = dict(df.dtypes)[task]
    return df.sparkSession.createDataFrame(
        [(c, t, dist) for t, (c, dist) in taken.items()], f"cluster int, {task} {kind}, distance double"
    )


def selection_quality(df: DataFrame, chosen: DataFrame, x: str = "x", task: str = "task_id") -> DataFrame:
    """Moment discrepancy between the rows of the chosen tasks and all rows;
    -1 when nothing is chosen."""
    picked = df.join(chosen.select(task), task, "left_semi")
    if picked.limit(1).count() == 0:
        return df.sparkSession.createDataFrame([(-1.0,)], "cmd double")
    return domain.cmd(df, picked, x).select("cmd")


# ------------------------------------------------------------------- trees

def gbt(train: DataFrame, test: DataFrame, x: str, label: str, loss: str = "MSE", rounds: int = 100, seed: int = 0) -> DataFrame:
    """Test rows with ``pred`` of boosted trees.  Squared percentage error is
    squared error with weight ``1/y^2``: same gradient and curvature."""
    if loss not in ("MSE", "MSPE"):
        raise ValueError(f"unknown loss {loss!r}")
    weight = F.lit(1.0) if loss == "MSE" else F.coalesce(ratio(F.lit(1.0), F.col(label) * F.col(label)), F.lit(0.0))
    fitted = GBTRegressor(
        featuresCol="vec", labelCol=label, weightCol="__w", predictionCol="pred", maxDepth=3, maxIter=rounds,
        stepSize=0.3, seed=seed,
    ).fit(with_vector(train, x).withColumn("__w", weight))
    return fitted.transform(with_vector(test, x)).drop("vec")


def good_bad_forest(
    parts: DataFrame | Callable[[], DataFrame], x: str, id_col: str, train_share: float = 0.95, seed: int = 0
) -> DataFrame:
    """Tell best from worst rows: accuracy on the training and held-out parts.

    ``parts`` has ``part`` best or worst; the smaller class is repeated.  It may
    be a function: what that writes is deleted when the rows have been taken.
    """
    share = F.conv(F.substring(hash_order(id_col), 1, 8), 16, 10).cast("double") / 2.0**32
    taken = lambda df: df.where("part IN ('best', 'worst')").select(
        id_col, x, "part", F.when(F.col("part") == "best", 1.0).otherwise(0.0).alias("label"),
        F.when(share < train_share, "val").otherwise("test").alias("side"),
    )
    rows = materialize_last(lambda: taken(parts() if callable(parts) else parts))
    train = upsample(rows.where("side = 'val'").select(id_col, x, "label"), "label", id_col)
    train = with_vector(train, x).select("vec", "label")
    # the fit keeps its rows in memory and reads a whole partition at every step
    tasks = -(-train.count() // FOREST_ROWS)
    if tasks > train.rdd.getNumPartitions():
        train = shuffled_once(train.repartition(tasks))  # the fit and its summary make several plans of it
    model = RandomForestClassifier(featuresCol="vec", labelCol="label", predictionCol="guess", seed=seed).fit(train)
    return model.transform(with_vector(rows, x)).groupBy("side", "part").agg(
        F.avg((F.col("guess") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


# ------------------------------------------------------------- linear costs

def _solve(gram: np.ndarray, xy: np.ndarray, positive: list[bool]) -> np.ndarray:
    """Least squares from normal equations; marked coefficients stay >= 0.

    With so few features every choice of zeros can be tried: the best feasible
    solution is the constrained optimum.
    """
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    g, b = gram / np.outer(scale, scale), xy / scale
    bounded = [i for i, p in enumerate(positive) if p]
    best, best_score = np.zeros(len(b)), 0.0
    for size in range(len(bounded) + 1):
        for zeros in combinations(bounded, size):
            free = [i for i in range(len(b)) if i not in zeros]
            if not free:
                continue
            sub = np.linalg.lstsq(g[np.ix_(free, free)], b[free], rcond=1e-12)[0]
            if any(v < -1e-12 and i in bounded for i, v in zip(free, sub)):
                continue
            w = np.zeros(len(b))
            w[free] = sub
            score = w @ g @ w - 2 * w @ b
            if score < best_score - 1e-12 * max(1.0, abs(best_score)):
                best, best_score = w, score
    return best / scale


def least_squares_many(
    df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[dict[str, Column], Sequence[str]]], y: str
) -> DataFrame:
    """Several linear models per key from one scan: ``model, n, coef`` rows.

    ``specs`` maps a model name to its features and to those that must not be
    negative.  Every task reduces its rows to matrices of products per key and
    the matrices are summed by Spark, so a hot key costs no more than a rare
    one; a solve sees one small matrix per key.
    """
    keys = list(keys)
    columns: dict[str, Column] = {}  # features that models share are computed once
    layout = []
    for model, (features, positive) in specs.items():
        columns |= {str(c): c for c in features.values()}
        at = [list(columns).index(str(c)) for c in features.values()]
        layout.append((model, list(features), at, [n in positive for n in features]))
    width = len(columns) + 1
    upper = np.triu_indices(width)
    flat = [f"__{i}" for i in range(width)]
    kinds = dict(df.dtypes)
    key_schema = "".join(f"`{k}` {kinds[k]}, " for k in keys)

    def rows_of(sums: dict) -> pd.DataFrame:
        frames = []
        for key, (n, gram) in sums.items():
            part = pd.DataFrame({"i": np.arange(len(gram) + 1), "v": np.append(gram, n)})
            for name, value in zip(keys, key):
                part[name] = value
            frames.append(part[[*keys, "i", "v"]])
        return pd.concat(frames, ignore_index=True)

    def products(batches):
        sums: dict = {}
        for batch in batches:
            batch = batch[~np.isnan(batch[flat].to_numpy(dtype=float)).any(axis=1)]  # nulls arrive as NaN
            if not len(batch):
                continue
            groups = batch.groupby(keys, sort=False)
            of = groups.ngroup().fillna(-1).to_numpy().astype(int)  # rows without a key are in no group
            order = np.argsort(of, kind="stable")
            m, ends = batch[flat].to_numpy(dtype=float)[order], np.searchsorted(of[order], np.arange(groups.ngroups + 1))
            named = batch[keys].iloc[order[ends[:-1]]].itertuples(index=False, name=None)
            for key, start, end in zip(named, ends, ends[1:]):
                part = m[start:end]
                n, gram = sums.get(key, (0, 0.0))
                sums[key] = (n + len(part), gram + (part.T @ part)[upper])
            if len(sums) > MAX_OPEN_KEYS:
                yield rows_of(sums)
                sums = {}
        if sums:
            yield rows_of(sums)

    rows = df.select(*keys, *[c.cast("double").alias(n) for n, c in zip(flat, [*columns.values(), F.col(y)])])
    parts = rows.mapInPandas(products, key_schema + "i int, v double")
    gram = parts.groupBy(*keys, "i").agg(F.sum("v").alias("v")).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("__g"))

    def solve(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                values = np.asarray(r["__g"], dtype=float)
                g = np.zeros((width, width))
                g[upper] = values[:-1]
                g = g + np.triu(g, 1).T
                for model, names, at, signs in layout:
                    w = _solve(g[np.ix_(at, at)], g[at, width - 1], signs)
                    out.append([r[k] for k in keys] + [model, int(values[-1]), dict(zip(names, map(float, w)))])
            yield pd.DataFrame(out, columns=[*keys, "model", "n", "coef"])

    return gram.mapInPandas(solve, key_schema + "model string, n bigint, coef map<string,double>")


def least_squares(df: DataFrame, keys: Sequence[str], features: dict[str, Column], y: str, positive: Sequence[str] = ()) -> DataFrame:
    """Coefficients (map feature -> value) of one linear model per key."""
    return least_squares_many(df, keys, {"": (features, positive)}, y).drop("model")


def per_group_models(train: DataFrame, test: DataFrame, group: str, features: dict[str, Column], label: str) -> DataFrame:
    """One linear model per group and its error on the group's test rows, for
    any number of groups: all models come from one scan, all errors from
    another.  Test rows of a group without training rows are counted only."""
    models = least_squares(train, [group], {**features, "one": F.lit(1.0)}, label).select(group, "coef")
    scored = test.join(lookup(models), group, "left").withColumn("pred", _predict({**features, "one": F.lit(1.0)}))
    return scored.groupBy(group).agg(
        F.avg(F.when(F.col("coef").isNotNull(), ape(label, "pred"))).alias("mape"), F.count(F.lit(1)).alias("n"))


def _tile_features(steps_on: str) -> dict[str, Column]:
    c = F.col
    read = c("tile_size_in") / c("target_bw")
    comp = c("tile_flop") / (c("target_clock") * c("target_core_num"))
    write = c("tile_size_out") / c("target_bw")
    stage = {"read": read, "comp": comp, "write": write}
    stage[steps_on] = stage[steps_on] * c("pipeline_num")
    return {**stage, "steps": c("pipeline_num"), "transform": c("transform"), "one": F.lit(1.0)}


# Shifts tried inside the logarithm of method 4.
LOG_SHIFTS = [0.0, 0.01, 0.1, 1.0, 10.0, 100.0]


def cost_methods() -> dict[int, list[tuple[dict[str, Column], list[str]]]]:
    """Method id -> variants of (linear features, non-negative ones).

    1 scaled source time; 2 all facts; 3 source time times facts; 4 source time
    times the logarithm of the intensity; 5 work and size; 6-8 tile model with
    the reading, computing or writing stage repeated.
    """
    c = F.col
    x0 = c("source_time")
    facts = {"work": c("op_flops"), "size": c("size"), "transform": c("transform"), "ai": c("ai"), "perf": c("perf")}
    log = [
        ({"time": x0, "time_log": x0 * F.ln(c("ai") + s), "one": F.lit(1.0)}, ["time_log", "one"])
        for s in LOG_SHIFTS
    ]
    out = {
        1: [({"time": x0, "one": F.lit(1.0)}, ["time", "one"])],
        2: [({"time": x0, **facts}, [])],
        3: [({n: x0 * f for n, f in facts.items()}, [])],
        4: log,
        5: [({"work": c("op_flops"), "transform": c("transform"), "size": c("size"), "one": F.lit(1.0)},
             ["work", "transform", "size", "one"])],
    }
    for m, stage in ((6, "read"), (7, "comp"), (8, "write")):
        f = _tile_features(stage)
        out[m] = [(f, list(f))]
    return out


def _predict(features: dict[str, Column], coef: str | Column = "coef") -> Column:
    parts = [F.coalesce(F.element_at(coef, n), F.lit(0.0)) * f for n, f in features.items()]
    return reduce(lambda a, b: a + b, parts)


def cost_fit(train: DataFrame, test: DataFrame, key: str, y: str, methods: Sequence[int] = tuple(range(1, 9))) -> tuple[DataFrame, DataFrame]:
    """Fitted parameters (key, method, variant, coef) and the error table
    (key, method, variant, mape) on the test rows; the best variant of a method
    counts.  All models are fitted in one scan and scored in another."""
    params, every = cost_fit_all(train, test, key, y, methods)
    best = every.groupBy(key, "method").agg(
        F.min(F.struct("mape", "variant")).alias("b")
    ).select(key, "method", "b.variant", "b.mape")
    return params, best


def cost_fit_all(train: DataFrame, test: DataFrame, key: str, y: str, methods: Sequence[int] = tuple(range(1, 9))) -> tuple[DataFrame, DataFrame]:
    """As ``cost_fit``, with the errors of every variant."""
    spec = cost_methods()
    specs = {f"{m}/{v}": fp for m in methods for v, fp in enumerate(spec[m])}
    fitted = materialize(least_squares_many(train, [key], specs, y))
    part = lambda i: F.split_part("model", F.lit("/"), F.lit(i)).cast("int")
    params = fitted.select(key, part(1).alias("method"), part(2).alias("variant"), "coef")
    # One row per key: the coefficients of all its models, by place.
    models = fitted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("model", "coef"))).alias("__m"))
    at = {f: i for i, f in enumerate((name, n) for name, (features, _) in specs.items() for n in features)}
    weights = F.array(*[F.coalesce(F.element_at(F.element_at("__m", name), n), F.lit(0.0)) for name, n in at])
    scored = test.join(lookup(models.select(key, weights.alias("__w"))), key)

    def error(name: str, features: dict[str, Column]) -> Column:
        predicted = reduce(lambda a, b: a + b, [F.col("__w")[at[name, n]] * f for n, f in features.items()])
        return F.avg(F.abs(ratio(predicted - F.col(y), F.col(y)))).alias(name)

    errors = scored.groupBy(key).agg(*[error(name, features) for name, (features, _) in specs.items()])
    rows = F.array(*[
        F.struct(F.lit(int(n.split("/")[0])).alias("method"), F.lit(int(n.split("/")[1])).alias("variant"), F.col(n).alias("mape"))
        for n in specs
    ])
    return params, errors.select(key, F.inline(rows))


def fit_table(errors: DataFrame, key: str) -> DataFrame:
    """Error per key and method in columns, and the best of methods 6-8."""
    wide = errors.groupBy(key).pivot("method", list(range(1, 9))).agg(F.max("mape"))
    tile = errors.where(F.col("method").isin(6, 7, 8)).groupBy(key).agg(
        F.min(F.struct("mape", "method")).alias("b")).select(key, F.col("b.method").alias("best_method"), F.col("b.mape").alias("best_mape"))
    return wide.join(tile, key, "left")


def parameter_table(params: DataFrame, key: str, prefix: str) -> DataFrame:
    """Tile-model parameters of keys with a name prefix: a row per key, a
    column per method and parameter."""
    rows = params.where(F.col(key).startswith(prefix) & F.col("method").isin(6, 7, 8)).select(
        key, "method", F.explode("coef").alias("name", "value"))
    columns = [f"m{m}_{n}" for m in (6, 7, 8) for n in _tile_features("read")]
    label = F.concat(F.lit("m"), F.col("method").cast("string"), F.lit("_"), F.col("name"))
    return rows.withColumn("col", label).groupBy(key).pivot("col", columns).agg(F.max("value"))


# ------------------------------------------------------- sensitivity, routes

# How and how much an entry is disturbed.
NOISE_FORMS = ["+", "-", "*", "/"]
NOISE_SCALES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


def _disturbed(column: np.ndarray, form: str, scale: float) -> np.ndarray:
    if form in "+-":
        return column + (scale if form == "+" else -scale)
    return column * (1 + (scale if form == "*" else -scale))


def entry_sensitivity(
    df: DataFrame, x: str, label: str, width: int,
    predict: Callable[[np.ndarray], np.ndarray], score: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> DataFrame:
    """Change of the mean score per entry, form and scale of the disturbance.

    ``predict`` maps a matrix of rows to predictions, ``score`` predictions and
    labels to numbers (errors, or the values themselves).  Every batch is
    disturbed in place and leaves only its sums.
    """
    cases = [(f, s) for f in NOISE_FORMS for s in NOISE_SCALES]

    def sums(batches):
        for batch in batches:
            if not len(batch):
                continue
            m, y = np.stack(batch["x"].to_numpy()).astype(float), batch["y"].to_numpy(dtype=float)
            base = float(score(predict(m), y).sum())
            rows = []
            for e in range(width):
                kept = m[:, e].copy()
                for form, scale in cases:
                    m[:, e] = _disturbed(kept, form, scale)
                    rows.append((e, form, scale, float(score(predict(m), y).sum()) - base, len(y)))
                m[:, e] = kept
            yield pd.DataFrame(rows, columns=["entry", "form", "scale", "change", "n"])

    parts = df.select(F.col(x).alias("x"), F.col(label).alias("y")).mapInPandas(
        sums, "entry int, form string, scale double, change double, n bigint")
    return parts.groupBy("entry", "form", "scale").agg((F.sum("change") / F.sum("n")).alias("change"))


def entry_importance(changes: DataFrame) -> DataFrame:
    """Share of an entry in all absolute changes, averaged over the cases."""
    total = changes.groupBy("form", "scale").agg(F.sum(F.abs("change")).alias("total"))
    return changes.join(F.broadcast(total), ["form", "scale"]).groupBy("entry").agg(  # one row per case
        F.avg(ratio(F.abs("change"), F.col("total"))).alias("importance"))


def routed_score(df: DataFrame, target: Column, models: dict[str, Column], fallback: Column, valid: Column, flops: str = "flops") -> DataFrame:
    """``score = 1 / predicted time`` of the model a row is routed to.

    Invalid rows score minus infinity; rows with unknown work or without a
    route use the fallback score.
    """
    time = F.lit(None).cast("double")
    for name, predicted in models.items():
        time = F.when(F.col("target") == name, predicted).otherwise(time)
    routed = df.withColumn("target", target)
    unknown = (F.col(flops) < 0) | F.col("target").isNull()
    return routed.withColumn("score", F.when(~valid, float("-inf")).when(unknown, fallback).otherwise(ratio(F.lit(1.0), time)))


def routed_transform(df: DataFrame, target: Column, models: dict[str, Callable[[DataFrame], DataFrame]], fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As above with fitted models: one transform per route, then a union."""
    routed = df.withColumn("target", target)
    known = F.col("target").isin(list(models)) & (F.col("flops") >= 0)
    parts = [m(routed.where((F.col("target") == name) & known)) for name, m in models.items()]
    parts.append(fallback(routed.where(~F.coalesce(known, F.lit(False)))))
    return reduce(DataFrame.unionByName, parts)


# ----------------------------------------------------------------- forecast

#: Shifts b of a / (x + b) + c, as multiples of the range of x: a first grid,
#: then finer factors around the best.  Beyond the last one the curve is a
#: straight line over the data, and no limit can be read from it.
SHIFT_GRID = [0.0] + [round(10 ** (-3 + i / 4), 9) for i in range(21)]
SHIFT_STEPS = [[round(10 ** ((i - 6) / 24), 9) for i in range(13)], [round(10 ** ((i - 6) / 144), 9) for i in range(13)]]


def forecast(df: DataFrame, keys: Sequence[str], x: str, y: str, at: float | None = None, weight: float = 0.0) -> DataFrame:
    """Fit ``a/(x+b)+c`` with a, b, c >= 0 per key and give its value at ``at``
    or its limit.  With a ``weight`` the values are smoothed first, in the order
    of x (``series.ema``).  For a given b the fit is linear and comes from sums; b is
    searched on a grid that follows the range of x, then refined twice."""
    keys = list(keys)
    rows = df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    if weight:
        rows = series.ema(rows, keys, ["__x", "__y"], "__y", weight).select(*keys, "__x", F.col("ema").alias("__y"))
    rows = materialize(rows)
    spans = rows.groupBy(*keys).agg((F.max("__x") - F.min("__x")).alias("__span"))
    tried = spans.withColumn("b", F.transform(arrays.literal(SHIFT_GRID), lambda g: g * F.col("__span")))
    best = _best_curve(rows, tried, keys)
    for factors in SHIFT_STEPS:
        tried = best.withColumn("b", F.transform(arrays.literal(factors), lambda g: g * F.col("f.b")))
        best = _best_curve(rows, tried, keys)
    value = F.col("f.c") if at is None else F.col("f.a") / (F.lit(float(at)) + F.col("f.b")) + F.col("f.c")
    return best.select(*keys, "f.a", "f.b", "f.c", value.alias("forecast"))


def _best_curve(rows: DataFrame, tried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the least-squares curve among the shifts in the array ``b``."""
    shifts = lookup(tried.select(*keys, "b"))
    each = rows.join(shifts, list(keys)).withColumn("b", F.explode("b"))
    u, v = 1 / (F.col("__x") + F.col("b")), F.col("__y")
    s = each.where(F.col("__x") + F.col("b") > 0).groupBy(*keys, "b").agg(
        F.count(F.lit(1)).alias("n"), F.avg(u).alias("mu"), F.avg(v).alias("my"),
        F.var_pop(u).alias("vu"), F.covar_pop(u, v).alias("cuy"), F.var_pop(v).alias("vy"))
    n, mu, my, vu, c, vy = (F.col(k) for k in ("n", "mu", "my", "vu", "cuy", "vy"))
    free_a = F.try_divide(c, vu)
    free_c = my - free_a * mu
    through = F.greatest((c + mu * my) / (vu + mu * mu), F.lit(0.0))
    flat = free_a.isNull() | (free_a < 0)
    a = F.when(flat, 0.0).when(free_c < 0, through).otherwise(free_a)
    top = F.when(flat, F.greatest(my, F.lit(0.0))).when(free_c < 0, 0.0).otherwise(free_c)
    fitted = s.withColumn("a", a).withColumn("c", top)
    bias = F.col("my") - F.col("a") * F.col("mu") - F.col("c")
    sse = n * (vy - 2 * F.col("a") * F.col("cuy") + F.col("a") ** 2 * vu + bias * bias)
    return fitted.withColumn("sse", sse).groupBy(*keys).agg(F.min(F.struct("sse", "b", "a", "c")).alias("f"))
