"""Hard negatives of anchor vectors, bounded along a spanning tree of anchors.

Anchors are packed into blocks of similar ones, candidates into blocks of rows;
every block of anchors meets every block of candidates once, a stated query set
against all rows.  In a block the anchors are the nodes of a minimum spanning
tree.  The scores of the root are reckoned; for a child, the score of every
candidate lies within the parent's score (or what bounds it), plus or minus the
length of the edge times the candidate's norm.  Only candidates whose bounds
reach into the child's window are scored again, and these have exact scores for
the children below.  A window narrows as better candidates are found, so a task
keeps what it has found of a block of anchors while it reads on.

Scores are integer inner products.  They are exact: as doubles where the norms
prove that no sum leaves 2^52, else as Python integers (a score beyond a long is
returned as the nearest long).

Defined cases: rows without label or vector, or with a null or non-finite
component, take no part; rows that repeat id, label and vector count once; a
null id is no anchor and comes last among ties; a shorter vector has zeros
behind it; ties go to the smaller id; an anchor without positives, or a positive
without negatives in its window, has no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perfspark.runtime import materialize, small_side

#: Anchors of a block, at most.
ANCHORS = 512
#: Candidates of a block, at most.
CANDIDATES = 4096
#: Blocks of anchors whose findings a task holds before it hands them on.
HELD = 32
#: Largest product of norms whose scores are exact as doubles.
EXACT = float(1 << 52)
NO_ID = np.iinfo(np.int64).max
FAR = np.iinfo(np.int64).max


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a double, as a long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def _matrix(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Rows of a list column as one matrix, shorter ones filled with zeros."""
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat[offsets[0]:offsets[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat[offsets[0]:offsets[-1]]
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parent and edge length of a minimum spanning tree (Prim); a node
    comes after its parent, the root has parent -1."""
    n = len(vectors)
    parent, edge, order = np.full(n, -1), np.zeros(n), np.empty(n, np.int64)
    nearest, via = np.full(n, np.inf), np.full(n, -1)
    free, at = np.ones(n, bool), 0
    for k in range(n):
        order[k] = at
        free[at] = False
        parent[at], edge[at] = via[at], 0.0 if via[at] < 0 else nearest[at]
        length = np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1))
        closer = free & (length < nearest)
        nearest[closer], via[closer] = length[closer], at
        if k + 1 < n:
            at = int(np.where(free, nearest, np.inf).argmin())
            if not free[at]:  # all that is left is infinitely far
                at = int(np.flatnonzero(free)[0])
                via[at] = order[k]
    return order, parent, edge


def exact_scores(rows: np.ndarray, vector: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products as longs."""
    if safe:
        return (rows @ vector).astype(np.int64)
    whole, found = [int(x) for x in vector], []
    for row in rows:
        score = sum(int(a) * b for a, b in zip(row, whole))
        found.append(min(max(score, -FAR), FAR))
    return np.array(found, np.int64)


class Best:
    """The ``k`` best of what was seen: higher scores, then smaller ids."""

    __slots__ = ("k", "ids", "scores")

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        """Scores below can't enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else -FAR

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.append(self.ids, ids), np.append(self.scores, scores)
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[order], scores[order]


class Block:
    """A block of anchors with its tree, and what was found for it so far.

    ``windows[i]`` lists the wanted score ranges of anchor i; ``same`` tells
    whether candidates have the anchor's label or another one.
    """

    def __init__(self, number: int, ids, labels, vectors, order, parent, edge, windows, same: bool, k: int):
        self.number, self.ids, self.labels, self.vectors = number, ids, labels, vectors
        self.order, self.parent, self.edge = order, parent, edge
        self.windows, self.same = windows, same
        self.found = [[Best(k) for _ in w] for w in windows]
        self.norm = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        left = np.zeros(len(ids), np.int64)
        for p in parent:
            if p >= 0:
                left[p] += 1
        self.children = left

    def window(self, i: int) -> tuple[int, int]:
        """Scores that can still enter what anchor ``i`` looks for."""
        if not self.windows[i]:
            return FAR, -FAR
        return (min(max(low, best.floor) for (low, _), best in zip(self.windows[i], self.found[i])),
                max(high for _, high in self.windows[i]))

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> int:
        """Search one block of candidates; returns how many were scored."""
        width = max(vectors.shape[1], self.vectors.shape[1])
        fill = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        vectors, anchors = fill(vectors), fill(self.vectors)
        wide = vectors.astype(np.float64)
        norms = np.sqrt((wide ** 2).sum(axis=1))
        safe = self.norm * float(norms.max(initial=0)) < EXACT
        own = anchors.astype(np.float64) if safe else anchors
        rows = wide if safe else vectors
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        children, scored = self.children.copy(), 0
        for i in self.order:
            low, high = self.window(i)
            wanted = (labels == self.labels[i]) if self.same else (labels != self.labels[i])
            p = int(self.parent[i])
            if p < 0 or not safe:
                least = most = exact_scores(rows, own[i], safe).astype(np.float64 if safe else object)
                scored += len(rows)
                inside = np.flatnonzero(wanted & (most >= low) & (least <= high))
                scores = least[inside].astype(np.int64)
            else:
                reach = norms * (self.edge[i] * (1 + 1e-9)) + 1
                least, most = bounds[p][0] - reach, bounds[p][1] + reach
                open_ = np.flatnonzero(wanted & (most >= low) & (least <= high))
                scores = exact_scores(rows[open_], own[i], safe)
                scored += len(open_)
                least[open_] = most[open_] = scores
                at = (scores >= low) & (scores <= high)
                inside, scores = open_[at], scores[at]
            if len(inside):
                other = ~((ids[inside] == self.ids[i]) & (vectors[inside] == anchors[i]).all(axis=1)) if self.same else slice(None)
                inside, scores = inside[other], scores[other]
                for (lo, hi), best in zip(self.windows[i], self.found[i]):
                    fits = (scores >= max(lo, best.floor)) & (scores <= hi)
                    if fits.any():
                        best.add(ids[inside[fits]], scores[fits])
            if safe:
                if children[i]:
                    bounds[int(i)] = least, most
                if p >= 0:
                    children[p] -= 1
                    if not children[p]:
                        del bounds[p]
        return scored

    def rows(self):
        """(anchor number, window number, score, id) of all that was found."""
        for i, bests in enumerate(self.found):
            for w, best in enumerate(bests):
                for score, vec in zip(best.scores, best.ids):
                    yield self.number * ANCHORS + i, w, int(score), None if vec == NO_ID else int(vec)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _ids(column) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(rows: DataFrame, size: int, tree: bool) -> DataFrame:
    """Blocks of at most ``size`` rows of each partition: block, ids, labels,
    width, flat (all components), and the tree of the block."""
    names = ["block", "ids", "labels", "width", "flat"] + (["tree_order", "tree_parent", "tree_edge"] if tree else [])

    def made(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def block(table, n):
            table = table.combine_chunks()
            matrix = _matrix(*_lists(table["v"].chunk(0)))
            wide = lambda a, t: pa.array([a], pa.list_(t))
            columns = [pa.array([n], pa.int64()), wide(_ids(table["id"].chunk(0)), pa.int64()),
                       wide(table["label"].chunk(0).to_numpy().astype(np.int64), pa.int64()),
                       pa.array([matrix.shape[1]], pa.int64()), wide(matrix.reshape(-1), pa.int64())]
            if tree:
                order, parent, edge = spanning_tree(matrix.astype(np.float64))
                columns += [wide(order, pa.int64()), wide(parent, pa.int64()), wide(edge, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == size:
                    yield block(pa.Table.from_batches(held), number)
                    held, count, number = [], 0, number + 1
        if count:
            yield block(pa.Table.from_batches(held), number)

    schema = "block long, ids array<long>, labels array<long>, width long, flat array<long>"
    return rows.mapInArrow(made, schema + (", tree_order array<long>, tree_parent array<long>, tree_edge array<double>" if tree else ""))


FOUND = "anchor long, window int, score long, id long"


def _searched(candidates: DataFrame, anchors: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """What every pair of blocks yields; ``anchors`` has the blocks' windows
    (numbers of anchors, least and greatest scores)."""
    def searched(batches):
        import pyarrow as pa

        held: dict[int, Block] = {}

        def out():
            rows = [r for b in held.values() for r in b.rows()]
            held.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["anchor", "window", "score", "id"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(j)[at] for j, name in enumerate(batch.schema.names)}
                listed = lambda name: row[name].values.to_numpy(zero_copy_only=False)  # noqa: B023,E731
                number = row["block"].as_py()
                block = held.get(number)
                if block is None:
                    if len(held) >= HELD:
                        yield out()
                    ids = listed("ids")
                    windows = [[] for _ in ids]
                    for who, low, high in zip(listed("who"), listed("low"), listed("high")):
                        windows[who].append((int(low), int(high)))
                    block = held[number] = Block(
                        number, ids, listed("labels"), listed("flat").reshape(len(ids), row["width"].as_py()),
                        listed("tree_order"), listed("tree_parent"), listed("tree_edge"), windows, same, k)
                ids = listed("c_ids")
                block.meet(ids, listed("c_labels"), listed("c_flat").reshape(len(ids), row["c_width"].as_py()))
        if held:
            yield out()

    dealt = candidates.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1).cast("long"))).alias("block"),
        *[F.col(c).alias("c_" + c) for c in ("ids", "labels", "width", "flat")])
    joined = dealt.join(small_side(anchors, max_rows=64), "block")
    found = joined.mapInArrow(searched, FOUND)
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "vector", label: str = "label",
          positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of all anchors: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    ``vector`` holds integers (``quantised``); ``anchor`` tells which rows are
    anchors.  The positives of an anchor are the ``positives`` best other rows
    of its label; of each, the ``negatives`` best rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"),
                       (F.coalesce(anchor, F.lit(False)) & F.col(vec_id).isNotNull()).alias("anchor"))
    base = materialize(base.where(F.col("label").isNotNull() & F.col("v").isNotNull()).distinct())
    chosen = base.where("anchor").drop("anchor")
    count = chosen.count()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # similar anchors share a block as far as their labels tell
    wanted = -(-count // max(ANCHORS // 2, 1))
    packed = materialize(_packed(chosen.repartitionByRange(wanted, "label", "id"), ANCHORS, True))
    numbers = Window.orderBy("block")  # one row per block of hundreds of anchors
    small = packed.select("block", F.row_number().over(numbers).cast("long").alias("n"))
    packed = materialize(packed.join(small_side(small), "block").drop("block").withColumn("block", F.col("n") - 1).drop("n"))
    blocks = packed.count()
    candidates = materialize(_packed(base.drop("anchor"), CANDIDATES, False))

    everyone = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: i.cast("long"))
    free = packed.withColumns({
        "who": everyone, "low": F.transform("ids", lambda _: F.lit(-FAR).cast("long")),
        "high": F.transform("ids", lambda _: F.lit(FAR).cast("long"))})
    near = materialize(_searched(candidates, free, blocks, True, positives).select(
        "anchor", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # windows in whole numbers: low * p <= 100 * n <= high * p
    score = F.col("positive_score").cast("decimal(38,0)")
    least = F.ceil(score * low / F.lit(100).cast("decimal(3,0)")).cast("long")
    greatest = F.floor(score * high / F.lit(100).cast("decimal(3,0)")).cast("long")
    window = F.struct("anchor", "p", least.alias("low"), greatest.alias("high"))
    # at most ``positives`` windows for each of a block's anchors
    windows = near.groupBy(F.floor(F.col("anchor") / ANCHORS).alias("block")).agg(F.sort_array(F.collect_list(window)).alias("w"))
    aimed = packed.join(windows, "block").select(
        "*", F.transform("w", lambda w: w["anchor"] % ANCHORS).alias("who"),
        F.col("w.low").alias("low"), F.col("w.high").alias("high")).drop("w")
    far = _searched(candidates, materialize(aimed), blocks, False, negatives)
    names = packed.select(F.posexplode("ids").alias("i", "anchor_id"), "block").select(
        (F.col("block") * ANCHORS + F.col("i")).alias("anchor"), "anchor_id")
    return (
        far.withColumn("p", F.col("window") + 1).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
        .join(near, ["anchor", "p"]).join(names, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
