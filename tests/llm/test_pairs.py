import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfspark.llm import hard_negatives, jaccard_join
from tests.llm.conftest import TEXTS


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def components(texts):
    """Smallest id reachable over links, by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(seed):
    """Groups of near copies of 1 to 60 words, some around the threshold."""
    rng, texts = random.Random(seed), []
    for g in range(30):
        size = rng.choice([1, 3, 5, 6, 7, 9, 12, 15, 18, 20, 30, 60])
        base = [f"w{rng.randrange(40)}" for _ in range(size)]
        for _ in range(rng.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(words) + 1)
                words[at:at + rng.randint(0, 1)] = [f"w{rng.randrange(40)}"] * rng.randint(0, 1)
            texts.append((len(texts), rng.choice([" ", "  ", "\n"]).join(words)))
    return texts


@pytest.mark.parametrize("boundary, rounds, chunk", [(None, 3, 64), (0, 0, 2), (16, 1, 3), (9, 2, 64)])
def test_components_are_those_of_all_pairs(spark, boundary, rounds, chunk):
    texts = variants(boundary or 5)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = jaccard_join.joined(docs, boundary=boundary, rounds=rounds, chunk=chunk).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(texts)
    assert len(got) == len(texts)


def test_odd_rows(odd, nothing):
    got = jaccard_join.joined(odd).collect()
    assert len(got) == len(TEXTS) and jaccard_join.joined(nothing).count() == 0
    want = components([(i, t) for i, t in TEXTS if i is not None])
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got if r["id"] is not None} == want
    assert all(r["component_id"] is None for r in got if r["id"] is None)


def test_overlap_is_least():
    for s in range(1, 60):
        for t in jaccard_join.partners(s):
            o = jaccard_join.overlap(s, t)
            assert 100 * o >= 80 * (s + t - o) and not 100 * (o - 1) >= 80 * (s + t - o + 1)
            assert max(s, t) - o < jaccard_join.prefix(max(s, t)) and min(s, t) - o < jaccard_join.prefix(min(s, t))


def brute(rows, every=50):
    """The contract of the query, by loops."""
    out = []
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    for a in rows:
        if a[0] is None or a[0] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], c[2])), c) for c in rows if c != a]
        scored.sort(key=lambda x: (-x[0], x[1][0] is None, x[1][0] or 0))
        for p, pos in [x for x in scored if x[1][1] == a[1]][:5]:
            fits = [x for x in scored if x[1][1] != a[1] and 50 * p <= 100 * x[0] <= 95 * p][:3]
            out += [(a[0], pos[0], k + 1, n[0], p, s) for k, (s, n) in enumerate(fits)]
    return out


@pytest.mark.parametrize("scale, dims", [(20, 6), (3, 2), (1 << 30, 4)])
def test_hard_negatives(spark, scale, dims, monkeypatch):
    """Ties, negative scores, and sums that doubles do not hold."""
    rng = np.random.default_rng(dims)
    centres = rng.integers(-scale, scale, (5, dims))
    rows = []
    for i in range(700):
        c = int(rng.integers(5))
        v = [int(x) for x in centres[c] + rng.integers(-scale // 3 - 1, scale // 3 + 2, dims)]
        rows.append((i, int(c) if rng.random() < 0.8 else int(rng.integers(5)), v))
    rows += [rows[50], rows[3], (None, 1, rows[0][2])]
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 100)
    docs = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    got = hard_negatives.mined(docs, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert len(got) > 20


def test_bounds_spare_scores():
    """Along the tree, candidates out of reach are not scored."""
    rng = np.random.default_rng(1)
    anchors = (rng.normal(size=(1, 64)) * 100 + rng.normal(size=(50, 64)) * 3).astype(np.int64)
    rows = (rng.normal(size=(2000, 64)) * 100).astype(np.int64)
    order, parent, edge = hard_negatives.spanning_tree(anchors.astype(float))
    assert sorted(order) == list(range(50)) and (parent >= 0).sum() == 49
    high = int(np.percentile(rows @ anchors[0], 99.5))
    block = hard_negatives.Block(0, np.arange(50), np.zeros(50, int), anchors, order, parent, edge,
                                 [[(high, 1 << 50)] for _ in range(50)], False, 3)
    assert block.meet(np.arange(2000), np.ones(2000, int), rows) < 0.3 * 50 * 2000
    for i in range(50):
        scores = rows @ anchors[i]
        want = sorted(((-s, k) for k, s in enumerate(scores) if s >= high))[:3]
        assert [(-s, k) for s, k in zip(block.found[i][0].scores, block.found[i][0].ids)] == want


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, -0.5]), (1, 1, [0.5, None]), (2, 1, [nan, 1.0]), (3, 2, [inf, 1.0]), (4, 2, None), (5, None, [1.0, 1.0]),
            (6, 1, []), (7, 1, [0.001, -0.001])]
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    kept = docs.where(hard_negatives.usable(F.col("embedding"))).select("vec_id", hard_negatives.quantised(F.col("embedding")).alias("v"))
    assert {r[0]: r[1] for r in kept.collect()} == {0: [128, -128], 5: [256, 256], 6: [], 7: [0, -1]}
    none = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert hard_negatives.mined(none, F.col("vec_id") % 50 == 0).count() == 0
