import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from perfspark.llm import common, exact_dedup, near_dup
from tests.llm.conftest import TEXTS, squeezed


def test_exact_groups(odd):
    got = exact_dedup.groups(odd).collect()
    assert len(got) == len(TEXTS)
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(hashlib.sha256(squeezed(t).encode()).hexdigest(), []).append((-len(t or ""), i is None, i or 0))
    for digest, members in groups.items():
        rows = [r for r in got if r["digest"] == digest]
        least = min(members)
        assert len(rows) == len(members) and all(r["group_size"] == len(members) for r in rows)
        assert all(r["keep_id"] == (None if least[1] else least[2]) for r in rows)
        assert sum(r["kept"] for r in rows) == 1


@pytest.mark.parametrize("rows", [1, 3000])
def test_frequent_digests_are_decided_apart(spark, rows):
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(
        F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.groups(docs, tracked=64, heavy=8)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("kept").count() == rows - (rows + 2) // 3 + 1
    assert {r["group_size"] for r in got.where("id % 3 = 0").collect()} == {(rows + 2) // 3}


def test_exact_keeps_columns_and_one_row(odd, nothing):
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({squeezed(t) for _, t in TEXTS})
    assert exact_dedup.groups(nothing).count() == 0 and exact_dedup.deduplicated(nothing).count() == 0


def simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    """Component of every value, by comparing all pairs."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = list(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= near_dup.BUDGET:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_fingerprints(odd, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 1000)  # a long text takes several blocks
    for _, text in TEXTS:
        assert near_dup.text_fingerprint(text or "") & (1 << 64) - 1 == simhash(text)
    got = {r[0]: r[1] for r in near_dup.groups(odd).select("id", near_dup.fingerprint_hex()).collect()}
    assert all(got[i] == f"{simhash(t):016x}" for i, t in TEXTS if i is not None)


@pytest.mark.parametrize("bucket", [64, 1])
def test_links_find_the_components_of_all_pairs(spark, bucket):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 30])):
            near = centre
            for _ in range(rng.randint(0, 5)):
                near ^= 1 << rng.randrange(64)
            values.add(near)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    want = roots(values)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in common.components(near_dup.links(frame, bucket)).collect()}
    classes = {}
    for v in values:
        classes.setdefault(want[v], set()).add(got.get(signed(v), signed(v)))
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set().union(*classes.values()))


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.createDataFrame([((i * 7919) % n, ((i + 1) * 7919) % n) for i in range(n - 1)], "a long, b long")
    got = common.components(edges).collect()
    assert len(got) == n and {r["root"] for r in got} == {0}
    assert common.components(edges.where("a < 0")).count() == 0


def test_near_groups(odd, nothing):
    got = near_dup.groups(odd).collect()
    assert len(got) == len(TEXTS)
    want = roots({simhash(t) for _, t in TEXTS})
    for r in got:
        same = [i for i, t in TEXTS if want[simhash(t)] == want[r["fp"] & (1 << 64) - 1]]
        named = [i for i in same if i is not None]
        assert r["component_id"] == (min(named) if named else None)
    kept = near_dup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(want.values()))
    assert near_dup.groups(nothing).count() == 0 and near_dup.deduplicated(nothing).count() == 0
