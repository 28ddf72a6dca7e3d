"""SimHash near-duplicates, candidates by the pigeonring principle.

A fingerprint's 64 bits are cut into ``BUDGET + 1`` segments on a ring.  If two
fingerprints differ in at most ``BUDGET`` bits, some segment starts a chain
whose first ``l`` segments differ in at most ``floor(l * BUDGET / segments)``
bits, for every ``l``.  With a budget of 2 that is: one segment equal, the next
with at most one difference, all three with at most two.  The first two steps
become join keys (a segment, and one half of the next, as a single difference
leaves one half equal), so the rows that meet already satisfy most of the
chain; the chain test and the full distance follow.

Work is done on distinct fingerprints: copies never meet each other.  Buckets
beyond ``BUCKET`` fingerprints are not compared in pairs: two fingerprints
within two bits share a point at distance one or less, so grouping by such
points finds the same links with 65 rows for each fingerprint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfspark.llm.common import components, keep_documents, text_key, whole_text
from perfspark.runtime import materialize

#: Bits in which linked fingerprints may differ.
BUDGET = 2
#: First bit and width of the segments on the ring.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints of a bucket that are compared in pairs.
BUCKET = 64
#: Shingle hashes that are counted at once, whatever the text's length.
BLOCK = 1 << 16


def text_fingerprint(text: str) -> int:
    """SimHash over the XXH64 (seed 42) of 3-word shingles, as a signed long.
    No words give 0; fewer than three are one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width, digest = min(3, len(words)), xxhash.xxh64_intdigest
    total, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        hashes = np.fromiter(
            (digest(b" ".join(words[i:i + width]), 42) for i in range(at, min(at + BLOCK, total))), "<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return texts.map(text_fingerprint).astype("int64")


def _part(bits: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1))


def _keys() -> Column:
    """Six keys: start of the chain, its segment, and a half of the next one."""
    keys = []
    for i, (at, width) in enumerate(SEGMENTS):
        nat, nwidth = SEGMENTS[(i + 1) % len(SEGMENTS)]
        low = nwidth // 2
        for half, (hat, hwidth) in enumerate(((nat, low), (nat + low, nwidth - low))):
            head = F.lit((i * 2 + half) << 40).bitwiseOR(F.shiftleft(_part(F.col("fp"), at, width), 12))
            keys.append(F.struct(F.lit(i).alias("start"), head.bitwiseOR(_part(F.col("fp"), hat, hwidth)).alias("bucket")))
    return F.array(*keys)


def _chain(differing: Column, start: Column) -> Column:
    """Whether the chain from ``start`` keeps to its proportional budgets."""
    ok = F.lit(False)
    for i in range(len(SEGMENTS)):
        passed, total = F.lit(True), F.lit(0)
        for length in range(1, len(SEGMENTS) + 1):
            total = total + F.bit_count(_part(differing, *SEGMENTS[(i + length - 1) % len(SEGMENTS)]))
            passed = passed & (total <= length * BUDGET // len(SEGMENTS))
        ok = ok | ((start == i) & passed)
    return ok


def links(fingerprints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` whose connected components
    are those of all pairs that differ in at most ``BUDGET`` bits."""
    keyed = fingerprints.select("fp", F.explode(_keys()).alias("k")).select("fp", "k.start", "k.bucket")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(keyed.join(sizes, "bucket"))
    few = shared.where(F.col("size") <= bucket)
    left = few.select("bucket", "start", F.col("fp").alias("a"))
    right = few.select("bucket", F.col("fp").alias("b"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (
        left.join(right, "bucket")
        .where((F.col("a") < F.col("b")) & _chain(differing, F.col("start")) & (F.bit_count(differing) <= BUDGET))
        .select("a", "b")
    )
    # crowded buckets: all fingerprints around one point are linked to its least
    crowd = shared.where(F.col("size") > bucket).select("fp").distinct()
    around = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.when(i == 64, F.col("fp")).otherwise(
        F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    points = materialize(crowd.select("fp", F.explode(around).alias("point")))
    centre = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(centre, "point").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: id, key, fp, component_id, kept.

    The component id is the smallest id reachable over links (a null id comes
    last).  Null is the empty text; texts without words share fingerprint 0 and
    are linked like others.  Of a component one document is kept: that of the
    smallest id; rows that repeat id and text are one document.
    """
    rows = materialize(docs.select(
        F.col(doc_id).alias("id"), text_key(text).alias("key"), fingerprint(whole_text(text)).alias("fp"),
    ))
    rank = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")
    distinct = materialize(rows.groupBy("fp").agg(F.min(rank).alias("best")))
    roots = components(links(distinct, bucket))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "best", F.coalesce("root", "fp").alias("component"))
    first = rooted.groupBy("component").agg(F.min("best").alias("first"))
    named = rooted.join(first, "component").select("fp", "first")
    return rows.join(named, "fp").select(
        "id", "key", "fp", F.col("first.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))).alias("kept"),
    )


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component; columns unchanged."""
    return keep_documents(docs, groups(docs, doc_id, text, **options).where("kept"), doc_id, text)
