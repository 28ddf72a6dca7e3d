"""Exact duplicates with a heavy-hitter split.

Texts are compared by the SHA-256 of the text without white space.  A
Misra-Gries summary (Spark's mergeable frequent-items sketch) names the digests
that may be frequent; an exact count verifies them, and the rows that stay for
them are broadcast, so that the rows of large groups are decided where they
are.  All other digests are grouped by an ordinary shuffle in which no key is
frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfspark.llm.common import keep_documents, text_key, whole_text
from perfspark.runtime import materialize

#: Counters of the summary.  Its counts err by at most 3.5 / TRACKED of the
#: rows, so a digest with more than twice that share is always named.  The rest
#: is decided by the shuffle, whatever the summary says.
TRACKED = 1024
#: Candidates taken from the summary, and so the most rows ever broadcast.
HEAVY = 512


def normal_digest(text: Column) -> Column:
    """SHA-256, in lower-case hex, of the text without ``[\\x20\\x09-\\x0D]``."""
    return F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""), 256)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tracked: int = TRACKED,
           heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: id, key, digest, group_size, keep_id, kept.

    Of equal texts the row with most code points stays, then the smallest id;
    a null id comes last.  Null is the empty text.  Rows that repeat id and
    text are ties: exactly one of them is kept.  An empty table gives no rows.
    """
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("id"), text_key(text).alias("key"), normal_digest(whole_text(text)).alias("digest"),
            F.char_length(whole_text(text)).alias("n"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    rank = F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("unnamed"), "id", "row")
    best = [F.count("*").alias("group_size"), F.min(rank).alias("best")]
    seen = rows.agg(F.expr(f"approx_top_k(digest, {int(heavy)}, {int(tracked)})").alias("top"))
    frequent = seen.select(F.explode("top").alias("c")).select(F.col("c.item").alias("digest")).where("digest IS NOT NULL")
    # at most `heavy` rows of a digest, a size and a row name
    winners = materialize(rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*best))
    large = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    others = rest.join(rest.groupBy("digest").agg(*best), "digest")
    return large.unionByName(others).select(
        "id", "key", "digest", "group_size", F.col("best.id").alias("keep_id"),
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns unchanged."""
    return keep_documents(docs, groups(docs, doc_id, text, **options).where("kept"), doc_id, text)
