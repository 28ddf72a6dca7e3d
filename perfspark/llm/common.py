"""Expressions and table helpers that several text operators share."""

from __future__ import annotations

import gc

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perfspark.runtime import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession, value) -> Broadcast:
    """Broadcast a model or a tool by value: tasks need no copy of this package."""
    return spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})


def shipped(box: Broadcast):
    """What ``ship`` was given; a task process unpacks it once and keeps it.
    What it kept of earlier jobs may hold itself in cycles and goes first."""
    content = box.value
    if "value" not in content:
        gc.collect()
        content["value"] = cloudpickle.loads(content.pop("packed"))
    return content["value"]


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.  ``lower`` does the
    same for texts of ASCII only, at a fraction of the cost."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: str = "text") -> Column:
    """With the id, the name of a document: rows that repeat both are one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def keep_documents(docs: DataFrame, kept: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` named by ``kept(id, key)``, each once.

    Both sides are named by the id's text, whether it is null, and the key.
    The join and the numbering that drops repeated rows share these columns, so
    the texts are shuffled once.
    """
    name = lambda i, k: [F.coalesce(i.cast("string"), F.lit("")).alias("__id"), i.isNull().alias("__null"), k.alias("__key")]
    named = kept.select(*name(F.col("id"), F.col("key"))).distinct()
    columns = ["__id", "__null", "__key"]
    joined = docs.select("*", *name(F.col(doc_id), text_key(text))).join(named, columns, "left_semi")
    repeats = Window.partitionBy(*columns).orderBy(F.lit(0))
    return joined.withColumn("__n", F.row_number().over(repeats)).where("__n = 1").select(*docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, root) per node
    that has a link; the root is the smallest node of its component.

    Alternating star contraction: every round links the larger neighbours of a
    node, then its smaller ones, to the smallest.  Minima are aggregated before
    they meet the edges again, so a node with very many links is never
    gathered.  Each round is written, which bounds lineage and survives lost
    executors; only a count and a checksum reach the driver.
    """
    a, b = F.col("a"), F.col("b")
    current = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = current.select(b.alias("a"), a.alias("b")).join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        # the node itself is linked to its minimum as well
        large = large.unionByName(low.select("a", F.col("m").alias("b"))).where(a != b).distinct()
        large = materialize(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where(a != b).distinct()
        current = materialize(small)
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(a.alias("node"), b.alias("root"))
    return roots.unionByName(current.select(b.alias("node"), b.alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
