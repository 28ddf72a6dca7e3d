"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of 13 consecutive words (an item of fewer
words is one window); a window is the set of its 5-word shingles.  A document
that holds the window holds all its shingles, so one of them, the rarest in the
documents, is prefix enough: only where it occurs is the window compared, after
bounds on its start and length, with the words that stand there.

The texts are split once.  A small bit table of all benchmark shingles picks
the documents and positions that can matter; false ones only cost a
comparison.  Nothing but those positions, with the words around them, is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfspark.llm.common import ascii_lower, keep_documents, text_key, whole_text
from perfspark.runtime import lookup, materialize

WINDOW = 13
SHINGLE = 5
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Bits of the table per shingle, and its largest size (1 MB).  A fuller table
#: only lets more positions through to the join.
BITS, MOST_BITS = 64, 1 << 23

DELIMITERS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lowered."""
    return F.array_remove(F.split(ascii_lower(text), DELIMITERS), "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, at + F.lit(k)) for k in range(width)])


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all shingles of one width, in order."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _shingle(words, i, width))).otherwise(
        F.array().cast("array<bigint>"))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: words, length, width (of its shingles), items.  An
    item without words has none; a null id is the empty one."""
    split = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                         words_of(whole_text(text)).alias("words"))
    last = F.greatest(F.size("words") - window, F.lit(0))
    cut = split.where(F.size("words") > 0).select("item", F.explode(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, window))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(
        "words", "items", F.size("words").alias("length"), F.least(F.size("words"), F.lit(SHINGLE)).alias("width"))


def _elements(table: DataFrame, widths: list[int]) -> DataFrame:
    """Shingles of every window: window columns, offset, hash."""
    hashes = F.lit(None).cast("array<bigint>")
    for width in widths:
        hashes = F.when(F.col("width") == width, _shingles(F.col("words"), width)).otherwise(hashes)
    return table.select("*", F.posexplode(hashes).alias("offset", "hash"))


def _probe(hash_: Column, probe: int, bits: int) -> Column:
    return F.shiftrightunsigned(hash_, 20 * probe).bitwiseAND(F.lit(bits - 1))


def _bit_table(hashes: DataFrame, probe: int, bits: int) -> DataFrame:
    """One row: the bits of one probe as an array of longs."""
    at = _probe(F.col("hash"), probe, bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    filled = hashes.groupBy(F.shiftrightunsigned(at, 6).alias("slot")).agg(F.bit_or(one).alias("bits"))
    slots = hashes.sparkSession.range(bits // 64).select(F.col("id").alias("slot"))
    dense = slots.join(filled, "slot", "left").select("slot", F.coalesce("bits", F.lit(0)).alias("bits"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("slot", "bits"))).alias("t")).select("t.bits")


def _is_set(table: Column, hashes: Column, probe: int, bits: int):
    """Position -> whether the bit of its hash is set."""

    def test(i: Column) -> Column:
        at = _probe(F.get(hashes, i), probe, bits)
        slot = F.get(table, F.shiftrightunsigned(at, 6).cast("int"))
        return F.getbit(slot, at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def _place(hashes: Column):
    return lambda i: F.struct(i.alias("pos"), F.get(hashes, i).alias("hash"))


def _scan(docs: DataFrame, doc_id: str, text: str, elements: DataFrame | None, widths: list[int]) -> DataFrame:
    """One row per document: row, id, key, n_words, and where benchmark
    shingles may stand: found (position, hash), with the words if any."""
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"),
                        text_key(text).alias("key"), words_of(whole_text(text)).alias("words"))
    places = []
    if elements is not None:
        hashes = elements.select("hash").distinct()
        bits = 1 << 16
        while bits < BITS * hashes.count() and bits < MOST_BITS:
            bits *= 2
        tables = [_bit_table(hashes, probe, bits).scalar() for probe in range(3)]
        for width in widths:
            hashed = f"h{width}"
            split = split.withColumn(hashed, _shingles(F.col("words"), width))
            found = F.sequence(F.lit(0), F.size(hashed) - 1)
            for probe, table in enumerate(tables):
                # a column of its own, as a lambda may not hold a subquery
                split = split.withColumn(f"t{width}_{probe}", table)
                found = F.filter(found, _is_set(F.col(f"t{width}_{probe}"), F.col(hashed), probe, bits))
            found = F.transform(found, _place(F.col(hashed)))
            places.append(F.when(F.size(hashed) > 0, found).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>")))
    found = F.concat(*places) if places else F.array().cast("array<struct<pos:int,hash:bigint>>")
    read = split.select("row", "id", "key", F.size("words").alias("n_words"), "words", found.alias("found"))
    return materialize(read.withColumn("words", F.when(F.size("found") > 0, F.col("words"))))


def scores(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, key, n_words, n_hit (words inside any
    occurrence of a window), items (ids, as strings, sorted), contaminated.

    Null is the empty text, which has no words and no hits.  Repeated rows each
    give a row; no items give no hits.
    """
    table = materialize(windows(items, item_id, item_text, window))
    widths = sorted(r["width"] for r in table.select("width").distinct().collect())
    elements = materialize(_elements(table, widths)) if widths else None
    scanned = _scan(docs, doc_id, text, elements, widths)
    none = scanned.where(F.size("found") == 0).select(
        "id", "key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    if elements is None:
        return _judged(none)
    some = scanned.where(F.size("found") > 0)

    # rarity over all documents decides which shingle stands for a window
    seen = some.select(F.explode("found.hash").alias("hash")).groupBy("hash").agg(F.count("*").alias("seen"))
    ranked = elements.join(seen, "hash", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)), "hash", "offset")).alias("rarest"),
        F.first("items").alias("items"), F.first("length").alias("length"))
    prefix = lookup(ranked.select("rarest.hash", "rarest.offset", F.col("words").alias("window"), "items", "length"))

    reach = window - 1
    around = F.explode(F.transform("found", lambda f: F.struct(
        f["pos"].alias("pos"), f["hash"].alias("hash"), F.least(f["pos"], F.lit(reach)).alias("at"),
        F.slice("words", F.greatest(f["pos"] - reach, F.lit(0)) + 1, 2 * reach + 1).alias("near"))))
    start = F.col("f.pos") - F.col("offset")
    there = F.slice("f.near", F.col("f.at") - F.col("offset") + 1, F.col("length"))
    placed = some.select("row", "n_words", around.alias("f")).join(prefix, F.col("f.hash") == F.col("hash"))
    bounded = placed.where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    matches = bounded.where(there == F.col("window")).select("row", start.alias("start"), "length", "items")
    merged = matches.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(
        (a["hit"] + F.greatest(s["start"] + s["length"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("hit"),
        F.greatest(a["end"], s["start"] + s["length"]).alias("end")))["hit"]
    hit = some.select("row", "id", "key", "n_words").join(merged, "row", "left").select(
        "id", "key", "n_words", F.coalesce(covered, F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return _judged(hit.unionByName(none))


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_words", F.col("n_words").cast("long")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones; columns unchanged, repeated rows
    of a document once."""
    return keep_documents(docs, scores(docs, items, doc_id, text, **options).where("NOT contaminated"), doc_id, text)
