"""Similarity join of texts by the Jaccard similarity of their word shingles:
subsets for light sets, inverted lists for heavy ones.

Two sets of sizes s and t are linked when they share at least ``overlap(s, t)``
shingles.  A light set writes down all its subsets of the size that it must
share with a set of each possible size; equal subsets are a proof of the link,
so the sets of one subset are linked to the least of them, without pairs.  Heavy
sets are found by inverted lists: shingles are ordered by rarity, and linked sets
share one of their rarest ``prefix(s)`` shingles.  The boundary between light and
heavy is the size with the least cost: subsets written against list entries read.

Lists are read in rounds.  In a round every list compares its members with a few
leaders, and only with members of other components.  What is left after the
rounds are pairs of different components; they meet in chunks of lists, a long
list spread over many.  A pair must pass bounds on its sizes, its places in the
list, and the parities of its elements in 512 buckets: in each bucket where these
differ lies an element that is not shared.  Then it is checked against its whole sets.  So members
of a large group of near copies meet their leaders, not each other, and all
links between components are found.

Rarity comes from a sketch of counts over all shingles of all texts; it sets an
order that all tasks share, its errors only cost time.  Shingles are 64-bit
hashes; equal sets are one set from the start.

Defined cases: null, empty and blank texts have no shingles and no links; fewer
words than ``width`` are one shingle; every row is a document, repeated or not;
null ids come last and stand for a component only if it has no other id.
"""

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfspark.llm.common import components, ship, shipped, text_key, whole_text
from perfspark.runtime import lookup, materialize

WIDTH = 5
PERCENT = 80
#: Largest size of a set that may count as light.
LIGHT = 16
#: Rounds of leaders before the pairs of different components meet.
ROUNDS = 1
#: Leaders of a list in a round.
LEADERS = 8
#: Members of a list that meet in one chunk.
CHUNK = 64
#: Bits of the buckets of the count sketch, and its rows as tasks hand them on.
SKETCH_BITS, SKETCH_ROWS = 22, 256
#: 64-bit words of the parities that a set is sketched by.
PARITIES = 8
#: Shingles that are counted at once.
TOGETHER = 1 << 20
#: Fixed odd factors of the shingle hash.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
           0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


PARITY = [f"odd{i}" for i in range(PARITIES)]


def overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """Least number of shared elements of linked sets of these sizes."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int = PERCENT) -> range:
    """Sizes of sets that can be linked with one of size ``s``."""
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def prefix(s: int, percent: int = PERCENT) -> int:
    """Rarest elements of which linked sets share one."""
    return s - -(-percent * s // 100) + 1


def subsets(s: int, boundary: int, percent: int = PERCENT) -> int:
    """Subsets that a light set of size ``s`` writes down."""
    return sum(comb(s, overlap(s, t, percent)) for t in partners(s, percent) if t <= boundary)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes of a text, in order."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size * FACTORS[-1] & (1 << 64) - 1, np.uint64)
    for i in range(size):
        mixed += hashes[i:i + n] * np.uint64(FACTORS[i % 7]) ^ np.uint64(i // 7)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(FACTORS[3])
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def rarity(docs: DataFrame, text: str = "text", width: int = WIDTH) -> np.ndarray:
    """Counts of all shingles of all texts in buckets of their hashes: a table
    of fixed size, whatever the data."""
    share = (1 << SKETCH_BITS) // SKETCH_ROWS

    def counted(batches):
        total, held, size = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(shingles(value.as_py(), width))
                size += len(held[-1])
                if size >= TOGETHER:
                    total += np.bincount(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), minlength=len(total))
                    held, size = [], 0
        if size:
            total += np.bincount(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SKETCH_ROWS), pa.int32()), pa.array([r.astype("<u2").tobytes() for r in np.minimum(total, 65535).reshape(-1, share)])],
                names=["place", "counts"])

    def summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(share, np.int64)
        for batch in batches:
            for value in batch.column("counts"):
                total += np.frombuffer(value.as_buffer(), "<u2")
        total = np.minimum(total, (1 << 32) - 1).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], names=["place", "counts"])

    schema = "place int, counts binary"
    parts = docs.select(whole_text(text).alias("text")).mapInArrow(counted, schema)
    rows = {r["place"]: r["counts"] for r in parts.groupBy("place").applyInArrow(summed, schema).collect()}
    empty = bytes(4 * share)
    return np.frombuffer(b"".join(rows.get(i, empty) for i in range(SKETCH_ROWS)), "<u4")


def _hashed(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, sketch=None) -> DataFrame:
    """Every document with the size and digest of its set and, of its shingles
    by rarity, the prefix (of sets that may be light: all), and the parities of
    all its shingles by buckets; without a sketch, all shingles in any order."""
    rows = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("key"), whole_text(text).alias("text"))

    def made(batches):
        from xxhash import xxh3_128_digest

        order = None if sketch is None else shipped(sketch)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, digests, heads, ends, odd = [], [], [], [0], []
                for value in part.column(2):
                    found = shingles(value.as_py(), width)
                    n = len(found)
                    sizes.append(n)
                    digests.append(xxh3_128_digest(found.tobytes()) if n else b"")
                    if order is not None:
                        odd.append(np.packbits(np.bincount((found & np.uint64(64 * PARITIES - 1)).view(np.int64), minlength=64 * PARITIES) & 1))
                        found = found[np.lexsort((found, order[found >> np.uint64(64 - SKETCH_BITS)]))]
                        found = found if n <= LIGHT else found[:prefix(n, percent)]
                    heads.append(found)
                    ends.append(ends[-1] + len(found))
                flat = pa.array(np.concatenate(heads).view(np.int64))
                columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                           pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                if order is not None:
                    columns += [pa.array(c) for c in np.ascontiguousarray(np.stack(odd).view(np.int64).T)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "key", "n", "digest", "tokens", *(PARITY if sketch is not None else ())]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, key long, n long, digest binary, tokens array<long>"
    return rows.mapInArrow(made, ", ".join([schema, *(f"{c} long" for c in names[5:])]))


def _subset_links(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all linked light sets."""
    def written(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            keys, names, least = [], [], []
            for name, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s, tokens = len(tokens), [t.to_bytes(8, "little", signed=True) for t in sorted(tokens)]
                for t in partners(s, percent):
                    if t <= boundary:
                        head = bytes([min(s, t), max(s, t)])
                        for subset in combinations(tokens, overlap(s, t, percent)):
                            keys.append(xxh64_intdigest(head + b"".join(subset)) - (1 << 63))
                            names.append(name)
                            least.append(s <= t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(least, pa.bool_())], names=["subset", "a", "least"])

    light = sets.where(F.col("n") <= boundary).select("set", "tokens")
    rows = materialize(light.mapInArrow(written, "subset long, a long, least boolean"))
    # a set of the smaller size is linked with all sets that share the subset
    centre = rows.groupBy("subset").agg(F.min(F.when(F.col("least"), F.col("a"))).alias("b"), F.count("*").alias("m"))
    centre = centre.where("m > 1 AND b IS NOT NULL").drop("m")
    return rows.join(centre, "subset").where("a <> b").select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """The linked ones among distinct ``pairs(a, b)``, by their whole sets."""
    wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    # one document stands for each set; its text is read again
    named = lookup(sets.join(wanted, "set").select(
        "set", F.col("best.id").alias("id"), F.col("best.key").alias("key"), F.col("best.unnamed").alias("unnamed")))
    found = docs.select(F.col(doc_id).alias("id"), text_key(text).alias("key"), F.col(text).alias("text"))
    same = found["id"].eqNullSafe(named["id"]) & (found["key"] == named["key"])
    chosen = found.join(named.select("id", "key"), same, "left_semi")
    whole = _hashed(chosen, "id", "text", width, percent)
    whole = whole.join(sets.select("set", "digest"), "digest").select("set", "tokens").dropDuplicates(["set"])
    whole = materialize(whole)
    met = (
        pairs.join(whole.select(F.col("set").alias("a"), F.col("tokens").alias("x")), "a")
        .join(whole.select(F.col("set").alias("b"), F.col("tokens").alias("y")), "b")
        .select("a", "b", F.size("x").alias("s"), F.size("y").alias("t"), F.size(F.array_intersect("x", "y")).alias("common"))
    )
    return met.where(100 * F.col("common") >= percent * (F.col("s") + F.col("t") - F.col("common"))).select("a", "b")


def _fits(a: str, b: str, percent: int):
    """Whether sizes and places in the prefixes allow a link, for columns
    ``a_n, a_at, b_n, b_at``."""
    size = lambda x: F.col(x + "_n")
    rest = F.least(size(a) - F.col(a + "_at"), size(b) - F.col(b + "_at"))
    return (100 * rest >= percent * (size(a) + size(b) - rest)) & (100 * F.least(size(a), size(b)) >= percent * F.greatest(size(a), size(b)))


def _alike(a: str, b: str, percent: int):
    """Whether parities allow a link, for columns ``a_n, a_odd0, .., b_n, b_odd0,
    ..``: of s + t elements, at least the differing buckets' are not shared."""
    differ = reduce(add, [F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in PARITY])
    total = F.col(f"{a}_n") + F.col(f"{b}_n")
    both = (total - differ) / 2
    return 100 * both >= percent * (total - both)


def boundary_of(sets: DataFrame, lists: DataFrame, percent: int = PERCENT) -> int:
    """Size up to which subsets cost less than lists: subsets written against
    list entries read, over the sets that may be light."""
    small = sets.where(F.col("n") <= LIGHT)
    entries = small.select("n", F.explode(F.slice("tokens", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))).alias("token"))
    read = entries.join(lists, "token", "left").groupBy("n").agg(F.sum(1 + F.coalesce("members", F.lit(1))).alias("read"))
    cost = {r["n"]: r["read"] for r in read.collect()}
    count = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}

    def total(x):
        return sum(m * subsets(s, x, percent) if s <= x else cost.get(s, 0) for s, m in count.items())

    return min(range(LIGHT + 1), key=lambda x: (total(x), x))


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
           rounds: int = ROUNDS, leaders: int = LEADERS, chunk: int = CHUNK,
           boundary: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, key, n_shingles, class_id (the smallest
    id with an equal set), component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    sketch = ship(spark, rarity(docs, text, width))
    rows = materialize(_hashed(docs, doc_id, text, width, percent, sketch))
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("best")
    sets = rows.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), best,
                                                    *[F.first(c).alias(c) for c in PARITY])
    sets = materialize(sets.withColumn("set", F.monotonically_increasing_id()))

    size = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    entries = sets.select("set", "n", F.posexplode(F.slice("tokens", F.lit(1), size)).alias("at", "token"))
    lists = materialize(entries.groupBy("token").agg(F.count("*").alias("members")).where("members > 1"))
    boundary = boundary_of(sets, lists, percent) if boundary is None else min(boundary, LIGHT)
    least = -(-percent * (boundary + 1) // 100)
    heavy = materialize(entries.where(F.col("n") >= least).join(lists, "token"))

    links = materialize(_subset_links(sets, boundary, percent))
    carried, parities = ["set", "n", "at", "part"], sets.select("set", *PARITY)
    tried = roots = None
    for number in range(rounds + 1):
        parts = heavy if roots is None else heavy.join(roots, F.col("set") == F.col("node"), "left")
        part = F.col("set") if roots is None else F.coalesce("root", "set")
        member = materialize(parts.select("token", "set", "n", "at", "members", part.alias("part")))
        # lists whose members are of one component have told all
        mixed = member.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("token")
        open_ = member.join(mixed, "token", "left_semi")
        if number < rounds:
            side = lambda x, *more: open_.select("token", *[F.col(c).alias(f"{x}_{c}") for c in carried], *more)  # noqa: B023,E731
            order = F.struct(F.xxhash64("a_set", F.lit(number)).alias("h"), *[f"a_{c}" for c in carried])
            some = side("a", F.pmod(F.xxhash64("set", F.lit(number)), F.lit(leaders)).alias("place"))
            leader = some.groupBy("token", "place").agg(F.min(order).alias("l")).select(
                "token", *[F.col("l")[f"a_{c}"].alias(f"b_{c}") for c in carried])
            met = side("a").join(leader, "token")
        else:
            known = open_.join(parities, "set")
            side = lambda x, *more: known.select(  # noqa: B023,E731
                "token", *[F.col(c).alias(f"{x}_{c}") for c in (*carried, *PARITY)], *more)
            chunks = F.ceil(F.col("members") / chunk).cast("int")
            left = side("a", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
            right = side("b", F.pmod(F.xxhash64("set"), chunks).cast("int").alias("chunk"))
            met = left.join(right, ["token", "chunk"]).where("a_set < b_set").where(_alike("a", "b", percent))
        pairs = met.where((F.col("a_part") != F.col("b_part")) & (F.greatest("a_n", "b_n") > boundary) & _fits("a", "b", percent))
        pairs = pairs.select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b"), F.least("a_n", "b_n").alias("x_n"),
                             F.greatest("a_n", "b_n").alias("y_n")).distinct()
        if number < rounds:
            side = lambda x: parities.select(F.col("set").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in PARITY])
            both = pairs.withColumnsRenamed({"x_n": "a_n", "y_n": "b_n"}).join(side("a"), "a").join(side("b"), "b")
            pairs = both.where(_alike("a", "b", percent))
        pairs = pairs.select("a", "b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        if pairs.isEmpty() and roots is not None:
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = _verified(pairs, docs, sets, doc_id, text, width, percent)
        # what is known already is one link for each set
        old = links if roots is None else roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(materialize(old.unionByName(new)))

    rooted = sets.join(roots, F.col("set") == F.col("node"), "left").select("digest", "best", F.coalesce("root", "set").alias("root"))
    first = rooted.groupBy("root").agg(F.min("best").alias("first"))
    named = rooted.join(first, "root").select("digest", F.col("best.id").alias("class_id"), F.col("first.id").alias("component_id"))
    alone = rows.where("n = 0").select("id", "key", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return rows.where("n > 0").join(named, "digest").select(
        "id", "key", F.col("n").alias("n_shingles"), "class_id", "component_id").unionByName(alone)
