"""Secret scan: credential patterns, and a battery of randomness tests.

Three patterns give the base spans.  Beside them every other long run of key
characters is tested, whole and without the plain words at its ends: its encoding is inferred from its characters, and three
statistics compare it with a uniform random string over that alphabet: equal
pairs of characters (the chi-squared statistic, up to a linear map), the number
of runs below and above the middle of the alphabet, and the serial correlation
of neighbours.

A string whose runs or neighbours reject randomness is no secret.  For the
others the null hypothesis is an ordinary string: one whose characters agree in
pairs as often as in written words and, over alphabets of both cases, one that
keeps mostly to one case.  The score is the worse of both normal scores; their
power rises with length.  Strings are kept by the false-discovery rule of
Benjamini and Hochberg within each encoding and doubling of length; scores are
rounded up to a fixed grid, so that counts on the grid replace a global order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perfspark.llm.common import text_key, whole_text
from perfspark.runtime import materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
          "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Fewer characters of the value are no credential.
VALUE = 6
#: The longest run decides; a shorter one could not hold a longer match.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Runs that the battery tests: 20 characters, of which the last may be padding.  A run ends at "=", so that a name and
#: the value assigned to it are tested apart.
RUN = "([A-Za-z0-9+/_-]{20,}=*|[A-Za-z0-9+/_-]{19}=+|[A-Za-z0-9+/_-]{18}==+)"
PATTERNS = (ASSIGN, ACCESS, HEX, RUN)

#: Shortest string that is tested.
LEAST = 20
#: A part of a run between "/", "_" and "-" that is a plain word, or empty.
PLAIN = "([a-z]+|[A-Z]+|[A-Z][a-z]+)?"

LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
#: Encodings from the narrowest: name, pattern, alphabet, the chance that two
#: characters of an ordinary string over it agree, and whether it has two cases.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.1, False),
    ("base32", "^[A-Z2-7]+$", LOWER.upper() + "234567", 0.065, False),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER, 0.065, False),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + LOWER.upper() + LOWER, 0.065, True),
    ("base64", "", DIGITS + LOWER.upper() + LOWER + "+/", 0.065, True),
)
#: Of an ordinary string: the chance that three characters agree beyond its
#: square for two, which widens the spread of agreeing pairs; and the share by
#: which one half of an alphabet of two cases outweighs the other.
THREE, ONE_CASE = 0.0012, 0.7
#: Departure at which the runs and neighbours of a string reject randomness.
REJECTED = 3.3
#: Accepted share of false discoveries; steps of the score's grid and its ends.
FALSE_SHARE, STEPS, ENDS = 0.01, 16, 160


def _scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: row, id, key, and per kind the matches with the
    code points before each of them since the last one."""
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"),
                       text_key(text).alias("key"), whole_text(text).alias("text"))
    for kind, pattern in zip(KINDS, PATTERNS):
        read = read.withColumn(kind, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    matched = []
    for i, (kind, pattern) in enumerate(zip(KINDS, PATTERNS)):
        gaps = F.transform(F.split("text", pattern, -1), F.char_length)
        some = F.zip_with(F.col(kind), F.slice(gaps, 1, F.size(kind)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
        matched.append(F.when(F.size(kind) > 0, F.struct(F.lit(i).alias("kind"), some.alias("found"))))
    return materialize(read.select("row", "id", "key", F.array_compact(F.array(*matched)).alias("kinds")))


def _placed(scanned: DataFrame) -> DataFrame:
    """row, kind, start, end, match of the matches that count.  A run that
    overlaps a base span is left out."""
    listed = scanned.select("row", F.explode("kinds").alias("k")).select(
        "row", "k.kind", F.posexplode("k.found").alias("i", "m"))
    running = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("m.match")
    ended = listed.select("row", "kind", "m.match", F.sum(F.col("m.gap") + size).over(running).cast("long").alias("end"),
                          size.alias("size"))
    value = F.char_length(F.regexp_extract("match", ASSIGN, 2))
    spans = ended.where((F.col("kind") != 0) | (value >= VALUE)).withColumn("start", F.col("end") - F.col("size"))
    base = F.col("kind") < 3
    order = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    apart = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    flagged = spans.withColumn("apart", apart)
    return flagged.where(base | F.col("apart")).drop("apart", "size")


def tested(runs: DataFrame) -> DataFrame:
    """``runs(match)`` with stratum (encoding and doubling of length) and score
    on the grid: low for strings that no ordinary one resembles."""
    body = F.regexp_replace("match", "=+$", "")
    encoding = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        encoding = F.when(body.rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(encoding)
    rows = runs.withColumn("body", body).withColumn("encoding", encoding)

    def pick(value) -> Column:
        chosen = F.lit(value(ENCODINGS[-1]))
        for i in range(len(ENCODINGS) - 1):
            chosen = F.when(F.col("encoding") == i, F.lit(value(ENCODINGS[i]))).otherwise(chosen)
        return chosen

    folded = F.when(F.col("encoding") == 0, F.lower("body")).when(F.col("encoding") == 2, F.lower("body")).otherwise(
        F.translate("body", "-_=", "+//"))
    rows = rows.withColumn("body", folded).withColumn("alphabet", pick(lambda e: e[2])).withColumn(
        "k", pick(lambda e: len(e[2]))).withColumn(
        "often", pick(lambda e: e[3])).withColumn("cased", pick(lambda e: e[4]))
    codes = F.transform(F.split("body", ""), lambda c: F.call_function("locate", c, F.col("alphabet")) - 1)
    rows = rows.withColumn("x", codes).withColumn("n", F.size("x"))

    low = lambda c: F.col("k") > 2 * c
    at = lambda i: F.get("x", i)
    near = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("agree", F.aggregate(  # ordered pairs of equal characters
        F.array_distinct("x"), F.lit(0).cast("long"), lambda a, v: a + _squares(v)))
    rows = rows.withColumn("low", F.size(F.filter("x", low)).cast("long")).withColumn(
        "runs", 1 + F.size(F.filter(near, lambda i: low(at(i)) != low(at(i - 1))))).withColumn(
        "serial", F.aggregate(near, F.lit(0).cast("long"), lambda a, i: a + (
            (2 * at(i) - F.col("k") + 1) * (2 * at(i - 1) - F.col("k") + 1)).cast("long")))

    n, k, n1 = F.greatest("n", F.lit(2)).cast("double"), F.col("k").cast("double"), F.col("low").cast("double")
    n2 = n - n1
    pairs = n * (n - 1) / 2
    often = F.col("often")
    z_equal = (F.col("agree") / 2.0 - often * pairs) / F.sqrt(
        pairs * often * (1 - often) + n * (n - 1) * F.greatest(n - 2, F.lit(0.0)) * THREE)
    z_case = F.when(F.col("cased"), F.abs(2 * n1 - n) / F.sqrt(n) - ONE_CASE * F.sqrt(n)).otherwise(z_equal)
    mean = 2 * n1 * n2 / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when(spread > 0, F.abs(F.col("runs") - mean) / F.sqrt(F.when(spread > 0, spread).otherwise(1.0))).otherwise(99.0)
    z_serial = F.abs(F.col("serial") / 4.0) / ((k * k - 1) / 12 * F.sqrt(n - 1))
    rejected = F.greatest(z_runs, z_serial) > REJECTED
    score = F.when(rejected, F.lit(ENDS)).otherwise(F.ceil(F.greatest(z_equal, z_case) * STEPS))
    band = F.floor(F.log2(n) + 1e-9)
    return rows.withColumn("stratum", (F.col("encoding") * 64 + band).cast("int")).withColumn(
        "score", F.least(F.greatest(score, F.lit(-ENDS)), F.lit(ENDS)).cast("int")).drop(
        "body", "encoding", "alphabet", "k", "often", "cased", "x", "n", "agree", "low", "runs", "serial")


def with_cores(runs: DataFrame) -> DataFrame:
    """``runs(row, start, end, match)`` as the strings to test: every run whole
    and, if plain words stand at its ends, the core that is left without them
    (``core``), so that a value behind a path or a name is tested for itself.
    ``run`` is the start of the run."""
    body = F.regexp_replace("match", "=+$", "")
    rows = runs.withColumn("parts", F.split(body, "[/_-]")).withColumn(
        "odd", F.transform("parts", lambda p: ~p.rlike(f"^{PLAIN}$"))).withColumn("size", F.char_length(body))
    chars = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.char_length(p) + 1)
    ahead = F.array_position("odd", True).cast("int") - 1
    behind = F.array_position(F.reverse("odd"), True).cast("int") - 1
    rows = rows.withColumn("from", chars(F.slice("parts", F.lit(1), F.greatest(ahead, F.lit(0))))).withColumn(
        "less", chars(F.slice(F.reverse("parts"), F.lit(1), F.greatest(behind, F.lit(0)))))
    last = F.when(F.col("less") > 0, F.col("size") - F.col("less")).otherwise(F.char_length("match"))
    cut = F.substring("match", F.col("from") + 1, (last - F.col("from")).cast("int"))
    core = F.struct((F.col("start") + F.col("from")).alias("start"), (F.col("start") + last).alias("end"), cut.alias("match"), F.lit(True).alias("core"))
    whole = F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "match", F.lit(False).alias("core"))
    has = (ahead >= 0) & (F.col("from") + F.col("less") > 0) & (last - F.col("from") >= LEAST)
    both = F.when(has, F.array(whole, core)).otherwise(F.array(whole))
    return rows.select("row", F.col("start").alias("run"), F.inline(both))


def _squares(value: Column) -> Column:
    count = F.size(F.filter("x", lambda c: c == value)).cast("long")
    return count * (count - 1)


def _chance(score: Column) -> Column:
    """Normal tail below a negative grid score, by its continued fraction."""
    z = -score / float(STEPS)
    rest = z
    for i in range(5, 0, -1):
        rest = z + i / rest
    return F.exp(-z * z / 2) / (rest * math.sqrt(2 * math.pi))


def limits(scored: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """stratum, limit: the largest grid score that is still a discovery."""
    counts = scored.groupBy("stratum", "score").agg(F.count("*").alias("n"))
    # at most 2 * ENDS + 1 rows of a stratum
    upto = Window.partitionBy("stratum").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    held = ranked.where((F.col("score") < 0) & (_chance(F.least("score", F.lit(-1))) * F.col("all") <= share * F.col("upto")))
    return held.groupBy("stratum").agg(F.max("score").alias("limit"))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """One row per row of ``docs``: id, key, spans: array of (start, kind, end)
    by start, then kind (index into ``KINDS``); code points, end exclusive.

    Null is the empty text.  Texts without a span have an empty array; repeated
    rows each give a row.
    """
    scanned = _scan(docs, doc_id, text)
    placed = materialize(_placed(scanned))
    scored = materialize(tested(with_cores(placed.where("kind = 3").select("row", "start", "end", "match"))))
    # at most one row of an encoding and doubling of length: a few hundred
    found = scored.join(F.broadcast(limits(scored, share)), "stratum").where("score <= limit")
    # a core that is found stands for its run
    found = found.groupBy("row", "run").agg(F.max(F.struct("core", "start", "end")).alias("best")).select(
        "row", "best.start", "best.end")
    kept = placed.where("kind < 3").select("row", "start", "kind", "end").unionByName(
        found.select("row", "start", F.lit(3).alias("kind"), "end"))
    gathered = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scanned.select("row", "id", "key").join(gathered, "row", "left").select(
        "id", "key", F.coalesce("spans", none).alias("spans"))


def described(spans_: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
