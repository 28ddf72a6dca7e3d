"""Queries over the given tables, one per operator, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfspark.llm import (
    alignment, decontaminate, exact_dedup, hard_negatives, html_text, jaccard_join, licences, near_dup, quality, secrets, token_files, tokens, toxicity,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn=None, sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register(fn) if fn else register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_simhash_near_dedup(spark, sf_dir):
    rows = near_dup.groups(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), near_dup.fingerprint_hex().alias("fingerprint"), "component_id")


@query
def op3_bpe(spark, sf_dir):
    rows = tokens.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
    return rows.withColumnRenamed("id", "doc_id")


@query
def op2_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_text.texts(pages, html_text.trained(pages))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CONTAMINATION_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(sql=f"""
WITH d AS (SELECT doc_id, {CONTAMINATION_WORDS} AS w FROM documents),
b AS (SELECT item_id, {CONTAMINATION_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p + 1:p + n], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS p
        FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM win),
texts AS (SELECT DISTINCT n, s FROM win),
places AS (
  SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, n, p, s FROM places SEMI JOIN texts USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found JOIN win USING (n, s)) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op4_decontamination(spark, sf_dir):
    rows = decontaminate.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query(sql="""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, first(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first(doc_id) OVER best = doc_id AS kept, text_sha256
FROM t WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""")
def op7_exact_dedup(spark, sf_dir):
    rows = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def _secret_sql() -> str:
    quoted = [p.replace("'", "''") for p in secrets.PATTERNS]
    matched = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS gs FROM t"
        for i, p in enumerate(quoted))
    tests = secrets.ENCODINGS[:-1]
    encoding = "CASE " + " ".join(f"WHEN regexp_matches(body, '{e[1]}') THEN {i}" for i, e in enumerate(tests)) + " ELSE 4 END"
    facts = ", ".join(f"({i}, '{e[2]}', {len(e[2])}, {e[3]!r}, {str(e[4]).lower()})" for i, e in enumerate(secrets.ENCODINGS))
    z = f"(-score / {secrets.STEPS}.0)"
    rest = z
    for i in range(5, 0, -1):
        rest = f"({z} + {i} / {rest})"
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secrets.KINDS)) + " END"
    text = f"string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({matched}),
listed AS (SELECT doc_id, kind, i, ms[i] AS match, length(gs[i]) AS gap
           FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM matched)),
ended AS (SELECT doc_id, kind, match, length(match) AS n,
                 CAST(sum(gap + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM listed),
spans AS (SELECT *, e - n AS s FROM ended
          WHERE kind <> 0 OR length(regexp_extract(match, '{quoted[0]}', 2)) >= {secrets.VALUE}),
flagged AS (
  SELECT *, coalesce(max(CASE WHEN kind < 3 THEN e END) OVER (
              PARTITION BY doc_id ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) <= s
            AND coalesce(min(CASE WHEN kind < 3 THEN s END) OVER (
              PARTITION BY doc_id ORDER BY s, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), e) >= e AS apart
  FROM spans),
facts(encoding, alphabet, k, often, cased) AS (VALUES {facts}),
runs AS (SELECT doc_id, s, e, match, regexp_replace(match, '=+$', '') AS body FROM flagged WHERE kind = 3 AND apart),
ends AS (SELECT *, length(regexp_extract(body, '^(?:{secrets.PLAIN}[/_-])+')) AS ahead,
                length(regexp_extract(body, '(?:[/_-]{secrets.PLAIN})+$')) AS behind,
                regexp_matches(body, '^{secrets.PLAIN}(?:[/_-]{secrets.PLAIN})*$') AS plain FROM runs),
cores AS (SELECT *, CASE WHEN behind > 0 THEN length(body) - behind ELSE length(match) END AS stop FROM ends WHERE NOT plain AND ahead + behind > 0),
strings AS (SELECT doc_id, s AS run, s, e, match, false AS core FROM runs
            UNION ALL SELECT doc_id, s, s + ahead, s + stop, match[ahead + 1:stop], true FROM cores WHERE stop - ahead >= {secrets.LEAST}),
bodies AS (SELECT doc_id, run, core, s, e, body, {encoding} AS encoding
           FROM (SELECT *, regexp_replace(match, '=+$', '') AS body FROM strings)),
known AS (SELECT doc_id, run, core, s, e, alphabet, k, often, cased, encoding, greatest(length(body), 2) AS n,
                 CASE WHEN encoding IN (0, 2) THEN lower(body) ELSE translate(body, '-_=', '+//') END AS body
          FROM bodies JOIN facts USING (encoding)),
codes AS (SELECT doc_id, s, e, k, i, strpos(alphabet, substr(body, i, 1)) - 1 AS x
          FROM (SELECT *, unnest(range(1, length(body) + 1)) AS i FROM known)),
steps AS (SELECT *, lag(x) OVER (PARTITION BY doc_id, s, e ORDER BY i) AS y FROM codes),
sums AS (SELECT doc_id, s, e, count(*) FILTER (k > 2 * x) AS low,
                1 + count(*) FILTER (y IS NOT NULL AND (k > 2 * x) <> (k > 2 * y)) AS runs,
                coalesce(sum((2 * x - k + 1) * (2 * y - k + 1)), 0) AS serial FROM steps GROUP BY ALL),
same AS (SELECT doc_id, s, e, sum(c * (c - 1)) AS agree
         FROM (SELECT doc_id, s, e, x, count(*) AS c FROM codes GROUP BY ALL) GROUP BY ALL),
measured AS (
  SELECT doc_id, run, core, s, e, encoding, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k, CAST(often AS DOUBLE) AS often, cased, CAST(agree AS DOUBLE) AS agree,
         CAST(low AS DOUBLE) AS n1, n - CAST(low AS DOUBLE) AS n2, CAST(runs AS DOUBLE) AS runs,
         CAST(serial AS DOUBLE) AS serial
  FROM known JOIN sums USING (doc_id, s, e) JOIN same USING (doc_id, s, e)),
spread AS (SELECT *, n * (n - 1) / 2 AS pairs, 2 * n1 * n2 / n + 1 AS mean FROM measured),
departed AS (
  SELECT doc_id, run, core, s, e, encoding, n, cased, (agree / 2.0 - often * pairs) / sqrt(
           pairs * often * (1 - often) + n * (n - 1) * greatest(n - 2, 0.0) * {secrets.THREE}) AS z1,
         abs(2 * n1 - n) / sqrt(n) - {secrets.ONE_CASE} * sqrt(n) AS z4,
         CASE WHEN (mean - 1) * (mean - 2) / (n - 1) > 0
              THEN abs(runs - mean) / sqrt(greatest((mean - 1) * (mean - 2) / (n - 1), 1e-300)) ELSE 99.0 END AS z2,
         abs(serial / 4.0) / ((k * k - 1) / 12 * sqrt(n - 1)) AS z3 FROM spread),
scored AS (
  SELECT doc_id, run, core, s, e, encoding * 64 + CAST(floor(log2(n) + 1e-9) AS INTEGER) AS stratum,
         CAST(CASE WHEN greatest(z2, z3) > {secrets.REJECTED} THEN {secrets.ENDS} ELSE
              least(greatest(ceil(CASE WHEN cased THEN greatest(z1, z4) ELSE z1 END * {secrets.STEPS}), -{secrets.ENDS}), {secrets.ENDS})
              END AS INTEGER) AS score FROM departed),
counts AS (SELECT stratum, score, sum(count(*)) OVER (PARTITION BY stratum ORDER BY score) AS upto,
                  sum(count(*)) OVER (PARTITION BY stratum) AS total FROM scored GROUP BY stratum, score),
limits AS (SELECT stratum, max(score) AS lim FROM counts
           WHERE score < 0 AND exp(-{z} * {z} / 2) / ({rest} * sqrt(2 * pi())) * total <= {secrets.FALSE_SHARE} * upto
           GROUP BY stratum),
kept AS (SELECT doc_id, s, kind, e FROM flagged WHERE kind < 3
         UNION ALL SELECT doc_id, s, 3, e FROM scored JOIN limits USING (stratum) WHERE score <= lim
         QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY core DESC) = 1),
told AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
                count(*) FILTER (kind = 2) AS n_hex, {text} FILTER (kind < 3) AS base, {text} AS spans
         FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN told USING (doc_id)"""


@query(sql=_secret_sql())
def op9_secrets(spark, sf_dir):
    rows = secrets.spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.described(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        secrets.described(F.col("spans")).alias("spans"))


def _licence_sql() -> str:
    def canonical(column: str) -> str:
        form = f"replace({LOWERED.replace('text', column)}, '\u00a9', 'copyright ')"
        form = f"regexp_replace({form}, '{licences.PUNCTUATION}', ' ', 'g')"
        for old, new in licences.SPELLINGS:
            form = f"replace({form}, '{old}', '{new}')"
        old, new = licences.Z_SPELLING
        return f"regexp_replace({form}, '{old}', '\\1{new}\\2', 'g')"

    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licences.KNOWN)
    lines = f"line <> '' AND NOT regexp_matches(line, '{licences.CLAIM}')"
    return f"""
WITH known(licence, body) AS (VALUES {known}),
known_lines AS (SELECT k, licence, i, trim(line) AS line FROM (
  SELECT k, licence, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (
    SELECT row_number() OVER () AS k, licence, string_split({canonical('body')}, chr(10)) AS ls FROM known))),
table_ AS (SELECT digest, min(licence) AS licence FROM (
  SELECT k, licence, sha256(string_agg(line, ' ' ORDER BY i)) AS digest FROM known_lines WHERE {lines} GROUP BY k, licence) GROUP BY digest),
listed AS (SELECT doc_id, i, trim(line) AS line FROM (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (
    SELECT doc_id, string_split({canonical('text')}, chr(10)) AS ls FROM documents))),
kept AS (SELECT * FROM listed WHERE {lines}),
whole AS (SELECT doc_id, sha256(string_agg(line, ' ' ORDER BY i)) AS digest FROM kept GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
          FROM kept JOIN table_ ON sha256(line) = digest GROUP BY doc_id)
SELECT d.doc_id, coalesce(whole.digest, sha256('')) AS digest, licence, coalesce(notices, '') AS notices,
       coalesce(n_notices, 0) AS n_notices
FROM documents d LEFT JOIN whole USING (doc_id) LEFT JOIN table_ ON whole.digest = table_.digest
LEFT JOIN found USING (doc_id)"""


@query(sql=_licence_sql())
def op6_licences(spark, sf_dir):
    rows = licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))
    return rows.select(F.col("id").alias("doc_id"), "digest", "licence", F.array_join("notices", ",").alias("notices"), "n_notices")


#: Appended to every document in token files.
END_OF_TEXT = 2


@query
def op5_token_files(spark, sf_dir):
    folder = token_files.default_folder(spark)
    manifest = token_files.write(table(spark, sf_dir, "documents"), folder, vocabulary_path(), END_OF_TEXT)
    rows = token_files.placed(token_files.read(spark, folder), manifest)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def fold(doc_id: str, folds: int):
    return F.crc32(F.col(doc_id).cast("string")) % folds


@query
def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.trained(docs, labels.where(fold("doc_id", 5) != 0))
    rows = toxicity.scored(docs, model).withColumn("held_out", fold("id", 5) == 0)
    return rows.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.trained(docs, labels.where(fold("doc_id", 3) != 1))
    rows = quality.scored(docs, model).withColumn("held_out", fold("id", 3) == 1)
    return rows.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(sql=f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 5], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y USING (s)
                    WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n AS p ON a = p.doc_id JOIN n AS q ON b = q.doc_id WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, least(doc_id, min(b)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON doc_id = a GROUP BY doc_id""")
def op11_jaccard_join(spark, sf_dir):
    rows = jaccard_join.joined(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op12_token_alignment(spark, sf_dir):
    rows = alignment.aligned(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
    return rows.withColumnRenamed("id", "doc_id")


@query(sql="""
WITH base AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM base a JOIN base c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM near JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 3""")
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(hard_negatives.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("vector"))
    return hard_negatives.mined(rows, F.col("vec_id") % 50 == 0)
