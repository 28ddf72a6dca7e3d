import hashlib
import random
import re
import string
import textwrap

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from perfspark.llm import decontaminate, licences, queries, secrets
from tests.llm.conftest import SF, TEXTS
from tests.oracle_check import compare, connect

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def split_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def hits(text, items):
    words = split_words(text)
    hit, named = set(), set()
    for item, body in items:
        own = split_words(body)
        n = min(13, len(own))
        for at in range(max(len(own) - 13, 0) + 1 if own else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == own[at:at + n]:
                    hit.update(range(i, i + n))
                    named.add("" if item is None else str(item))
    return len(words), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_against_brute_force(spark, odd, nothing):
    rng = random.Random(2)
    vocabulary = ["the", "of", "a", "Été", "x1"]
    item = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(1, item(40)), (2, item(13)), (3, item(5)), (10, "lazy dog"), (4, ""), (5, None), (None, "ONE two"), (1, item(14)),
             (6, "the " * 15)]
    docs = [(i, " ".join([item(rng.randint(0, 30)), *([rng.choice(items)[1] or ""] * rng.randint(0, 2)), item(20)])) for i in range(100, 160)]
    rows = TEXTS + docs
    table = odd.select("doc_id", "text").unionByName(spark.createDataFrame(docs, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scores(table, benchmark).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows}
    for r in got:
        if r["id"] is not None:
            assert (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) == hits(text[r["id"]], items)
    kept = decontaminate.clean(odd, benchmark)
    assert kept.columns == odd.columns
    assert kept.count() == len({(i, t) for i, t in TEXTS if not hits(t, items)[3]})
    assert decontaminate.scores(nothing, benchmark).count() == 0
    none = decontaminate.scores(odd, benchmark.where("item_id < 0"))
    assert none.count() == len(TEXTS) and none.where("n_hit > 0").count() == 0


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def key(rng, n, alphabet):
    return "".join(rng.choices(alphabet, k=n))


def test_secrets(spark, odd, nothing):
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits
    rows = list(TEXTS)
    for i in range(200, 260):
        parts = [f'🎉 API_KEY: "{key(rng, rng.randint(3, 9), letters)}" token=token=ab', "AKIA" + key(rng, rng.randint(12, 20), "ABC123"),
                 key(rng, rng.randint(20, 30), "0123456789abcdef"), "secret:token: abcdefgh", "é" * rng.randint(0, 3)]
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", ""]).join(parts)))
    planted = key(rng, 44, letters + "+/")
    rows += [(300, f"see {planted}, or Donaudampfschifffahrtsgesellschaftskapitaen"), (301, "=" * 40), (302, "0" * 23 + " " + "ab" * 20 + "-")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.spans(docs).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t in rows if i is not None}
    random_spans = {}
    for r in got:
        if r["id"] is not None:
            mine = [tuple(s) for s in r["spans"]]
            assert [s for s in mine if s[1] < 3] == base_spans(text[r["id"]])
            random_spans[r["id"]] = [text[r["id"]][s:e] for s, k, e in mine if k == 3]
    assert random_spans[300] == [planted]
    assert random_spans[301] == [] and random_spans[302] == [] and random_spans[8] == []
    assert secrets.spans(odd).count() == len(TEXTS) and secrets.spans(nothing).count() == 0


def test_values_are_tested_without_their_names(spark):
    """Behind a name the same values are found as alone."""
    rng = random.Random(7)
    names = ["aws_secret_access_key=", "client_credential_value=", "key=", "k="]
    values = [key(rng, 40, string.ascii_letters + string.digits + "+/") + "=" * (i % 3) for i in range(400)]

    def found(rows):
        got = secrets.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        return {(r["id"], rows[r["id"]][1][s:e]) for r in got for s, _, e in r["spans"]}

    alone = found([(i, f"export {v} # {i}") for i, v in enumerate(values)])
    assert len(alone) >= 0.9 * len(values)
    assert found([(i, f"export {names[i % 4]}{v} # {i}") for i, v in enumerate(values)]) == alone


@pytest.mark.parametrize("before, after", [("com/example/service/", ""), ("production_client_", ""), ("hooks/services/", ""), ("prod-api-", "-readonly")])
def test_values_are_tested_without_words_around_them(spark, before, after):
    """Behind and before words that belong to the same run."""
    rng = random.Random(9)
    values = [key(rng, 40, string.ascii_letters + string.digits + "+/") for _ in range(1000)]

    def found(rows):
        got = secrets.spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
        return {r["id"]: [rows[r["id"]][s:e] for s, _, e in r["spans"]] for r in got}

    alone, inside = found([f"see {v} now" for v in values]), found([f"see {before}{v}{after} now" for v in values])
    lost = [i for i, v in enumerate(values) if alone[i] and not any(v[8:32] in x for x in inside[i])]
    whole = sum(v in inside[i] for i, v in enumerate(values))
    assert len(lost) <= 0.01 * len(values), len(lost)
    assert whole >= 0.8 * len(values), whole


def test_cores_of_runs(spark):
    rows = ["com/example/AbC9dEf0GhI1jKl2MnO3", "AbC9dEf0GhI1jKl2MnO3-word_Word", "just/plain/words_and-more_words", "a/9-" + "Zz9" * 8 + "==",
            "-" * 30, "word/" + "9" * 19, "Ab9" * 10, "x-" * 50_000 + "9q" * 20]
    df = spark.createDataFrame([(i, 5, 5 + len(t), t) for i, t in enumerate(rows)], "row int, start long, end long, match string")
    got = {r["row"]: (r["start"], r["end"], r["match"]) for r in secrets.with_cores(df).where("core").collect()}
    assert got == {0: (17, 37, rows[0][12:]), 1: (5, 25, rows[1][:20]), 3: (7, 5 + len(rows[3]), rows[3][2:]),
                   7: (100_005, 100_045, "9q" * 20)}
    assert secrets.with_cores(df).where("NOT core").count() == len(rows)


def test_false_discoveries_are_rare(spark):
    rng = random.Random(6)
    syllables = ["ver", "ein", "schaft", "un", "keit", "lich", "ent", "zu", "ge", "ber", "auf", "isch"]
    words = ["".join(rng.choices(syllables, k=rng.randint(6, 12))) for _ in range(3000)]
    keys = [key(rng, rng.choice([32, 40, 64]), string.ascii_letters + string.digits) for _ in range(300)]
    runs = spark.createDataFrame([(w if len(w) >= 20 else w + "ungsgesellschaften", False) for w in words] + [(k, True) for k in keys], "match string, secret boolean")
    scored = secrets.tested(runs)
    found = scored.join(secrets.limits(scored), "stratum").where("score <= limit")
    counts = {r["secret"]: r["count"] for r in found.groupBy("secret").count().collect()}
    assert counts[True] >= 0.9 * len(keys) and counts.get(False, 0) <= 0.02 * counts[True]


def test_licences(spark, odd, nothing):
    mit = licences.KNOWN[0][1]
    other = "© 2020 Somebody\nCopyright (c) 2021 Others. All rights reserved.\n\n" + mit.lower().replace(",", " ,").replace("sublicense", "sublicence")
    rows = [(1, mit), (2, other), (3, mit + " more"), (4, None), (5, "intro\nReleased under the MIT Licence!\nMIT license\n* licensed under CC-BY 4.0 *"), (5, "")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_licences(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert len(got) == len(rows)
    assert by[1][0]["licence"] == by[2][0]["licence"] == "MIT" and by[1][0]["digest"] == by[2][0]["digest"]
    assert by[3][0]["licence"] is None and by[4][0]["licence"] is None
    assert by[4][0]["digest"] == hashlib.sha256(b"").hexdigest()
    assert {(tuple(r["notices"]), r["n_notices"]) for r in by[5]} == {(("CC-BY-4.0", "MIT"), 3), ((), 0)}
    assert licences.scan(odd, licences.known_licences(spark)).count() == len(TEXTS)
    assert licences.scan(nothing, licences.known_licences(spark)).count() == 0
    empty = licences.known_licences(spark).where(F.lit(False))
    assert licences.scan(odd, empty).where("licence IS NOT NULL OR n_notices > 0").count() == 0


def test_only_claims_are_dropped(spark):
    claims = ["Copyright (c) 2021 Others. All rights reserved.", "(c) Copyright 1990 Nobody", "© Somebody", "Copyright Jane Doe",
              "// (C) 2019 Somebody", "All rights reserved."]
    kept = ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE FOR", "copyright",
            "copyright owner or by an individual", "copyright law", "copyright licence to reproduce", "(c) You must retain all", "© holders"]
    rows = spark.createDataFrame([(0, "\n".join(claims)), (1, "\n".join(kept))], "id int, text string")
    lines = {r["id"]: r["lines"] for r in rows.select("id", licences.canonical_lines(F.col("text")).alias("lines")).collect()}
    assert lines[0] == [] and len(lines[1]) == len(kept)


def wrapped(text, width):
    """The paragraphs of a text, broken anew."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text))


def test_line_breaks_do_not_matter(spark):
    texts = [(n, t) for n, t in licences.KNOWN if "\n" in t]
    rows = [(n, "Copyright (c) 2020 Somebody\n\n" + wrapped(t, width)) for n, t in texts[:3] for width in (1, *range(20, 120, 3))]
    found = licences.scan(spark.createDataFrame(rows, "doc_id string, text string"), licences.known_licences(spark)).collect()
    assert len(found) == len(rows) and all(r["licence"] == r["id"] for r in found)


def test_full_texts_with_and_without_title(spark):
    """Every known text re-wrapped; paragraphs with a claim inside stay."""
    claim = re.compile(r"copyright (\(c\)|[\[<])", re.I)

    def again(text, width):
        parts = re.split(r"\n[ \t]*\n", text)
        return "\n\n".join(p if claim.search(p) else wrapped(p, width) for p in parts)

    texts = [(n, t) for n, t in licences.KNOWN if "\n" in t]
    rows = [(n, "Copyright (c) 2020 Somebody\n\n" + again(t, width)) for n, t in texts for width in (30, 72, 79, 100)]
    permission = licences.KNOWN[0][1]
    rows += [("MIT", f"MIT License\n\nCopyright (c) 2020 Somebody\n\n{permission}")]
    assert {"MIT", "ISC", "0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0",
            "MPL-2.0", "Unlicense", "CC0-1.0", "Zlib", "BSL-1.0"} <= {n for n, _ in rows}
    found = licences.scan(spark.createDataFrame(rows, "doc_id string, text string"), licences.known_licences(spark)).collect()
    wrong = {r["id"] for r in found if r["licence"] != r["id"]}
    assert len(found) == len(rows) and not wrong
    titles = licences.scan(spark.createDataFrame([(1, "ISC License")], "doc_id long, text string"), licences.known_licences(spark))
    assert titles.first()["notices"] == ["ISC"]
