import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from perfspark.llm import html_text, quality, toxicity
from tests.llm.conftest import TEXTS

BIG = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    rows = entry.queries()[name](spark, BIG)
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    assert rows.count() == spark.read.parquet(f"{BIG}/documents.parquet").count()
    out = rows.where("held_out").join(labels, "doc_id").toPandas()
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    return out


@pytest.mark.parametrize("name, label, rare, fold", [("op8_toxicity", "toxic", 1, (5, 0)), ("op10_quality", "quality", 0, (3, 1))])
def test_held_out_rows(spark, name, label, rare, fold):
    out = held_out(spark, name, label)
    assert all(zlib.crc32(str(i).encode()) % fold[0] == fold[1] for i in out["doc_id"])
    right = out["predicted"] == out["label"]
    assert right.mean() > 0.97
    assert right[out["label"] == rare].mean() > 0.9
    assert right[out["label"] != rare].mean() > 0.98


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, odd, nothing, module, label):
    """Scores of odd texts, and of models without rows or without a class."""
    for given in ([(1, 1), (2, 0), (5, None), (None, 1), (2, 0)], [(1, 1)], [(99, 1)], []):
        labels = spark.createDataFrame(given, f"doc_id long, {label} int")
        model = module.trained(odd, labels)
        scores = [r["score"] for r in module.scored(odd, model).collect()]
        assert len(scores) == len(TEXTS) and all(0 <= s <= 1 for s in scores)
        assert module.scored(nothing, model).count() == 0
    kept = quality.good_documents(odd, quality.trained(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int")))
    assert kept.columns == odd.columns and kept.count() == len(TEXTS)


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    sizes, links = [1, 4, 6, 3], rng.normal(size=(2, 2))
    unary = rng.normal(size=sum(sizes)) * 2
    starts = np.append(0, np.cumsum(sizes))[:-1]
    good, pairs, norm = quality.marginals(unary, links, starts)
    total, want_pairs = 0.0, np.zeros((2, 2))
    for at, n in zip(starts, sizes):
        weight, mass, both = np.zeros(n), 0.0, np.zeros((2, 2))
        for code in range(2 ** n):
            labels = [code >> i & 1 for i in range(n)]
            score = np.exp(sum(unary[at + i] * y for i, y in enumerate(labels)) + sum(links[a, b] for a, b in zip(labels, labels[1:])))
            mass += score
            weight += score * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                both[a, b] += score
        assert np.allclose(good[at:at + n], weight / mass)
        total += np.log(mass)
        want_pairs += both / mass
    assert np.isclose(norm, total) and np.allclose(pairs, want_pairs)


def test_network_gradient():
    rng = np.random.default_rng(1)
    h, w = toxicity.HIDDEN, 2 * toxicity.WIDTH
    p = {k: rng.normal(size=s) * 0.4 for side in "fr" for k, s in (
        ("W" + side, (w, 3 * h)), ("U" + side, (h, 3 * h)), ("b" + side, 3 * h))}
    p |= {"A": rng.normal(size=(2 * h, h)), "v": rng.normal(size=h), "o": rng.normal(size=2 * h), "c": np.array(0.1)}
    table = np.vstack([rng.normal(size=(6, w)), np.zeros((1, w))])
    ids = rng.integers(0, 6, (3, toxicity.WINDOW))
    ids[1, 20:] = 6
    slope = np.array([0.5, -1.0, 0.7])
    _, cache = toxicity.forward(table, ids, p, keep=True)
    grads, _ = toxicity.backward(table, ids, p, cache, slope)
    for name in p:
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        moved = {k: v.copy() for k, v in p.items()}
        step = 1e-2
        moved[name][at] += step
        up = (toxicity.forward(table, ids, moved) * slope).sum()
        moved[name][at] -= 2 * step
        down = (toxicity.forward(table, ids, moved) * slope).sum()
        assert np.isclose((up - down) / (2 * step), grads[name][at], rtol=0.05, atol=2e-3), name


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 500):
        covered = {i for a in toxicity.windows(n) for i in range(a, a + toxicity.WINDOW)}
        assert set(range(n)) <= covered


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav>
<!-- <p>note</p> --><script>var t = "</p>";</script><article><h1>A &amp; B</h1><p>First  <b>bold</b>
text &eacute;t&#233;.<p>Second<br>line</article><footer>&copy; me</footer>"""


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.trained(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_main_text(spark, trees):
    rows = [(1, "u", PAGE, "c"), (2, None, None, "c"), (None, "u", "", "c"), (3, "u", "<p", "c"), (3, "u", "<p", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_text.texts(pages, trees).collect()]
    want = "A & B\nFirst bold text été.\nSecond line"
    assert got[0] == (1, "u", want, len(want)) and got[1] == (2, None, "", 0) and got[2] == (None, "u", "", 0)
    assert len(got) == 5 and html_text.texts(pages.where("page_id < 0"), trees).count() == 0


def test_given_pages(spark, trees):
    """The article of pages that were not learnt from, read by its markup."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = html_text.texts(pages, trees).join(pages.select("page_id", "html"), "page_id").toPandas()
    wrong = 0
    for markup, text in zip(got["html"], got["text"]):
        body = re.search("<article>(.*)</article>", markup, re.S)[1]
        blocks = [re.sub("<[^>]*>", "", b.replace("<br>", " ")) for b in re.split("</?(?:p|h1)>", body)]
        wrong += "\n".join(" ".join(html_text.html.unescape(b).split()) for b in blocks if b.strip()) != text
    assert wrong <= 0.01 * len(got)


def test_no_kept_node_below_a_dropped_one(trees):
    page = html_text.parse(PAGE)
    rng = np.random.default_rng(0)
    for _ in range(20):
        score = rng.normal(size=len(page.parent))
        keep = html_text.decode(page, score)
        assert all(keep[page.parent[i]] for i in np.flatnonzero(keep) if i)


def test_training_without_named_parts(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string")
    assert html_text.texts(pages, html_text.trained(pages)).first()["text"] == "a"


def test_trees_learn_a_rule():
    rng = np.random.default_rng(2)
    rows = rng.random((2000, 5))
    labels = ((rows[:, 1] > 0.5) ^ (rows[:, 3] > 0.3)).astype(float)
    made = html_text.fit_trees(rows, labels)
    assert ((made.score(rows) > 0) == (labels > 0)).mean() > 0.97
    assert isinstance(pd.Series(made.score(rows[:1])), pd.Series)
