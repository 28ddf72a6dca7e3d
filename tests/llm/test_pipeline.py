import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from perfspark.llm import queries
from tests.llm.conftest import SF, squeezed
from tests.llm.test_duplicates import roots, simhash
from tests.llm.test_text_scans import hits


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    good = corpus_pipeline.good_quality(spark, docs, SF)
    assert good.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in queries.op10_quality(spark, SF).collect()}
    rows = sorted((r["doc_id"], r["text"] or "") for r in good.collect())
    assert [i for i, _ in rows] == sorted(i for i, kept in scores.items() if kept)

    groups = {}
    for i, text in rows:
        groups.setdefault(squeezed(text), []).append((-len(text), i, text))
    rows = sorted((i, text) for _, i, text in map(min, groups.values()))

    component = roots({simhash(t) for _, t in rows})
    first = {}
    for i, text in rows:
        first.setdefault(component[simhash(text)], (i, text))
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    rows = sorted((i, t) for i, t in first.values() if not hits(t, items)[3])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(corpus_pipeline.run(spark, SF).collect())
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for r, (_, text) in zip(got, rows):
        assert list(r["ids"]) == library.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_every_stage_takes_odd_and_no_rows(spark, odd, nothing):
    for rows in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert name == "bpe" or out.columns == rows.columns
            out.count()


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
