import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from perfspark.llm import alignment, queries
from tests.llm.conftest import TEXTS

MORE = [
    (20, " leading and  double   spaces "), (21, "  "), (22, "a ▁ b"), (23, "tab\tnew\n\nline \n x"), (24, "<s> </s> <unk> <0x41> <|endoftext|>"),
    (25, "naïve café 𝔘𝔫𝔦 🎉🎉 ﬁ １２ é"), (26, "　wide space​"), (27, "the the the river river"), (28, "it's we'll don't"),
    (29, "nul\x00here \x1f"), (30, "x" * 500 + " 日本語のテキスト " * 20),
]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(queries.vocabulary_path())
    byte.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path("piece_bpe_32k.model"))
    return byte, pieces


def byte_level():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return table


def expected(texts):
    """The contract's figures, by the libraries and plain loops."""
    byte, pieces = libraries()
    table = byte_level()

    def split(text):
        a = byte.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        in_a = [bytes(table[c] for c in byte.id_to_token(i)) for i in a]
        in_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, pieces.id_to_piece(i)) for i in b)]
        if not text or b"".join(in_a) != (" " + text).encode() or b"".join(in_b) != (" " + text).encode():
            return [], [], []
        ends = lambda parts: [sum(map(len, parts[:i + 1])) for i in range(len(parts))]
        ea, eb = ends(in_a), ends(in_b)
        groups, before = [], 0
        for end in sorted(set(ea) & set(eb)):
            groups.append(([i for i, e in zip(a, ea) if before < e <= end], [i for i, e in zip(b, eb) if before < e <= end]))
            before = end
        return a, b, groups

    found = [split(t) for t in texts]
    links = [[(x, y) for ga, gb in g for x in ga for y in gb] for _, _, g in found]
    count = Counter(p for ls in links for p in set(ls))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = []
    for (a, b, groups), ls in zip(found, links):
        told = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        rows.append((len(a), len(b), len(groups), len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls),
                     hashlib.sha256(told.encode()).hexdigest() if a else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("broadcast_pairs", [1_000_000, 40])
def test_alignment_is_that_of_the_libraries(spark, odd, broadcast_pairs):
    """With few broadcast pairs the others come back through the shuffle."""
    short = odd.where(F.coalesce(F.length("text"), F.lit(0)) < 5000).unionByName(
        spark.createDataFrame(MORE, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in short.collect()]
    got = alignment.aligned(short, queries.vocabulary_path(), queries.vocabulary_path("piece_bpe_32k.model"),
                            broadcast_pairs=broadcast_pairs).select("id", *COLUMNS).collect()
    want = [(i, *r) for (i, _), r in zip(rows, expected([t or "" for _, t in rows]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000")
    rows = docs.select("doc_id", "text").collect()
    got = alignment.aligned(docs, queries.vocabulary_path(), queries.vocabulary_path("piece_bpe_32k.model"), with_groups=True)
    got = {r["id"]: r for r in got.collect()}
    for (i, _), want in zip(rows, expected([r["text"] or "" for r in rows])):
        assert tuple(got[i][c] for c in COLUMNS) == want
        assert not want[0] or hashlib.sha256(got[i]["groups"].encode()).hexdigest() == want[-1]


def test_long_and_missing(spark, odd, nothing):
    assert alignment.aligned(nothing, queries.vocabulary_path(), queries.vocabulary_path("piece_bpe_32k.model")).count() == 0
    rows = alignment.aligned(odd, queries.vocabulary_path(), queries.vocabulary_path("piece_bpe_32k.model"))
    got = {(r["id"], r["n_a"] > 0) for r in rows.collect()}
    assert (9, True) in got and (3, False) in got and (None, False) in got and (4, False) in got
    assert rows.count() == len(TEXTS)
