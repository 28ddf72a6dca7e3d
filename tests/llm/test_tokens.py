import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from perfspark.llm import token_files, tokens
from perfspark.runtime import new_folder
from tests.llm.conftest import SF, TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", " ", "  ", "\n", "'", "s", "ll", "9", "é", "日", "!", "_", "\t", " ", "<|endoftext|>", "́", " ", "🎉"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module", params=[tokens.Encoder, token_files.LibraryEncoder])
def encoder(request):
    made = request.param(tokens.Vocabulary(PATH) if request.param is tokens.Encoder else PATH, 50)
    made.start()
    return made


def test_equal_to_the_library(encoder, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(3000)] + [t or "" for _, t in TEXTS]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(encoder.encode(text)) == ids
        assert encoder.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_decode_of_cut_characters(encoder, library):
    ids = library.encode("日本語 🎉", add_special_tokens=False).ids
    for part in (ids[1:], ids[:-1], ids[::-1]):
        assert encoder.decode(part).decode() == library.decode(part, skip_special_tokens=False)


def test_round_trip_rows(odd, nothing, library):
    got = tokens.round_trip(odd, PATH, with_ids=True).collect()
    assert len(got) == len(TEXTS) and tokens.round_trip(nothing, PATH).count() == 0
    want = sorted((i is None, i or 0, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in TEXTS)
    got = sorted((r["id"] is None, r["id"] or 0, list(r["ids"]), r) for r in got)
    for (_, _, ids, text), (_, _, have, row) in zip(want, got):
        assert ids == have and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = tokens.decoded(tokens.encoded(odd, PATH), PATH).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), max_size=3000), st.integers(1, 100))
def test_packing_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    blocks, sizes = token_files.pack(ids, percentile)
    starts = np.append(0, np.cumsum(sizes))[:-1].astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    assert (token_files.unpack(blocks, starts) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(1024, dtype=np.uint32) % 8 + 1000
    plain, _ = token_files.pack(ids)
    ids[[3, 500]] = 4_000_000_000
    patched, _ = token_files.pack(ids)
    assert len(patched) == len(plain) + 2 * 6


def check_files(spark, docs, rows, library, file_ids):
    folder = new_folder(spark)
    if folder.startswith("/"):
        folder = "file://" + folder
    manifest = token_files.write(docs, folder, PATH, 2, file_ids=file_ids)
    got = token_files.placed(token_files.read(spark, folder), manifest).orderBy("start").collect()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    start = 0
    for r, (i, text) in zip(got, rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert manifest.count() > 1 or file_ids > start or not rows
    return folder


def test_token_files(spark, odd, nothing, library):
    folder = check_files(spark, odd, TEXTS, library, 2000)
    stored = {(r["doc_id"], len(r["ids"])) for r in token_files.read_ids(spark, folder).collect()}
    assert (4, 1) in stored
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_files(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()], library, 10_000)
    folder = new_folder(spark)
    assert token_files.write(nothing, folder, PATH, 2).count() == 0


def test_damage_is_noticed():
    content = token_files.file_bytes(np.arange(5000, dtype=np.uint32), [1, None], [4000, 1000])
    assert token_files.file_content(content)[1] == [1, None]
    with pytest.raises(ValueError):
        token_files.file_content(b"x" + content[1:])
