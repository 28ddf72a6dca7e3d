"""Byte-level BPE: encoding with a priority queue of merge ranks over a doubly
linked symbol list, and decoding by concatenating vocabulary strings.

The vocabulary file (JSON with ``model.vocab``, ``model.merges`` and
``added_tokens``) is read on the driver and broadcast; its size does not grow
with the data.  A task looks words up in a bounded memory of words that it has
met and runs the merges for the others.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfspark.llm.common import ship, shipped

#: Pieces of text remembered by a task process.  More only saves time.
REMEMBERED = 600_000
#: Marks that often end a piece; each is a word of its own.
MARKS = ".,;:!?)"
#: Longest unit that is remembered.
LONGEST = 64

#: Fixed value: how byte-level vocabularies split text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Documents whose ids a task holds before it hands them on.
HELD = 256

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters
    for themselves, the others from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Memory(dict):
    """A bounded memory of two generations: what is not used while one
    generation fills up is forgotten."""

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size // 2, {}

    def __missing__(self, key):
        value = self.old.get(key) or self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Merges and strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids = content["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.of_byte = [ids[c] for c in symbols]
        self.merges: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left], ids[right]] = rank
            self.merged.append(ids[left + right])
        self.added = {t["content"]: t["id"] for t in content["added_tokens"]}
        strings = dict.fromkeys(range(1 + max([*ids.values(), *self.added.values()])), b"")
        for string, i in (ids | self.added).items():
            known = all(c in byte_of for c in string)
            strings[i] = bytes(byte_of[c] for c in string) if known else string.encode()
        self.strings = [strings[i] for i in sorted(strings)]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word.  The queue holds (rank, position of the left
        symbol); an entry is stale when the pair at its position is no longer
        the one that has its rank."""
        symbols = [self.of_byte[b] for b in word]
        n = len(symbols)
        if n < 2:
            return symbols
        rank_of, merged = self.merges.get, self.merged
        queue = []
        for i, pair in enumerate(zip(symbols, symbols[1:])):
            rank = rank_of(pair)
            if rank is not None:
                queue.append(rank << 40 | i)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while queue:
            entry = pop(queue)
            i, rank = entry & 0xFFFFFFFFFF, entry >> 40
            j = after[i]
            if j >= n or symbols[i] < 0 or rank_of((symbols[i], symbols[j])) != rank:
                continue
            new = symbols[i] = merged[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            before[k] = i
            if k < n:
                rank = rank_of((new, symbols[k]))
                if rank is not None:
                    push(queue, rank << 40 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of((symbols[h], new))
                if rank is not None:
                    push(queue, rank << 40 | h)
        return [s for s in symbols if s >= 0]


class Encoder:
    """Text to ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.ready = False

    def start(self) -> None:
        """Made in the task process, once."""
        import regex

        self.pattern = regex.compile(SPLIT)
        self.special = re.compile("|".join(map(re.escape, self.vocabulary.added)))
        self.words = Memory(self.word_ids, self.remembered // 4)
        self.pieces = Memory(self.piece_ids, self.remembered)
        self.marks = {m: self.word_ids(m) for m in MARKS}
        self.numerals = [str(i) for i in range(len(self.vocabulary.strings))]
        self.ready = True

    def word_ids(self, word: str) -> bytes:
        return array("I", self.vocabulary.merge(word.encode("utf-8", "surrogatepass"))).tobytes()

    def piece_ids(self, piece: str) -> bytes | None:
        """Of a space and the text up to the next one; None where that space
        does not start a word.  Letters alone are one word, a mark behind them
        another."""
        if piece.isalpha():
            return self.word_ids(" " + piece)
        end = piece[-1:]
        if not end or end.isspace():
            return None
        mark = self.marks.get(end)
        if mark is not None and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + mark
        return self.unit_ids(" " + piece)

    def unit_ids(self, unit: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(unit)))

    def plain(self, text: str) -> bytes:
        """A space before a character that is not white space starts a word,
        whatever precedes it; so a text may be cut there and its pieces looked
        up whole, unless white space stands before such a space."""
        first, *rest = text.split(" ")
        if not rest:
            return self.unit_ids(text)
        last = rest.pop()
        if last and not first[-1:].isspace():
            try:
                return self.unit_ids(first) + b"".join(map(self.pieces.__getitem__, rest)) + self.unit_ids(" " + last)
            except TypeError:  # a piece without ids of its own
                pass
        return self.unit_ids(text)

    def encode(self, text: str) -> array:
        """Ids of a text; strings of added tokens become their ids."""
        if not self.ready:
            self.start()
        ids, at = array("I"), 0
        for found in self.special.finditer(text) if any(map(text.__contains__, self.vocabulary.added)) else ():
            ids.frombytes(self.plain(text[at:found.start()]))
            ids.append(self.vocabulary.added[found[0]])
            at = found.end()
        ids.frombytes(self.plain(text[at:] if at else text))
        return ids

    def decode(self, ids) -> bytes:
        """The vocabulary strings one after the other, as bytes of a text."""
        return b"".join(map(self.vocabulary.strings.__getitem__, ids)).decode("utf-8", "replace").encode()

    def listed(self, ids) -> bytes:
        """Decimal ids joined by commas."""
        return ",".join(map(self.numerals.__getitem__, ids)).encode()


def shared_encoder(spark: SparkSession, path: str, remembered: int = REMEMBERED):
    """The encoder of a vocabulary file as a broadcast; its word memory lives
    as long as the task process."""
    return ship(spark, Encoder(Vocabulary(path), remembered))


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
            remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` as (id, ids): the token ids of every whole text.  Null is the
    empty text, which has no ids; repeated rows stay."""
    encoder = shared_encoder(docs.sparkSession, path, remembered)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shipped(encoder).encode(t or ""))

    return docs.select(F.col(doc_id).alias("id"), ids(F.coalesce(F.col(text), F.lit(""))).alias("ids"))


def decoded(rows: DataFrame, path: str, doc_id: str = "id", ids: str = "ids") -> DataFrame:
    """``rows`` as (id, text): the text of every list of ids (null: empty)."""
    encoder = shared_encoder(rows.sparkSession, path)

    @F.pandas_udf(T.StringType())
    def text(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: shipped(encoder).decode([] if x is None else list(x)).decode())

    return rows.select(F.col(doc_id).alias("id"), text(F.col(ids)).alias("text"))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
               remembered: int = REMEMBERED, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text in one pass: (id, n_tokens,
    ids_sha256, decoded_sha256), one row per row of ``docs``, on request with
    the ids, which else never leave the task.  A task holds the ids of ``HELD``
    documents at once."""
    encoder = shared_encoder(docs.sparkSession, path, remembered)
    rows = docs.select(F.col(doc_id).alias("id"), whole(text).alias("text"))
    fields = T.StructType.fromDDL(RESULT + (", ids array<int>" if with_ids else "")).fields

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                part, tool = batch.slice(at, HELD), shipped(encoder)
                sizes, digests, backs, kept = [], [], [], []
                for value in part.column(1).to_pylist():
                    ids = tool.encode(value)
                    sizes.append(len(ids))
                    digests.append(hashlib.sha256(tool.listed(ids)).hexdigest())
                    backs.append(hashlib.sha256(tool.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(np.frombuffer(ids, np.int32))
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(backs)]
                if with_ids:
                    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", *[f.name for f in fields]])

    return rows.mapInArrow(made, T.StructType([rows.schema["id"], *fields]))


def whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))
