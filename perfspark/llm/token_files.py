"""Token ids in binary files: patched frame-of-reference blocks.

A file holds ids of whole documents in ascending order of their ids, in blocks
of ``BLOCK``.  A block stores its least id, a bit width chosen at a percentile
of its differences, the low bits of all differences packed at that width, and
the positions and values of those that need more.  Behind the blocks stand
their starting bytes, then the documents' ids and lengths, then a footer.  All
numbers are little-endian.

Spark sorts the texts into ranges and every task writes its own range, file by
file, under a name that only depends on its place, by way of a temporary name:
a task that runs again leaves the same files.  Files are read back as Spark's
binary files, one at a time.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perfspark.llm.common import ship, shipped, whole_text
from perfspark.llm.tokens import REMEMBERED, SPLIT, Encoder, Vocabulary
from perfspark.runtime import materialize, small_side

BLOCK = 1024
#: Share of a block's differences that its width must hold.
PERCENTILE = 90
#: Ids after which a file ends, at the end of a document.
FILE_IDS = 4_000_000
#: Blocks that are packed or unpacked at once.
TOGETHER = 256
MAGIC = b"PFORTOK1"
#: Least id, width, ids, exceptions.
HEAD = "<IBHH"
#: Ids, blocks, documents, where the block starts begin.
FOOT = "<QQQQ8s"


def _widths(differences: np.ndarray) -> np.ndarray:
    return np.frexp(differences.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Blocks of the ids (uint32), and the bytes each of them takes."""
    out, sizes = [], []
    full = len(ids) // BLOCK * BLOCK
    for at in range(0, full, BLOCK * TOGETHER):
        rows = ids[at:min(at + BLOCK * TOGETHER, full)].reshape(-1, BLOCK)
        _pack_rows(rows, percentile, out, sizes)
    if full < len(ids):
        _pack_rows(ids[full:].reshape(1, -1), percentile, out, sizes)
    return b"".join(out), np.array(sizes, "<u8")


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low bits of every row's values one after the other, from the lowest
    bit on.  Eight values fill ``width`` bytes; every byte is put together from
    the values that reach into it."""
    rows, n = values.shape
    if not width:
        return np.zeros((rows, 0), np.uint8)
    grouped = np.zeros((rows, -(-n // 8) * 8), np.uint64 if width > 16 else np.uint32)
    grouped[:, :n] = values
    grouped = (grouped & ((1 << width) - 1)).reshape(rows, -1, 8)
    out = np.empty((rows, grouped.shape[1], width), np.uint8)
    for k in range(width):
        byte = 0
        for i in range(8 * k // width, min((8 * k + 7) // width, 7) + 1):
            shift = i * width - 8 * k
            byte = byte | (grouped[:, :, i] << shift if shift >= 0 else grouped[:, :, i] >> -shift)
        out[:, :, k] = byte & 255
    return out.reshape(rows, -1)[:, :(n * width + 7) // 8]


def unpack_bits(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    """Rows of ``n`` values of ``width`` bits."""
    rows = len(packed)
    if not width:
        return np.zeros((rows, n), np.uint32)
    groups = -(-n // 8)
    wide = np.uint64 if width > 16 else np.uint32
    padded = np.zeros((rows, groups * width), wide)
    padded[:, :packed.shape[1]] = packed
    padded = padded.reshape(rows, groups, width)
    out = np.empty((rows, groups, 8), np.uint32)
    for i in range(8):
        value = 0
        for k in range(i * width // 8, (i * width + width - 1) // 8 + 1):
            shift = 8 * k - i * width
            value = value | (padded[:, :, k] << shift if shift >= 0 else padded[:, :, k] >> -shift)
        out[:, :, i] = value & ((1 << width) - 1)
    return out.reshape(rows, -1)[:, :n]


def _pack_rows(rows: np.ndarray, percentile: int, out: list, sizes: list) -> None:
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    need = _widths(rest)
    place = min((rows.shape[1] * percentile + 99) // 100, rows.shape[1]) - 1
    widths = np.partition(need, place, axis=1)[:, place]
    packed: dict[int, bytes] = {}
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        flat = pack_bits(rest[chosen], int(width))
        for i, row in zip(chosen, flat):
            packed[i] = row.tobytes()
    over = need > widths[:, None]
    for i in range(len(rows)):
        at = np.flatnonzero(over[i])
        block = struct.pack(HEAD, int(least[i]), int(widths[i]), rows.shape[1], len(at)) + packed[i] + at.astype(
            "<u2").tobytes() + rest[i, at].astype("<u4").tobytes()
        out.append(block)
        sizes.append(len(block))


def unpack(content: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at the given bytes."""
    heads = [struct.unpack_from(HEAD, content, s) for s in starts]
    ends = np.cumsum([h[2] for h in heads]) if heads else np.zeros(0, int)
    ids = np.empty(int(ends[-1]) if heads else 0, np.uint32)
    by_shape: dict[tuple[int, int], list[int]] = {}
    for i, (_, width, n, _) in enumerate(heads):
        by_shape.setdefault((width, n), []).append(i)
    for (width, n), members in by_shape.items():
        size = (n * width + 7) // 8
        for at in range(0, len(members), TOGETHER):
            some = members[at:at + TOGETHER]
            raw = np.stack([np.frombuffer(content, np.uint8, size, int(starts[i]) + struct.calcsize(HEAD)) for i in some])
            values = unpack_bits(raw, n, width)
            for i, row in zip(some, values):
                least, _, _, extra = heads[i]
                if extra:
                    after = int(starts[i]) + struct.calcsize(HEAD) + size
                    row[np.frombuffer(content, "<u2", extra, after)] = np.frombuffer(content, "<u4", extra, after + 2 * extra)
                ids[ends[i] - n:ends[i]] = row + np.uint32(least)
    return ids


def file_bytes(ids: np.ndarray, doc_ids: list, lengths: list[int], percentile: int = PERCENTILE) -> bytes:
    """A whole file.  A null document id is flagged."""
    blocks, sizes = pack(ids, percentile)
    starts = len(MAGIC) + np.append(0, np.cumsum(sizes))[:-1].astype("<u8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    foot = struct.pack(FOOT, len(ids), len(sizes), len(doc_ids), len(MAGIC) + len(blocks), MAGIC)
    return b"".join([MAGIC, blocks, starts.astype("<u8").tobytes(), named.tobytes(), np.array(lengths, "<i8").tobytes(),
                     null.tobytes(), foot])


def file_content(content: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """Ids, document ids and lengths of a file."""
    n_ids, n_blocks, n_docs, at, magic = struct.unpack_from(FOOT, content, len(content) - struct.calcsize(FOOT))
    if magic != MAGIC or content[:len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    starts = np.frombuffer(content, "<u8", n_blocks, at)
    at += 8 * n_blocks
    named = np.frombuffer(content, "<i8", n_docs, at)
    lengths = np.frombuffer(content, "<i8", n_docs, at + 8 * n_docs)
    null = np.frombuffer(content, np.uint8, n_docs, at + 16 * n_docs)
    ids = unpack(content, starts)
    if len(ids) != n_ids:
        raise ValueError("token file is cut short")
    return ids, [None if z else int(d) for d, z in zip(named, null)], lengths


class LibraryEncoder(Encoder):
    """As ``Encoder``, by a library.

    A byte-level BPE file whose merges make ids in ascending order is a list of
    ranks, with which tiktoken encodes whole texts; any other file is left to
    ``Encoder``.  Strings of added tokens become their ids, or with ``as_text``
    are ordinary text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, as_text: bool = False):
        super().__init__(Vocabulary(path), remembered)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        splits, model, merged = content.get("pre_tokenizer") or {}, content["model"], self.vocabulary.merged
        self.as_text = as_text
        self.ranked = (
            splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
            and not content.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in content["added_tokens"])
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(x < y for x, y in zip([max(self.vocabulary.of_byte), *merged], merged))
        )

    def start(self) -> None:
        super().start()
        if self.ranked:
            import tiktoken

            words = self.vocabulary
            ranks = {words.strings[i]: i for i in [*words.of_byte, *words.merged]}
            known = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={} if self.as_text else words.added)
            self.run = partial(known.encode_to_numpy, allowed_special="all", disallowed_special=())
        else:
            self.run = lambda text: np.frombuffer(self.plain(text) if self.as_text else super(LibraryEncoder, self).encode(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Ids (unsigned 32-bit) of a text."""
        if not self.ready:
            self.start()
        return self.run(text)


def write(docs: DataFrame, folder: str, path: str, end: int, doc_id: str = "doc_id", text: str = "text",
          file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of every whole text, each followed by ``end``, to files in
    ``folder`` (a URI that the tasks can write to), in ascending order of id.

    Returns the manifest, one row per file: file, first_id, n_ids, n_docs.
    Null is the empty text; a null id sorts first; equal ids by their texts.
    """
    spark = docs.sparkSession
    encoder = ship(spark, LibraryEncoder(path))

    def store(name: str, content: bytes) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        part = f"{base}/_{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as stream:
            stream.write(content)
        system.move(part, f"{base}/{name}")

    def written(batches):
        import pyarrow as pa

        place, number = TaskContext.get().partitionId(), 0
        parts, names, lengths, held = [], [], [], 0
        stop = np.array([end], np.uint32)

        def closed():
            name = f"{place:06d}-{number:05d}.pfor"
            store(name, file_bytes(np.concatenate(parts), names, lengths))
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), *[pa.array([v], pa.int64()) for v in (names[0], held, len(names))]],
                names=["file", "first_id", "n_ids", "n_docs"])

        tool = shipped(encoder)
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = tool.encode(value.as_py())
                parts += (found, stop)
                names.append(doc)
                lengths.append(len(found) + 1)
                held += len(found) + 1
                if held >= file_ids:
                    yield closed()
                    number += 1
                    parts, names, lengths, held = [], [], [], 0
        if names:
            yield closed()

    # rows that share an id, or have none, are dealt by their texts
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), whole_text(text).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("place"))
    ranged = rows.repartitionByRange("id", "place").sortWithinPartitions("id", "place", "text").drop("place")
    return materialize(ranged.mapInArrow(written, "file string, first_id long, n_ids long, n_docs long"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files: file, position (in the file), doc_id, start
    (ids before it in the file), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def listed(frames):
        for frame in frames:
            for file, content in zip(frame["file"], frame["content"]):
                ids, names, lengths = file_content(content)
                ends = np.cumsum(lengths)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                yield pd.DataFrame({
                    "file": file, "position": np.arange(len(names)), "doc_id": pd.array(names, "Int64"),
                    "start": ends - lengths, "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(raw[4 * int(e - n):4 * int(e)]) for e, n in zip(ends, lengths)],
                })

    return files.mapInPandas(
        listed, "file string, position long, doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files with their ids: file, position, doc_id, ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def listed(frames):
        for frame in frames:
            for file, content in zip(frame["file"], frame["content"]):
                ids, names, lengths = file_content(content)
                ends = np.cumsum(lengths)
                for i, name in enumerate(names):
                    yield pd.DataFrame({"file": [file], "position": [i], "doc_id": pd.array([name], "Int64"),
                                        "ids": [ids[ends[i] - lengths[i]:ends[i]].astype(np.int64)]})

    return files.mapInPandas(listed, "file string, position long, doc_id long, ids array<long>")


def placed(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """``documents`` with the start counted over all files."""
    # one row per file: a file stands for millions of ids
    before = Window.orderBy("first_id", "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))
    return documents.join(small_side(offsets), "file").withColumn("start", F.col("start") + F.col("offset")).drop("offset")


def default_folder(spark: SparkSession) -> str:
    """A new folder for token files beside the intermediate tables."""
    from perfspark.runtime import new_folder

    return os.path.join(new_folder(spark), "tokens")
