"""Alignment of the tokens of two tokenizers, and how often their ids meet.

Every text, behind a space, is tokenised whole by a byte-level BPE (A) and by a
piece BPE (B).  Byte offsets where a token of A and one of B both end cut the
tokens into groups; all occurrences of A and B in one group are linked.  Shared
ends that precede a space-marked token of either side are the anchors: the
document falls into windows of token ids between anchors, and a window's groups
depend on its ids alone, so a task aligns a tuple of ids once and remembers it.

How many documents hold a pair of ids linked is counted over the distinct pairs
of every document.  The counts go back to the documents in two ways, whatever
their number: the most frequent pairs, as many as a bound allows, in a broadcast
join, which also takes the hot keys; the others in a shuffled join.  Pairs of a
single document, unless they are the best of their A id, need neither.

Defined cases: null, empty, and texts whose tokens do not spell them byte by byte
(such as texts with U+2581) have no tokens and all figures zero; every row is a
document of its own, repeated or without id.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfspark.llm.common import ship, shipped, whole_text
from perfspark.llm.token_files import LibraryEncoder
from perfspark.llm.wordwise import NO_ID, Remembered, Wordwise, joined_ids
from perfspark.runtime import materialize

#: Words of either side, and windows, that a task remembers.  More only saves time.
REMEMBERED = 150_000
#: Bytes of text that a task aligns at once (a longer text is taken alone).
TOGETHER = 1 << 20
#: Pairs of ids whose counts are broadcast, at most (16 bytes each).
BROADCAST_PAIRS = 1_000_000
#: Between the ids of A and of B in a window's key.
BREAK = NO_ID
SPACE = "▁"


class PieceEncoder:
    """Ids of a sentencepiece BPE model with byte fallback, and their bytes.

    No piece holds a space behind another character, so merges never cross the
    start of a run of spaces, and a text may be cut there.  With other models a
    text is one unit.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, "rb") as file:
            self.source = file.read()
        self.remembered = remembered

    def start(self) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=self.source)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.blank = np.array([pieces.index(SPACE)] if SPACE in pieces else [BREAK], np.uint32).tobytes()
        apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.words = Wordwise(self.fresh, "  |^ | $" if apart else "^", self.units if apart else lambda t: [" " + t], self.remembered)

    def units(self, text: str) -> list[str]:
        """Runs of spaces with what follows."""
        return re.findall(" +[^ ]*", " " + text)

    def single(self, unit: str) -> bytes:
        """Ids of one unit; NO_ID if they spell something else."""
        if unit == " ":
            return self.blank
        ids = self.model.encode(unit[1:])
        spelt = b"".join(map(self.bytes.__getitem__, ids)) == unit.encode("utf-8", "surrogatepass")
        return np.array(ids if spelt else [BREAK], np.uint32).tobytes()

    def fresh(self, units: list[str]) -> list[bytes]:
        """Units are encoded as one text where that spells them."""
        def spelt(text):
            ids = self.model.encode(text[1:])
            return ids if b"".join(map(self.bytes.__getitem__, ids)) == text.encode("utf-8", "surrogatepass") else []

        joint = [i for i, u in enumerate(units) if len(u) > 1 and u[1] != " " and u[-1] != " "]
        out: list = [None] * len(units)
        for i, found in zip(joint, joined_ids([units[i] for i in joint], spelt, self.length)):
            out[i] = found
        return [self.single(u) if found is None else found for u, found in zip(units, out)]


def _strings(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


class Windows:
    """Alignment of windows, given as keys: ids of A, a break, ids of B."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (a_bytes, b_bytes))
        # an id and what follows it: "," or, behind the last of its group, "|" or ";"
        self.told = [f"{i}{c}" for side, ends in ((a_bytes, ",|"), (b_bytes, ",;")) for i in range(len(side)) for c in ends]
        self.told_size = np.array([len(t) for t in self.told], np.int64)

    def aligned(self, keys: list[bytes]) -> list[tuple[int, int, str, bytes]]:
        """Of every window: groups, links, the groups as text (each followed by
        ";"), and the linked pairs (a << 32 | b)."""
        ids = np.frombuffer(b"".join(keys), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, keys), np.int64, len(keys)) // 4
        breaks = ids == BREAK
        window = np.repeat(np.arange(len(keys)), size)
        behind = np.cumsum(breaks)[np.cumsum(size) - 1]
        # tokens of B stand behind the break of their window
        in_b = (np.cumsum(breaks) == np.repeat(behind, size)) & ~breaks
        in_a = ~in_b & ~breaks
        a, b, a_window = ids[in_a], ids[in_b], window[in_a]
        a_ends, b_ends = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        n_a, n_b = np.bincount(a_group, minlength=len(shared)), np.bincount(b_group, minlength=len(shared))
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        of = a_window[stop_a - 1]  # the window of a group
        each = n_b[a_group]
        done = np.cumsum(each)
        pairs = np.repeat(a, each) << 32 | b[np.repeat((stop_b - n_b)[a_group] - (done - each), each) + np.arange(done[-1])]
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + (stop_b - n_b)[a_group]] = 2 * a + (np.arange(len(a)) == stop_a[a_group] - 1)
        code[np.arange(len(b)) + stop_a[b_group]] = 2 * (len(self.a_size) + b) + (np.arange(len(b)) == stop_b[b_group] - 1)
        text = "".join(map(self.told.__getitem__, code.tolist()))
        text_stop = np.cumsum(self.told_size[code])[(stop_a + stop_b)[np.searchsorted(of, np.arange(len(keys)), side="right") - 1] - 1]
        groups, links = np.bincount(of, minlength=len(keys)), np.bincount(a_window, each, len(keys)).astype(np.int64)
        raw, at = pairs.astype(np.uint64).tobytes(), (8 * np.cumsum(links)).tolist()
        text_at = text_stop.tolist()
        return [(g, n, text[s:e], raw[p:q]) for g, n, s, e, p, q in zip(
            groups.tolist(), links.tolist(), [0, *text_at], text_at, [0, *at], at)]


class Aligner:
    """Both encoders and the memory of windows; lives as long as the task process."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED):
        self.a, self.b = LibraryEncoder(path_a, as_text=True), PieceEncoder(path_b, remembered)
        self.remembered, self.ready = remembered, False

    def start(self) -> None:
        self.a.start()
        self.b.start()
        strings = self.a.vocabulary.strings
        self.a_size, self.b_size = np.array([len(s) for s in strings], np.int64), self.b.length
        self.a_marked, self.b_marked = (np.array([s[:1] == b" " for s in side]) for side in (strings, self.b.bytes))
        self.windows = Remembered(Windows(strings, self.b.bytes).aligned, self.remembered)
        self.ready = True

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, tokens of A in every text, and the same of B; none for
        texts that the tokens do not spell."""
        spaced = [" " + t for t in texts.to_pylist()]
        found = [self.a.encode(t) for t in spaced]
        n_a = np.array([len(f) for f in found], np.int64)
        a = np.concatenate(found)
        ends, b = self.b.words.encode(texts)
        n_b = np.diff(ends, prepend=0)
        bytes_ = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        total = lambda sizes, n: np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n))])
        lost = b == BREAK
        good = (bytes_ > 1) & (total(self.a_size[a], n_a) == bytes_)
        good &= (total(lost, n_b) == 0) & (total(np.where(lost, 0, self.b_size[np.where(lost, 0, b)]), n_b) == bytes_)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        return a, n_a, b, n_b

    def align(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Columns of ``FIELDS`` for some texts: each begins with a space, so
        they are cut into windows as one text."""
        if not self.ready:
            self.start()
        a, n_a, b, n_b = self.tokens(texts)
        a_ends, b_ends = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        before_a, before_b = a_ends[:-1][self.a_marked[a[1:]]], b_ends[:-1][self.b_marked[b[1:]]]
        anchors = np.intersect1d(before_a, before_b, assume_unique=True)
        cuts_a = np.concatenate(([0], np.searchsorted(a_ends, anchors) + 1, [len(a)])) if len(a) else np.zeros(1, np.int64)
        cuts_b = np.concatenate(([0], np.searchsorted(b_ends, anchors) + 1, [len(b)])) if len(a) else np.zeros(1, np.int64)
        in_a, in_b = np.diff(cuts_a), np.diff(cuts_b)
        ends = (in_a + in_b + 1).cumsum()
        starts = ends - (in_a + in_b + 1)
        keys = np.full(int(ends[-1]) if len(ends) else 0, BREAK, np.uint32)
        keys[np.arange(len(a)) + np.repeat(starts - cuts_a[:-1], in_a)] = a
        keys[np.arange(len(b)) + np.repeat(starts + in_a + 1 - cuts_b[:-1], in_b)] = b
        # distinct windows of these texts are numbered by Arrow, then looked up
        numbered = _strings(np.append(0, 4 * ends), keys).dictionary_encode()
        code = numbered.indices.to_numpy().astype(np.int64)
        known = self.windows.lookup(numbered.dictionary.to_pylist())
        groups, links = (np.array([w[i] for w in known], np.int64) for i in (0, 1))
        doc = np.searchsorted(np.cumsum(n_a), cuts_a[:-1], side="right")
        per_doc = lambda values: np.bincount(doc, values, len(texts)).astype(np.int64)
        told = pa.array([w[2] for w in known], pa.large_string()).take(pa.array(code))
        stop = np.frombuffer(told.buffers()[1], np.int64, len(told) + 1) if len(told) else np.zeros(1, np.int64)
        text = memoryview(told.buffers()[2]) if len(told) else b""
        edge = stop[np.searchsorted(doc, np.arange(len(texts) + 1))]
        listed = [bytes(text[s:e - 1]) if e > s else b"" for s, e in zip(edge.tolist(), edge[1:].tolist())]
        ends, links_ = self._pairs(doc, code, known, len(texts))
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(per_doc(groups[code])), "n_links": pa.array(per_doc(links[code])),
            "groups_sha256": pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in listed]),
            "links": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links_), "groups": pa.array([t.decode() for t in listed]),
        }

    def _pairs(self, doc: np.ndarray, code: np.ndarray, known: list, docs: int) -> tuple[np.ndarray, pa.Array]:
        """Distinct pairs of ids of every document, and how often each is
        linked in it: windows first, then their pairs."""
        size = np.array([w[1] for w in known], np.int64)
        table, pair = np.unique(np.frombuffer(b"".join([w[3] for w in known]), np.uint64), return_inverse=True)
        begin = np.cumsum(size) - size
        window, times = np.unique(doc * max(len(known), 1) + code, return_counts=True)
        owner, window = np.divmod(window, max(len(known), 1))
        each = size[window]
        stop = np.cumsum(each)
        place = np.repeat(begin[window] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)
        key, where = np.unique(np.repeat(owner, each) * max(len(table), 1) + pair[place], return_inverse=True)
        n = np.bincount(where, np.repeat(times, each), len(key)).astype(np.int32)
        owner, pair = np.divmod(key, max(len(table), 1))
        linked = table[pair]
        links = pa.StructArray.from_arrays(
            [pa.array((linked >> np.uint64(32)).astype(np.int32)), pa.array((linked & np.uint64(BREAK)).astype(np.int32)), pa.array(n)],
            names=["a", "b", "n"])
        return np.searchsorted(owner, np.arange(docs + 1)), links


FIELDS = "row long, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " \
         "links array<struct<a: int, b: int, n: int>>"


def _linked(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str, remembered: int, with_groups: bool) -> DataFrame:
    """One row per document with its distinct pairs of ids and how often each
    is linked in it."""
    tool = ship(docs.sparkSession, Aligner(path_a, path_b, remembered))
    rows = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("text"))
    schema = FIELDS.format(id=rows.schema["id"].dataType.simpleString()) + (", groups string" if with_groups else "")
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"] + (["groups"] if with_groups else [])

    def made(batches):
        from pyspark import TaskContext

        aligner, row = shipped(tool), TaskContext.get().partitionId() << 33
        for batch in batches:
            part_of = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(part_of)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                if to > at:
                    part = batch.slice(at, to - at)
                    found = aligner.align(part.column(1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(row, row + to - at)), part.column(0), *[found[n] for n in names]], names=["row", "id", *names])
                    row += to - at

    return rows.mapInArrow(made, schema)


def pair_counts(documents: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents a pair of ids is linked, and
    whether no pair of its A id is in more.  ``documents`` has ``links``."""
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    counts = materialize(documents.select(F.inline("links")).groupBy("a", "b").agg(F.count("*").alias("count")))
    # one row per id of a vocabulary
    most = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("most")))
    return counts.join(most, "a").select(pair.alias("pair"), "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED,
            broadcast_pairs: int = BROADCAST_PAIRS, with_groups: bool = False) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best (links whose pair
    is the most frequent of its A id), count_sum (document counts over links),
    groups_sha256; on request the groups as text."""
    documents = materialize(_linked(docs, path_a, path_b, doc_id, text, remembered, with_groups))
    # a pair of one document that is not the best of its id adds one for each link
    counts = materialize(pair_counts(documents).where("count > 1 OR best"))
    power = F.floor(F.log2("count")).cast("int")
    level, room = 64, broadcast_pairs
    for p, n in sorted(((r[0], r[1]) for r in counts.groupBy(power.alias("p")).count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        level = p
    else:
        level = 0
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    links = documents.select("row", F.inline("links")).select("row", pair.alias("pair"), "n")
    frequent = F.broadcast(counts.where(power >= level))  # at most ``broadcast_pairs`` rows
    count, best = F.coalesce("count", F.lit(1)), F.coalesce("best", F.lit(False))
    sums = [F.sum(F.col("n") * count).alias("count_sum"), F.sum(F.when(best, F.col("n")).otherwise(0)).alias("n_best")]
    if level == 0:
        figures = links.join(frequent, "pair", "left").groupBy("row").agg(*sums)
    else:
        seldom = links.join(frequent, "pair", "left_anti").join(counts.where(power < level), "pair", "left")
        both = links.join(frequent, "pair").groupBy("row").agg(*sums).unionByName(seldom.groupBy("row").agg(*sums))
        figures = both.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    names = ["id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
             F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"]
    return documents.drop("links").join(figures, "row", "left").select(*names, *(["groups"] if with_groups else []))
