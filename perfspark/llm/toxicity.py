"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own embedding next to the sum of its character-sequence
embeddings (both hashed), so that inflected and compounded forms are read by
their letters.  Windows of ``WINDOW`` words, each overlapping the next, cover
the whole text; a recurrent network reads every window in both directions,
attention pools its states, and the worst window is the document's score.

Training is numpy on a bounded sample of labelled rows: embeddings start from
class log-odds, then all weights follow the gradient through the worst window
of each document.  Scoring is numpy in the tasks, many windows at a time.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfspark.llm.common import ship, shipped, text_key, whole_text

#: Labelled rows that are fitted, by the order of a hash of their ids, and the
#: longest text among them (characters).  Scoring has no such limits.
TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_CHARS = 1200, 2400, 100_000
WINDOW, STRIDE = 32, 24
HIDDEN, WIDTH, BUCKETS = 8, 4, 1 << 17
GRAMS = (3, 4, 5)
EPOCHS, BATCH = 6, 64
#: Windows advanced together, and characters of text prepared together.
TOGETHER, CHARS = 4096, 4_000_000

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, of all their character sequences, and where each
    word's sequences start.  Word ends count as characters."""
    joined = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.append(0, np.cumsum(sizes))[:-1]
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters to the word's end
    owner = np.repeat(np.arange(len(words)), sizes)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BUCKETS.bit_length() + 1)
    found, owners = [], []
    state = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        state[:len(codes) - n + 1] = (state[:len(codes) - n + 1] + codes[n - 1:] + np.uint64(n)) * mix
        state ^= state >> np.uint64(29)
        if n in GRAMS:
            whole = left >= n
            found.append(((state[whole] * mix) >> shift).astype(np.int64))
            owners.append(owner[whole])
    buckets, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    at = np.append(0, np.cumsum(counts))[:-1]
    # a word is named by the sum of its positions' hashes
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    named = (codes + place * np.uint64(1_000_003)) * mix
    named ^= named >> np.uint64(31)
    total = np.add.reduceat(named * mix, starts) if len(words) else np.zeros(0, np.uint64)
    return ((total * mix) >> shift).astype(np.int64), buckets[order], at


@dataclasses.dataclass
class Model:
    words: np.ndarray  # BUCKETS x WIDTH
    grams: np.ndarray
    dense: dict[str, np.ndarray]

    def inputs(self, words: list[str]) -> np.ndarray:
        """One row per word, and a last row of zeros for padding."""
        out = np.zeros((len(words) + 1, 2 * WIDTH), np.float32)
        if words:
            named, buckets, at = word_buckets(words)
            out[:-1, :WIDTH] = self.words[named]
            counts = np.diff(np.append(at, len(buckets)))
            sums = np.add.reduceat(self.grams[buckets], at, axis=0)
            out[:-1, WIDTH:] = sums / np.sqrt(counts)[:, None]
        return out


def windows(n: int) -> list[int]:
    """Starts of the windows over ``n`` words; an empty text has one."""
    return list(range(0, max(n - (WINDOW - STRIDE), 1), STRIDE))


def _prepare(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, windows of word numbers (padding is the number of
    words), and the first window of each text."""
    known: dict[str, int] = {}
    pieces, first, total = [], [], 0
    for text in texts:
        first.append(total)
        ids = np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.int64)
        at = windows(len(ids))
        padded = np.full(at[-1] + WINDOW, -1, np.int64)
        padded[:len(ids)] = ids
        pieces.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[at])
        total += len(at)
    ids = np.concatenate(pieces)
    ids[ids < 0] = len(known)
    return list(known), ids, np.array(first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(table: np.ndarray, ids: np.ndarray, mask: np.ndarray, p: dict, side: str, keep: bool):
    """One direction: states (steps, windows, HIDDEN) and what the gradient
    needs.  Padding leaves the state as it is."""
    projected = table @ p["W" + side] + p["b" + side]
    u, h = p["U" + side], np.zeros((len(ids), HIDDEN), np.float32)
    states, saved = np.empty((WINDOW, len(ids), HIDDEN), np.float32), []
    for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
        x, r = projected[ids[:, t]], h @ u
        gates = _sigmoid(x[:, :2 * HIDDEN] + r[:, :2 * HIDDEN])
        z, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN:] + reset * r[:, 2 * HIDDEN:])
        before, m = h, mask[:, t, None]
        h = h + m * (1 - z) * (new - h)
        states[t] = h
        if keep:
            saved.append((t, before, z, reset, new, r[:, 2 * HIDDEN:], m))
    return states, saved


def forward(table: np.ndarray, ids: np.ndarray, p: dict, keep: bool = False):
    """Logits of the windows."""
    mask = (ids != len(table) - 1).astype(np.float32)
    ahead, saved_f = _read(table, ids, mask, p, "f", keep)
    back, saved_b = _read(table, ids, mask, p, "r", keep)
    both = np.concatenate([ahead, back], axis=2)
    seen = np.tanh(both @ p["A"])
    weight = (seen @ p["v"]) + np.where(mask.T > 0, 0, -1e4)
    weight = np.exp(weight - weight.max(axis=0))
    weight = (weight / weight.sum(axis=0) * (mask.T > 0)).astype(np.float32)
    pooled = (weight[:, :, None] * both).sum(axis=0)
    logits = pooled @ p["o"] + p["c"]
    return (logits, (mask, both, seen, weight, pooled, saved_f, saved_b)) if keep else logits


def backward(table: np.ndarray, ids: np.ndarray, p: dict, cache, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the dense weights, and of the input rows (windows, steps, inputs)."""
    mask, both, seen, weight, pooled, saved_f, saved_b = cache
    g = {"o": pooled.T @ slope, "c": np.array(slope.sum(), np.float32)}
    d_pooled = slope[:, None] * p["o"]
    d_both = weight[:, :, None] * d_pooled
    d_weight = (both * d_pooled).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["v"] = np.tensordot(d_score, seen, ([0, 1], [0, 1]))
    d_seen = d_score[:, :, None] * p["v"] * (1 - seen * seen)
    g["A"] = np.tensordot(both, d_seen, ([0, 1], [0, 1]))
    d_both = d_both + d_seen @ p["A"].T
    d_x = np.zeros((len(ids), WINDOW, table.shape[1]), np.float32)
    for side, saved, part in (("f", saved_f, d_both[:, :, :HIDDEN]), ("r", saved_b, d_both[:, :, HIDDEN:])):
        w, u = p["W" + side], p["U" + side]
        g["W" + side], g["U" + side], g["b" + side] = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * HIDDEN, np.float32)
        d_h = np.zeros((len(ids), HIDDEN), np.float32)
        for t, before, z, reset, new, rec, m in reversed(saved):
            d_h = d_h + part[t]
            d_new = d_h * m * (1 - z) * (1 - new * new)
            d_z = -d_h * m * (new - before) * z * (1 - z)
            d_reset = d_new * rec * reset * (1 - reset)
            d_gate = np.concatenate([d_z, d_reset, d_new], axis=1)
            d_rec = np.concatenate([d_z, d_reset, d_new * reset], axis=1)
            g["W" + side] += table[ids[:, t]].T @ d_gate
            g["b" + side] += d_gate.sum(axis=0)
            g["U" + side] += before.T @ d_rec
            d_x[:, t] += d_gate @ w.T
            d_h = d_h * (1 - m * (1 - z)) + d_rec @ u.T
    return g, d_x


def _log_odds(present: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Shrunken class log-odds of the buckets that texts hold."""
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for found, label in zip(present, labels):
        (toxic if label else clean)[found] += 1
    t, c = labels.sum(), len(labels) - labels.sum()
    odds = np.log((toxic + 0.5) / (t + 1)) - np.log((clean + 0.5) / (c + 1))
    seen = np.where(odds > 0, toxic, clean)
    return np.clip(odds * seen / (seen + 5), -4, 4).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """The network of labelled texts (1 toxic, 0 clean)."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    named, grams = [], []
    for text in texts:
        words = list(dict.fromkeys(words_of(text)))
        a, b, _ = word_buckets(words) if words else (np.zeros(0, int), np.zeros(0, int), None)
        named.append(np.unique(a))
        grams.append(np.unique(b))
    model = Model(draw(BUCKETS, WIDTH) * 0.1, draw(BUCKETS, WIDTH) * 0.1, {})
    model.words[:, 0], model.grams[:, 0] = _log_odds(named, labels), _log_odds(grams, labels)
    p = model.dense
    for side in "fr":
        p["W" + side], p["U" + side] = draw(2 * WIDTH, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN)
        p["b" + side] = np.zeros(3 * HIDDEN, np.float32)
    p["A"], p["v"], p["o"], p["c"] = draw(2 * HIDDEN, HIDDEN), draw(HIDDEN), draw(2 * HIDDEN), np.array(0.0, np.float32)
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            words, ids, first = _prepare([texts[i] for i in chosen])
            table = model.inputs(words)
            logits = np.concatenate([forward(table, ids[i:i + TOGETHER], p) for i in range(0, len(ids), TOGETHER)])
            ends = np.append(first[1:], len(ids))
            worst = np.array([a + int(np.argmax(logits[a:b])) for a, b in zip(first, ends)])
            logit, cache = forward(table, ids[worst], p, keep=True)
            slope = ((_sigmoid(logit) - labels[chosen]) / len(chosen)).astype(np.float32)
            g, d_x = backward(table, ids[worst], p, cache, slope)
            step += 1
            for k in p:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] * g[k]
                p[k] = (p[k] - 0.02 * mean[k] / (1 - 0.9 ** step) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
            used = ids[worst].ravel()
            real = used < len(words)
            row_slope = np.zeros((len(words) + 1, 2 * WIDTH), np.float32)
            np.add.at(row_slope, used[real], d_x.reshape(-1, 2 * WIDTH)[real])
            touched = np.unique(used[real])
            if len(touched):
                named_at, bucket_at, begin = word_buckets([words[i] for i in touched])
                counts = np.diff(np.append(begin, len(bucket_at)))
                np.add.at(model.words, named_at, -row_slope[touched, :WIDTH])
                spread = row_slope[touched, WIDTH:] / np.sqrt(counts)[:, None]
                np.add.at(model.grams, bucket_at, -np.repeat(spread, counts, axis=0))
    return model


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Chance that the worst window of each whole text is toxic."""
    scores, at = np.empty(len(texts)), 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= CHARS):
            chars += len(texts[end])
            end += 1
        words, ids, first = _prepare(texts[at:end])
        table = model.inputs(words)
        logits = np.concatenate([forward(table, ids[i:i + TOGETHER], model.dense) for i in range(0, len(ids), TOGETHER)])
        scores[at:end] = _sigmoid(np.maximum.reduceat(logits.astype(np.float64), first))
        at = end
    return scores


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
            label: str = "toxic") -> Model | float:
    """Fit on a bounded sample of ``labels`` that name a document; null labels
    are left out.  Without both classes the share of the toxic one (0.5 without
    labels) is the score of every text."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(
        "label IS NOT NULL AND id IS NOT NULL").dropDuplicates(["id"])
    short = docs.where(F.char_length(whole_text(text)) <= SAMPLE_CHARS)
    known = known.join(short.select(F.col(doc_id).alias("id")), "id", "left_semi")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.where("label = 1").orderBy(*order).limit(TOXIC_SAMPLE).unionByName(
        known.where("label = 0").orderBy(*order).limit(CLEAN_SAMPLE))
    # at most TOXIC_SAMPLE + CLEAN_SAMPLE ids, then as many texts
    rows = short.select(F.col(doc_id).alias("id"), whole_text(text).alias("text")).join(F.broadcast(chosen), "id").toPandas()
    rows = rows.drop_duplicates("id").sort_values("id")
    if set(rows["label"]) != {0, 1}:
        return float(rows["label"].iloc[0]) if len(rows) else 0.5
    return fit(rows["text"].tolist(), rows["label"].to_numpy())


def scored(docs: DataFrame, model: Model | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, key, score (0 to 1, higher: toxic).
    Null is the empty text, which is scored as a window without words."""
    shared = ship(docs.sparkSession, model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        if isinstance(shipped(shared), float):
            return pd.Series(np.full(len(texts), shipped(shared)))
        return pd.Series(score_texts(shipped(shared), texts.tolist()))

    return docs.select(F.col(doc_id).alias("id"), text_key(text).alias("key"), score(whole_text(text)).alias("score"))
