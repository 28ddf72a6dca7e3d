"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line is described by its own character and word
statistics and by those of the lines before and after it; weights and the
transitions between neighbouring labels are fitted by maximum likelihood with
forward-backward marginals.  Only documents are labelled, so the lines of good
documents are good; those of bad ones are first judged one by one, by their own
statistics alone, and then by the chain of the fit before, with at least the
worst one staying bad.  A document's score is its length-weighted share of good
lines, calibrated by a logistic fit.

The fit sees a bounded sample of labelled rows (``SAMPLE``); the features are
computed where the texts are, and only numbers reach the driver.
"""

from __future__ import annotations

import dataclasses
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfspark.llm.common import text_key, whole_text

#: Labelled rows that are fitted, by the order of a hash of their ids.
SAMPLE = 4000
#: Characters of text whose lines are scored together.
BATCH = 4_000_000
ROUNDS, STEPS, PENALTY = 2, 80, 1e-5

# character classes of bytes
SPACE, LOWER, UPPER, DIGIT, SYMBOL, SHOUT, BAR, POINT, HIGH = range(9)
CLASSES = 9
OWN = 13  # statistics of a line


def _byte_classes() -> np.ndarray:
    table = np.full(256, POINT, np.uint8)
    for chars, cls in ((b" \t\n\r\x0b\x0c", SPACE), (b"#$%&*@^~_<>=+\\", SYMBOL), (b"!", SHOUT), (b"|", BAR)):
        table[list(chars)] = cls
    table[ord("a"):ord("z") + 1], table[ord("A"):ord("Z") + 1], table[ord("0"):ord("9") + 1] = LOWER, UPPER, DIGIT
    table[128:] = HIGH
    return table


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n, OWN) statistics of the lines that are not blank, and their lengths.
    A text without such a line is one line of length 1 with all-zero statistics."""
    lines = text.split("\n")
    kept = [i for i, line in enumerate(lines) if line and not line.isspace()]
    if not kept:
        return np.zeros((1, OWN), np.float32), np.ones(1, np.int64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    where = np.cumsum(raw == 10, dtype=np.int64) * CLASSES
    counts = np.bincount(where + _byte_classes()[raw], minlength=len(lines) * CLASSES)
    counts = counts[:len(lines) * CLASSES].reshape(-1, CLASSES)[kept].astype(np.float32)
    size = np.maximum(counts.sum(axis=1), 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER] + counts[:, HIGH] / 2, 1)
    repeated = Counter(lines[i].strip() for i in kept)
    words = [lines[i].split() for i in kept]
    n_words = np.array([len(w) for w in words], np.float32)
    distinct = np.array([len(set(w)) for w in words], np.float32)
    echo = np.array([sum(map(str.__eq__, w, w[1:])) for w in words], np.float32)
    again = np.array([repeated[lines[i].strip()] > 1 for i in kept], np.float32)
    share = np.sqrt(counts[:, [DIGIT, SYMBOL, SHOUT, BAR, POINT, HIGH]] / size[:, None])
    own = np.column_stack([
        np.log1p(size) / 6, counts[:, UPPER] / letters, share, np.log1p(size / np.maximum(n_words, 1)) / 2,
        distinct / n_words, np.sqrt(echo / n_words), again, np.log1p(n_words) / 5,
    ]).astype(np.float32)
    return own, size.astype(np.int64)


def chain_features(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own statistics with those of both neighbours inside the document."""
    n = len(own)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[starts] = True
    last[np.append(starts[1:], n) - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([np.ones(n, np.float32), own, before, after, first, last]).astype(np.float64)


@dataclasses.dataclass
class Model:
    weights: np.ndarray  # of the good label, per feature
    links: np.ndarray  # 2 x 2 scores of (label, next label)
    centre: np.ndarray  # of the lines' statistics
    spread: np.ndarray
    scale: float = 1.0
    shift: float = 0.0


def marginals(unary: np.ndarray, links: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance that each line is good, expected label pairs, log normaliser.
    All chains advance together, longest first."""
    n, sizes = len(unary), np.diff(np.append(starts, len(unary)))
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = starts[order], sizes[order]
    shift = np.maximum(unary, 0)
    odds = np.column_stack([np.exp(-shift), np.exp(unary - shift)])  # of bad, good
    step = np.exp(links)
    forward, norm, ahead = np.empty((n, 2)), np.empty(n), np.ones((n, 2))
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]) if len(sizes) else 0)]
    for t, m in enumerate(active):
        at = begin[:m] + t
        state = odds[at] if t == 0 else (forward[at - 1] @ step) * odds[at]
        norm[at] = state.sum(axis=1)
        forward[at] = state / norm[at][:, None]
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = begin[:active[t]] + t
        later = odds[at] * ahead[at] / norm[at][:, None]
        pairs += step * (forward[at - 1].T @ later)
        ahead[at - 1] = later @ step.T
    good = forward * ahead
    return good[:, 1] / good.sum(axis=1), pairs, float(np.log(norm).sum() + shift.sum())


def fit_chain(features: np.ndarray, labels: np.ndarray, starts: np.ndarray, steps: int = STEPS,
              linked: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam on weights and links (without: no links)."""
    n, width = features.shape
    theta, mean, square = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    inner = np.ones(n, bool)
    inner[starts] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    for i in range(1, steps + 1):
        unary = features @ theta[:width]
        if linked:
            good, pairs, _ = marginals(unary, theta[width:].reshape(2, 2), starts)
        else:
            good, pairs = 1 / (1 + np.exp(-np.clip(unary, -30, 30))), seen
        slope = np.append(features.T @ (good - labels), (pairs - seen).ravel()) / n + PENALTY * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        theta = theta - 0.15 * (mean / (1 - 0.9 ** i)) / (np.sqrt(square / (1 - 0.99 ** i)) + 1e-8)
    return theta[:width], theta[width:].reshape(2, 2)


def good_share(model: Model, own: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted share of good lines per document, and line marginals."""
    features = chain_features((own - model.centre) / model.spread, starts)
    good, _, _ = marginals(features @ model.weights, model.links, starts)
    return np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts), good


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(own: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of labelled documents (1 good, 0 bad)."""
    sizes = np.array([len(x) for x in own])
    starts = np.append(0, np.cumsum(sizes)[:-1])
    stacked, weights = np.concatenate(own), np.concatenate(lengths)
    doc = np.repeat(np.arange(len(own)), sizes)
    line = labels[doc].astype(int)
    centre, spread = stacked.mean(axis=0), stacked.std(axis=0) + 1e-6
    features = chain_features((stacked - centre) / spread, starts)
    alone = features[:, :1 + OWN]
    good = alone @ fit_chain(alone, line, starts, 2 * STEPS, linked=False)[0]
    good = 1 / (1 + np.exp(-np.clip(good, -30, 30)))
    for _ in range(ROUNDS):
        worst = np.minimum.reduceat(good, starts)[doc]
        line = np.where(labels[doc] == 1, 1, ((good > 0.5) & (good > worst)).astype(int))
        model = Model(*fit_chain(features, line, starts), centre, spread)
        good, _, _ = marginals(features @ model.weights, model.links, starts)
    share, _ = good_share(model, stacked, weights, starts)
    x, scale, shift = _logit(share), 1.0, 0.0
    for _ in range(200):  # Newton steps of a two-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30)))
        g = np.array([((p - labels) * x).sum() + 1e-3 * scale, (p - labels).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        move = np.linalg.solve(h, g)
        scale, shift = scale - np.clip(move[0], -1, 1), shift - np.clip(move[1], -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return dataclasses.replace(model, scale=float(scale), shift=float(shift))


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Scores of whole texts, some of them at a time."""
    scores, at = np.empty(len(texts)), 0
    while at < len(texts):
        own, lengths, end, chars = [], [], at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH):
            chars += len(texts[end])
            features, sizes = line_features(texts[end])
            own.append(features)
            lengths.append(sizes)
            end += 1
        starts = np.append(0, np.cumsum([len(x) for x in own])[:-1])
        share, _ = good_share(model, np.concatenate(own), np.concatenate(lengths), starts)
        scores[at:end] = 1 / (1 + np.exp(-np.clip(model.scale * _logit(share) + model.shift, -30, 30)))
        at = end
    return scores


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
            label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of ``labels`` that name a document; null
    labels are left out.  Without both classes the model scores every text by
    the share of the class there is (0.5 without labels)."""
    named = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(
        "label IS NOT NULL AND id IS NOT NULL").dropDuplicates(["id"])
    known = named.join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi")
    # at most `sample` pairs of an id and a label
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def described(frames):
        for frame in frames:
            rows = [line_features(t) for t in frame["text"]]
            yield pd.DataFrame({
                "id": frame["id"], "label": frame["label"],
                "own": [o.astype("<f4").tobytes() for o, _ in rows], "size": [s.astype("<i8").tobytes() for _, s in rows],
            })

    texts = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.select("id", "label", "text").mapInPandas(described, "id long, label int, own binary, size binary").toPandas()
    rows = rows.drop_duplicates("id").sort_values("id")
    classes = set(rows["label"])
    if classes != {0, 1}:
        width = 1 + 3 * OWN + 2
        odds = 0.0 if not classes else (20.0 if classes == {1} else -20.0)
        return Model(np.zeros(width), np.zeros((2, 2)), np.zeros(OWN), np.ones(OWN), 0.0, odds)
    own = [np.frombuffer(b, "<f4").reshape(-1, OWN) for b in rows["own"]]
    return fit(own, [np.frombuffer(b, "<i8") for b in rows["size"]], rows["label"].to_numpy())


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, key, score (0 to 1, higher is better).
    Null is the empty text, which is scored as a blank line."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(model, texts.tolist()))

    return docs.select(F.col(doc_id).alias("id"), text_key(text).alias("key"), score(whole_text(text)).alias("score"))


def good_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those scored below 0.5; columns and rows unchanged
    otherwise."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(model, texts.tolist()))

    return docs.where(score(whole_text(text)) >= 0.5)
