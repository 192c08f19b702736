"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams, a passage of a text the mean of its words, and a
softmax over that mean says how toxic the passage is; vectors and softmax are trained jointly in numpy. A text scores
as its worst passage, so a long text hides nothing; training therefore works in rounds, in which the passages of a
toxic document that the last round found clean drop out. Misspelt words share most n-grams with the words they stand
for.

The labelled sample has `sample_docs` documents at most, taken by hash from the rows that may be learnt from; it and
the model are all that the driver holds. Scoring is one pass without a shuffle.

Defined cases: a null or empty text has no words and scores as the softmax of the zero vector; a null doc_id has no
label and is not held out; of repeated labels of a document the largest counts; without labels of both classes all
scores are the share of toxic labels (0 without any); other columns of either table are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is cut off the ends of words.
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-–—…«»„“”"


@dataclass(frozen=True)
class Config:
    sample_docs: int = 2100
    buckets: int = 1 << 18
    low: int = 3
    high: int = 5
    size: int = 4
    passage: int = 5
    min_docs: int = 6
    epochs: int = 20
    rounds: int = 3
    rate: float = 0.03
    gain: float = 30.0
    decay: float = 1e-3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """The model as scoring needs it: since all steps up to the softmax are linear, each bucket is one number."""

    weight: np.ndarray
    bias: float
    config: Config


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(word: str, c: Config) -> list[int]:
    """Buckets of a word's n-grams of bytes and of the word itself, edges marked."""
    marked = b"<" + word.strip(EDGES).encode("utf-8", "replace") + b">"
    most, hashed, end = c.buckets, zlib.crc32, len(marked) + 1
    found = [hashed(marked[i : i + n]) % most for n in range(c.low, c.high + 1) for i in range(end - n)]
    return [*found, hashed(marked) % most]


def passage_starts(n_words: int, size: int) -> np.ndarray:
    """Passages of `size` words; an end of under half that belongs to the passage before it."""
    starts = np.arange(0, max(n_words, 1), size)
    return starts[:-1] if len(starts) > 1 and n_words - starts[-1] < size / 2 else starts


def sample(docs: DataFrame, labels: DataFrame, c: Config) -> pd.DataFrame:
    """text, toxic of at most sample_docs labelled documents, a third of them toxic if there are so many."""
    known = (
        labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("order", F.xxhash64("doc_id", F.lit(c.seed)))
    )
    third = c.sample_docs // 3
    chosen = known.where("toxic = 1").orderBy("order").limit(third)
    chosen = chosen.unionByName(known.where("toxic = 0").orderBy("order").limit(c.sample_docs - third))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.orderBy(F.xxhash64("order", "text")).limit(c.sample_docs).select("text", "toxic").toPandas()


def fit(texts: list[str | None], toxic: np.ndarray, c: Config = Config()) -> Model:
    y = np.asarray(toxic, dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(c.buckets, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))), c)
    learn = np.arange(len(y)) % 4 != 0  # the others calibrate
    if len(np.unique(y[learn])) < 2 or len(np.unique(y[~learn])) < 2:
        learn = np.ones(len(y), dtype=bool)
    weight = _embedded([t for t, k in zip(texts, learn) if k], y[learn], c)
    rest = ~learn if not learn.all() else learn
    words = _Words(Model(weight, 0.0, c))
    odds = np.array([_worst(t, words) for t, k in zip(texts, rest) if k])
    scale, bias = _calibrated(odds, y[rest])
    return Model((weight * scale).astype(np.float32), bias, c)


def _calibrated(odds: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and bias of a logistic curve over the worst passages' odds, by Newton steps with a small ridge."""
    unit = max(float(np.abs(odds).max()), 1e-9)
    x = np.stack([odds / unit, np.ones(len(odds))], axis=1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(h, x.T @ (p - y) + 1e-3 * beta)
    return max(float(beta[0] / unit), 0.0), float(beta[1])


def _embedded(texts: list[str | None], y: np.ndarray, c: Config) -> np.ndarray:
    """The joint training; returns the weight of each bucket."""
    index: dict[str, int] = {}
    tokens, starts, owner, at = [], [], [], 0
    for d, text in enumerate(texts):
        own = [index.setdefault(w, len(index)) for w in (text or "").lower().split()]
        if own:
            tokens.append(np.array(own, np.int32))
            first = passage_starts(len(own), c.passage)
            starts.append(first + at)
            owner.append(np.full(len(first), d))
            at += len(own)
    if not tokens:
        return np.zeros(c.buckets, np.float32)
    token, start, owner = np.concatenate(tokens), np.concatenate(starts), np.concatenate(owner)
    length = np.diff(np.r_[start, len(token)]).astype(np.float32)
    flat, counts = array("i"), array("i")
    for w in index:
        own = grams(w, c)
        flat.extend(own)
        counts.append(len(own))
    all_grams, n_grams = np.frombuffer(flat, np.int32), np.array(counts, np.float32)
    word_start = np.r_[0, np.cumsum(np.frombuffer(counts, np.int32)[:-1], dtype=np.int64)]
    # only buckets that several documents have get a vector: the others would learn single documents by heart
    spread = np.zeros(c.buckets, np.int32)
    for own in tokens:
        spread[np.unique(np.concatenate([all_grams[word_start[w] : word_start[w] + counts[w]] for w in np.unique(own)]))] += 1
    slot = np.zeros(c.buckets, np.int32)
    bucket = np.flatnonzero(spread >= min(c.min_docs, max(1, len(tokens) // 50)))
    slot[bucket] = np.arange(1, len(bucket) + 1)  # slot 0: no vector
    gram = slot[all_grams]
    label = y[owner]
    rng = np.random.default_rng(c.seed)
    shapes = ((len(bucket) + 1, c.size), (c.size, 2), (2,))
    params = [rng.normal(0, x, s).astype(np.float32) for x, s in zip((0.01, 0.5, 0.01), shapes)]
    mean_move, mean_square = ([np.zeros(s, np.float32) for s in shapes] for _ in range(2))
    weight = np.ones(len(start), np.float32)
    step = 0
    for _ in range(c.rounds):
        share = np.array([weight[label == k].sum() for k in (0, 1)])
        scale = weight / (2 * share[label])
        for _ in range(c.epochs):
            vectors, softmax, bias = params
            words = np.add.reduceat(vectors[gram], word_start, axis=0) / n_grams[:, None]
            mean = np.add.reduceat(words[token], start, axis=0) / length[:, None]
            logits = c.gain * (mean @ softmax) + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - np.eye(2, dtype=np.float32)[label]) * scale[:, None]
            back = c.gain * (error @ softmax.T) / length[:, None]
            sizes = length.astype(int)
            to_grams = np.empty_like(vectors)
            for k in range(c.size):
                to_words = np.bincount(token, np.repeat(back[:, k], sizes), len(index)) / n_grams
                to_grams[:, k] = np.bincount(gram, np.repeat(to_words, n_grams.astype(int)), len(vectors))
            to_grams[0] = 0
            step += 1
            for i, g in enumerate((to_grams, c.gain * (mean.T @ error), error.sum(axis=0))):  # Adam
                g = g + c.decay * params[i] / len(vectors)
                mean_move[i] += 0.1 * (g - mean_move[i])
                mean_square[i] += 0.01 * (g * g - mean_square[i])
                move = (mean_move[i] / (1 - 0.9**step)) / (np.sqrt(mean_square[i] / (1 - 0.99**step)) + 1e-9)
                params[i] = (params[i] - c.rate * move).astype(np.float32)
            params[0][0] = 0
        # next round: of toxic documents only the worst passage and those found toxic
        odds = logits[:, 1] - logits[:, 0]
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, odds)
        weight = ((label == 0) | (odds > 0) | (odds >= worst[owner])).astype(np.float32)
    vectors, softmax, _ = params
    out = np.zeros(c.buckets, np.float32)
    out[bucket] = vectors[1:] @ (softmax[:, 1] - softmax[:, 0])
    return out


class _Words(dict):
    """The weight of each word met, kept up to a bound in each worker."""

    def __init__(self, model: Model, most: int = 400_000):
        super().__init__()
        self.model, self.most = model, most
        self.weight = model.weight.tolist()

    def __missing__(self, word: str) -> float:
        own = grams(word, self.model.config)
        mean = sum(map(self.weight.__getitem__, own)) / len(own)
        if len(word) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = mean
        return mean


def _worst(text: str | None, words: _Words) -> float:
    own = (text or "").lower().split()
    if not own:
        return 0.0
    each = np.fromiter(map(words.__getitem__, own), np.float64, len(own))
    start = passage_starts(len(own), words.model.config.passage)
    return float((np.add.reduceat(each, start) / np.diff(np.r_[start, len(own)])).max())


def score_text(text: str | None, words: _Words) -> float:
    return float(1 / (1 + np.exp(-np.clip(_worst(text, words) + words.model.bias, -50, 50))))


_MET: dict[int, _Words] = {}


def scorer(model: Model):
    """A column function: text -> probability of being toxic."""
    key = zlib.crc32(model.weight.tobytes() + repr((model.bias, model.config)).encode())

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _MET:
            _MET.clear()
            _MET[key] = _Words(model)
        for texts in batches:
            yield pd.Series([score_text(t, _MET[key]) for t in texts], dtype="float64")

    return score


def train(docs: DataFrame, labels: DataFrame, c: Config = Config()) -> Model:
    rows = sample(docs, labels, c)
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy(), c)


def report(docs: DataFrame, labels: DataFrame, c: Config = Config()) -> DataFrame:
    score = scorer(train(docs, labels, c))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, c: Config = Config()) -> DataFrame:
    """`docs` without those that score 0.5 or more, all columns kept."""
    return docs.where(scorer(train(docs, labels, c))("text") < 0.5)
