"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its hashed character n-grams; the mean of their vectors
is the word's embedding, and the mean over a window of words goes through a
linear softmax. Vectors and softmax are trained jointly in numpy, from the
n-grams' log odds, on the highest-scoring window of each text and a random
one, so that one insult in a long text counts as much as in a short one. Words never seen in
training, misspellings too, score by the n-grams that they share with others.
A text's score is that of its highest window, calibrated on the labels' rate.

Since the softmax is linear, an n-gram's vector adds one number to a window's
logit; executors get these numbers only (1 MiB, whatever the input).

The model is fitted on at most ``rows`` labelled texts of each class, those
with the least hash of their id, and ``longest`` characters of a longer text,
from a place that its hash draws; all
texts are scored whole. Defined results: null and empty texts have no words
and get the rate of label 1; without labels of both classes the score is the rate
of label 1 (0 without any); rows with null labels or ids don't train; repeated
rows are scored each; input columns pass through.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, stage, window

ROWS, LONGEST = 2000, 8_000
BUCKETS, DIM, WINDOW = 1 << 18, 8, 4
GRAMS = (3, 4, 5, 6)
SUPPORT, SHRINK, DECAY, START = 3, 10, 1e-5, 4.0
STEPS, RATE = 60, 0.03
_words = re.compile(r"[^\W\d_]+").findall


def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams (of UTF-8 bytes), and of the word."""
    data = b"<%b>" % word.encode()
    parts = [data[i:i + n] for n in GRAMS for i in range(len(data) - n + 1)]
    return [h & (BUCKETS - 1) for h in map(zlib.crc32, (data, *parts))]


@dataclass
class Model:
    weight: np.ndarray  # of each bucket in a word's logit
    bias: float
    slope: float        # of the calibration
    shift: float
    rate: float         # share of label 1, the score of a text without words

    def top(self, scores: np.ndarray) -> float:
        """Highest mean over a window of word logits."""
        if len(scores) <= WINDOW:
            return self.bias + (float(scores.mean()) if len(scores) else 0.0)
        sums = np.cumsum(np.concatenate(([0.0], scores)))
        return self.bias + float((sums[WINDOW:] - sums[:-WINDOW]).max()) / WINDOW

    def score(self, top: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -30, 30))))


class WordLogits(dict):
    def __init__(self, weight: np.ndarray):
        self.weight = weight.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) > 150_000:
            self.clear()
        buckets = grams(word)
        z = sum(map(self.weight.__getitem__, buckets)) / len(buckets)
        if len(word) <= 64:
            self[word] = z
        return z


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, **pairs: tuple[np.ndarray, np.ndarray]) -> None:
        self.t += 1
        for k, (x, g) in pairs.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            x -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + 1e-8)


def fit(texts: list[str], labels: list[int], rate: float) -> Model:
    """Train on the texts; ``rate`` is the true share of label 1."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        p = min(max(rate, 1e-9), 1 - 1e-9)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))), p)
    vocab: dict[str, int] = {}
    placed = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in _words(t.lower())), np.int32) for t in texts]
    some = np.flatnonzero([len(d) for d in placed])  # texts without words teach nothing
    y, sizes, tokens = y[some], np.array([len(placed[i]) for i in some]), np.concatenate([placed[i] for i in some])
    del placed
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    per, packed = np.zeros(len(vocab), np.int32), array("i")
    for i, w in enumerate(vocab):
        got = grams(w)
        per[i] = len(got)
        packed.extend(got)
    flat, owner = np.array(packed, np.int32), np.repeat(np.arange(len(vocab), dtype=np.int32), per)
    del packed
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    # Where training starts: an n-gram's log odds of label 1, drawn to 0 where few texts have it.
    grams_of = np.concatenate(([0], np.cumsum(per)))
    with_it, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for start, size, label in zip(starts, sizes, y):
        own = np.unique(np.concatenate([flat[grams_of[w]:grams_of[w + 1]] for w in np.unique(tokens[start:start + size])]))
        with_it[own] += 1
        toxic[own] += label
    p = y.mean()
    odds = np.log((toxic + SHRINK * p) / (with_it + SHRINK) / p) - np.log(
        (with_it - toxic + SHRINK * (1 - p)) / (with_it + SHRINK) / (1 - p))
    # those of few texts would only be learnt by heart; their vectors stay out of it
    keep = with_it[flat] >= SUPPORT
    flat, owner = flat[keep], owner[keep]
    used, flat = np.unique(flat, return_inverse=True)
    random = np.random.default_rng(7)
    vectors = random.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    vectors[:, 0] += odds[used]
    soft = random.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    soft[0] = -START, START
    bias = np.zeros(2)

    def word_logits() -> np.ndarray:
        return np.bincount(owner, (vectors @ (soft[:, 1] - soft[:, 0]))[flat], len(per)) / per

    def learn(adam: Adam, word_pull: np.ndarray, pull: float) -> None:
        """One step; ``word_pull``: the loss's derivative by each word's logit."""
        share = np.bincount(flat, (word_pull / per)[owner], len(used)).astype(np.float32)
        up = share @ vectors
        adam.step(v=(vectors, np.outer(share, soft[:, 1] - soft[:, 0]) + DECAY * vectors),
                  u=(soft, np.stack([-up, up], axis=1) + 1e-4 * soft), b=(bias, np.array([-pull, pull])))

    adam = Adam(RATE)
    doc_of = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    width = np.minimum(sizes, WINDOW)
    last = (starts + sizes - width)[doc_of]  # where a text's last window begins
    begin = np.arange(len(tokens), dtype=np.int32)
    inside = begin <= last
    ends = np.where(inside, begin + width[doc_of], begin)
    for _ in range(STEPS):  # the highest window of each text, and one at random of label 0
        logits = word_logits()
        sums = np.concatenate(([0.0], np.cumsum(logits[tokens])))
        means = np.where(inside, (sums[ends] - sums[:-1]) / width[doc_of], -np.inf)
        top = np.maximum.reduceat(means, starts)
        hits = np.flatnonzero(means >= top[doc_of])[::-1]
        first = starts.copy()
        first[doc_of[hits]] = hits
        pull = (1 / (1 + np.exp(-(top + bias[1] - bias[0]))) - y) * balance
        drawn = starts + (random.random(len(y)) * (sizes - width + 1)).astype(np.int64)
        other = np.where(y > 0, 0.0, balance / (1 + np.exp(-means[drawn] - bias[1] + bias[0])))
        weights = np.zeros(len(per))
        for k in range(WINDOW):
            there = np.flatnonzero(k < width)
            for base, force in ((first, pull), (drawn, other)):
                weights += np.bincount(tokens[base[there] + k], (force / width)[there], len(per))
        learn(adam, weights, (pull + other).sum())

    z = np.zeros(BUCKETS, np.float32)
    z[used] = vectors @ (soft[:, 1] - soft[:, 0])
    model = Model(z, float(bias[1] - bias[0]), 1.0, 0.0, rate)
    logits = word_logits()
    tops = np.array([model.top(logits[tokens[s:s + k]]) for s, k in zip(starts, sizes)])
    weight = np.where(y > 0, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression with a prior of some rows of each class
        p = 1 / (1 + np.exp(-np.clip(a * tops + b, -30, 30)))
        g, h = weight * (p - (y * 0.98 + 0.01)), weight * np.maximum(p * (1 - p), 1e-6)
        m = np.array([[(h * tops * tops).sum() + 1e-3, (h * tops).sum()], [(h * tops).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(m, [(g * tops).sum(), g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return Model(z, model.bias, float(a), float(b), rate)


def held_out(id_col: str):
    """crc32 of the id as text, modulo 4, is 2: such rows never train."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          rows: int = ROWS, longest: int = LONGEST) -> Model:
    """Fit on labelled rows that aren't held out."""
    known = labels.select(F.col(id_col).alias("_w_id"), F.col(label_col).cast("int").alias("_w_y")).where(
        "_w_id is not null and _w_y in (0, 1)").where(~held_out("_w_id"))
    rates = known.agg(F.avg("_w_y")).first()[0] or 0.0
    texts = docs.select(F.col(id_col).alias("_w_id"), F.col(text_col).alias("_w_text")).where("_w_text is not null")
    picked = [known.where(F.col("_w_y") == y).orderBy(F.xxhash64("_w_id"), "_w_id").limit(rows) for y in (0, 1)]
    few = picked[0].unionByName(picked[1])  # at most 2 * rows ids and labels
    # repeated ids may bring any number of rows: equal texts are one, toxic if any is, and at most ``rows`` of a class come here
    found = stage(texts.join(F.broadcast(few), "_w_id").withColumn("_w_text", window(F.col("_w_text"), longest)).groupBy("_w_text").agg(F.max("_w_y").alias("_w_y")))
    got = [tuple(r) for y in (0, 1)
           for r in found.where(F.col("_w_y") == y).orderBy(F.xxhash64("_w_text"), "_w_text").limit(rows).collect()]
    return fit(*map(list, zip(*sorted(got))), rates) if got else fit([], [], rates)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logits = WordLogits(m.weight)
        for batch in slices(batches):
            out = []
            for text in batch.column(at).to_pylist():
                words = _words((text or "").lower())
                found = np.fromiter(map(logits.__getitem__, words), float, len(words))
                out.append(m.score(m.top(found)) if words else m.rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())],
                                             names=[*batch.schema.names, score_col])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
