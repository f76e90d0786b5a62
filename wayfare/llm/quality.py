"""Quality by a weak-label model and a hashed linear scorer.

Overlapping heuristics vote good, bad or nothing on every document. Their
votes are counted by pattern over all documents (a table of at most 3^8 rows),
and expectation-maximisation estimates from it the share of good documents
and how each heuristic votes on bad ones; how it votes on good ones is all but
fixed by a prior (votes can't tell a misfire from a kind of junk that only one
heuristic sees). That gives a posterior to each pattern. A linear scorer on hashed features of the words' shapes and of their
repetition is then fitted to the posteriors of at most ``rows`` documents,
those with the least hash of their id, and scores all texts whole.

Defined results: null and empty texts have no words and only the length votes
(bad); equal texts have equal scores; if all votes agree the posterior is that
of the prior; null ids are scored like any other; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, window

ROWS, LONGEST = 4000, 20_000
BUCKETS = 1 << 14
PRIOR_WEIGHT = 20.0       # of the heuristics' prior, times all documents: it outweighs the votes
GOOD, BAD, NONE = 1, 0, 2
NAMES = ("symbols", "top_word", "capitals", "sentences", "bars", "repeats", "length", "word_length")
MARKS = b"!#$%&*+/<=>@[\\]^`{|}~"  # fixed value: ASCII marks that prose has few of


def measures(text: str) -> tuple[list[str], list[float]]:
    """Words, and what the heuristics look at (in the order of NAMES)."""
    words, raw = text.split(), text.encode()
    n = max(1, len(words))
    counts = Counter(words)
    stops = text.count(".") + text.count("!") + text.count("?")
    return words, [(len(raw) - len(raw.translate(None, MARKS))) / max(1, len(raw)), max(counts.values(), default=0) / n,
                   sum(map(str.isupper, words)) / n, n / max(1, stops), counts["|"] / n,
                   sum(map(eq, words, islice(words, 1, None))) / n, len(words), len(text) / n]


def votes(m: list[float]) -> list[int]:
    """A vote of each heuristic, from fixed thresholds; short texts give fewer."""
    long = m[6] >= 20

    def low(x: float, good: float, bad: float) -> int:
        return GOOD if x <= good else BAD if x >= bad else NONE

    return [low(m[0], 0.005, 0.03), low(m[1], 0.12, 0.25) if long else NONE, low(m[2], 0.15, 0.4),
            NONE if not long else BAD if m[3] > 120 or m[3] < 1.5 else GOOD if m[3] <= 40 else NONE,
            low(m[4], 0.0, 0.1), low(m[5], 0.03, 0.15), GOOD if long else BAD if m[6] < 3 else NONE,
            GOOD if 3 <= m[7] <= 12 else BAD if m[7] < 2 or m[7] > 25 else NONE]


def _code(v: list[int]) -> int:
    return sum(x * 3 ** k for k, x in enumerate(v))


def _votes_of(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3 ** k % 3 for k in range(len(NAMES))], axis=1)


class WeakLabels:
    """``prior`` of a good document, ``right[j]``: how often heuristic j, when
    it votes at all, votes good on a good document and bad on a bad one."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 200):
        v, n = _votes_of(codes), counts.astype(float)
        p = np.where((v == BAD).any(1), 0.1, 0.95)  # a first guess
        belief = PRIOR_WEIGHT * n.sum()
        for _ in range(rounds):
            self.prior = float(((n * p).sum() + 1) / (n.sum() + 2))
            self.right = []
            for j in range(len(NAMES)):
                good, bad = v[:, j] == GOOD, v[:, j] == BAD
                # heuristics are made to spare good documents, which is their prior
                spared = ((n * p * good).sum() + 0.999 * belief + 1) / ((n * p * (good | bad)).sum() + belief + 2)
                caught = ((n * (1 - p) * bad).sum() + 1) / ((n * (1 - p) * (good | bad)).sum() + 2)
                self.right.append((spared, caught))
            p = self.posterior(codes)

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        v = _votes_of(codes)
        z = np.full(len(codes), np.log(self.prior) - np.log(1 - self.prior))
        for j, (spared, caught) in enumerate(self.right):
            z += np.where(v[:, j] == GOOD, np.log(spared) - np.log(1 - caught), 0.0)
            z += np.where(v[:, j] == BAD, np.log(1 - spared) - np.log(caught), 0.0)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# --- the scorer ----------------------------------------------------------------

@lru_cache(1 << 16)
def _bucket(*parts: object) -> int:
    return zlib.crc32(" ".join(map(str, parts)).encode()) & (BUCKETS - 1)


def shape(word: str) -> str:
    """A for capitals, a for other letters, 9 for digits; runs are one."""
    if word.isalpha():
        return "a" if word.islower() else "A" if word.isupper() else "Aa" if word.istitle() else "aA"
    kinds = ("9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in word)
    return "".join(c for c, _ in groupby(kinds))


def word_buckets(word: str) -> tuple[int, int, int]:
    """Hashed shape, length and last characters of a word."""
    core = word.rstrip(".,")
    shaped = _bucket if len(word) <= 64 else _bucket.__wrapped__  # the cache keeps no long words
    return shaped("shape", shape(core), word[len(core):]), _bucket("size", min(len(word), 20)), _bucket("end", word[-2:])


def text_buckets(m: list[float]) -> list[int]:
    """Hashed bins of the measures of the text."""
    edges = np.array([0, .002, .005, .01, .02, .04, .08, .15, .25, .4, .6, 1.5, 3, 6, 12, 25, 50, 100, 200, 1e9])
    return [_bucket("bin", name, int(np.searchsorted(edges, x))) for name, x in zip(NAMES, m)]


class WordBuckets(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        got = word_buckets(word)
        if len(word) <= 64:
            self[word] = got
        return got


def fit(texts: list[str], target: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on the posteriors by full gradients."""
    known, columns, values, owner = WordBuckets(), [], [], []
    for d, text in enumerate(texts):
        words, m = measures(text)
        seen = Counter(b for w in words for b in known[w])
        one = [*((b, c / len(words)) for b, c in seen.items()), *((b, 1.0) for b in text_buckets(m))]
        columns += [b for b, _ in one]
        values += [x for _, x in one]
        owner += [d] * len(one)
    columns, values, owner = np.array(columns, np.int32), np.array(values), np.array(owner, np.int32)
    weight, bias, m, v = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, values * weight[columns], len(texts)) + bias
        g = (1 / (1 + np.exp(-z)) - target) / max(1, len(texts))
        full = np.append(np.bincount(columns, values * g[owner], BUCKETS) + 1e-5 * weight, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full * full
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        weight, bias = weight - step[:-1], bias - step[-1]
    return weight, float(bias)


class WordWeights(dict):
    """A word's share in the score, by the scorer's weights."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) > 150_000:
            self.clear()
        x = sum(map(self.weight.__getitem__, word_buckets(word)))
        if len(word) <= 64:
            self[word] = x
        return x


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, longest: int = LONGEST,
            keep_at: float = 0.5) -> DataFrame:
    """Per document: id, ``posterior`` of the votes, ``score`` (0 to 1) and
    whether it is ``kept``."""
    texts = small_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = Counter(_code(votes(measures(t or "")[1])) for t in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(codes.keys(), pa.int32()), pa.array(codes.values(), pa.int64())],
                                             names=["code", "n"])

    patterns = (texts.select("text").mapInArrow(vote, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
                .orderBy("code").collect())  # 3^8 rows at most
    weak = WeakLabels(np.array([r[0] for r in patterns], np.int64), np.array([r[1] for r in patterns], np.int64))
    picked = (texts.where("text is not null").select("id", F.xxhash64("id", "text").alias("h"))
              .orderBy("h", "id").limit(rows).groupBy("h").agg(F.count("*").alias("n")))
    # equal rows come as one and count as often as they were picked
    sample = sorted(r[1] for r in texts.where("text is not null").withColumn("h", F.xxhash64("id", "text"))
                    .join(F.broadcast(picked), "h").withColumn("text", window(F.col("text"), longest)).groupBy("h", "text").agg(F.max("n").alias("n")).collect() for _ in range(r[2]))
    codes = np.array([_code(votes(measures(t)[1])) for t in sample], np.int64)
    weight, bias = fit(sample, weak.posterior(codes)) if sample else (np.zeros(BUCKETS), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((weak, weight, bias))  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, weight, bias = shared.value
        known = WordWeights(weight)
        for batch in slices(batches):
            codes, z = [], []
            for text in batch.column(1).to_pylist():
                words, m = measures(text or "")
                codes.append(_code(votes(m)))
                z.append(bias + sum(map(known.__getitem__, words)) / max(1, len(words)) + weight[text_buckets(m)].sum())
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(weak.posterior(np.array(codes, np.int64))), pa.array(p), pa.array(p >= keep_at)],
                names=["id", "posterior", "score", "kept"])

    return (texts.mapInArrow(score, "id bigint, posterior double, score double, kept boolean")
            .withColumnRenamed("id", id_col))
