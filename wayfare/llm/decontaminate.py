"""Benchmark decontamination by greedy string tiling.

Texts become lower-case words without ASCII punctuation. Running Karp-Rabin
hashes of five words find the seeds that a document shares with an item of
the benchmark; an item is looked at if its shared seeds could cover enough of it.
The longest match whose words are free in both texts becomes a tile, again
and again, down to five words; running hashes of a length's runs find the
matches, so repeats cost no more than other words. The share of an item's
words that lie in tiles is its coverage, so that passages in another order
still count. A document of which some item
has ``threshold`` coverage is contaminated.

The benchmark is sent to the executors in blocks of at most ``block`` words,
one pass over the documents each, so its size is never a limit; documents are
not shuffled. Items shorter than a seed must occur as a whole.

Defined results: null and empty texts contain nothing; items without words or
with a null text match nothing; equal items and repeated documents give a row
each; empty tables give no rows; extra columns pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

SEED, THRESHOLD, BLOCK = 5, 0.5, 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_table = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
SCHEMA = "doc_id bigint, item_id bigint, item_words int, covered_words int, tiles int, coverage double"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_table).split()


def _rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``width`` words."""
    n = max(0, len(ids) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _P + ids[k:k + n]
    h = (h ^ (h >> np.uint64(31))) * _P
    return h ^ (h >> np.uint64(29))


class Seeds:
    """Runs of a width in the items, by hash."""

    def __init__(self, items: list[np.ndarray], which: list[int], width: int):
        self.width = width
        found = [(_rolling(items[i], width), i) for i in which]
        h = np.concatenate([f for f, _ in found])
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate([np.full(len(f), i) for f, i in found])[order]
        self.at = np.concatenate([np.arange(len(f)) for f, _ in found])[order]
        self.may = np.zeros(1 << 22, bool)
        self.may[(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in the item), in order, of the runs that a document
        shares, each once however often the document has it."""
        h = np.unique(_rolling(ids, self.width))
        h = h[self.may[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        k = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else lo
        order = np.lexsort((self.at[k], self.item[k]))
        return self.item[k][order], self.at[k][order]


class Benchmark:
    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.rows, self.items, self.vocab = [], [], [], {}
        for k, (i, text) in enumerate(rows):
            w = words(text)
            if w:
                self.ids.append(i)
                self.rows.append(k)
                self.items.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.uint64))
        by_width: dict[int, list[int]] = {}
        for i, item in enumerate(self.items):
            by_width.setdefault(min(SEED, len(item)), []).append(i)
        self.seeds = [Seeds(self.items, which, width) for width, which in sorted(by_width.items())]

    def covered(self, text: str | None, share: float = 0.0) -> Iterator[tuple[int, int, int]]:
        """(index of the item, words covered, tiles) of items that share a
        seed and may have ``share`` of their words covered: no more can be
        than lie in shared seeds."""
        if not text or not self.items:
            return
        w = words(text)
        doc = np.fromiter(map(self.vocab.get, w, repeat(0)), np.uint64, len(w))
        for seeds in self.seeds:
            item, at = seeds.hits(doc)
            if not len(item):
                continue
            starts = np.concatenate(([0], np.flatnonzero(np.diff(item)) + 1))
            step = np.minimum(np.append(np.diff(at), seeds.width), seeds.width)  # words that a seed has before the next
            step[np.append(starts[1:] - 1, len(item) - 1)] = seeds.width
            for i, most in zip(item[starts].tolist(), np.add.reduceat(step, starts).tolist()):
                if most >= share * len(self.items[i]):
                    yield i, *tiling(doc, self.items[i], seeds.width)


class _Windows:
    """Hashes of all runs of a length, by differences of one running sum."""

    def __init__(self, ids: np.ndarray):
        x = (ids + np.uint64(1)) * _P
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        n = len(ids)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _P))))
        self.back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(int(_P), -1, 1 << 64))))))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum((x ^ (x >> np.uint64(31))) * power[:n], dtype=np.uint64)))
        self.used = np.zeros(n, bool)

    def free(self, length: int) -> np.ndarray:
        """Where runs of the length begin that no tile has touched."""
        taken = np.concatenate(([0], np.cumsum(self.used)))
        n = len(self.used) - length + 1
        return np.flatnonzero(taken[length:length + n] == taken[:n]) if n > 0 else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]


def tiling(doc: np.ndarray, item: np.ndarray, width: int) -> tuple[int, int]:
    """Words of the item in tiles, and tiles: the longest match of free words
    first, of equals the first in the document, then in the item.

    The longest length is found by bisection with running Karp-Rabin hashes;
    all tiles of a length are then laid in order. So a length costs time
    linear in both texts (but for sorting), however often they repeat, and
    lengths are few: they add up to no more than the item.
    """
    d, t = _Windows(doc), _Windows(item)

    def matches(length: int) -> tuple[np.ndarray, ...]:
        """Places in the document whose run the item has, too; the item's
        places, ordered by hash; where each of the former finds its own."""
        places = t.free(length)
        h = t.hashes(places, length)
        order = np.argsort(h, kind="stable")
        places, h = places[order], h[order]
        at = d.free(length)
        mine = d.hashes(at, length)
        lo = np.searchsorted(h, mine, "left")
        found = lo < len(h)
        found[found] = h[lo[found]] == mine[found]
        return at[found], places, lo[found], np.searchsorted(h, mine[found], "right")

    tiles, most = 0, min(len(doc), len(item))
    while most >= width:
        if not len(matches(most)[0]):
            low, high = width - 1, most  # a match of ``low`` words or none at all; none of ``high``
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if len(matches(middle)[0]) else (low, middle)
            most = low
            if most < width:
                break
        at, places, lo, hi = matches(most)
        next_place, k = {}, 0  # the item's places of a hash that are behind
        while k < len(at):
            p, first = int(at[k]), int(lo[k])
            spot = next_place.get(first, first)
            while spot < hi[k] and (t.used[places[spot]:places[spot] + most].any()
                                    or (doc[p:p + most] != item[places[spot]:places[spot] + most]).any()):
                spot += 1
            next_place[first] = spot
            if spot < hi[k]:
                q = int(places[spot])
                tiles += 1
                d.used[p:p + most] = t.used[q:q + most] = True
                k = int(np.searchsorted(at, p + most))
            else:
                k += 1
        most -= 1
    return int(t.used.sum()), tiles


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> Iterator[tuple[list[tuple[int, str]], list[int]]]:
    """The items, equal ones once, and how many rows each has, in blocks of
    about ``block`` words at most (or one item)."""
    rows = (benchmark.select(F.col(item_col).alias("_w_id"), F.col(text_col).alias("_w_text")).where("_w_text is not null")
            .groupBy("_w_id", "_w_text").agg(F.count("*").alias("_w_n")))
    total = rows.agg(F.sum(F.size(F.split("_w_text", r"\s+")))).first()[0] or 0
    n = -(-2 * total // block) if total > block else 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("_w_id", "_w_text"), F.lit(n)) == k)
        got = part.orderBy("_w_id", "_w_text").collect()
        yield [(r[0], r[1]) for r in got], [r[2] for r in got]


def _per_worker(shared) -> Benchmark:
    """The benchmark of a broadcast, indexed once in a worker."""
    if _per_worker.of is not shared.value:
        _per_worker.of, _per_worker.made = shared.value, Benchmark(shared.value)
    return _per_worker.made


_per_worker.of = _per_worker.made = None


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
                 block: int = BLOCK) -> DataFrame:
    """A row for each document and item with coverage of ``threshold`` or more."""
    texts = small_batches(docs).select(F.col(id_col).cast("bigint").alias("_w_id"), F.col(text_col).alias("_w_text"))
    out = None
    for rows, times in _blocks(benchmark, item_col, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        repeats = {k: n for k, n in enumerate(times) if n > 1}

        def run(batches: Iterator[pa.RecordBatch], shared=shared, repeats=repeats) -> Iterator[pa.RecordBatch]:
            bench = _per_worker(shared)
            for batch in slices(batches):
                found = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item, n, tiles in bench.covered(text, threshold):
                        size = len(bench.items[item])
                        if n >= threshold * size:
                            found.append((i, bench.ids[item], size, n, tiles, n / size, repeats.get(bench.rows[item], 1)))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
                columns = zip(*found) if found else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=[*(f.split()[0] for f in SCHEMA.split(", ")), "_w_n"])

        part = texts.mapInArrow(run, f"{SCHEMA}, _w_n bigint")
        if repeats:  # a row for each row of the benchmark
            part = part.withColumn("_w_k", F.explode(F.sequence(F.lit(1).cast("long"), "_w_n"))).drop("_w_k")
        part = part.drop("_w_n")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    at = docs.columns.index(text_col)
    for rows, _ in _blocks(benchmark, item_col, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = _per_worker(shared)
            for batch in slices(batches):
                keep = [all(n < threshold * len(bench.items[item]) for item, n, _ in bench.covered(text, threshold))
                        for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs
