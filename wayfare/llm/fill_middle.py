"""Fill-in-the-middle transformation by rank queries on a wavelet matrix.

A text's units are runs of other characters with the white space before them,
and a last run of white space. Each byte of a text is of a class: white, first
byte of a character or a later one, and whether a run of other characters ends
with it. A wavelet matrix over the classes of a batch of texts answers how many
bytes of a class stand before a place; sums and differences of such ranks are
a text's units and the characters between two places, and bisection on the
ranks of run ends finds the byte where a given unit ends, for all texts at once.

Two numbers from a hash of the id choose the cuts between units, two more the
form: plain, or prefix, middle and suffix put in another order behind marks.

Defined results: null and empty texts are plain and have no units; texts that
hold a mark are plain; whole texts are cut, however long; a null id counts as
an empty one; rows that repeat id and text come out alike; an empty table
gives no rows; input columns pass through, and clash only with the names of
the new ones (n, form, prefix_chars, middle_chars, output).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import light_slices, small_batches

SEED = 42
PLAIN_PERCENT = 50   # of all texts
SPM_PERCENT = 80     # of those that are cut
MARKS = ("<P>", "<S>", "<M>")
WHITE, LATER, END = 1, 2, 4      # bits of a class
ADDED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType())])


class Bits:
    """A bit vector that counts its ones before a place: a running count for
    every 64 bits, and the ones of a word's part. Its zeros are the rest."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        part = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the one that ``k`` ones stand before: bisection on the
        counts of the words, then on the ranks inside one."""
        low = (np.searchsorted(self.before, k, side="right") - 1) << 6
        for step in (32, 16, 8, 4, 2, 1):
            low = np.where(self.rank(low + step) <= k, low + step, low)
        return low


class WaveletMatrix:
    """Symbols of ``depth`` bits, a bit vector for each from the highest
    down; every level sorts stably by the bit before it, zeros first."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels = []
        for shift in reversed(range(depth)):
            bit = (symbols >> shift) & 1
            self.levels.append(Bits(bit))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        self.size, self.depth = len(symbols), depth

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the symbols before each place equal ``symbol``."""
        start = np.zeros(1, np.int64)
        for level, shift in zip(self.levels, reversed(range(self.depth))):
            zeros = self.size - level.ones
            if symbol >> shift & 1:
                start, at = zeros + level.rank(start), zeros + level.rank(at)
            else:
                start, at = start - level.rank(start), at - level.rank(at)
        return at - start


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each byte of texts that begin at ``starts`` (the end of all
    bytes is the last)."""
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    stop = np.append(white[1:], True)           # a white byte or a text's end follows
    stop[starts[1:][starts[1:] > 0] - 1] = True
    return (white * WHITE + ((data & 0xC0) == 0x80) * LATER + (stop[:len(data)] & ~white) * END).astype(np.uint8)


def draws(ids: list) -> np.ndarray:
    """Four unsigned numbers of each id."""
    digests = b"".join(hashlib.sha256(f"{SEED}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _cut(ids: list, texts: list[bytes]) -> pa.StructArray:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    matrix = WaveletMatrix(classes(data, starts), 3)
    ends = matrix.levels[0]                     # END is the highest bit
    before = ends.rank(starts)
    runs = before[1:] - before[:-1]
    open_end = (sizes > 0) & (matrix.rank(WHITE, starts[1:]) > matrix.rank(WHITE, np.maximum(starts[1:] - 1, 0)))
    n = runs + open_end

    h = draws(ids)
    first, second = h[:, 0] % (n + 1), h[:, 1] % (n + 1)

    def place(units: np.ndarray) -> np.ndarray:
        """Byte after so many units of each text."""
        inside = (units > 0) & (units <= runs)
        found = ends.select(np.where(inside, before[:-1] + units - 1, 0)) + 1 if ends.ones else starts[:-1]
        return np.where(inside, found, np.where(units > runs, starts[1:], starts[:-1]))

    def chars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Characters between two places: bytes less the later ones, of
        which some end a run and some don't."""
        later = [matrix.rank(c, b) - matrix.rank(c, a) for c in (LATER, LATER | END)]
        return b - a - sum(later)

    p, m = place(np.minimum(first, second)), place(np.maximum(first, second))
    marked = np.array([any(k.encode() in t for k in MARKS) for t in texts], bool)
    plain = (sizes == 0) | marked | (h[:, 2] % 100 >= PLAIN_PERCENT)
    spm = h[:, 3] % 100 < SPM_PERCENT
    prefix, suffix, middle = (k.encode() for k in MARKS)
    outputs = []
    for k, text in enumerate(texts):
        if plain[k]:
            outputs.append(text)
            continue
        a, b = int(p[k] - starts[k]), int(m[k] - starts[k])
        parts = (suffix, text[b:], prefix, text[:a]) if spm[k] else (prefix, text[:a], suffix, text[b:])
        outputs.append(b"".join((*parts, middle, text[a:b])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
         pa.array(chars(starts[:-1], p), pa.int64(), mask=plain), pa.array(chars(p, m), pa.int64(), mask=plain),
         pa.array(outputs, pa.binary()).cast(pa.string())], names=ADDED.names)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with each text's units ``n``, its ``form``, the characters of
    prefix and middle (null if plain) and the transformed ``output``; the
    text column itself stays out, since ``restore`` gives it back."""
    keep = [c for c in df.columns if c != text_col]
    fields = [f for f in df.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light_slices(batches, text_col):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            cut = _cut(batch.column(id_col).to_pylist(), [t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + cut.flatten(), names=keep + ADDED.names)

    return small_batches(df).mapInArrow(run, T.StructType(fields + ADDED.fields))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: no part holds a mark, so the
    marks cut it into its parts again."""
    part = F.split(output, "|".join(MARKS), -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
