"""Token counts by byte-pair merging with a heap and a linked list.

A text's characters are the first symbols. A heap holds the adjacent pairs
that the vocabulary joins, best score first and the leftmost of equals; a
popped pair that still stands becomes one symbol, and the pairs it forms with
its neighbours in the linked list are pushed. The number of tokens is that of
the first symbols less the merges, so no identifiers are made. A character
that the vocabulary lacks counts as its UTF-8 bytes.

Merges never cross two characters that stand side by side in no piece of the
vocabulary, so a text falls into parts that can be counted one by one: first
words, whose counts are remembered, then, in a new word, the parts between
such characters. All of it is exact, and the memory of a worker is bounded.

Defined results: null and empty texts have no tokens (and zero bytes); texts
are counted whole, however long; strings of special tokens are ordinary text;
repeated rows are counted alike; an empty table gives no rows; input columns
pass through, and clash only with the names given for the new ones.
"""

from __future__ import annotations

import heapq
import pickle
import re
from itertools import islice

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"     # stands for a space in pieces
WORDS = 300_000      # words remembered by a worker, and parts of words
LONG = 64            # longer words aren't remembered


def scores(path: str) -> dict[str, float]:
    """Score of each piece that texts can hold; the model must leave texts as
    they are but for the spaces, and fall back to bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize("ａ  é ") != f"{SPACE}ａ{SPACE * 2}é{SPACE}":
        raise ValueError(f"{path} normalizes texts")
    ids = range(model.vocab_size())
    if sum(map(model.is_byte, ids)) != 256:
        raise ValueError(f"{path} has no byte pieces")
    return {model.id_to_piece(i): model.get_score(i) for i in ids
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}


class Counts(dict):
    """Tokens of words; the older half goes when there are too many."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, word: str) -> int:
        got = self.count(word)
        if len(word) <= LONG:
            if len(self) >= WORDS:
                for old in list(islice(self, WORDS // 2)):
                    del self[old]
            self[word] = got
        return got


class Counter:
    """One vocabulary, ready to count."""

    def __init__(self, score: dict[str, float]):
        self.rank = {p: -s for p, s in score.items()}
        # bytes of characters that stand in pieces without being one
        self.inner = {c: len(c.encode()) for c in set("".join(score)) if c not in score}
        self.side_by_side = {p[i:i + 2] for p in score for i in range(len(p) - 1)}
        # words can be told apart by spaces if no piece goes on after one
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in score)
        self.words = Counts(lambda word: self.parts(SPACE + word.replace(" ", SPACE)))
        self.known = Counts(self.merged)

    def merged(self, part: str) -> int:
        if len(part) == 1:
            return 1 if part in self.rank else len(part.encode())
        symbol: list[str | None] = list(part)
        size, rank, more = len(part), self.rank, self.inner
        count = size + sum(more[s] - 1 for s in symbol if s in more)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(rank[pair], left, pair) for left, pair in enumerate(map(str.__add__, part, part[1:])) if pair in rank]
        heapq.heapify(heap)
        while heap:
            _, left, joined = heapq.heappop(heap)
            one, right = symbol[left], after[left]
            if one is None or right == size or one + (two := symbol[right]) != joined:
                continue  # one of the two has been merged since
            count -= more.get(one, 1) + more.get(two, 1) - 1
            symbol[left], symbol[right] = joined, None
            follower = after[left] = after[right]
            if follower < size:
                before[follower] = left
                if (pair := joined + symbol[follower]) in rank:
                    heapq.heappush(heap, (rank[pair], left, pair))
            if (leader := before[left]) >= 0 and (pair := symbol[leader] + joined) in rank:
                heapq.heappush(heap, (rank[pair], leader, pair))
        return count

    def parts(self, word: str) -> int:
        count, start, near = 0, 0, self.side_by_side
        for end, pair in enumerate(map(str.__add__, word, word[1:]), 1):
            if pair not in near:
                count += self.known[word[start:end]]
                start = end
        return count + self.known[word[start:]]

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        if not self.by_words:
            return self.parts(SPACE + text.replace(" ", SPACE))
        if text[0] == " " or "  " in text:
            words = [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
        else:
            words = text.split(" ")
        return sum(map(self.words.__getitem__, words))


_counters: dict[int, Counter] = {}


def _counter(packed: bytes) -> Counter:
    key = hash(packed)
    if key not in _counters:
        _counters[key] = Counter(pickle.loads(packed))
    return _counters[key]


def count_tokens(df: DataFrame, text_col: str = "text", bytes_col: str = "n_bytes", tokens_col: str = "n_tokens",
                 model: str = MODEL) -> DataFrame:
    """``df`` with the UTF-8 bytes and the tokens of each text."""
    # a table of fixed size, the vocabulary's
    packed = df.sparkSession.sparkContext.broadcast(pickle.dumps(scores(model)))

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        count = _counter(packed.value).tokens
        return pa.array([count(t) for t in texts.to_pylist()], pa.int64())

    text = F.col(f"`{text_col}`")
    return small_batches(df).withColumns({bytes_col: F.octet_length(F.coalesce(text, F.lit(""))).cast("long"),
                                          tokens_col: tokens(text)})
