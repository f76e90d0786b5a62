"""Byte-level BPE encoding and decoding in time linear in the text.

The vocabulary's byte strings, mapped to Latin-1, make an Aho-Corasick
automaton that finds the longest token at every position of a piece. Tokens
are laid from left to right, the longest first; a token may follow another
only if the merges turn their joined bytes into just these two, which is
computed once per pair and kept. Where nothing fits, the last token is taken
back and its end never tried again. A sequence whose neighbours all agree is
the one the merges produce, so the result is exact.

Defined results: null and empty texts have no tokens and decode to no bytes;
whole texts are read; strings of special tokens are ordinary text; input
columns pass through, and clash only with the name given for the new one.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = 150_000      # words remembered by a worker
PIECES = 60_000      # pieces of words
PAIRS = 250_000      # pairs of tokens
MARKS = 1 << 22      # of texts that were asked for once
LONG = 48            # longer pieces and words aren't remembered
STOPS = ".,;:!?"
WHITE = regex.compile(r"\s").match

# letters and numbers of later Unicode than the tiktoken library's, to which they are
# unassigned; they split as another unassigned character does
LATER = regex.compile("[" + "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f "
    "12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 "
    "18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
    "2cea2-2cead 323b0-33479 3d000-3fc3f").split()) + "]")
UNASSIGNED = "\u0378"


def ranks(lines: bytes) -> dict[bytes, int]:
    """A line is a token in base 64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


def letters(word: str) -> bool:
    """Whether a word is surely one run of letters to the pattern."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class Memo(dict):
    """Values made when first asked for. The oldest eighth is forgotten when
    there are too many, and from then on a text is kept when asked for again
    (marks by hash say so, wiped in time), as most come once. Long texts, and
    those with an end that is quickly put to the rest, aren't kept."""

    def __init__(self, make: Callable, most: int, ends: str = ""):
        self.make, self.most, self.ends = make, most, ends
        self.marks, self.marked = bytearray(), 0

    def again(self, key: str) -> bool:
        at = hash(key) % MARKS
        if self.marks[at]:
            return True
        if self.marked >= MARKS // 2:
            self.marks, self.marked = bytearray(MARKS), 0
        self.marks[at] = 1
        self.marked += 1
        return False

    def __missing__(self, key):
        got = self.make(key)
        if not isinstance(key, str) or (len(key) <= LONG and key[-1:] not in self.ends and (not self.marks or self.again(key))):
            if len(self) >= self.most:
                for old in list(islice(self, self.most // 8)):
                    del self[old]
                if isinstance(key, str) and not self.marks:
                    self.marks = bytearray(MARKS)
            self[key] = got
        return got


class Codec:
    """One vocabulary, ready to encode."""

    def __init__(self, lines: bytes, pattern: str):
        self.rank = ranks(lines)
        self.token = dict(zip(self.rank.values(), self.rank))
        self.pattern = regex.compile(pattern)
        # no match of the pattern goes on from another character to a space
        self.by_words = pattern == public_tokenizers.PATTERN
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.size = {r: len(t) for t, r in self.rank.items()}
        self.most = max(self.size.values())
        self.halves = Memo(self.half, 1 << 62)     # of tokens: as many as there are
        self.shorter = Memo(self.next_shorter, 1 << 62)
        self.agree = Memo(self.fits, PAIRS)
        self.pieces = Memo(self.piece, PIECES)
        self.words = Memo(self.word, WORDS, STOPS)

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins, itself twice
        for a byte, None if merges don't lead to it: the lowest rank first,
        the leftmost of equals."""
        data = self.token[token]
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low >= token:
                return None
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return self.rank[parts[0]], self.rank[parts[-1]]

    def fits(self, key: int) -> bool:
        """Whether a token may follow another (-1: stand at the start).

        The merges that made the two are taken back in turn, the latest
        first. Whatever then touches at the seam must not have been merged
        across it before the token that was taken back was made."""
        left, right = key >> 32, key & 0xFFFFFFFF
        halves, token, rank = self.halves, self.token, self.rank
        if left < 0:
            return halves[right] is not None
        if halves[left] is None or halves[right] is None:
            return False
        made = 1 << 60        # rank of the merge taken back last
        on_left = True        # ... was it left of the seam
        while True:
            across = rank.get(token[left] + token[right], 1 << 60)
            # of equal ranks the leftmost merge comes first
            if across < made or (across == made and not on_left):
                return False
            ends = halves[left][1] if len(token[left]) > 1 else -1
            begins = halves[right][0] if len(token[right]) > 1 else -1
            if ends < 0 and begins < 0:
                return True
            if begins < 0 or (ends >= 0 and left > right):
                made, on_left, left = left, True, ends
            else:
                made, on_left, right = right, False, begins

    def next_shorter(self, token: int) -> int:
        """The longest token that ``token`` starts with, or -1."""
        data = self.token[token]
        return next((self.rank[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.rank), -1)

    def split(self, piece: bytes) -> list[int]:
        latin = piece.decode("latin-1")
        size, agree, shorter = self.size, self.agree, self.shorter
        out, at, last, closed = [], 0, -1, set()
        for end, token in self.automaton.iter_long(latin):  # the longest at each place, from the left
            if not agree[last << 32 | token]:
                break
            out.append(token)
            at, last = end + 1, token
        else:
            return out
        prefix, get, most = self.automaton.longest_prefix, self.automaton.get, self.most
        while True:
            while token >= 0 and (not agree[last << 32 | token] or at + size[token] in closed):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last = token
                at += size[token]
                if at == len(latin):
                    return out
                rest = latin[at:at + most]
                n = prefix(rest)
                while (token := get(rest[:n], -1)) < 0:
                    n -= 1
            else:  # longer ones than the one taken back were tried before it
                closed.add(at)
                last = out.pop()
                at -= size[last]
                token = shorter[last]
                last = out[-1] if out else -1

    def piece(self, text: str) -> bytes:
        """Packed ids of a match of the pattern; a whole token stays whole."""
        data = text.encode()
        rank = self.rank.get(data)
        return array("i", self.split(data) if rank is None else (rank,)).tobytes()

    def find(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if text.isascii() or not LATER.search(text):
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(LATER.sub(UNASSIGNED, text))]

    def matches(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def word(self, word: str) -> bytes | None:
        """Packed ids of a space and a word; None if white space ends it, as
        the next space may then belong to it."""
        core = word.rstrip(STOPS)
        if letters(core):  # one match, and another one of marks
            if core == word:
                return self.piece(" " + word)
            return self.words[core] + self.pieces[word[len(core):]]
        if not word or WHITE(word[-1]):
            return None
        head, line, tail = word.partition("\n")
        if line and head and not WHITE(head[-1]) and not WHITE(tail[0]):  # a match of its own between two others
            return self.words[head] + self.pieces[line] + self.unspaced(tail)
        return self.matches(" " + word)

    def unspaced(self, text: str) -> bytes:
        """Packed ids of a text that no white space ends."""
        core = text.rstrip(STOPS)
        if letters(core):
            return self.pieces[core] + (self.pieces[text[len(core):]] if core != text else b"")
        return self.matches(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *words = text.split(" ") if self.by_words else [text]
        try:
            if not first or WHITE(first[-1]):
                return self.matches(text)
            return self.matches(first) + b"".join(map(self.words.__getitem__, words))
        except TypeError:  # a word ends with white space
            return self.matches(text)


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(lines: bytes, pattern: str) -> Codec:
    key = (hash(lines), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(lines, pattern)
    return _codecs[key]


_tokens: dict[int, pa.Array] = {}


def _tokens_of(lines: bytes) -> pa.Array:
    """The tokens by rank: all that decoding needs."""
    key = hash(lines)
    if key not in _tokens:
        token = {r: t for t, r in ranks(lines).items()}
        _tokens[key] = pa.array(map(token.get, range(max(token) + 1)), pa.binary())
    return _tokens[key]


def _shared(df: DataFrame, path: str):
    """The vocabulary file, of fixed size, for all executors."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _joined(lines: bytes, ids: pa.Array) -> pa.Array:
    """The bytes of each array of ids (null: none)."""
    found = _tokens_of(lines).take(ids.flatten())
    if found.null_count:
        raise KeyError("an id that no token has")
    # the tokens lie one after the other: a text's bytes run from its first one to its last
    starts = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1)
    ends = np.cumsum([0, *pc.list_value_length(ids).fill_null(0).to_pylist()])
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(starts[ends]), found.buffers()[2]])


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: str = VOCABULARY,
           pattern: str = public_tokenizers.PATTERN, bytes_col: str | None = None) -> DataFrame:
    """``df`` with the token ids of each text, an array of int; with
    ``bytes_col`` also what ``decode`` makes of them, in the same pass."""
    lines = _shared(df, vocabulary)

    def both(texts: pa.Array) -> pa.Array:
        packed = [*map(_codec(lines.value, pattern).encode, texts.to_pylist())]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), np.int32)))
        return pa.StructArray.from_arrays([ids] + ([_joined(lines.value, ids)] if bytes_col else []), names=["i", "b"][:1 + bool(bytes_col)])

    kind = T.StructType([T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("b", T.BinaryType())][:1 + bool(bytes_col)])
    # called non-deterministic, so that its fields are read from one call
    made = F.arrow_udf(both, kind).asNondeterministic()
    out = small_batches(df).withColumn("_w_made", made(F.col(f"`{text_col}`")))
    out = out.withColumn(ids_col, F.col("_w_made.i"))
    return (out.withColumn(bytes_col, F.col("_w_made.b")) if bytes_col else out).drop("_w_made")


def decode(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the bytes that each array of ids stands for (null: none)."""
    lines = _shared(df, vocabulary)

    @F.arrow_udf(T.BinaryType())
    def joined(ids: pa.Array) -> pa.Array:
        return _joined(lines.value, ids)

    return small_batches(df).withColumn(bytes_col, joined(F.col(f"`{ids_col}`")))
