"""Merkle manifest, fill-in-the-middle and token counts against brute force."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("wayfare.llm")

import numpy as np  # noqa: E402
import sentencepiece  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wayfare.llm import fill_middle, merkle, queries, token_count  # noqa: E402
from wayfare.llm.common import light_slices  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, path string, leaf string"
TEXTS = [None, "", " ", "a", " a", "a ", "A  b\tc\n", "<P>x", "x" * 60_000, "lang wort " * 8000, "é日本 😀 ▁ <s>", "AbC dEf", " x\u0085y"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def low(t):
    return None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)


def up(run):
    """Level by level, the nodes from a run of nodes to its root."""
    levels = [run]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        levels.append([h(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)])
    return levels


def brute_manifest(rows):
    leaf = lambda r, t: h(*map(field, (r[0], r[3], r[2], r[4], t)))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang, own in langs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[lang] = up([leaf(r, r[1]) for r in own])
    top = up([trees[x][-1][0] for x in order]) if order else []
    out = []
    for lang, own in langs.items():
        for pos, r in enumerate(own):
            found = leaf(r, low(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r, r[1])
            joined, node = [], found
            for levels, at in ((trees[lang], pos), (top, order.index(lang))):
                for nodes in levels[:-1]:
                    run = nodes[at - at % 8:at - at % 8 + 8]
                    joined += run[:at % 8] + run[at % 8 + 1:]
                    node = h(*run[:at % 8], node, *run[at % 8 + 1:])
                    at //= 8
            out.append((r[0], leaf(r, r[1]), trees[lang][-1][0], top[-1][0], h(*joined), node, node == top[-1][0]))
    return out


def as_table(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("sizes", [[1], [8], [3, 9], [1, 64, 65, 513], [1200] + [1] * 11])
def test_manifest(spark, tmp_path, sizes):
    r = random.Random(sum(sizes))
    rows = []
    for k, size in enumerate(sizes):
        for _ in range(size):
            rows.append((len(rows) * 7 % 5000, r.choice(TEXTS[:8] + TEXTS[10:]), None if k == 0 else f"l{k}", r.choice([None, "s", ""]),
                         r.choice([None, 3]), "x", "y", "z"))
    got = queries.op11_merkle(spark, as_table(spark, tmp_path, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(rows)))


def test_manifest_ties_nulls_and_long_texts(spark, tmp_path):
    rows = [(k % 5 if k % 7 else None, t, "", "s", 1, "n", "p", "l") for k, t in enumerate(TEXTS * 3)]
    got = queries.op11_merkle(spark, as_table(spark, tmp_path, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(rows)))


def test_manifest_writes_flat_rows(spark, tmp_path, monkeypatch):
    """Readers take thousands of rows at once: none may hold a block."""
    written, stage, through = [], merkle.stage, merkle.cut_through
    note = lambda df: written.append(df.dtypes) or df
    monkeypatch.setattr(merkle, "stage", lambda df: stage(note(df)))
    monkeypatch.setattr(merkle, "cut_through", lambda session, build: note(through(session, build)), raising=False)
    rows = [(k, "t", "en" if k % 3 else None, "s", 1, "x", "y", "z") for k in range(1600)]
    got = queries.op11_merkle(spark, as_table(spark, tmp_path, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(rows)))
    assert len(written) >= 4 and not [t for table in written for _, t in table if "array" in t]


def test_manifest_carries_columns_and_is_empty(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1, "n", "p", "l")], DOCS)
    row = merkle.manifest(df, merkle.leaf_hash([F.col("text")]), carry={"path2": F.col("path")}).first()
    assert row.leaf == row.subroot == row.root == h("1:a") and row.path == [] and row.path2 == "p"
    assert merkle.manifest(df.limit(0), merkle.leaf_hash([F.col("text")])).count() == 0


UNITS = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_cut(i, text):
    text = text or ""
    units, g = UNITS.findall(text), h(f"42:{'' if i is None else i}")
    n, draw = len(units), [int(g[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or draw[2] % 100 >= 50:
        return i, n, "plain", None, None, text
    if draw[3] % 100 < 80:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    r = random.Random(4)
    parts = ["a", "é", "日", "😀", " ", "\n", "  ", "<P>", "<S", "<", ">", "x y", "\x0b", "\x85", "\xa0"]
    texts = TEXTS + ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(400)]
    rows = [(r.choice([None, k]), t, "en", "s", 1, "own", "p", "l") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:3], DOCS).drop("n")
    out = fill_middle.fill_in_middle(df)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "path", "leaf", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.select("*", fill_middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((g.doc_id, g.n, g.form, g.prefix_chars, g.middle_chars, g.output) for g in got), key=key) == sorted(
        (brute_cut(x[0], x[1]) for x in rows + rows[:3]), key=key)
    assert sorted(g.back for g in got) == sorted((x[1] or "") for x in rows + rows[:3])
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_wavelet_matrix(symbols):
    data = np.array(symbols, np.uint8)
    matrix, at = fill_middle.WaveletMatrix(data, 3), np.arange(len(data) + 1)
    for symbol in range(8):
        assert matrix.rank(symbol, at).tolist() == [symbols[:k].count(symbol) for k in at]
    ends = [k for k, s in enumerate(symbols) if s >= 4]
    if ends:
        assert matrix.levels[0].select(np.arange(len(ends))).tolist() == ends


def test_light_slices(spark):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 5, None, "b" * 30, "c", "d" * 9, "e"]})
    assert [p.num_rows for p in light_slices([batch], "t", most=10)] == [2, 1, 2, 1]
    assert [p.num_rows for p in light_slices([batch], "t", rows=4, most=99)] == [4, 2]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_count.MODEL)


def test_token_counts(spark, library):
    rows = [(k, t, "en", "s", 1, "n", "p", "l") for k, t in enumerate(TEXTS + TEXTS[:4])]
    got = token_count.count_tokens(spark.createDataFrame(rows, DOCS).withColumnRenamed("n", "word")).collect()
    assert {g.doc_id: (g.n_bytes, g.n_tokens, g.word) for g in got} == {
        k: (len((t or "").encode()), len(library.encode(t or "")), "n") for k, t, *_ in rows}
    assert token_count.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("  aeinrst\n\t▁12.<s>é²日ａ😀\0")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_token_counts_of_any_text(text):
    global _COUNTER
    _COUNTER = globals().get("_COUNTER") or token_count.Counter(token_count.scores(token_count.MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=token_count.MODEL)
    assert _COUNTER.tokens(text) == len(library.encode(text))


def test_token_counts_of_a_small_vocabulary():
    """Pieces that go on after a space, and characters that aren't pieces."""
    score = {"a": -1.0, "b": -2.0, "▁": -3.0, "ab": -4.0, "b▁a": -5.0, "aé": -6.0, "▁a": -7.0, "b▁": -8.0, "abab": -9.0}
    counter = token_count.Counter(score)

    def plain(text):
        parts = list("▁" + text.replace(" ", "▁")) if text else []
        while True:
            best = max((score.get(x + y, -99.0) for x, y in zip(parts, parts[1:])), default=-99.0)
            if best == -99.0:
                return sum(1 if p in score else len(p.encode()) for p in parts)
            i = next(i for i, (x, y) in enumerate(zip(parts, parts[1:])) if score.get(x + y) == best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice("aab  é日") for _ in range(r.randint(0, 14)))
        assert counter.tokens(text) == plain(text), text
    kept = token_count.WORDS
    try:
        token_count.WORDS = 4  # forgetting words changes no count
        again = token_count.Counter(token_count.scores(token_count.MODEL))
        assert [again.tokens("alpha beta gamma delta eps zeta") for _ in range(3)] == [again.tokens("alpha beta gamma delta eps zeta")] * 3
        assert len(again.words) <= 5
    finally:
        token_count.WORDS = kept


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers
    from wayfare.llm import bpe
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Codec(f.read(), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("  aeinrst\n\t'12.,!é²日 \x1c\x85")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_byte_bpe_of_any_text(codec, text):
    import public_tokenizers
    import tiktoken
    global _TIKTOKEN
    if "_TIKTOKEN" not in globals():
        _TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.rank, special_tokens={})
    assert np.frombuffer(codec.encode(text), np.int32).tolist() == _TIKTOKEN.encode_ordinary(text)


def test_characters_that_the_library_does_not_know(codec):
    import tiktoken
    want = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=codec.rank, special_tokens={})
    later = [0x558, 0x88F, 0x11DE0, 0x16FF4, 0x187F8, 0x2B73A, 0x3323C, 0x33479]
    for c in [*later, *range(0x80, 0xD800, 61), *range(0xE000, 0x40000, 61)]:
        for text in (f"{chr(c)}대", f"no a{chr(c)}1 {chr(c)}é.{chr(c)}"):
            assert np.frombuffer(codec.encode(text), np.int32).tolist() == want.encode_ordinary(text), text


def test_words_around_a_line_break_are_looked_up(codec):
    import tiktoken
    want = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=codec.rank, special_tokens={})
    found, kept = [], codec.find
    codec.find = lambda text: found.append(text) or kept(text)  # hides the method
    try:
        text = "Some qzxv.\nThen wvrk,\nzorp!\nÀ la\nfin x"
        assert np.frombuffer(codec.encode(text), np.int32).tolist() == want.encode_ordinary(text)
        assert found == ["Some", "zorp!\nÀ"]  # the first word, and a tail that isn't one word
    finally:
        del codec.find
    for text in ("a\n", "a\n b", "a \nb", "a\n\nb", "a.\n.b", "a\n's", "\na", "a b\n\x85c", "a b\n12.\nc", "a b\r\nc", "a b\nc\nd "):
        assert np.frombuffer(codec.encode(text), np.int32).tolist() == want.encode_ordinary(text)


def test_memo_keeps_what_comes_again():
    from wayfare.llm import bpe
    made = []
    memo = bpe.Memo(lambda key: made.append(key) or len(key), 16)
    for k in range(16):
        assert memo[f"w{k:02}"] == 3
    assert memo["again"] == 5  # the last before marks are needed
    often = [f"w{k:02}" for k in range(2, 16)] + ["again"]
    for k in range(40):
        assert memo[f"once{k}"] == len(f"once{k}") and len(memo) <= 16
    made.clear()
    assert [memo[k] for k in often] == [len(k) for k in often] and not made  # words that came once drove none out
    memo["twice"], memo["twice"]
    assert "twice" in memo and made == ["twice", "twice"]


def test_decoded_bytes_of_odd_id_arrays():
    import pyarrow as pa
    from wayfare.llm import bpe
    lines = b"YQ== 0\nYmM= 2\n/w== 3\n"  # no token 1
    ids = pa.array([[9], [0, 2], None, [], [3, 3, 0]], pa.list_(pa.int32())).slice(1)
    assert bpe._joined(lines, ids).to_pylist() == [b"abc", b"", b"", b"\xff\xffa"]
    assert bpe._joined(lines, ids.slice(0, 0)).to_pylist() == [] and bpe._joined(lines, ids.slice(1, 1)).to_pylist() == [b""]
    for bad in (1, 7):
        with pytest.raises((KeyError, IndexError)):
            bpe._joined(lines, pa.array([[0, bad]], pa.list_(pa.int32())))


def test_neighbours_agree_as_the_merges_say(codec):
    def merged(data):
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            low = min(codec.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:]))
            if low == 1 << 60:
                break
            i = next(i for i, (a, b) in enumerate(zip(parts, parts[1:])) if codec.rank.get(a + b) == low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    r = random.Random(6)
    tokens = [t for t in codec.token if len(codec.token[t]) < 9]
    agreed = 0
    for _ in range(20_000):
        a, b = r.choice(tokens), r.choice(tokens[:r.choice([200, 3000, len(tokens)])])
        want = merged(codec.token[a] + codec.token[b]) == [codec.token[a], codec.token[b]]
        assert codec.fits(a << 32 | b) == want
        agreed += want
    assert 2000 < agreed < 19_500


def naive_tiling(doc, item, width):
    """Greedy string tiling by its definition."""
    doc_free, item_free, tiles = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc_free[p + n] and item_free[q + n] and doc[p + n] == item[q + n]:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < width:
            return item_free.count(False), tiles
        tiles += 1
        doc_free[p:p + n] = item_free[q:q + n] = [False] * n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=45), st.lists(st.integers(1, 3), min_size=1, max_size=30), st.integers(2, 5))
def test_tiling_equals_its_definition(doc, item, width):
    from wayfare.llm.decontaminate import tiling
    assert tiling(np.array(doc, np.uint64), np.array(item, np.uint64), width) == naive_tiling(doc, item, width)


def test_decontamination_equals_naive_tiling(spark):
    from wayfare.llm import decontaminate as D
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(r.choice(vocab[:r.choice([2, 40])]) for _ in range(n))
    items = [(k, text(r.choice([1, 3, 5, 8, 20, 40]))) for k in range(40)] + [(40, None), (41, ""), (7, "w1 w2")]
    docs = [(k, text(r.randint(0, 60)) + " " + " ".join(items[r.randrange(40)][1].split()[r.randint(0, 4):])) for k in range(120)]
    want = set()
    for i, t in docs:
        for j, it in items:
            w, v = t.split(), (it or "").split()
            if v:
                n, tiles = naive_tiling(w, v, min(5, len(v)))
                if n and n >= 0.5 * len(v):
                    want.add((i, j, len(v), n, tiles))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, block=100)
    assert {tuple(x)[:5] for x in got.collect()} == want
    assert D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).count() == 0


def test_repeated_words_cost_no_more_than_others():
    import time
    from wayfare.llm.decontaminate import Benchmark
    start = time.time()
    bench = Benchmark([(1, "la " * 20_000), (2, "la lu " * 3000)])
    assert dict((i, (n, k)) for i, n, k in bench.covered("la " * 20_000, 0.5)) == {0: (20_000, 1)}
    assert list(bench.covered("lu la " * 5000, 0.5)) == [(1, 6000, 1)]
    assert time.time() - start < 5


def html_of(html):
    from wayfare.llm import html_text
    page = html_text.Page(html)
    return page.text(html_text.train().marginals(page))


def test_html_odd_markup_loses_no_article():
    page = "<article><p>One, two. Three.</p>%s<p>Whole article, of it. Yes.</p>%s<p>Last one, here.</p></article>"
    want = "One, two. Three. Whole article, of it. Yes. Last one, here."
    for odd in ("<!-->", "<!--->", "<!-- no --!>", "<!-- a > b -->", "<script>var a='<p>no';</script foo>", "<style>p{}</style\n>",
                "<object>no<object>no</object>no</object>", "<svg><svg>no</svg>no</svg>", "<svg>", "<template>", "<object data='x'>"):
        assert html_of(page % (odd, odd)) == want, odd
    for cut in ("<p class='x", '<a href="y', "<div", "</p", "<!-- rest", "<script>rest"):
        assert html_of(page % ("", "") + cut) == want, cut


def test_long_addresses_begin_where_they_begin():
    from wayfare.llm import pii
    local, domain = "a" * 90 + ".b", " dot ".join(f"label{k}" for k in range(9))
    text = f"write to {local} at {domain}."
    assert ("email", 9, len(text) - 1) in pii.candidates(text)
    assert pii.candidates("at dot") == [] and pii.candidates(" at x.y") == []


def test_warc_records_are_told_apart_by_any_reader(spark):
    """A reader of the bare format: frames, headers, blocks by length."""
    import struct
    import zstandard
    from wayfare.llm import warc
    body = "<p>" + "text " * 400 + "</p>"
    rows = [(1, "http://a.org/x y", body), (2, "http://b.org/", body), (2, "http://b.org/", body), (3, None, "short"), (3, None, "short"), (None, None, None)]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)).collect()
    ids, kinds, refers = [], [], []
    for a in archives:
        content = bytes(a.content)
        magic, size = struct.unpack_from("<II", content)
        assert 0x184D2A50 <= magic <= 0x184D2A5F
        plain = content[8:8 + size]
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain) if plain else None)
        data = reader.stream_reader(content[8 + size:], read_across_frames=True).read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert data[n:n + 4] == b"\r\n\r\n"
            data = data[n + 4:]
            assert {"WARC-Date", "WARC-Type", "WARC-Record-ID"} <= set(fields)
            ids.append(fields["WARC-Record-ID"])
            kinds.append(fields["WARC-Type"])
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"].endswith("/identical-payload-digest")
                refers.append((fields["WARC-Refers-To-Target-URI"], fields["WARC-Refers-To-Date"]))
    assert len(set(ids)) == len(ids) == 6 and sorted(kinds) == ["response"] * 5 + ["revisit"]
    assert refers == [("http://b.org/", "1970-01-01T00:00:00Z")]
