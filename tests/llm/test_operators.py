"""The training-data operators against brute force, on small edge fixtures."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import pytest

pytest.importorskip("wayfare.llm")

from pyspark.sql import functions as F  # noqa: E402

from wayfare.llm import bpe, decontaminate, html_text, pii, quality, toxicity, warc  # noqa: E402
from wayfare.llm.components import components  # noqa: E402
from wayfare.llm.exact_dedup import exact_dedup, exact_groups  # noqa: E402
from wayfare.llm.minhash import drop_near_duplicates, near_duplicates  # noqa: E402
from wayfare.llm.url_filter import judge_urls  # noqa: E402

DOCS = "doc_id long, text string, kept string, h string"  # two extra columns with names used inside
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    base = [sentence(r, 60) for _ in range(6)]
    rows = [None, "", " \t", "one", "ONE", "a b c d", "x" * 50_000, "long " * 5000, *base, *base[:3], base[0]]
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 999))
            rows.append(" ".join(w))
    return [(i, t, "k", "h") for i, t in enumerate(rows)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    top = {r[0]: r[0] for r in rows}

    def find(x):
        return x if top[x] == x else find(top[x])

    sets = {r[0]: shingles(r[1]) for r in rows}
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(spark, docs):
    got = near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == classes(docs)


def test_near_duplicates_null_id_and_empty(spark):
    rows = [(None, "a b c d e f", "", ""), (1, "a b c d e f", "", ""), (1, "a b c d e f", "", "")]
    got = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, None), (1, 1), (1, 1)]
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_of_an_id_with_several_texts(spark):
    r = random.Random(11)
    base = [sentence(r, 60) for _ in range(5)]
    edited = base[0].rsplit(" ", 1)[0] + " edited"
    rows = [(1, base[0], "a", ""), (2, edited, "b", ""), (2, base[1], "c", ""), (2, base[1], "d", ""), (3, base[1], "e", ""),
            (3, base[2], "f", ""), (4, base[2], "g", ""), (4, None, "h", ""), (5, base[3], "i", ""), (None, base[0], "j", "")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((x.doc_id or -1), x.n_shingles, x.component_id or -1, x.kept) for x in near_duplicates(df).collect())
    assert sorted((i, c, k) for i, _, c, k in got) == [
        (-1, -1, True), (1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 2, False), (3, 3, True), (4, 3, False), (4, 4, True),
        (5, 5, True)]
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(x.kept for x in kept.collect()) == list("acdfhij")


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}}


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 15])
def test_exact_groups(spark, docs, max_bits):
    rows = docs + [docs[9], (None, "one", "", "")]
    got = exact_groups(spark.createDataFrame(rows, DOCS), max_bits=max_bits).collect()
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(t or "", []).append(i)
    want = set()
    for t, ids in texts.items():
        last = max((i for i in ids if i is not None), default=None)
        want |= {(i, last, len(ids), i == last, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = exact_dedup(spark.createDataFrame(rows, DOCS), max_bits=max_bits)
    assert kept.columns == ["doc_id", "text", "kept", "h"]
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted(x[0] or -1 for x in want if x[3])
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("b.org", "/x/", "block"), ("b.org", "/x/1", "block"), ("com", "", "block"),
                                   (None, "/", "block")], "host string, path string, verdict string")
    urls = [None, "", "nothing", "http://A.B.org/x/12?q", "https://xb.org/x/1", "ftp://b.org", "http://b.org/x/#f", "http://com", "x://q.com/a?b/c",
            "http://a.b.org/x", "://org/", "http://b.org\n/x/1"]
    rows = [(k, u, "x") for k, u in enumerate(urls)] + [(3, urls[3], "y")]
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), rules).collect()}
    want = ("", "", None, "allow")
    assert [got[k] for k in range(3)] == [want] * 3
    assert got[3] == ("a.b.org", "/x/12", "b.org/x/1", "block") and got[4] == ("xb.org", "/x/1", "org/", "allow")
    assert got[5] == ("b.org", "", None, "allow") and got[6] == ("b.org", "/x/", "b.org/x/", "block")
    assert got[7] == ("com", "", "com", "block") and got[8] == ("q.com", "/a", "com", "block")
    assert got[9][2:] == ("org/", "allow") and got[10] == ("org", "/", "org/", "allow") and got[11][0] == "b.org\n"
    none = judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), rules.where("false"))
    assert {r.verdict for r in none.collect()} == {"allow"} and none.count() == len(rows)


def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    parts = ["a", "th", "ing", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "ß", "日本", "12", "##", "'s", "😀", "́", "<|endoftext|>", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["a" * 20_000, " " * 9000, "日本" * 3000]
    rows = [(k, t, "x") for k, t in enumerate([*texts, None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded_ids string")
    got = {x.doc_id: x for x in bpe.decode(bpe.encode(df)).collect()}
    for k, t, _ in rows:
        assert got[k].ids == want.encode_ordinary(t or "") and bytes(got[k].decoded) == (t or "").encode()


def test_decontamination(spark):
    r = random.Random(3)
    item = sentence(r, 30).split()
    bench = spark.createDataFrame([(1, " ".join(item), "e"), (2, "too short", "e"), (3, None, "e"), (4, "", "e")], "item_id long, text string, tiles string")
    filler = sentence(r, 40)
    texts = [None, "", filler, f"{filler} {' '.join(item).upper()}, {filler}", f"{' '.join(item[15:])} {filler} {' '.join(item[:15])}",
             f"{filler} {' '.join(item[:10])}", "x too, short!", " ".join(item[:7]) + " " + " ".join(item[:7]) + " " + " ".join(item[:7])]
    rows = [(k, t, "z") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    for block in (10, 1 << 20):
        got = {(x.doc_id, x.item_id): (x.covered_words, x.tiles) for x in decontaminate.contaminated(df, bench, block=block).collect()}
        assert got == {(3, 1): (30, 1), (4, 1): (30, 2), (6, 2): (2, 1)}
        assert {x.doc_id for x in decontaminate.clean(df, bench, block=block).collect()} == {0, 1, 2, 5, 7}


def test_repeated_rows_stay_bounded(spark, monkeypatch):
    r = random.Random(8)
    item, other = sentence(r, 30), sentence(r, 30)
    bench = spark.createDataFrame([(1, item)] * 40 + [(2, other), (5, "..."), (None, item), (None, item)], "item_id long, text string")
    assert sorted(len(b) for b, _ in decontaminate._blocks(bench, "item_id", "text", 1 << 20)) == [4]
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, other)], "doc_id long, text string")
    for block in (10, 1 << 20):
        got = [(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench, block=block).collect()]
        assert sorted(got, key=str) == [(1, 1)] * 40 + [(1, None)] * 2 + [(2, 2)]

    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, target: seen.append(texts) or (quality.np.zeros(quality.BUCKETS), 0.0))
    rows = [(None, "one text " * 5)] * 300 + [(k, sentence(r, 9)) for k in range(100)]
    quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), rows=50)
    quality.quality(spark.createDataFrame(rows[300:], "doc_id long, text string"), rows=500)
    assert len(seen[0]) <= 50 and seen[1] == sorted(t for _, t in rows[300:])

    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, rate: seen.append((texts, labels)))
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 != 2][:3]
    rows = [(ids[0], sentence(r, 9)) for _ in range(300)] + [(ids[1], "plain words"), (ids[2], "plain words"), (ids[2], "more")]
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"),
                   spark.createDataFrame([(ids[0], 1), (ids[1], 1), (ids[2], 0)], "doc_id long, toxic int"), rows=10)
    texts, labels = seen[-1]
    assert texts == sorted(set(texts)) and labels.count(1) == 10 and [t for t, y in zip(texts, labels) if not y] == ["more"]


def test_toxicity(spark):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        w = sentence(r, r.randint(5, 80)).split()
        if bad:
            w.insert(r.randrange(len(w)), r.choice(("grobblix", "grobblar", "snurffen", "snurffit")))
        rows.append((k, " ".join(w), "x"))
        labels.append((k, int(bad)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "some words and grobblum here", "x")]  # a form never seen
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    wrong = sum((got[k] >= 0.3) != bool(y) for k, y in labels)
    assert wrong <= 12 and got[1002] >= 0.3 and got[1000] == got[1001] < 0.3
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(x.score for x in toxicity.score(docs, none).collect()) < 0.01


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>é</p>" * 300, "<b>other</b>" * 200
    rows = [(1, "http://a/ b\r\nX: y", big, 0), (5, None, big, 0), (3, "http://c", "small", 0), (4, "http://d", "small", 0), (6, "u", None, 0),
            (7, "u", "", 0), (8, "v", other, 0), (None, "v", other, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    archives = warc.write(pages)
    got = {r.page_id: r for r in warc.read(archives).collect()}
    assert len(got) == 8 and (got[1].record_type, got[1].refers_to, got[5].record_type) == ("revisit", 5, "response")
    assert got[None].refers_to == 8 and got[3].record_type == got[4].record_type == "response"
    assert bytes(got[5].payload).decode() == big and got[6].payload_bytes == got[7].payload_bytes == 0
    assert all(r.payload_digest == hashlib.sha1((h or "").encode()).hexdigest() for i, _, h, _ in rows for r in [got[i]])
    assert got[1].url == "http://a/%20b%0D%0AX:%20y" and got[5].url is None
    records = [warc.record(k, "http://x", hashlib.sha1(b"p%d" % k * 200).hexdigest(), 400 + 200 * (k > 9) + 200 * (k > 99), None, b"p%d" % k * 200)
               for k in range(300)]
    content = warc.pack(records)
    assert list(warc.unpack(content)) == records and int.from_bytes(content[4:8], "little") > 0  # with a dictionary
    files = warc.export(archives, str(tmp_path)).collect()
    assert all((tmp_path / r.file.rsplit("/", 1)[1]).stat().st_size == r.bytes for r in files)
    assert warc.read(warc.write(pages.where("false"))).count() == 0


def test_html(spark):
    pages = [
        ("<nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p>First,   text\n here. And&nbsp;more, of it.<br>Next<p><b>Bo</b>ld.</p>"
         "<script>no('</p>')</script><aside><p>Related, long text. Really.</p></aside><form><p>Sign up now.</p></form>"
         "<section class='comments'><p>I disagree, strongly. So there.</p></section></article><footer>&copy; x</footer>",
         "A & B First, text here. And more, of it. Next Bold."),
        ("<div class=header>Site</div><div id=content><p>One long sentence, with commas, stands here. Yes.</p><div class='ad'>Buy, now.</div>"
         "<p>Two.</p></div><div class='cookie-banner'>We use cookies, accept.</div>", "One long sentence, with commas, stands here. Yes. Two."),
        (None, ""), ("", ""), ("<!-- open", ""), ("<div>" * 3000, ""), ("</p></div>", "")]
    df = spark.createDataFrame([(k, "u", h, 1) for k, (h, _) in enumerate(pages)], "page_id long, url string, html string, text long")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(df).collect()}
    assert got == {k: (t, len(t)) for k, (_, t) in enumerate(pages)}


def html_of(html):
    page = html_text.Page(html)
    return page.text(html_text.train().marginals(page))


def test_html_empty_svg_and_custom_elements():
    page = "<article><p>One, two. Three.</p>%s<p>Whole article, of it. Yes.</p>%s<p>Last one, here.</p></article>"
    want = "One, two. Three. Whole article, of it. Yes. Last one, here."
    for tag in ('<svg viewBox="0 0 1 1"/>', "<math/>", '<svg a="x>y" />', "<svg><path/><text>no</text></svg>", "<math a='/'>no</math>"):
        assert html_of(page % (tag, tag)) == want
    for name in ("object-list", "select-menu", "template-x"):
        assert html_of(page % (f"<{name}>", f"</{name}>")) == want
    assert html_of(page % ("<select>no</select>", "<object data='x'>no</object>")) == want


def test_html_text_outside_a_body():
    assert html_of("<h1>T</h1>Body text <b>x</b>.<br>More") == "T Body text x. More"
    assert html_of("Just one bare text, here. And more of it.") == "Just one bare text, here. And more of it."
    assert html_of("\ufeffshort") == "short"
    one = "<nav><a>Menu</a></nav><h1>T</h1>Some text, long enough. It is.<p>More of it, too. Yes.</p><div class='footer'>&copy; me</div>"
    want = "T Some text, long enough. It is. More of it, too. Yes."
    for page in (one, f"<body>{one}</body>", f"<html><head><title>x</title></head>{one}", f"\n<!DOCTYPE html><html><body>{one}</body></html>\n",
                 one.replace("It is.", "It is.</body></html>")):
        assert html_of(page) == want
    article = "<div class='ad'>Buy, now.</div><article><h1>T</h1><p>One, two. Three, four, five.</p></article><footer>Site</footer>"
    assert html_of(article) == html_of(f"<body>{article}</body>") == "T One, two. Three, four, five."


def test_html_marginals_are_exact():
    page = html_text.Page("<div><p>Text one.</p><article><p>More, here. Yes.</p><aside>x</aside></article></div>")
    model = html_text.train()
    n, logits, sums, total = len(page.parent), model.logits(page), [0.0] * len(page.parent), 0.0
    import math
    for y in itertools.product((0, 1), repeat=n):
        if y[0]:
            continue
        w = math.exp(sum(z * v for z, v in zip(logits[1:], y[1:])) + sum(model.pair[y[page.parent[i]]][y[i]] for i in range(1, n)))
        total += w
        sums = [s + w * v for s, v in zip(sums, y)]
    assert [s / total for s in sums] == pytest.approx(model.marginals(page), abs=1e-9)


def reference_spans(t):
    def good(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub(r"\D", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and good(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_personal_data(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("ab1.2@+-()% 4093") for _ in range(r.randint(0, 50))) for _ in range(3000)]
    assert [pii.base_spans(t) for t in texts] == [reference_spans(t) for t in texts]
    rows = [(0, None, 1), (1, "", 1), (2, "call 555-123-4567 now", 1), (3, "version 4.0.1 of 2024-10-11", 1), (4, "é a.b@c.de", 1),
            (5, "mail bob at example dot com please", 1), (6, "7" * 60_000 + "@", 1)]
    got = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()}
    names = {k: [(s.kind, s.start, s.end) for s in x.spans] for k, x in got.items()}
    assert names == {0: [], 1: [], 2: [("phone", 5, 17)], 3: [], 4: [("email", 2, 10)], 5: [("email", 5, 27)], 6: []}
    assert pii.redact("call 555-123-4567 now", [("phone", 5, 17, 1.0)]) == "call [phone] now"


def test_pii_numbers_side_by_side():
    model = pii.train()
    for text, kind, want in (
            ("2024-01-05 555-123-4567", "phone", ["555-123-4567"]),
            ("(555) 123-4567 (555) 987-6543", "phone", ["(555) 123-4567", "(555) 987-6543"]),
            ("tel 0171 234567 0171 345678", "phone", ["0171 234567", "0171 345678"]),
            ("ssn 123-45-6789 987-65-4320", "id", ["123-45-6789", "987-65-4320"])):
        assert {(kind, text.index(w), text.index(w) + len(w)) for w in want} <= set(pii.candidates(text))
        assert [(s[0], text[s[1]:s[2]]) for s in pii.find(text, *model)] == [(kind, w) for w in want]
    assert len(pii.candidates("1 " * 5000)) < 40 * 5000 and pii.candidates("7" * 60_000) == [("card", 59_981, 60_000)]


def test_pii_held_out():
    trees, least = pii.train()
    x, y = pii._examples(1500, 99)
    hits = [trees.logit(row) >= least[pii.KINDS[int(row[0])]] for row in x.tolist()]
    right = sum(h and v == 1 for h, v in zip(hits, y))
    assert right / sum(hits) > 0.93 and right / y.sum() > 0.7


def test_quality(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abdeilnorst") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word().capitalize() + " " + " ".join(word() for _ in range(8)) + "." for _ in range(n))
    rows = [(k, prose(r.randint(4, 12)), 1) for k in range(200)]
    junk = [" | ".join(prose(6).split()), "###".join(prose(6).split()) + "%%% $$$ &&&", prose(6).upper().replace(" ", "!! "), "same " * 80]
    rows += [(1000 + k, junk[k % 4], 0) for k in range(40)] + [(2000, None, 0), (2001, "", 0)]
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, score int")).collect()}
    assert all(got[k].kept == bool(y) for k, _, y in rows if k < 2000), [(k, got[k]) for k, _, y in rows if k < 2000 and got[k].kept != bool(y)][:3]
    assert got[2000].score == got[2001].score
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0
