"""Personal data by candidate gradient boosting.

Base spans are found by format alone. High-recall generators then propose
overlapping candidates of each kind: local and unsigned telephone numbers,
written-out addresses, card-like digit runs, identity and account numbers.
Boosted trees on format and context features score every candidate, and
those over their kind's threshold are taken, the likeliest first, unless they
overlap a span that is there already; base spans always stay. The trees learn
from labelled examples that are made by rule (numbers and addresses written in
many forms, and dates, prices, versions, hashes and the like between them);
thresholds are calibrated on examples held out, for the precision asked for.

All scans are linear in the text: runs are found once from their start.

Defined results: null and empty texts have no spans; offsets are code points
with an exclusive end; a span's kind is one of KINDS; equal texts have equal
spans; rows pass one by one, so repeated rows repeat; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

# The base formats' kinds in the order in which they are listed, then the others.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "account")
SPANS = "array<struct<kind string, start int, end int, score double>>"

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_local_char = re.compile(r"[^A-Za-z0-9._%+-]")
_digits = re.compile(r"[^0-9]")
_not_digits = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _local_char.match(text[start - 1]):
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        else:
            done = at + 1  # no match reaches over an @ before its domain
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """The spans of the four formats, leftmost and non-overlapping per kind."""
    out = list(_emails(text)) if "@" in text else []
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card.finditer(text):
        d = _digits.sub("", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= len(_digits.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- candidates ------------------------------------------------------------------

_word_at = re.compile(r"[\[({<]?\s?\b(?:at|arroba)\b\s?[\])}>]?|[\[({<]\s?@\s?[\])}>]| @ ", re.I)
_spelt_local = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_spelt_domain = re.compile(r"\s?[A-Za-z0-9-]++(?:\s?(?:\.|[\[({<]?\b(?:dot|punto|punkt|point)\b[\])}>]?)\s?[A-Za-z0-9-]++)+", re.I)
_run = re.compile(r"[0-9(](?:[ ().\/-]{0,2}[0-9])++")
_group = re.compile(r"[0-9]{13,19}(?![0-9])|[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])")
_letters_run = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b")
_has_digit = re.compile(r"[0-9]")
_digit_group = re.compile(r"\(?[0-9]++")
_digit_before = re.compile(r"[0-9][ ().\/-]{0,2}\Z")
_digit_after = re.compile(r"[ ().\/-]{0,2}[0-9]")


def candidates(text: str) -> list[Span]:
    """Possible spans of every kind; they may overlap."""
    out: list[Span] = []
    for m in _word_at.finditer(text):
        end = m.start() - text[max(0, m.start() - 1):m.start()].isspace()
        start = end
        while start and text[start - 1] in _spelt_local:
            start -= 1
        while start < end and not text[start].isalnum():
            start += 1
        right = _spelt_domain.match(text, m.end()) if start < end else None
        if right:
            out.append(("email", start, right.end()))
    if not _has_digit.search(text):
        return out
    for m in _run.finditer(text):
        out += _stretches(text, *m.span())
    out += [("account", *m.span()) for m in _letters_run.finditer(text)]
    return out


def _stretches(text: str, start: int, end: int) -> list[Span]:
    """Every stretch of consecutive digit groups of a run that has the digits
    of a kind, as numbers may stand side by side; no stretch has more than 19
    digits, so neither has a start more than 19 of them."""
    groups = [g.span() for g in _digit_group.finditer(text, start, end)]
    groups[0] = start, groups[0][1]
    sizes = [b - a - text.count("(", a, b) for a, b in groups]
    out: list[Span] = []
    for i, (a, _) in enumerate(groups):
        n = 0
        for k in range(i, len(groups)):
            n += sizes[k]
            if n > 19:
                break
            b = groups[k][1]
            if 7 <= n <= 15:
                out.append(("phone", a, b))
            if 8 <= n <= 12:
                out.append(("id", a, b))
            if 13 <= n <= 19:
                out.append(("card", a, b))
    if sum(sizes) > 19:  # cards whose first or last digits run into another number
        cards = (("card", start + g.start(), start + g.end()) for g in _group.finditer(text[start:end]))
        out = list(dict.fromkeys([*out, *cards]))
    return out


# --- features and trees -------------------------------------------------------------

CUES = {
    "phone": r"tel\w*|phone|call|mobile|mobil|fax|cell|whatsapp|llam\w*|ruf\w*|appel\w*|number|nummer|numero",
    "email": r"e-?mail|mail|contact|write|correo|kontakt|courriel|reach",
    "card": r"card|visa|mastercard|amex|credit|karte|tarjeta|carte|payment",
    "id": r"ssn|social|passport|id|dni|nif|identity|ausweis|license|tax",
    "account": r"iban|account|konto|cuenta|compte|bank|sepa|bic",
    "other": r"order|invoice|version|page|isbn|doi|ref\w*|ticket|build|commit|date|on|since|in|price|usd|eur|total|section|art\w*",
}
_cues = [re.compile(rf"(?i)\b(?:{p})\b") for p in CUES.values()]
_shapes = [re.compile(p) for p in (
    r"\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}\Z", r"\d{3}-\d{2}-\d{4}\Z", r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}", r"\d{3}-\d{4}\Z",
    r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\Z", r"\d+\.\d+\Z", r"0\d{2,4}[ /-]\d", r"97[89]", r"[A-Z]{2}\d{2}")]
FEATURES = 19 + len(_shapes) + 2 * len(_cues)


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s, digits = text[start:end], _digits.sub("", text[start:end])
    before, after = text[max(0, start - 24):start], text[end:end + 12]
    groups = [len(g) for g in _not_digits.split(s) if g] or [0]
    return [KINDS.index(kind), len(s), len(digits), s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count("/"),
            float(luhn(digits)) if digits else 0.0, float(digits[:1] == "0"), len(set(digits)),
            float(before[-1:].isalnum()), float(before[-1:] in tuple("$€£#+.,-_=")), float(after[:1].isalnum() or after[:1] in "%€$°_"),
            float(bool(re.search(r"(?i)dot|punto|punkt|point", s))) + 2.0 * ("@" in s or bool(re.search(r"[\[({<]", s))),
            float(bool(_digit_before.search(before[-3:]))), float(bool(_digit_after.match(after))), len(groups), groups[0], groups[-1],
            *(float(bool(p.match(s))) for p in _shapes),
            *(float(bool(p.search(before))) for p in _cues), *(float(bool(p.search(after))) for p in _cues)]


class Trees:
    """Gradient-boosted regression trees of fixed depth on the logistic loss;
    every level of a tree splits all its nodes (by feature and value)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 100, depth: int = 3, rate: float = 0.2):
        self.depth, self.rate, self.trees = depth, rate, []
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        z = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))) for f in range(x.shape[1])]
        sides = [np.searchsorted(values, x[:, f], "left") for f, values in enumerate(cuts)]  # value <= values[i] for side <= i
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                chosen = []
                for k in range(1 << level):
                    rows = np.flatnonzero(node == k)
                    best, split = 1e-6, (0, np.inf)
                    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    for f, values in enumerate(cuts) if len(rows) > 1 else ():
                        side = sides[f][rows]
                        gl, hl = (np.cumsum(np.bincount(side, w[rows], len(values) + 1))[:-1] for w in (g, h))
                        gain = gl ** 2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - whole
                        i = int(gain.argmax())
                        if gain[i] > best:
                            best, split = gain[i], (f, float(values[i]))
                    chosen.append(split)
                splits.append(chosen)
                f, value = np.array([c[0] for c in chosen]), np.array([c[1] for c in chosen])
                node = 2 * node + (x[np.arange(len(x)), f[node]] > value[node])
            leaf = np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
            self.trees.append((splits, (rate * leaf).tolist()))
            z += rate * leaf[node]

    def logit(self, row: list[float]) -> float:
        z = self.start
        for splits, leaf in self.trees:
            node = 0
            for level in splits:
                f, value = level[node]
                node = 2 * node + (row[f] > value)
            z += leaf[node]
        return z


# --- labelled examples ----------------------------------------------------------------

def _examples(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The candidates of ``count`` made-up sentences that have any; label 1 if
    the candidate is what was put in as personal data of its kind."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abdeilnorstuvm") for _ in range(r.randint(2, 9)))

    def card() -> str:
        s = r.choice("3456") + d(14)
        s += next(c for c in "0123456789" if luhn(s + c))
        return r.choice((s, " ".join(s[i:i + 4] for i in range(0, 16, 4)), "-".join(s[i:i + 4] for i in range(0, 16, 4))))

    good = {
        "phone": lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(6)}", f"0{d(2)}/{d(7)}",
                                   f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(9)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}")),
        "email": lambda: f"{w()}{r.choice(('', '.' + w(), d(2)))}{r.choice((' at ', ' [at] ', '(at)', ' (at) ', '[@]', ' @ '))}{w()}"
                         f"{r.choice((' dot ', ' [dot] ', '(dot)', '.'))}{r.choice(('com', 'org', 'net', 'de', 'es'))}",
        "card": card,
        "id": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "account": lambda: r.choice("DEFRES") + r.choice("DEFRES") + d(2) + "".join(" " + d(4) for _ in range(r.randint(3, 5))),
    }
    bad = [lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{d(2)}.{d(2)}.{r.randint(1900, 2030)}",
           lambda: f"{d(1)}.{d(2)}.{d(2)}.{d(4)}", lambda: f"${d(3)},{d(3)}.{d(2)}", lambda: d(r.randint(7, 20)), lambda: f"{d(3)}.{d(r.randint(4, 9))}",
           lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(4)}/{d(4)}", lambda: f"{w()}{d(8)}{w()}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
           lambda: f"{d(4)}-{d(4)} {d(4)}", lambda: f"{d(16)}", lambda: f"look at {w()}.{w()} now", lambda: f"was at {w()} point {w()}",
           lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", lambda: f"{d(2)}:{d(2)}:{d(2)}.{d(6)}", lambda: f"{d(3)} {d(3)} {d(3)}"]
    cues = {"phone": ("call", "tel", "phone", "mobile", "fax"), "email": ("email", "mail", "contact", "write to"),
            "card": ("card", "visa", "credit"), "id": ("ssn", "id", "passport"), "account": ("iban", "account", "konto")}
    other = ("order", "invoice", "version", "page", "on", "isbn", "ref", "total", "since")
    x, y, sentences = [], [], 0
    while sentences < count:
        kind = r.choice(tuple(good)) if r.random() < 0.5 else None
        put = good[kind]() if kind else r.choice(bad)()
        cue = r.choice(cues[kind]) if kind and r.random() < 0.7 else r.choice(other) if not kind and r.random() < 0.5 else w()
        # without a cue a bare run of digits says nothing about its owner
        plain = kind == "phone" and put.isdigit() and cue not in cues["phone"]
        head = f"{w()} {w()} {cue}{r.choice((' ', ': ', ' '))}"
        # another number may stand right before or after: one of the same kind, a date, or a short one
        beside = [(kind, put)]
        if kind and kind != "email" and not put.isdigit() and r.random() < 0.4:
            other_one = r.choice(((kind, good[kind]()), (None, bad[0]()), (None, bad[1]()), (None, d(r.randint(1, 4)))))
            beside.insert(r.randint(0, 1), other_one)
        text, real = head, []
        for k, (of, number) in enumerate(beside):
            text += r.choice((" ", " ", "  ")) * (k > 0)
            if of and not plain:
                real.append((of, len(text), len(text) + len(number)))
            text += number
        text += r.choice((" ", ". ", ", ", "; ")) + f"{w()} {w()}."
        found = candidates(text)
        sentences += bool(found)
        for span in found:
            right = any(span[0] == of and span[1] >= a - 1 and span[2] <= b + 1 and span[2] - span[1] >= 0.9 * (b - a) for of, a, b in real)
            x.append(features(text, span))
            y.append(float(right))
    return np.array(x), np.array(y)


@lru_cache(4)
def train(precision: float = 0.98, count: int = 5000) -> tuple[Trees, dict[str, float]]:
    """The trees, and of each kind the least logit that holds the precision on
    examples that were held out (infinite if none does)."""
    trees = Trees(*_examples(count, 5))
    x, y = _examples(count // 2, 6)
    z = np.array([trees.logit(row) for row in x.tolist()])
    least = {}
    for k, kind in enumerate(KINDS):
        own = np.flatnonzero(x[:, 0] == k)
        order = own[np.argsort(-z[own], kind="stable")]
        share = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(share >= precision)
        least[kind] = float(z[order[enough[-1]]]) if len(enough) else float("inf")
    return trees, least


def find(text: str, trees: Trees, least: dict[str, float]) -> list[tuple[str, int, int, float]]:
    """All spans of a text in order: (kind, start, end, probability)."""
    spans = [(*s, 1.0) for s in base_spans(text)]
    taken = sorted((s[1], s[2]) for s in spans)
    scored = []
    for span in candidates(text):
        z = trees.logit(features(text, span))
        if z >= least[span[0]]:
            scored.append((-z, span))
    for z, span in sorted(scored):
        i = bisect.bisect_left(taken, (span[2], -1))  # base spans of two kinds may overlap, so look back a little
        if any(a < span[2] and b > span[1] for a, b in taken[max(0, i - len(BASE)):i]):
            continue
        spans.append((*span, float(1 / (1 + np.exp(z)))))
        bisect.insort(taken, (span[1], span[2]))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98) -> DataFrame:
    """Per document: id, ``base`` and ``spans`` (all), lists of kind, start,
    end and score."""
    model = docs.sparkSession.sparkContext.broadcast(train(precision))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, least = model.value
        named = lambda found: [dict(zip(("kind", "start", "end", "score"), s)) for s in found]
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([named((*s, 1.0) for s in base_spans(t)) for t in texts], pa.list_(span)),
                 pa.array([named(find(t, trees, least)) for t in texts], pa.list_(span))], names=["id", "base", "spans"])

    rows = small_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id bigint, base {SPANS}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
