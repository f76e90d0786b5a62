"""Pure Column expressions (string rules, slot predicates, rendering).

Everything here is a JVM-side expression so it stays inside whole-stage
codegen; nothing is evaluated in Python.
"""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare import contracts as C

# Whitespace as Python's str.strip() sees it, derived from str.isspace()
# (all such characters lie below U+3001).
PY_SPACES = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """XPR-1 without the NULL step: strip edge whitespace like Python."""
    return F.trim(col_of(c), F.lit(PY_SPACES))


def blank_to_null(c) -> Column:
    """XPR-1: strip, and an empty result becomes NULL."""
    return F.nullif(py_strip(c), F.lit(""))


def contains_any(text, terms) -> Column:
    """FLT-6: literal substring test against a vocabulary (not a regex)."""
    t = col_of(text)
    return reduce(lambda a, b: a | b, [F.instr(t, F.lit(term)) > 0 for term in terms])


def valid_slot(c) -> Column:
    """FLT-4: present and not a placeholder word after strip + lower."""
    v = F.lower(py_strip(col_of(c)))
    return F.coalesce(~v.isin(*C.INVALID_SLOT_VALUES), F.lit(False))


def truthy(c) -> Column:
    """FLT-5: present and not the empty string (blank text counts as present)."""
    v = col_of(c)
    return F.coalesce(v != F.lit(""), F.lit(False))


def keep_members(arr, allowed) -> Column:
    """FLT-7: keep list items in a set; order and duplicates are kept."""
    return F.filter(col_of(arr), lambda x: x.isin(*allowed))


def drop_member(arr, value) -> Column:
    """FLT-8: remove every copy of one value, order kept."""
    return F.filter(col_of(arr), lambda x: x != F.lit(value))


def first_present(values) -> Column:
    """XPR-9: first alias whose value is truthy (Python ``a or b or c``)."""
    cols = [col_of(v) for v in values]
    out = cols[-1]
    for v in reversed(cols[:-1]):
        out = F.when(truthy(v), v).otherwise(out)
    return out


def render(template: str, **values) -> Column:
    """Fill ``{name}`` placeholders with columns (XPR-3 / summaries), all at
    once: a placeholder inside a value stays as it is."""
    parts = re.split(r"(\{\w+\})", template)
    filled = [F.coalesce(col_of(values[p[1:-1]]).cast("string"), F.lit("")) if p[:1] == "{" and p[1:-1] in values
              else F.lit(p) for p in parts if p]
    return F.concat(*filled) if filled else F.lit("")


def json_text(pairs: dict) -> Column:
    """One JSON object of the given columns; NULL prints as null."""
    return F.to_json(F.struct(*[col_of(v).alias(k) for k, v in pairs.items()]), {"ignoreNullFields": "false"})


def render_template_col(template_col, city, date, dep, arr) -> Column:
    """XPR-3: fill a template held in a column; missing values print as ''."""
    marks = r"\{(?:city|date|dep|arr)\}"
    pieces = F.split(col_of(template_col), rf"(?={marks})|(?<={marks})")

    def fill(piece: Column) -> Column:
        out = piece
        for name, value in (("city", city), ("date", date), ("dep", dep), ("arr", arr)):
            out = F.when(piece == "{" + name + "}", F.coalesce(col_of(value), F.lit(""))).otherwise(out)
        return out

    return F.array_join(F.transform(pieces, fill), "")


def pick_cyclic(items: list[str], one_based_index) -> Column:
    """XPR-4: ``items[(idx - 1) % len(items)]`` for a 1-based index column."""
    arr = F.array(*[F.lit(i) for i in items])
    return F.element_at(arr, ((col_of(one_based_index) - 1) % len(items) + 1).cast("int"))


def padded_id(prefix: str, n) -> Column:
    """XPR-5: ``weather_01``."""
    return F.format_string(prefix + "_%02d", col_of(n))


def iso_datetime(c) -> Column:
    """XPR-14: ``datetime.isoformat()`` for values without fractional seconds."""
    return F.date_format(col_of(c), "yyyy-MM-dd'T'HH:mm:ss")


def iso_date(c) -> Column:
    """XPR-16: ``yyyy-MM-dd``."""
    return F.date_format(col_of(c), "yyyy-MM-dd")


def strict_date(c) -> Column:
    """Parse request dates as strict ``yyyy-MM-dd`` (bad text -> NULL)."""
    return F.try_to_date(col_of(c), "yyyy-MM-dd")


def labels_question(missing) -> Column:
    """XPR-6: labels joined by the list separator into the clarification text."""
    labels = F.create_map(*[x for k, v in C.SLOT_LABELS.items() for x in (F.lit(k), F.lit(v))])
    joined = F.array_join(F.transform(col_of(missing), lambda s: F.element_at(labels, s)), C.LABEL_SEPARATOR)
    return F.when(F.size(col_of(missing)) > 0,
                  F.concat(F.lit(C.CLARIFY_PREFIX), joined, F.lit(C.CLARIFY_SUFFIX))).otherwise(F.lit(""))


def intent_of(agents) -> Column:
    """XPR-19: intent from the final agent list (one agent -> its intent,
    several -> travel planning, none -> unknown)."""
    a = col_of(agents)
    single = F.create_map(F.lit("weather_agent"), F.lit(C.INTENT_WEATHER),
                          F.lit("ticket_agent"), F.lit(C.INTENT_TICKET))
    return (F.when(F.size(a) > 1, F.lit(C.INTENT_BOTH))
            .otherwise(F.coalesce(F.try_element_at(single, F.try_element_at(a, F.lit(1))),
                                  F.lit(C.INTENT_UNKNOWN))))


def sorted_entries(m) -> Column:
    """XPR-18: a map rendered comparable (maps cannot be compared with =)."""
    return F.array_sort(F.map_entries(col_of(m)))


def same_multiset(left, right) -> Column:
    """SET-2: sorted equality, multiplicity kept; NULL lists count as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.coalesce(col_of(left), empty)) == F.array_sort(F.coalesce(col_of(right), empty))


def list_text(arr) -> Column:
    """Arrays are reported as comma-joined text."""
    return F.array_join(col_of(arr), ",")


COLLATION = "UNICODE_CI_AI_RTRIM"


def canonical_map(values, col: str, collation: str = COLLATION):
    """§1.2/§4: raw value -> canonical value under a collation (case, accents
    and trailing spaces ignored by default).

    Collated comparisons are neither pushed down nor hash-joined, so the
    collation is applied once, to the distinct raw values only (a table that
    grows with the number of spellings, not with the rows); the canonical
    value of a group is its smallest raw spelling. Callers join both sides
    to this table on the raw value (plain string equality), then join on
    ``canonical``.
    """
    distinct = values.select(F.col(col).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    groups = distinct.groupBy(F.collate(F.col("raw"), collation).alias("__k")).agg(
        F.min(F.col("raw").cast("string")).alias("canonical"))
    keyed = distinct.withColumn("__k", F.collate(F.col("raw"), collation))
    return keyed.join(groups, "__k").select("raw", "canonical")


def collated_keys(df, columns: list[str], names: list[str], collation: str = COLLATION):
    """``df`` with ``names``: the columns as plain text that is equal where
    the collation calls them equal, for grouping without a collated sort.

    Printable ASCII is equal under ``COLLATION`` if it is in lower case and
    without trailing blanks, and needs no collator. Other spellings, if there
    are any, take the plain spelling that they equal, else the least of their
    own; only then is the collation applied, to distinct spellings. ``df`` is
    read more than once.
    """
    if collation != COLLATION:
        raise ValueError(f"no plain form of {collation}")
    plain = {c: F.col(c).rlike(r"\A[ -~]*\z") for c in columns}
    keyed = df.withColumns({n: F.when(plain[c], F.lower(F.rtrim(c))) for c, n in zip(columns, names)})
    other = keyed.agg(*[F.coalesce(F.bool_or(~plain[c]), F.lit(False)).alias(n) for c, n in zip(columns, names)]).first()
    for c, n in zip(columns, names):
        if not other[n]:
            continue
        odd = canonical_map(df.where(~plain[c]), c, collation)
        known = keyed.where(F.col(n).isNotNull()).select(F.col(n).alias("__plain")).distinct()
        mapping = odd.join(known, F.collate("canonical", collation) == F.collate("__plain", collation), "left").select(
            F.col("raw").alias("__raw"), F.coalesce("__plain", "canonical").alias("__canon"))
        keyed = keyed.join(mapping, keyed[c] == mapping["__raw"], "left").withColumn(
            n, F.coalesce(n, "__canon")).drop("__raw", "__canon")
    return keyed


def canonicalize(df, col: str, mapping, out: str | None = None):
    """Replace ``col`` by its canonical value (unknown values stay as they are)."""
    m = mapping.withColumnRenamed("raw", "__raw").withColumnRenamed("canonical", "__canon")
    joined = df.join(m, df[col] == m["__raw"], "left")
    return joined.withColumn(out or col, F.coalesce(F.col("__canon"), F.col(col))).drop("__raw", "__canon")
