"""Left joins to a unique table that a hot key doesn't put in one task.

AQE splits a skewed side only if both sides of a join come straight from an
exchange, which isn't so where the right side is an aggregate. Here a sketch
of frequent items names the keys that hold a large share of the left rows
(at most ``MOST`` of them, whatever the input); their left rows are dealt
over many salts by a hash of the whole row, and their few right rows, one a
key, are repeated for every salt. All other rows join as they are. Rows
whose key is null match nothing and are dealt out likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.session import cut_lineage

MOST = 64            # hot keys looked for
TRACKED = 4096       # keys that the sketch keeps track of
SHARE = 0.5          # of an even share of the rows of a task makes a key hot

_KEY, _SALT = "__hot_key", "__hot_salt"


def _hash(cols: list) -> Column:
    """Null if any of the key's columns is."""
    some_null = F.lit(False)
    for c in cols:
        some_null = some_null | c.isNull()
    return F.when(~some_null, F.xxhash64(*cols))


def hot_keys(left: DataFrame, keys: list[str], salts: int) -> list[int]:
    """Hashes of the keys that hold more than a task's even share of rows;
    a list of bounded length, and only a matter of speed."""
    found = left.agg(F.count(F.lit(1)).alias("n"),
                     F.call_function("approx_top_k", _hash([F.col(f"`{k}`") for k in keys]), F.lit(MOST), F.lit(TRACKED))
                     .alias("top")).first()
    return [x["item"] for x in found["top"] or [] if x["item"] is not None and x["count"] * salts > SHARE * found["n"]]


def left_join(left: DataFrame, right: DataFrame, on: dict[str, str], salts: int | None = None) -> DataFrame:
    """``left`` with the columns of its ``right`` row (NULL without one).

    ``on`` maps left to right key columns; ``right`` has one row per key and
    no column name of ``left``. Its key columns are dropped. ``left`` is
    written once, since the sketch and the join both read it.
    """
    salts = salts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = cut_lineage(left)
    hot = hot_keys(left, list(on), salts)
    lkey = _hash([F.col(f"`{k}`") for k in on])
    rkey = _hash([F.col(f"`{k}`") for k in on.values()])
    row = F.xxhash64(*[_plain(f) for f in left.schema.fields])
    dealt = lkey.isNull() | lkey.isin(hot) if hot else lkey.isNull()
    salted = left.withColumn(_SALT, F.when(dealt, F.pmod(row, F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    spread = right.where(rkey.isNotNull())
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    spread = (spread.withColumn(_KEY, F.explode(F.when(rkey.isin(hot), every).otherwise(F.array(F.lit(0))))) if hot
              else spread.withColumn(_KEY, F.lit(0)))
    cond = salted[_SALT] == spread[_KEY]
    for a, b in on.items():
        cond = cond & (salted[a] == spread[b])
    return salted.join(spread, cond, "left").drop(_SALT, _KEY, *on.values())


def _plain(field) -> Column:
    """A column that can be hashed (maps can't)."""
    c = F.col(f"`{field.name}`")
    return F.to_json(c) if "map<" in field.dataType.simpleString() else c
