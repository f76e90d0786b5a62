"""URL rules: a blocked Bloom filter in front of an exact hash join.

Every url yields the keys host suffix x path prefix that a listed rule could
have; a broadcast blocked Bloom filter of the listed canonical keys drops
nearly all of them in place, and only possible hits go on to the exact join
with the list, which removes false positives. The longest rule that fits wins
(ties: the longer host, then the greater string).

Defined results: a url that is null or has no ``://`` has an empty host and
path and fits no rule; urls without a rule get ``default``; repeated rows give
repeated rows; rules with a null host or path are ignored; an empty list or
table is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_FILTER_BITS, bloom_filter, filter_blocks, probe, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEP = "\x00"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z in
    lower case; path from there up to ``?`` or ``#``."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(F.lit("")), F.when(there, path).otherwise(F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``rules``: (host, path, verdict). Returns id, host, path, rule, verdict."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_w_id"), host.alias("host"), path.alias("path"))

    listed = stage(rules.where("host is not null and path is not null").select(
        F.concat("host", F.lit(SEP), "path").alias("_w_key"), F.concat("host", "path").alias("rule"),
        F.length("host").alias("_w_hlen"), F.col("verdict"),
        F.size(F.split("host", r"\.")).alias("_w_labels"), F.length("path").alias("_w_plen"))
        .groupBy("_w_key").agg(*[F.max(c).alias(c) for c in ("rule", "_w_hlen", "verdict", "_w_labels", "_w_plen")]))
    # shapes of the list: labels of a host name x length of a path, both bounded by what a url can be
    shapes = [(r[0], r[1]) for r in listed.select("_w_labels", "_w_plen").distinct().collect()]
    if not shapes:
        return rows.select(F.col("_w_id").alias(id_col), "host", "path",
                           F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = filter_blocks(listed.count(), max_bits)
    blooms = bloom_filter(listed, "_w_key", blocks)

    keys = F.array_distinct(F.array(*[
        F.concat(F.substring_index("host", ".", -k), F.lit(SEP), F.substring("path", 1, n)) for k, n in sorted(shapes)]))
    # probed where they lie: only possible hits are shuffled, each url once
    cand = rows.where("host != ''").select("host", "path", F.explode(keys).alias("_w_key"))
    hits = probe(cand, "_w_key", blooms, blocks).where("_w_maybe").drop("_w_maybe").distinct()
    best = (hits.join(listed.select("_w_key", "rule", "_w_hlen", "verdict"), "_w_key")
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule"), "_w_hlen", "rule", "verdict")).alias("_w_best")))
    best = stage(best.select(F.col("host").alias("_w_host"), F.col("path").alias("_w_path"),
                             "_w_best.rule", "_w_best.verdict"))
    out = rows.join(best, (F.col("host") == F.col("_w_host")) & (F.col("path") == F.col("_w_path")), "left")
    return out.select(F.col("_w_id").alias(id_col), "host", "path", "rule",
                      F.coalesce("verdict", F.lit(default)).alias("verdict"))
