"""Exact deduplication by two-pass Bloom filtering (native).

Pass one hashes every text and marks the filter bits that two rows or more
set; pass two sends only rows whose bits are all marked, the possibly repeated
ones, to the exact grouping by SHA-256. All other rows pass straight through
without a shuffle. DataFrame functions only.

Defined results: a null text counts as empty; texts are compared byte for
byte, no matter how long; of equal texts the row with the largest id stays
(null ids sort below all others); rows that repeat both id and text are one
document; an empty table gives no rows; other columns never take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_FILTER_BITS, bloom_filter, filter_blocks, probe, stage


def _sha(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _repeats(keys: DataFrame, max_bits: int):
    """Filter of possibly repeated keys, and its number of blocks."""
    blocks = filter_blocks(keys.count(), max_bits)
    return bloom_filter(keys, "_w_sha", blocks, twice=True), blocks


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``."""
    keys = stage(docs.select(F.col(id_col).alias("_w_id"), _sha(text_col).alias("_w_sha")))
    blooms, blocks = _repeats(keys, max_bits)
    tagged = probe(keys, "_w_sha", blooms, blocks)
    single = tagged.where("not _w_maybe").select(
        "_w_id", F.col("_w_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "_w_sha")
    maybe = tagged.where("_w_maybe").groupBy("_w_sha", "_w_id").agg(F.count("*").alias("_w_n"))
    maybe = stage(maybe)
    # staged, so that the join below exchanges both sides and AQE can split a hot group
    groups = stage(maybe.groupBy("_w_sha").agg(
        F.max("_w_id").alias("keep_id"), F.sum("_w_n").alias("group_size")))
    repeated = maybe.join(groups, "_w_sha").select("_w_id", "keep_id", "group_size", "_w_sha")
    return single.unionByName(repeated).select(
        F.col("_w_id").alias(id_col), "keep_id", "group_size",
        F.col("_w_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_w_sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows that stay, with all their columns. Whole rows are shuffled
    only if possibly repeated, and groups are reduced map-side first."""
    keys = stage(docs.select(_sha(text_col).alias("_w_sha")))
    blooms, blocks = _repeats(keys, max_bits)
    tagged = probe(docs.withColumn("_w_sha", _sha(text_col)), "_w_sha", stage(blooms), blocks)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(id_col), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = (tagged.where("_w_maybe").groupBy("_w_sha")
            .agg(F.max_by(row, order).alias("_w_row")).select("_w_row.*"))
    return tagged.where("not _w_maybe").select(*docs.columns).unionByName(kept)
