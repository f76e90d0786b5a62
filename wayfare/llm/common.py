"""Helpers the training-data operators share.

Internal columns start with ``_w_`` so that a caller's extra columns cannot
clash with them; operators select the columns they need before adding any.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.session import cut_lineage

BLOCK_BITS = 32768          # bits of one bitmap of Spark's bitmap functions
BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 28   # 32 MiB: the proven bound of every broadcast filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    return cut_lineage(df)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that few rows are Python objects at once."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def light_slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 500,
                 most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``most`` bytes in ``column``, or of one row."""
    for batch in slices(batches, rows):
        start, held = 0, 0
        for at, size in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if held + size > most and at > start:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        yield batch.slice(start)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; whole texts then go to Python 500 rows at a time, which bounds
    the memory of both sides. A session's own setting is left alone."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if df.sparkSession.conf.get(key) == default:
        df.sparkSession.conf.set(key, "500")
    return df


def window(text: Column, longest: int) -> Column:
    """A text of a bounded sample: whole, or ``longest`` characters of it
    from a place that a hash of the text draws."""
    spare = F.length(text) - F.lit(longest)
    start = F.pmod(F.xxhash64(text), F.greatest(spare, F.lit(0)).cast("long") + F.lit(1)).cast("int") + F.lit(1)
    return F.when(spare > 0, F.substring(text, start, F.lit(longest))).otherwise(text)


# --- blocked Bloom filters ---------------------------------------------------
# A key belongs to one block and sets two of its bits. A filter is a table of
# (_w_block, _w_bits): at most ``max_bits / 8`` bytes whatever the input, so it
# may be broadcast. A fuller filter only passes more rows on to the exact join.

def filter_blocks(rows: int, max_bits: int = MAX_FILTER_BITS) -> int:
    """Blocks for ``rows`` keys, a power of two within the size bound."""
    most = max(1, max_bits // BLOCK_BITS)
    want = max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))
    return min(most, 1 << (want - 1).bit_length())


def _positions(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    return (F.pmod(h, F.lit(blocks)), g.bitwiseAND(F.lit(BLOCK_BITS - 1)),
            F.shiftright(g, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)))


def bloom_filter(keys: DataFrame, column: str, blocks: int, twice: bool = False) -> DataFrame:
    """Filter of the keys; with ``twice``, of the bits that two rows or more
    set, which every repeated key passes. Both aggregate map-side."""
    block, p1, p2 = _positions(F.col(column), blocks)
    bits = keys.select(block.alias("_w_block"),
                       F.explode(F.array_distinct(F.array(p1, p2))).alias("_w_bit"))
    if twice:
        bits = bits.groupBy("_w_block", "_w_bit").agg(F.count("*").alias("_w_n")).where("_w_n > 1")
    return bits.groupBy("_w_block").agg(F.bitmap_construct_agg("_w_bit").alias("_w_bits"))


def _bit(position: Column) -> Column:
    byte = F.substring(F.col("_w_bits"), F.shiftright(position, 3).cast("int") + F.lit(1), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.call_function("shiftright", value, position.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))


def probe(df: DataFrame, column: str, blooms: DataFrame, blocks: int, flag: str = "_w_maybe") -> DataFrame:
    """``df`` with ``flag``: whether the key may be in the filter. The filter
    is broadcast (bounded, see above), so no row of ``df`` moves."""
    block, p1, p2 = _positions(F.col(column), blocks)
    out = df.withColumn("_w_block", block).join(F.broadcast(blooms), "_w_block", "left")
    hit = F.coalesce(_bit(p1).bitwiseAND(_bit(p2)), F.lit(0)) == 1
    return out.withColumn(flag, hit).drop("_w_block", "_w_bits")


def without(df: DataFrame, column: str, drop: DataFrame, max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``df`` without the rows whose ``column`` is in the one column of
    ``drop`` (staged by the caller). Only possible hits of a Bloom filter over
    ``drop`` are shuffled into the exact anti join; the rest pass straight
    through. Rows with a null key stay."""
    key = drop.columns[0]
    gone = drop.select(F.col(key).alias("_w_key")).where("_w_key is not null").distinct()
    blocks = filter_blocks(drop.count(), max_bits)
    tagged = probe(df, column, bloom_filter(gone, "_w_key", blocks), blocks)
    clear = tagged.where("not _w_maybe").drop("_w_maybe")
    hits = tagged.where("_w_maybe").drop("_w_maybe")
    return clear.unionByName(hits.join(gone, F.col(column) == F.col("_w_key"), "left_anti"))
