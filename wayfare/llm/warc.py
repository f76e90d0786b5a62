"""Dictionary-compressed WARC archives: writer and reader.

An archive is one file image, a row of (archive, content): first a skippable
frame that holds the Zstandard dictionary built from the archive's own
records, then one Zstandard frame per record, so that any record can be read
from its offset once the dictionary is known. Tasks fill archives of about
``size`` payload bytes one after the other; the rows are written as Parquet to
the cluster's shared folder, and ``export`` writes them as .warc.zst files
where executors see a mounted folder.

Of records with equal payloads of ``least`` bytes or more, the one with the
greatest id is a response and the others are revisits that refer to it. Which
digests repeat is found on (id, digest) alone; only pages whose digest hits a
Bloom filter of the repeated ones are joined with their decision, the others
go straight to the writer.

Defined results: a null payload is empty; a null url or id leaves out its
header; control characters and blanks in a url are percent-encoded; rows that
share an id and a repeated payload are all responses if that id is the
greatest; records of null id have no place in a group's maximum and refer to
it; equal groups without an id stay responses; an empty table gives no archive;
other columns aren't archived.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, filter_blocks, probe, slices, small_batches, stage

LEAST = 1000
SIZE = 8 << 20            # payload bytes of an archive, but for its last record
DICTIONARY = 32 << 10
SAMPLE = 2 << 20          # bytes of records that a dictionary is built from
LEVEL = 6
SKIPPABLE = 0x184D2A5D    # magic number of the leading frame that holds a dictionary
DATE = "1970-01-01T00:00:00Z"
ARCHIVES = "archive string, content binary"
RECORDS = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
           "refers_to bigint, payload binary")


# --- records -----------------------------------------------------------------

def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f\s]", lambda m: quote(m[0]), url)


def record(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes,
           refers_url: str | None = None, place: str = "", date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps no payload, and names the url and
    date of the record that has it. ``place`` tells equal rows apart."""
    revisit = refers_to is not None
    head = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))]
    block = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place} {page_id} {url} {digest}')}>"),
              ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(refers_to))]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", _uri(refers_url)))
    fields.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return dict(x.split(": ", 1) for x in lines if ": " in x), rest


def parse(data: bytes) -> tuple:
    """A row of RECORDS. A response's size and digest are those of the payload
    read, which must be what the header says; a revisit's are the header's."""
    head, rest = _headers(data)
    block = rest[:int(head["Content-Length"])]
    http, payload = _headers(block)
    revisit = head["WARC-Type"] == "revisit"
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
    if not revisit and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"damaged payload of record {head['WARC-Record-ID']}")
    number = lambda k: int(head[k]) if k in head else None
    return (number("X-Page-Id"), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"],
            number("X-Refers-To-Page-Id"), None if revisit else payload)


# --- archives ----------------------------------------------------------------

def _dictionary(records: list[bytes]) -> bytes:
    """Built from records spread over the archive; none if they are too few."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE))
    try:
        return zstandard.train_dictionary(DICTIONARY, records[::step], k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(records: list[bytes]) -> bytes:
    plain = _dictionary(records)
    known = zstandard.ZstdCompressionDict(plain) if plain else None
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=known).compress
    return b"".join([struct.pack("<II", SKIPPABLE, len(plain)), plain, *map(squeeze, records)])


def unpack(content: bytes) -> Iterator[bytes]:
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    plain, at = content[8:8 + size], 8 + size
    known = zstandard.ZstdCompressionDict(plain) if plain else None
    while at < len(content):
        reader = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        out = reader.decompress(memoryview(content)[at:])
        at = len(content) - len(reader.unused_data)
        yield out


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, number = [], 0, 0
    part = TaskContext.get().partitionId()

    def archive() -> pa.RecordBatch:
        content = pack(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha1(content).hexdigest()]), pa.array([content], pa.binary())], names=["archive", "content"])

    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(record(*row, place=f"{part}.{number}"))
            number += 1
            size += len(held[-1])
            if size >= SIZE:
                yield archive()
                held, size = [], 0
    if held:
        yield archive()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    for batch in batches:
        for content in batch.column(0):
            rows = [parse(r) for r in unpack(content.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            least: int = LEAST) -> DataFrame:
    """(page_id, url, digest, size, refers_to, payload, refers_url) of every row."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"),
                        payload.alias("payload"))
    keys = rows.where(F.col("size") >= least).select("digest", "page_id", "url")
    last = F.max_by("url", F.struct("page_id", "url"))
    repeated = stage(keys.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first"), last.alias("refers_url"))
                     .where("n > 1 and first is not null").select("digest", "first", "refers_url"))
    blocks = filter_blocks(repeated.count())
    tagged = probe(rows, "digest", bloom_filter(repeated, "digest", blocks), blocks)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    alone = tagged.where("not _w_maybe").withColumns({"refers_to": F.lit(None).cast("bigint"), "refers_url": F.lit(None).cast("string")})
    hits = tagged.where("_w_maybe").join(repeated, "digest", "left").withColumn("refers_to", refers)
    kept = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload")
    columns = ["page_id", "url", "digest", "size", "refers_to"]
    return alone.select(*columns, "payload", "refers_url").unionByName(hits.select(*columns, kept, "refers_url"))


def write(pages: DataFrame, **names) -> DataFrame:
    """The archives of the pages: a table in the shared folder."""
    return stage(decided(small_batches(pages), **names).mapInArrow(_write, ARCHIVES))


def read(archives: DataFrame) -> DataFrame:
    """Every record of the archives; a revisit has no payload."""
    return archives.select("content").mapInArrow(_read, RECORDS)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive to ``folder``, which all executors have mounted;
    returns their names and sizes. A task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"{folder}/{a}.warc.zst" for a in batch.column(0).to_pylist()]
            for name, content in zip(names, batch.column(1)):
                with open(name, "wb") as f:
                    f.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([len(c.as_buffer()) for c in batch.column(1)], pa.int64())], names=["file", "bytes"])

    return archives.mapInArrow(run, "file string, bytes bigint")
