"""WARC archives in Zstandard: a writer and a validating reader.

An archive begins with a skippable frame that holds a dictionary; every record is
a Zstandard frame of its own.  The writer makes archives of bounded size in tasks
and hands each to Spark's text sink as one row, so archives land in any file
system that Spark reaches; the sink's separator after the row is an empty
skippable frame, which readers pass over.  The reader loads the dictionary,
decodes frame by frame and checks versions, headers, lengths and digests.

Defined results
---------------
* null html: an empty payload; null url: the record's own id stands as its target.
* rows with equal payloads: those with the largest ``page_id`` are responses, the
  others revisit it; a null ``page_id`` never outranks another.
* payloads under ``min_bytes`` are all responses.
* equal rows each get a record.
* columns other than ``page_id``, ``url`` and ``html`` are ignored; an empty table
  writes no archive and reads back empty.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import cut, scratch_path, spread_join

DICTIONARY_FRAME = 0x184D2A5D
#: An empty skippable frame; plain ASCII, so that the text sink can write it after a row.
PADDING = struct.pack("<II", 0x184D2A50, 0)
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
EOL = b"\r\n"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Block-Digest", "WARC-Payload-Digest")
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)


class WarcError(ValueError):
    """An archive that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(value: str) -> int | None:
    if not (value.startswith("<urn:page:") and value.endswith(">")):
        raise WarcError(f"unknown record id {value}")
    return int(value[10:-1]) if value != "<urn:page:>" else None


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit if ``refers_to`` is given, and then without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n") or _id(page)[1:-1]
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _id(page),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": "sha1:" + sha1_base32(block),
        "WARC-Payload-Digest": "sha1:" + sha1_base32(payload),
    }
    if refers_to is not None:
        headers["WARC-Refers-To"] = _id(refers_to)
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    headers["Content-Length"] = str(len(block))
    lines = EOL.join(f"{k}: {v}".encode() for k, v in headers.items())
    return VERSION + EOL + lines + EOL + EOL + block + EOL + EOL


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of the samples; with too few of them, their beginning as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[: max(size, 8)].ljust(8, b"\0")


def archive(records: list[bytes], dictionary_bytes: int = 16 << 10, sample_bytes: int = 1 << 20, level: int = 3) -> bytes:
    """An archive of the records.  The dictionary comes from the beginnings of evenly spaced ones, ``sample_bytes`` in all."""
    step = max(1, len(records) * 4096 // sample_bytes)
    raw = train_dictionary([r[:4096] for r in records[::step]], dictionary_bytes)
    packed = zstandard.ZstdCompressor(level=level).compress(raw)
    coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(packed)), packed, *map(coder.compress, records)])


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded content of each frame; skippable frames are passed over, a leading dictionary frame is loaded."""
    view, at, dictionary = memoryview(data), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError("the archive ends inside a frame")
        magic, length = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + length > len(view):
                raise WarcError("the archive ends inside a skippable frame")
            if at == 0 and magic == DICTIONARY_FRAME:
                raw = bytes(view[8 : 8 + length])
                raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + length
            continue
        if bytes(view[at : at + 4]) != ZSTD_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, start = [], at
        while not decoder.eof:
            if at >= len(view):
                raise WarcError("the archive ends inside a frame")
            piece = view[at : at + (1 << 16)]
            try:
                parts.append(decoder.decompress(piece))
            except zstandard.ZstdError as error:
                raise WarcError(f"bad frame at byte {start}: {error}") from error
            at += len(piece) - len(decoder.unused_data)
        yield b"".join(parts)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not value.isdigit():
        raise WarcError(f"bad Content-Length {value!r}")
    return int(value)


def parse_record(data: bytes) -> tuple:
    """A ``RECORD`` row, after its headers, lengths and digests have been checked."""
    head, gap, rest = data.partition(EOL + EOL)
    lines = head.split(EOL)
    if not gap or lines[0] != VERSION:
        raise WarcError("no WARC version line")
    fields = _fields(lines[1:])
    missing = [n for n in REQUIRED if n.lower() not in fields]
    if missing:
        raise WarcError(f"missing headers: {', '.join(missing)}")
    if len(rest) != _length(fields) + 4 or rest[-4:] != EOL + EOL:
        raise WarcError("Content-Length and the frame's length differ")
    block = rest[:-4]
    if fields["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise WarcError("the block digest differs")
    http, gap, payload = block.partition(EOL + EOL)
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP response")
    length, digest = _length(_fields(http.split(EOL)[1:])), fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != length or sha1_base32(payload) != digest:
            raise WarcError("the payload's length or digest differs")
        refers = None
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise WarcError("a revisit has a payload or names no record")
        refers = _page(fields["warc-refers-to"])
    else:
        raise WarcError(f"unknown record type {kind}")
    text = payload.decode("utf-8") if kind == "response" else None
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, refers, length, digest, text


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: the largest page id with an equal payload, null for responses."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    # Page ids and digests alone are grouped and joined; a payload that many pages have is dealt to several tasks.
    names = cut(rows.where(F.col("size") >= min_bytes).select("page_id", "digest", "size"))
    repeated = cut(
        names.groupBy("digest", "size")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to"))
        .where("n > 1")
        .select("digest", "size", "refers_to")
    )
    found = spread_join(names, repeated, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    found = found.where("refers_to IS NOT NULL").select(F.col("page_id").alias("page"), F.col("digest").alias("same"), "refers_to").distinct()
    on = rows["page_id"].eqNullSafe(found["page"]) & (rows["digest"] == found["same"])
    return rows.join(found, on, "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = 16 << 20, date: str = "2026-01-01T00:00:00Z") -> None:
    """Archives of about ``archive_bytes`` of records each, one file per archive, under ``path``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive(records)], pa.binary())], ["archive"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for page, url, html, refers in zip(*columns):
                records.append(record(page.as_py(), url.as_py(), html.as_py().encode(), refers.as_py(), date))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield flush()
                    records, held = [], 0
        if records:
            yield flush()

    rows = revisits(pages, min_bytes).withColumn("page_id", F.col("page_id").cast("long"))
    archives = rows.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", PADDING.decode()).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, validated; a broken archive fails the read."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RECORD.fieldNames()
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for frame in frames(content.as_py()):
                    rows.append(parse_record(frame))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(unpack, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back; the contract's columns."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
