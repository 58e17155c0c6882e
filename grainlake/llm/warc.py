"""WARC archives: records written in segments, and read back by reassembly.

A long record is cut into segments of a bounded size (a first record and continuations), so archives have bounded
sizes as well and no reader holds more than one. Reading groups continuation records by the origin record's
identifier, puts them in order of their segment number, holds the sum against the total length that the last segment
declares, and decodes the chunked transfer framing of the HTTP message inside.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_batches

SEGMENT_BYTES = 64 * 1024
RECORDS_PER_FILE = 128
MIN_REVISIT_BYTES = 1000

# Fixed values of WARC 1.1 and HTTP 1.1.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _bytes(text: str) -> Column:
    return F.encode(F.lit(text), "UTF-8")


def _join(parts: Column) -> Column:
    """The bytes of an array of binaries, one after another."""
    return F.array_join(F.transform(parts, lambda x: x.cast("string")), "").cast("binary")


def _pieces(data: Column, size: Column) -> Column:
    """An array of ``data`` cut every ``size`` bytes; of empty data an empty array."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.substring(data, k * size + 1, size))


def chunked(payload: Column) -> Column:
    """Chunked transfer framing: chunks of 8 KiB, larger for payloads of over 64 chunks."""
    size = F.greatest(F.lit(8192), F.ceil(F.octet_length(payload) / 64)).cast("int")
    framed = F.transform(_pieces(payload, size), lambda x: F.concat(F.encode(F.lower(F.hex(F.octet_length(x).cast("long"))), "UTF-8"), _bytes("\r\n"), x, _bytes("\r\n")))
    return F.concat(_join(framed), _bytes("0\r\n\r\n"))


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``id, url, payload, digest, size, refers_to, refers_url``: of rows with equal payloads of at least ``min_bytes``
    the one with the largest id has no ``refers_to``, the others have that id and its url. Equal means equal length, SHA-1 and 64-bit
    hash. Only payloads that occur more than once are joined, whose rows adaptive execution splits if one is hot."""
    same = ["digest", "size", "_check"]
    large = pages.where(F.col("size") >= min_bytes).groupBy(*same).agg(F.max(F.struct("id", "url")).alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    large = large.select(*same, F.col("_best.id").alias("_rep"), F.col("_best.url").alias("_url"))
    # A table, as only a side that comes straight from its exchange lets a hot payload's rows be split.
    joined = pages.join(materialise(large, "repeated-payloads"), same, "left")
    # Null ids come before all others, and rows that share the largest id are responses, each of them.
    other = F.col("id").isNull() | (F.col("id") < F.col("_rep"))
    marked = joined.withColumns({"refers_to": F.when(other, F.col("_rep")), "refers_url": F.when(other, F.col("_url")), "revisit": F.col("_rep").isNotNull() & ~F.col("id").eqNullSafe(F.col("_rep"))})
    return marked.drop("_rep", "_url", "_check")


def _header(*lines: Column) -> Column:
    """Header lines; null ones are left out."""
    return F.concat_ws("\r\n", F.lit(VERSION), *lines)


def _line(name: str, value: Column) -> Column:
    clean = F.regexp_replace(value.cast("string"), "[\r\n]", "%0A")
    return F.when(clean.isNotNull(), F.concat(F.lit(f"{name}: "), clean))


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one WARC record a row, a response or a revisit, as gzipped archives under ``path``.

    The payload is the UTF-8 of ``payload_col`` (null: empty) behind an HTTP head, in chunked framing. Records of
    over ``segment_bytes`` become segments. An archive has at most ``records_per_file`` records, so at most
    ``records_per_file * segment_bytes`` and the headers before compression. Null urls have no target line. Rows
    that repeat an id are records of their own, told apart by a random name in the record. No rows, an empty folder.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long"), "_check": F.xxhash64("payload")})
    marked = mark_revisits(pages, min_revisit_bytes)
    block = F.when(F.col("revisit"), _bytes(HTTP_HEAD)).otherwise(F.concat(_bytes(HTTP_HEAD), chunked(F.col("payload"))))
    named = marked.select("id", "url", "digest", "size", "refers_to", "refers_url", "revisit", F.expr("uuid()").alias("name"), block.alias("block"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("block") / F.lit(segment_bytes))).cast("int")
    cut = named.withColumn("segments", count).withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    many, first, last = F.col("segments") > 1, F.col("segment") == 1, F.col("segment") == F.col("segments")
    part = F.substring(F.col("block"), (F.col("segment") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    urn = lambda name: F.concat(F.lit("<urn:uuid:"), name, F.lit(">"))
    origin = urn(F.col("name"))
    # A continuation's own name only has to be unique, so it is made from the origin's and the number.
    digits = F.md5(F.concat(F.col("name"), F.lit("/"), F.col("segment").cast("string")))
    own = F.when(first, origin).otherwise(urn(F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")))
    only = lambda when, value: F.when(when, value)
    head = _header(
        _line("WARC-Type", F.when(~first, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", own),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("Content-Type", only(first, F.lit("application/http;msgtype=response"))),
        _line("WARC-Payload-Digest", only(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _line("WARC-Profile", only(F.col("revisit"), F.lit(PROFILE))),
        _line("WARC-Refers-To-Target-URI", only(F.col("revisit"), F.col("refers_url"))),
        _line("WARC-Refers-To-Date", only(F.col("revisit"), F.lit(DATE))),
        _line("WARC-Segment-Number", only(many, F.col("segment"))),
        _line("WARC-Segment-Origin-ID", only(~first, origin)),
        _line("WARC-Segment-Total-Length", only(many & last, F.octet_length("block"))),
        _line("X-Row-ID", F.col("id")),
        _line("X-Refers-To-Row-ID", F.col("refers_to")),
        _line("X-Payload-Length", only(first, F.col("size"))),
        _line("Content-Length", F.octet_length(part)),
    )
    record = F.concat(F.encode(head, "UTF-8"), _bytes("\r\n\r\n"), part)
    # A record ends with two line ends, which is what separates the lines of this text file.
    cut.select(record.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def split_records(data: bytes):
    """Headers (lower-case names) and content block of each record of an archive, gzipped as a whole, by records, or not."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            member = zlib.decompressobj(31)
            plain.append(member.decompress(data) + member.flush())
            data = member.unused_data
        data = b"".join(plain)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at, size = stop + 4, int(headers["content-length"])
        if at + size > len(data):
            raise ValueError("the archive ends within a record")
        yield headers, data[at : at + size]
        at += size
        while data[at : at + 2] == b"\r\n":
            at += 2


def dechunk(body: bytes) -> bytes:
    """The payload within chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """What an HTTP message carries, its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


_RECORD = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("origin_id", T.StringType()),
    T.StructField("segment", T.IntegerType()), T.StructField("total_length", T.LongType()), T.StructField("target_uri", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("refers_to_row_id", T.LongType()),
    T.StructField("payload_length", T.LongType()), T.StructField("block", T.BinaryType()), T.StructField("payload", T.BinaryType()),
])


def read_records(spark: SparkSession, path: str, decode: bool = False) -> DataFrame:
    """One row a record of the archives under ``path``; ``segment`` is null where a record is whole. With ``decode``
    whole responses have their ``payload`` instead of their ``block``."""
    small_batches(spark, 200)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def row(h: dict[str, str], block: bytes) -> tuple:
        get, payload = h.get, None
        if decode and "warc-segment-number" not in h:
            payload, block = None if get("warc-type") == "revisit" else http_payload(block), None
        origin, digest = get("warc-segment-origin-id") or get("warc-record-id"), get("warc-payload-digest") or ""
        return get("warc-type"), get("warc-record-id"), origin, number(get("warc-segment-number")), number(get("warc-segment-total-length")), get("warc-target-uri"), digest.partition(":")[2] or None, number(get("x-row-id")), number(get("x-refers-to-row-id")), number(get("x-payload-length")), block, payload

    def parse(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [row(*x) for x in split_records(batch.column(0)[k].as_py())]
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), _ARROW)], names=_RECORD.names)

    return files.mapInArrow(parse, _RECORD)


_ARROW = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


_KEPT = ["record_id", "record_type", "target_uri", "payload_digest", "row_id", "refers_to_row_id", "payload_length"]


def reassemble(records: DataFrame) -> DataFrame:
    """Segments put together, in ``record_id, record_type, target_uri, payload_digest, row_id, refers_to_row_id,
    payload_length, block``; whole records have no part in it.

    Segments are shuffled by the origin's identifier; a group is one record. Missing or repeated segments, a
    missing first or last one, or a length other than the declared total raise an error.
    """
    first = F.col("segment") == 1
    pick = lambda name: F.max(F.when(first, F.col(name))).alias(name)
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))
    grouped = records.where(F.col("segment").isNotNull()).groupBy(F.col("origin_id").alias("record_id")).agg(*map(pick, _KEPT[1:]), F.max("total_length").alias("_total"), parts.alias("_parts"))
    blocks = _join(F.transform("_parts", lambda x: x["block"]))
    joined = grouped.withColumn("block", blocks).withColumn("_numbers", F.transform("_parts", lambda x: x["segment"]))
    sound = (F.col("_numbers") == F.sequence(F.lit(1), F.size("_parts"))) & (F.octet_length("block") == F.col("_total"))
    error = F.raise_error(F.concat(F.lit("segments don't add up: "), F.col("record_id"))).cast("binary")
    return joined.withColumn("block", F.when(F.coalesce(sound, F.lit(False)), F.col("block")).otherwise(error)).select(*_KEPT, "block")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, segments put together, with its decoded ``payload``; a revisit,
    which stores none, has null. Archives are parsed once, into a table of whole records and segments."""
    records = materialise(read_records(spark, path, decode=True), "records")
    parts = reassemble(records)
    schema = T.StructType([*(f for f in parts.schema if f.name != "block"), T.StructField("payload", T.BinaryType())])

    def decode(batches):
        for batch in batches:
            got = [http_payload(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.binary())], names=schema.names)

    whole = records.where(F.col("segment").isNull())
    return whole.select(*_KEPT, "payload").unionByName(parts.mapInArrow(decode, schema))


def round_trip(df: DataFrame, path: str, **names) -> DataFrame:
    """Write ``df`` as archives and read them: ``page_id, payload_bytes, payload_digest, record_type, refers_to``,
    with the digest of responses taken from the payload read, which must be the one that the record declares."""
    write_warc(df, path, **names)
    read = read_warc(df.sparkSession, path)
    got = F.sha1("payload")
    digest = F.when(F.col("payload").isNull() | (got == F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length"))
    return read.select(F.col("row_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("refers_to_row_id").alias("refers_to"))
