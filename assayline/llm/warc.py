"""Web archives: writing captures as WARC records, reading archives, assembling captures from their records.

Method: a capture is a request, a response (or a revisit of an equal payload) and a metadata record; request and
metadata name the response by WARC-Concurrent-To.  Reading returns one row per record in whatever order and
file they lie; assembly joins the records of a capture through these identifiers into one nested row.

Archives are written by Spark's text writer, one record a line with the record's end as line separator, so that
they land in whatever store Spark can write to; they are gzipped per file.  Reading follows
Content-Length, so payloads may hold anything, record ends included.  A file is read by one task, record
by record; no file that the writer makes holds more than about ``MOST_BYTES``, or one capture.

Cases: a null payload is empty, a null url too, and control characters of a url are percent-encoded, as headers are lines.  Records
with equal payloads of at least ``least`` bytes revisit the one with the largest id; smaller ones are all responses.  Rows that
repeat an id are captures of their own, with records of their own; of equal payloads with the largest id all stay responses.  Captures with
a null id are refused by an error.  Truncated archives raise an error.  Payloads of over ``LARGE`` bytes lie in files of their own
kind.  An empty table makes an archive without records, and other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.llm.common import only, shipped, written
from assayline.plans.joins import split_join

END = "\r\n\r\n"
#: Bytes of records per archive file, on average: a task begins a new file after as many records as fill one.
FILE_BYTES = 4 << 20
#: Payloads above this are written apart, so that no file grows far beyond the average; bytes of payloads in one file at most.
LARGE, MOST_BYTES = 1 << 16, 1 << 30
#: Fixed value of the format.
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(kind: str, key: Column, nth: Column | None = None) -> Column:
    """A stable identifier of a capture's record; ``nth`` tells captures with the same id apart."""
    name = F.concat(F.lit(kind + ":"), key.cast("string"))
    h = F.md5(name if nth is None else F.when(nth == 1, name).otherwise(F.concat(name, F.lit("#"), nth.cast("string"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits (160 bits: 32 letters without padding)."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    bits = [F.lpad(F.conv(F.substring(hexadecimal, i, 10), 16, 2), 40, "0") for i in (1, 11, 21, 31)]
    return F.concat(
        *[
            F.substring(alphabet, (F.conv(F.substring(b, 5 * j + 1, 5), 2, 10).cast("int") + 1), F.lit(1))
            for b in bits for j in range(8)
        ]
    )


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its end."""
    parts: list[Column] = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        parts += [F.lit(name + ": "), value, F.lit("\r\n")]
    return F.concat(*parts, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def _as_header(value: Column) -> Column:
    """Text with its control characters percent-encoded."""
    control = r"[\x00-\x1F\x7F]"
    encoded = F.transform(F.split(value, ""), lambda c: F.when(c.rlike(control), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c))
    return F.when(value.rlike(control), F.array_join(encoded, "")).otherwise(value)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``nth``, which counts those that share an id; only these are shuffled."""
    repeated = written(rows.groupBy("key").count().where("count > 1").select("key"), "repeated")
    if not repeated.limit(1).count():
        return rows.withColumn("nth", F.lit(1))
    order = Window.partitionBy("key").orderBy("sha2", "url")
    several = rows.join(shipped(repeated), "key", "left_semi").withColumn("nth", F.row_number().over(order))
    return rows.join(shipped(repeated), "key", "left_anti").withColumn("nth", F.lit(1)).unionByName(several)


def write_captures(pages: DataFrame, path: str, key: str, url: str, payload: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write three records per row of ``pages`` to gzipped archives below ``path``."""
    rows = only(pages, key, url, payload).toDF("key", "url", "payload")
    rows = rows.select("key", _as_header(F.coalesce("url", F.lit(""))).alias("url"), F.coalesce("payload", F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.when(F.col("key").isNull(), F.raise_error(F.lit("a capture has no id"))).otherwise(F.col("key")))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    rows = rows.withColumn("sha2", F.sha2("payload", 256))
    equal = (
        rows.where(F.col("bytes") >= least).groupBy("sha2", "bytes").agg(F.max("key").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("sha2", "bytes", "first")
    )
    # Only records that share their payload are joined; the payloads themselves stay where they are.
    revisits = split_join(rows.select("key", "sha2", "bytes"), equal, ["sha2", "bytes"]).where("key <> first").select("key", "sha2", "first").distinct()
    marked = _attached(_numbered(rows), written(revisits, "revisits"))
    target, digest = F.col("url"), F.concat(F.lit("sha1:"), _base32(F.col("sha1")))
    response, revisit = _record_id("response", F.col("key"), F.col("nth")), F.col("first").isNotNull()
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    whole = _record(
        [("WARC-Type", F.lit("response")), ("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", digest),
         ("Content-Type", F.lit("application/http;msgtype=response"))], F.concat(http, F.col("payload")),
    )
    pointer = _record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", digest),
         ("WARC-Profile", F.lit(IDENTICAL_PAYLOAD)), ("WARC-Refers-To", _record_id("response", F.col("first"))),
         ("Content-Type", F.lit("application/http;msgtype=response"))], http,
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id("request", F.col("key"), F.col("nth"))), *common,
         ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\n\r\n")),
    )
    about = F.concat(
        F.lit("id: "), F.col("key").cast("string"), F.lit("\r\npayload-bytes: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nrefers-to-id: "), F.col("first").cast("string"))).otherwise(F.lit("")), F.lit("\r\n"),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata", F.col("key"), F.col("nth"))), *common,
         ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], about,
    )
    large = F.col("bytes") > LARGE
    size, n, most = rows.agg(
        F.coalesce(F.sum(F.when(~large, F.col("bytes"))), F.lit(0)), F.count(F.when(~large, True)), F.coalesce(F.max("bytes"), F.lit(0))
    ).first()
    records = F.explode(F.array(request, F.when(revisit, pointer).otherwise(whole), metadata)).alias("value")

    def put(some: DataFrame, per_file: int, mode: str) -> None:
        writer = some.select(records).write.mode(mode).option("lineSep", END).option("compression", "gzip")
        writer.option("maxRecordsPerFile", per_file).text(path)

    put(marked.where(~large), max(3, FILE_BYTES * 3 * n // (size + 1500 * n)) if n else 3, "error")
    if most > LARGE:
        put(marked.where(large), 3 * max(1, MOST_BYTES // most), "append")


def _attached(rows: DataFrame, revisits: DataFrame) -> DataFrame:
    """Rows with the id they revisit, if any.  Few revisits are broadcast, many are joined by a shuffle."""
    revisits = shipped(revisits.toDF("_key", "_sha2", "first"), 200_000)
    return rows.join(revisits, (rows["key"] == revisits["_key"]) & (rows["sha2"] == revisits["_sha2"]), "left").drop("_key", "_sha2")


FIELDS = (
    "record_id string, type string, target string, concurrent_to string, refers_to string, digest string, "
    "content_type string, block_bytes long, payload binary, payload_bytes long, payload_digest string"
)


def _bytes_of(content: bytes) -> Iterator[bytes]:
    """The archive in pieces, decompressed if its first bytes say gzip; several members may follow each other."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at, size = memoryview(content), 0, 1 << 20
    unpack, rest = zlib.decompressobj(31), b""
    while rest or at < len(view):
        if not rest:
            rest, at = bytes(view[at : at + size]), at + size
        yield unpack.decompress(rest)
        rest = b""
        if unpack.eof:
            rest, unpack = unpack.unused_data, zlib.decompressobj(31)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    pieces, held = _bytes_of(content), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 or not held[:end].strip():
            if end >= 0:  # ends of the record before
                del held[: end + 4]
            elif not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        lines = bytes(held[:end]).decode("utf-8").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        length = int(headers["content-length"])
        del held[: end + 4]
        if not fill(length):
            raise ValueError("the archive ends inside a record's block")
        yield headers, bytes(held[:length])
        del held[:length]


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP header."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``.

    ``payload_bytes`` and ``payload_digest`` (bare base32 of SHA-1) come from the bytes read; ``digest``
    is what the record states.  ``with_payload=False`` leaves the payloads of requests, responses and revisits out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in records_of(content.as_buffer().to_pybytes()):
                    payload = _payload(headers, block)
                    stated = headers.get("warc-payload-digest")
                    kept = payload if with_payload or headers.get("warc-type") == "metadata" else None
                    rows.append((
                        headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"),
                        headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                        stated.removeprefix("sha1:") if stated else None, headers.get("content-type"), len(block), kept,
                        len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    ))
                    held += len(kept or b"") + 500
                    if held > 1 << 22:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FIELDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id``, and structs ``response`` (or revisit), ``request`` and ``metadata``.

    Records that answer no other are the captures; those concurrent to one join it.  Of several
    requests or metadata records of a capture the one with the smallest identifier is taken; missing ones are null.
    """
    names = [c for c in records.columns if c not in ("record_id", "concurrent_to")]
    nested = records.select(
        F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture"),
        "type", F.struct("record_id", *names).alias("record"),
    ).where("capture is not null")
    main = nested.where(F.col("type").isin("response", "revisit")).select("capture", F.col("record").alias("response"))
    sides = nested.where(F.col("type").isin("request", "metadata")).groupBy("capture").agg(
        *[F.min(F.when(F.col("type") == kind, F.col("record"))).alias(kind) for kind in ("request", "metadata")]
    )
    return main.join(sides, "capture", "left").withColumnRenamed("capture", "record_id")


def metadata_field(name: str) -> Column:
    """A field of a capture's metadata record."""
    return F.nullif(F.regexp_extract(F.col("metadata.payload").cast("string"), rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))
