"""WARC archives: writing captures, reading records, assembling transactions.

Archives are ordinary WARC/1.1 files, compressed as a whole, written and read by
Spark's text source with the record terminator as line separator; so they can lie
in any store that Spark reaches, a lost task is repeated by Spark, and no payload
is decoded. A capture is a response (or revisit), a request and a metadata record;
the last two name the first in WARC-Concurrent-To. They go to three folders, and
assembly joins them again through that identifier.

Defined results: a null body is an empty payload; a null URL is empty; of equal
payloads of at least ``least_bytes`` bytes, rows with the smallest id are
responses and the others revisits, rows that repeat that id and payload included;
without an id among them all are responses. Payloads may hold any bytes, record
terminators and header lines included, and be of any length: a task holds one record
at a time. Of several rows with the smallest id, revisits refer to the one that comes
first in the table. An empty table gives empty archives and no capture. Only the three
named columns are read, whatever other columns are called.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

END = "\r\n\r\n"
KINDS = ("response", "request", "metadata")

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "http_head")]
    + [T.StructField("payload", T.BinaryType())]
)


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1, from built-in functions: 32 digits are 8 groups of 20 bits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (id, url, payload, seq) with digest, bytes, refers_to, refers_url and refers_seq, null for a response.

    Equal payloads are counted before the shuffle; the join back splits a payload
    that a large share of the rows has (adaptive skew join).
    """
    marked = pages.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    named = F.when(F.col("id").isNotNull(), F.struct("id", "seq", "url"))
    first = marked.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    other = F.col("id").isNull() | (F.col("id") != F.col("first.id"))
    return (
        marked.join(first, ["digest", "bytes"], "left")
        .withColumns({c: F.when(other, F.col(f"first.{f}")) for c, f in (("refers_to", "id"), ("refers_url", "url"), ("refers_seq", "seq"))})
        .drop("first")
    )


def _urn(*parts) -> F.Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: F.Column, record_id: F.Column, content_type: str, block: F.Column, *headers: F.Column) -> F.Column:
    """A record without its terminator; headers whose value is null are left out."""
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"), *headers,
        F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(lines.cast("binary"), F.lit(END).cast("binary"), block)


def write(pages: DataFrame, path: str, id_column: str, url: str, body: str, least_bytes: int = 0) -> None:
    """Write an archive of three folders under path: one capture for each row."""
    rows = pages.select(
        F.col(id_column).alias("id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\\r\\n]", "").alias("url"), common.as_bytes(body).alias("payload")
    )
    rows = with_revisits(rows.withColumn("seq", F.monotonically_increasing_id()), least_bytes)
    number = F.coalesce(F.col("id").cast("string"), F.lit(""))
    main = _urn(F.lit("capture"), number, "digest", F.col("seq").cast("string"))
    first = _urn(F.lit("capture"), F.col("refers_to").cast("string"), "digest", F.col("refers_seq").cast("string"))
    revisit = F.col("refers_to").isNotNull()
    uri = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), main)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)).cast("binary")
    empty = F.lit("").cast("binary")
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), main, "application/http; msgtype=response",
        F.concat(head, F.when(revisit, empty).otherwise(F.col("payload"))), uri,
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), first)),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("refers_url"))),
        F.when(revisit, F.lit("WARC-Refers-To-Date: 2024-01-01T00:00:00Z")),
    )
    target = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    request = _record(
        F.lit("request"), _urn(F.lit("request"), number, "digest", F.col("seq").cast("string")), "application/http; msgtype=request",
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)).cast("binary"), uri, concurrent,
    )
    fields = F.concat_ws("\r\n", F.concat(F.lit("pageId: "), number), F.concat(F.lit("refersToPage: "), F.col("refers_to").cast("string")))
    metadata = _record(F.lit("metadata"), _urn(F.lit("metadata"), number, "digest", F.col("seq").cast("string")), "application/warc-fields", fields.cast("binary"), uri, concurrent)
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), r.cast("string").alias("value")) for k, r in zip(KINDS, (response, request, metadata), strict=True)])
    rows.select(F.explode(entries).alias("e")).select("e.kind", "e.value").write.partitionBy("kind").option("lineSep", END).option("compression", "gzip").text(path)


_HEADER = re.compile(rb"(?im)^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r?$")


def parse(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Records of a stream that was cut at each CR LF CR LF. One record is held at a time."""
    mark = END.encode()
    held = b""
    while True:
        held = held.lstrip(b"\r\n")
        while mark not in held:
            piece = next(pieces, None)
            if piece is None:
                return
            held = (held + piece + mark).lstrip(b"\r\n")
        head, _, rest = held.partition(mark)
        if not head.startswith(b"WARC/"):
            held = rest  # between records: padding or debris
            continue
        fields = {k.lower(): v for k, v in _HEADER.findall(head)}
        length = int(fields.get(b"content-length", b"0"))
        parts, have = [rest], len(rest)
        while have < length:
            piece = next(pieces, None)
            if piece is None:
                break
            parts += (piece, mark)
            have += len(piece) + len(mark)
        block = b"".join(parts)
        block, held = block[:length], block[length:]
        kind = fields.get(b"warc-type", b"").decode()
        is_http = fields.get(b"content-type", b"").startswith(b"application/http")
        http, _, payload = block.partition(mark) if is_http else (b"", b"", block)
        names = (b"warc-record-id", b"warc-concurrent-to", b"warc-refers-to", b"warc-target-uri", b"warc-date", b"warc-payload-digest")
        values = [fields[n].decode("utf-8", "replace") if n in fields else None for n in names]
        yield kind, *values, http.decode("latin-1"), payload


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in a folder (compressed files are read whole, each by one task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (x or b"" for b in batches for x in b.column(0).to_pylist())
        rows, size = [], 0
        for row in parse(stream):
            rows.append(row)
            size += len(row[-1]) + 500
            if size > 8 << 20:
                yield pack(rows)
                rows, size = [], 0
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 8 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORD.names)

    common.small_batches(spark)
    try:
        lines = spark.read.schema("value string").option("lineSep", END).text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")  # an archive of no page has no such folder
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """One nested row for each capture: response (or revisit), request, metadata.

    Requests and metadata are joined to their capture through WARC-Concurrent-To.
    A capture without one of them has null there; a request or metadata record
    whose capture is missing has no row.
    """
    main = records(spark, f"{path}/kind=response").where(F.col("record_type").isin("response", "revisit"))
    fields = [c for c in RECORD.names if c != "concurrent_to"]
    main = main.select("record_id", F.struct(*fields).alias("response"))
    request = records(spark, f"{path}/kind=request").where("record_type = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(*fields).alias("request"))
    metadata = records(spark, f"{path}/kind=metadata").where("record_type = 'metadata'")
    value = lambda name: F.nullif(F.regexp_extract(F.col("payload").cast("string"), rf"(?m)^{name}: ?([^\r\n]*)", 1), F.lit(""))
    metadata = metadata.select(
        F.col("concurrent_to").alias("record_id"),
        F.struct("record_id", value("pageId").alias("page_id"), value("refersToPage").alias("refers_to_page")).alias("metadata"),
    )
    return main.join(request, "record_id", "left").join(metadata, "record_id", "left")


def payload_bytes(record: str = "response") -> F.Column:
    """The length of a capture's payload: its own, or for a revisit what the HTTP head says."""
    said = F.regexp_extract(F.col(f"{record}.http_head"), r"(?im)^Content-Length:[ \t]*(\d+)", 1)
    return F.when(F.col(f"{record}.record_type") == "revisit", F.nullif(said, F.lit("")).cast("long")).otherwise(F.octet_length(f"{record}.payload").cast("long"))


def round_trip(pages: DataFrame, id_column: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the pages as archives (to the shared folder by default) and assemble what is read back."""
    spark = pages.sparkSession
    path = path or f"{common.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path, id_column, url, body, least_bytes)
    return transactions(spark, path)
