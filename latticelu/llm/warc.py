"""WARC archives: writing captures, reading them back, assembling transactions.

A capture is three records: a request, a response (or a revisit, when another capture
has the same payload) and a metadata record; request and metadata name the main record
in WARC-Concurrent-To.  Archives are written by Spark's own writer (any file system,
one gzip stream a file), a record being one value and CR LF the separator, which makes
the two line ends that close a record.  Files hold a bounded number of captures, so
that a file is read back as one value.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

CRLF = b"\r\n"
ARCHIVE_BYTES = 16 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard URL name space


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}:{key}')}>"


def build_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {_line(v)}\r\n".encode("utf-8", "surrogatepass") for k, v in head) + CRLF + block


def _line(value: str) -> str:
    """Header values are one line: percent-encode what would end it."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def parse_records(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by Content-Length; one record is held at a time."""
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    while line := f.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := f.readline()) != CRLF:
            if not line.endswith(CRLF):
                raise ValueError("a record's head is cut short")
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            headers[k.lower()] = _unline(v.strip(" \r\n"))
        size = int(headers["content-length"])
        block = f.read(size)
        if len(block) != size or f.read(4) != CRLF + CRLF:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


def main_id(row: int) -> str:
    return record_id("main", str(row))


def _capture(row: int, page: int | None, url: str | None, payload: bytes, refers: int | None, date: str) -> list[bytes]:
    target, digest, main = url or "", payload_digest(payload), main_id(row)
    request = f"GET {_line(target)} HTTP/1.1\r\n\r\n".encode("utf-8", "surrogatepass")
    base = [("WARC-Date", date), ("WARC-Target-URI", target)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    own = [("WARC-Record-ID", main), *base, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is None:
        record = build_record("response", own, http + payload)
    else:
        record = build_record("revisit", [*own, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", main_id(refers))], http)
    fields = f"page: {'' if page is None else page}\r\n".encode()
    return [
        build_record("request", [("WARC-Record-ID", record_id("request", str(row))), *base, ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")], request),
        record,
        build_record("metadata", [("WARC-Record-ID", record_id("metadata", str(row))), *base, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], fields),
    ]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write three records for each row of `pages` under `path`.

    Record ids come from a number that each row gets, so rows that repeat, and those with a
    null id, are captures of their own.  Null HTML is an empty payload, a null URL an empty
    one.  Of rows with equal payloads of at least `min_revisit_bytes` bytes, one of the least
    id is the response and the others revisit it; a row with a null id is always a response.
    Equal payloads are found by digest and length: partial aggregation, then an equi-join
    whose hot digests adaptive execution splits.  An archive holds captures up to about
    `archive_bytes` bytes of records, one at least.  An empty table writes an empty archive.
    """
    # stored, so that a row keeps its number in both passes
    rows = materialize(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")), "captures")
    keys = rows.filter("page is not null").select("page", "row", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes")).filter(F.col("bytes") >= min_revisit_bytes)
    first = keys.groupBy("digest", "bytes").agg(F.min(F.struct("page", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "bytes", F.col("first.row").alias("first"))
    refers = materialize(keys.join(first, ["digest", "bytes"]).filter("row <> first").select(F.col("row").alias("r"), "first"), "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-2]], pa.large_binary()).cast(pa.binary())], ["record"])  # the writer adds the last line end

        for batch in batches:
            for row, page, url, ref, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                made = b"".join(r + CRLF + CRLF for r in _capture(row, page, url, payload.as_py(), ref, date))
                if held and size + len(made) > archive_bytes:
                    yield archive()
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield archive()

    joined = rows.join(refers, rows["row"] == refers["r"], "left").select("row", "page", "url", "first", "payload")
    text = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


_RECORD = "kind string, id string, concurrent_to string, refers_to string, url string, page bigint, payload_bytes bigint, payload_digest string, stated_digest string, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives under `path`.

    payload_bytes and payload_digest are taken of the bytes read; a response whose stated
    digest is another is an error.  Archives are inflated record by record.
    """
    fields = [f.rsplit(" ", 1) for f in _RECORD.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        rows, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

        for batch in batches:
            for content in batch.column(0):
                for h, block in parse_records(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))):
                    page = count = digest = payload = None
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if h["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        digest, count = payload_digest(payload), len(payload)
                        if stated not in (None, digest):
                            raise ValueError(f"record {h['warc-record-id']}: the payload's digest is {digest}, not {stated}")
                    elif h["warc-type"] == "metadata":
                        own = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if line)
                        page = int(own["page"]) if own.get("page") else None
                    payload = payload if with_payload else None
                    rows.append((h["warc-type"], h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), page, count, digest, stated, payload))
                    size += len(payload or b"")
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page, request, response and metadata.

    Records meet by the id that they are concurrent to (a main record: its own), in one
    shuffle.  A capture without a request or metadata record has null there; requests and
    metadata without a main record give a row without response.  Of several records of a
    kind one stays.
    """
    key = F.coalesce("concurrent_to", "id")
    of = lambda *kinds: F.first(F.when(F.col("kind").isin(*kinds), F.struct(*[f.rsplit(" ", 1)[0] for f in _RECORD.split(", ")])), ignorenulls=True)
    return records.withColumn("capture", key).groupBy("capture").agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata")).select(F.col("metadata.page").alias("page"), "capture", "request", "response", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """`captures` with payload_bytes, payload_digest and refers_page.

    A response has those of its own payload; a revisit those of the response that its
    WARC-Refers-To names, null if there is none, and an error if that has another digest than
    the revisit states.  `captures` is read twice: store it.
    """
    again = F.coalesce(F.col("response.kind") == "revisit", F.lit(False))
    rest = captures.filter(~again).select("*", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.lit(None).cast("bigint").alias("refers_page"))
    revisits = captures.filter(again)
    wanted = revisits.select(F.col("response.refers_to").alias("_id")).distinct()
    known = captures.filter(F.col("response.kind") == "response").select(F.col("response.id").alias("_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("page").alias("refers_page"))
    found = revisits.join(known.join(wanted, "_id", "left_semi"), F.col("response.refers_to") == F.col("_id"), "left").drop("_id")
    wrong = F.col("payload_digest") != F.col("response.stated_digest")
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("the digest of the response is not that of revisit "), F.col("response.id")))).otherwise(F.col("payload_digest"))
    return rest.unionByName(found.withColumn("payload_digest", checked))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, **columns) -> DataFrame:
    """Write `pages` to archives in the shared folder; their resolved captures, without payloads, read back."""
    spark = pages.sparkSession
    path = f"{new_path(spark, 'warc')}/t"
    write_archives(pages, path, min_revisit_bytes=min_revisit_bytes, **columns)
    return resolve(materialize(assemble(read_records(spark, path, with_payload=False)), "transactions"))
