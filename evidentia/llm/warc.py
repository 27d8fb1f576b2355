"""WARC archives of page captures: writing, reading, and assembly of transactions.

Each capture is three records: request, response (or revisit) and metadata; request and
metadata name the response's record in WARC-Concurrent-To. A revisit names the record of
the response it repeats in WARC-Refers-To, and its metadata the page of that. For this,
all responses are written first, and revisits when the responses' records are known.
Reading parses the archives
into one row per record, joins them through these identifiers and gives one nested row
per capture. A task writes one archive of gzip members and moves it in place when whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded, checked, file_system, put, save, shared_dir

DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are never deduplicated.
MIN_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20


def record_id(archive: str, index: int, kind: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{index}/{kind}').urn}>"


def _safe(value: str) -> str:
    """A header value: controls and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, identifier: str, block: bytes, **fields: str | None) -> bytes:
    """One record as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Date", DATE), *((k.replace("_", "-"), v) for k, v in fields.items() if v is not None), ("Content-Length", str(len(block)))]
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _records(archive: str, index: int, page_id, url, main: list[tuple], block: bytes, length: int, fields: str) -> Iterator[bytes]:
    """Request, response or revisit (with headers ``main``), and metadata of one capture."""
    own, uri = record_id(archive, index, "main"), None if url is None else _safe(url)
    host = re.match(r"(?s).*?://([^/?#]*)", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    get = f"GET {uri or '/'} HTTP/1.1\r\nHost: {_safe(host[1]) if host else ''}\r\n\r\n".encode()
    yield record("request", record_id(archive, index, "request"), get, WARC_Target_URI=uri, WARC_Concurrent_To=own, Content_Type="application/http; msgtype=request")
    kind, more = main
    yield record(kind, own, http + block, WARC_Target_URI=uri, **more, Content_Type="application/http; msgtype=response")
    fields = ("" if page_id is None else f"page-id: {page_id}\r\n") + fields
    yield record("metadata", record_id(archive, index, "metadata"), fields.encode(), WARC_Target_URI=uri, WARC_Concurrent_To=own, Content_Type="application/warc-fields")


def _response(archive: str, index: int, page_id, url, html, sha) -> Iterator[bytes]:
    payload = (html or "").encode()
    return _records(archive, index, page_id, url, ("response", {"WARC_Payload_Digest": f"sha1:{digest(payload)}"}), payload, len(payload), "")


def _revisit(archive: str, index: int, page_id, url, size, sha, first, first_url, first_record) -> Iterator[bytes]:
    more = {
        "WARC_Payload_Digest": f"sha1:{base64.b32encode(sha).decode()}", "WARC_Profile": PROFILE, "WARC_Refers_To": first_record,
        "WARC_Refers_To_Target_URI": None if first_url is None else _safe(first_url), "WARC_Refers_To_Date": DATE,
    }
    return _records(archive, index, page_id, url, ("revisit", more), b"", size, f"refers-to-page-id: {first}\r\n")


_WRITTEN = pa.schema([("archive", pa.string()), ("sha", pa.binary()), ("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string())])
_WRITTEN_SQL = "archive string, sha binary, page_id long, url string, record_id string"


def _write(root: str, kind: str, capture):
    """Writes one archive; gives its name, and the record of each response that others may revisit (``first`` is its own page)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, n, targets = f"{kind}-{TaskContext.get().partitionId():08d}", [0], []
        fs, top = file_system(root)
        fs.create_dir(top, recursive=True)

        def write(out):
            out.write(record("warcinfo", record_id(archive, 0, "info"), b"format: WARC file version 1.1\r\n", Content_Type="application/warc-fields"))
            for batch in batches:
                names = batch.schema.names
                for k in range(batch.num_rows):
                    row = [batch.column(c)[k].as_py() for c in range(batch.num_columns)]
                    for data in capture(archive, n[0], *(row[:-1] if kind == "response" else row)):
                        out.write(data)
                    if names[-1] == "target" and row[-1]:
                        targets.append((archive, row[3], row[0], row[1], record_id(archive, n[0], "main")))
                    n[0] += 1

        put(fs, f"{top}/{archive}.warc.gz", write)
        targets.append((archive, None, None, None, None))
        for lo in range(0, len(targets), 5000):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*targets[lo : lo + 5000], strict=True), _WRITTEN, strict=True)], schema=_WRITTEN)

    return run


def write(pages: DataFrame, root: str, min_bytes: int = MIN_BYTES) -> list[str]:
    """Writes archives of all pages below ``root``; gives their names.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the smallest page_id is
    a response and the others revisit it. Null html is an empty payload; a page without
    an id revisits one with an id, and is a response where no page of its payload has
    one. Rows that repeat the smallest id are responses, of which revisits name one.
    Only digests that occur more than once are joined back, and only what is narrow goes
    to all tasks; if that is too much, the join shuffles.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha1(text)).alias("sha"), F.octet_length(text).alias("size"))
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1 AND first IS NOT NULL").select("sha", "first")
    firsts = save(firsts, shared_dir(spark, "warc-firsts"))
    joined = rows.join(checked(firsts), "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    single = joined.where(~again).select("page_id", "url", "html", "sha", F.col("first").isNotNull().alias("target"))
    written = save(single.mapInArrow(_write(root, "response", _response), _WRITTEN_SQL), shared_dir(spark, "warc-responses"))
    targets = written.where("sha IS NOT NULL").groupBy("sha").agg(F.min(F.struct("record_id", "page_id", "url")).alias("of"))
    targets = targets.select("sha", F.col("of.page_id").alias("first"), F.col("of.url").alias("first_url"), F.col("of.record_id").alias("first_record"))
    others = rows.drop("html").join(checked(targets), "sha").where(~F.col("page_id").eqNullSafe(F.col("first")))
    others = others.select("page_id", "url", "size", "sha", "first", "first_url", "first_record")
    second = save(others.mapInArrow(_write(root, "revisit", _revisit), _WRITTEN_SQL), shared_dir(spark, "warc-revisits"))
    return sorted(r.archive for t in (written, second) for r in t.where("sha IS NULL").select("archive").distinct().collect())


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip-member archive, read as a stream."""
    z, held, data = zlib.decompressobj(31), [], stream.read(_READ)
    while data:
        held.append(z.decompress(data))
        if not z.eof:
            data = stream.read(_READ)
            continue
        raw = b"".join(held)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(fields["Content-Length"])
        if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield fields, rest[:size]
        data = z.unused_data or stream.read(_READ)
        z, held = zlib.decompressobj(31), []


_RECORD = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary()), ("refers_to", pa.string()), ("refers_page", pa.int64())])
_RECORD_SQL = "kind string, record_id string, concurrent_to string, target_uri string, page_id long, payload_digest string, payload_bytes long, intact boolean, payload binary, refers_to string, refers_page long"


def _parse(root: str, payloads: bool):
    def row(fields: dict[str, str], block: bytes):
        kind, page, first, sha, n, intact, payload = fields["WARC-Type"], None, None, None, None, None, None
        if kind == "metadata":
            m = re.search(rb"^page-id: (-?\d+)\r$", block, re.M)
            page = int(m[1]) if m else None
            m = re.search(rb"^refers-to-page-id: (-?\d+)\r$", block, re.M)
            first = int(m[1]) if m else None
        elif kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            n = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
            intact = kind == "revisit" or len(payload) == n and digest(payload) == sha
        return kind, fields["WARC-Record-ID"], fields.get("WARC-Concurrent-To"), fields.get("WARC-Target-URI"), page, sha, n, intact, payload if payloads and kind == "response" else None, fields.get("WARC-Refers-To"), first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(root)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                out, size = [], 0
                with fs.open_input_stream(f"{top}/{archive}.warc.gz", compression=None) as stream:
                    for fields, block in records(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        out.append(row(fields, block))
                        size += len(out[-1][8] or b"") + 300
                        if size > 4 << 20:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RECORD, strict=True)], schema=_RECORD)
                            out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RECORD, strict=True)], schema=_RECORD)

    return run


def read(spark: SparkSession, root: str, archives: list[str], payloads: bool = False) -> DataFrame:
    """One row per request, response, revisit and metadata record of the archives."""
    if not archives:
        return spark.createDataFrame([], _RECORD_SQL)
    listed = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(len(archives))
    return listed.mapInArrow(_parse(root, payloads), _RECORD_SQL)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: structs ``request``, ``response`` and ``metadata``.

    Request and metadata meet their response or revisit where concurrent_to is its
    record id; a capture that lacks one has null there. Records without a partner of
    kind response or revisit give no row.
    """
    key = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    whole = F.struct(*[c for c in found.columns if c != "concurrent_to"])
    of = lambda *kinds: F.min_by(F.when(F.col("kind").isin(*kinds), whole), F.when(F.col("kind").isin(*kinds), F.col("record_id")))
    rows = found.where(key.isNotNull()).groupBy(key.alias("capture_id")).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))
    return rows.where("response IS NOT NULL")


def round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes, reads and assembles: page_id, payload_bytes, payload_digest, record_type, refers_to and intact.

    All of it is read from the archives: refers_to is the page that a revisit's metadata
    names, and ``refers_to_record`` the record in its WARC-Refers-To. Nulls and repeated
    rows as in :func:`write`; a payload of any length is one record; extra columns are
    ignored.
    """
    spark = pages.sparkSession
    root = root or shared_dir(spark, "warc")
    got = assemble(read(spark, root, write(pages, root)))
    return got.select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"), F.col("metadata.refers_page").alias("refers_to"), F.col("response.refers_to").alias("refers_to_record"),
        F.col("response.record_id").alias("record_id"), F.col("request.target_uri").alias("target_uri"), F.col("response.intact").alias("intact"),
    )
