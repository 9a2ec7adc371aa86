"""Web archives: write captures as WARC 1.1 files, read the records back, and assemble transactions.

A capture is a response (or a revisit of an earlier response with the same payload), the request, and a metadata record;
request and metadata name the response by WARC-Concurrent-To. Each record is a gzip member of its own.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import narrow, saved

# Header values set by the WARC 1.1 standard. Fixed values.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"

LEAST_REVISIT = 100
FILE_BYTES = 32 << 20
CAPTURED = "2024-01-01T00:00:00Z"

MANIFEST = "file string, records long, bytes long"
RECORD_FIELDS = {
    "type": pa.string(), "record_id": pa.string(), "concurrent_to": pa.string(), "refers_to_id": pa.string(),
    "target_uri": pa.string(), "date": pa.string(), "http_head": pa.string(), "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "page_id": pa.int64(), "payload": pa.binary(),
}
RECORDS = (
    "type string, record_id string, concurrent_to string, refers_to_id string, target_uri string, date string, "
    "http_head string, payload_bytes long, payload_digest string, page_id long, payload binary"
)


def record_id(page_id: int | None, digest: str, role: str = "") -> str:
    """The same for the same page, payload and role, so that a revisit can name its response without a lookup."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}|{digest}|{role}'.encode()).digest()[:16])}>"


def _line(value: str) -> str:
    """A header value: control characters would end the header, so they are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(headers: dict[str, str | None], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    data = f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    zipper = zlib.compressobj(level, zlib.DEFLATED, 31)
    return zipper.compress(data) + zipper.flush()


def capture_records(
    page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None, date: str, level: int
) -> Iterator[bytes]:
    """The three records of a page; ``response_id``: the page that has the payload already, if another."""
    own, uri = record_id(page_id, digest), None if url is None else _line(url)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = {"WARC-Date": date, "WARC-Target-URI": uri}
    main = {"WARC-Record-ID": own, **common, "WARC-Payload-Digest": f"sha256:{digest}",
            "Content-Type": "application/http;msgtype=response"}
    if response_id is None:
        yield make_record({"WARC-Type": "response", **main}, head + payload, level)
    else:
        yield make_record(
            {"WARC-Type": "revisit", **main, "WARC-Profile": REVISIT_PROFILE,
             "WARC-Refers-To": record_id(response_id, digest)}, head, level,
        )
    target = (uri or "about:blank").split("#")[0]
    yield make_record(
        {"WARC-Type": "request", "WARC-Record-ID": record_id(page_id, digest, "request"), **common,
         "WARC-Concurrent-To": own, "Content-Type": "application/http;msgtype=request"},
        f"GET {target} HTTP/1.1\r\nAccept: text/html\r\n\r\n".encode(), level,
    )
    note = "" if page_id is None else f"page-id: {page_id}\r\n"
    yield make_record(
        {"WARC-Type": "metadata", "WARC-Record-ID": record_id(page_id, digest, "metadata"), **common,
         "WARC-Concurrent-To": own, "Content-Type": "application/warc-fields"}, note.encode(), level,
    )


def parse_records(stream, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of an open file; one record in memory at a time."""
    raw = b""
    while True:
        unzip, data = zlib.decompressobj(31), []
        while not unzip.eof:
            raw = raw or stream.read(step)
            if not raw:
                if data:
                    raise ValueError("the archive ends within a record")
                return
            data.append(unzip.decompress(raw))
            raw = unzip.unused_data if unzip.eof else b""
        whole = b"".join(data)
        head, _, rest = whole.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        yield headers, rest[: int(headers["content-length"])]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def with_responses(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds payload, digest and ``response_id``: the smallest page id with that payload, if another and long enough.

    Only (digest, id) pairs are aggregated, with partial sums before the shuffle; a digest's many copies are never
    gathered. Digests that occur once drop out before the join.
    """
    rows = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    keyed = rows.where(F.length("payload") >= least)
    repeated = (
        keyed.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ).select("digest", "first_id")
    return rows.join(repeated, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("response_id")
    )


def write_warc(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least: int = LEAST_REVISIT, date: str = CAPTURED, file_bytes: int = FILE_BYTES, level: int = 3,
) -> DataFrame:
    """Archive every page below ``folder``; returns the manifest of files. Files without a row there do not count.

    Null html is an empty payload, a null url gives no target header, a null id no revisit. Rows of equal id are each kept.
    """

    def write(batches):
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        stream, name, records, size, number = None, "", 0, 0, 0

        def done():
            stream.close()
            return pa.RecordBatch.from_pylist(
                [{"file": name, "records": records, "bytes": size}],
                pa.schema({"file": pa.string(), "records": pa.int64(), "bytes": pa.int64()}),
            )

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "response_id")), strict=True):
                page_id, url, payload, digest, response_id = (x.as_py() for x in row)
                if stream is None:
                    part = TaskContext.get().partitionId()
                    name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.warc.gz"
                    stream, records, size, number = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0, number + 1
                    start = make_record(
                        {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date,
                         "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n", level,
                    )
                    stream.write(start)
                    size += len(start)
                for record in capture_records(page_id, url, payload, digest, response_id, date, level):
                    stream.write(record)
                    size += len(record)
                    records += 1
                if size >= file_bytes:
                    yield done()
                    stream = None
        if stream is not None:
            yield done()

    rows = with_responses(narrow(pages, page_id=id_col, url=url_col, html=html_col), least)
    return saved(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of the manifest's files; a response's payload size and digest are taken from its bytes."""

    def read(batches):
        store, root = _open(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in parse_records(stream):
                        kind = headers["warc-type"]
                        row = {
                            "type": kind, "record_id": headers.get("warc-record-id"),
                            "concurrent_to": headers.get("warc-concurrent-to"), "refers_to_id": headers.get("warc-refers-to"),
                            "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
                        }
                        if kind in ("response", "revisit", "request"):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            row["http_head"] = head.decode("utf-8", "replace")
                        if kind == "response":
                            row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
                            if with_payload:
                                row["payload"] = payload
                                held += len(payload)
                        elif kind == "revisit":
                            row["payload_digest"] = headers["warc-payload-digest"].partition(":")[2]
                        elif kind == "metadata":
                            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                            row["page_id"] = int(fields["page-id"]) if "page-id" in fields else None
                        rows.append(row)
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(RECORD_FIELDS))
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, pa.schema(RECORD_FIELDS))

    files = max(1, manifest.count())
    return manifest.select("file").repartition(files).mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata that were concurrent to it.

    Requests and metadata are reduced to one each per capture before the join. A revisit also gets the page and payload
    size of the response it refers to; both are null if that response is not in the archive.
    """
    side = F.struct("record_id", "target_uri", "date", "http_head", "page_id")
    beside = records.where(F.col("type").isin("request", "metadata")).groupBy("concurrent_to").agg(
        F.max(F.when(F.col("type") == "request", side)).alias("request"),
        F.max(F.when(F.col("type") == "metadata", side)).alias("metadata"),
    )
    captures = (
        records.where(F.col("type").isin("response", "revisit"))
        .join(beside.withColumnRenamed("concurrent_to", "capture"), F.col("record_id") == F.col("capture"), "left")
        .select(
            "record_id", F.col("metadata.page_id").alias("page_id"), "type", "refers_to_id", "target_uri", "date", "http_head",
            "payload_bytes", "payload_digest", "payload",
            F.struct("request.record_id", "request.http_head").alias("request"), F.struct("metadata.record_id").alias("metadata"),
        )
    )
    captures = saved(captures, "captures")
    targets = (
        captures.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to_id"))
        .agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("target_bytes"))
    )
    revisits = captures.where("type = 'revisit'").join(targets, "refers_to_id", "left")
    responses = captures.where("type = 'response'").withColumns(
        {"refers_to": F.lit(None).cast("long"), "target_bytes": F.lit(None).cast("long")}
    )
    return responses.unionByName(revisits).select(
        "page_id",
        F.struct(
            "record_id", "type", "target_uri", "date", "http_head", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"),
            "payload_digest", "payload", "refers_to",
        ).alias("response"),
        "request", "metadata",
    )
