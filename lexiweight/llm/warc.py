"""Web archives (WARC): writing pages with an index, and reading records back by byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiweight.llm.shared import new_folder, saved, ship

# An archive is closed once it has so many bytes; ranges of records to read are joined up to so
# many bytes, across gaps of up to so many.
ARCHIVE_BYTES, RANGE_BYTES, GAP_BYTES = 256 << 20, 4 << 20, 64 << 10

INDEX = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string,"
    " refers_to bigint, archive string, offset bigint, length bigint"
)


def _file_system(uri: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _line(text: str | None) -> str:
    """A header value: on one line, whatever a URL holds."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in (text or "").strip())


def record(page_id, url, payload: bytes, name: str, refers_to) -> bytes:
    """One gzip member with a response, or with a revisit, which has no payload."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {_line(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{name}",
        "Content-Type: text/html; charset=utf-8",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head.insert(2, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_name(refers_to)}")
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """Headers and payload of a record; the digest and size of a response are taken from its payload."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    payload = rest[: int(headers["Content-Length"])]
    page = lambda name: None if name in (None, "<urn:page:none>") else int(name[10:-1])
    kind = headers["WARC-Type"]
    own = kind == "response"
    found = digest(payload) if own else headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if f"sha1:{found}" != headers["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": page(headers["WARC-Record-ID"]),
        "url": headers["WARC-Target-URI"],
        "payload_bytes": len(payload) if own else int(headers["X-Payload-Length"]),
        "payload_digest": found,
        "record_type": kind,
        "refers_to": page(headers.get("WARC-Refers-To")),
        "payload": payload if own else None,
    }


def _with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [digest((h or "").encode()) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "name"])


def _write(folder: str, limit: int):
    """Append records to archives of this task and yield where each of them is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        archive = stream = None
        offset = 0
        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                if stream is None or offset >= limit:
                    if stream is not None:
                        stream.close()
                    system.create_dir(path, recursive=True)
                    archive, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = system.open_output_stream(f"{path}/{archive}", compression=None)
                payload = (page["html"] or "").encode()
                member = record(page["page_id"], page["url"], payload, page["name"], page["refers_to"])
                stream.write(member)
                rows.append(
                    {
                        "page_id": page["page_id"],
                        "url": page["url"],
                        "payload_bytes": len(payload),
                        "payload_digest": page["name"],
                        "record_type": "response" if page["refers_to"] is None else "revisit",
                        "refers_to": page["refers_to"],
                        "archive": f"{folder}/{archive}",
                        "offset": offset,
                        "length": len(member),
                    }
                )
                offset += len(member)
            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)
        if stream is not None:
            stream.close()

    return run


_INDEX_ARROW = pa.schema(
    [
        (c.split()[0], {"bigint": pa.int64(), "string": pa.string()}[c.split()[1]])
        for c in INDEX.split(", ")
    ]
)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages (page_id, url, html)`` below ``folder``; the index.

    The index is a saved table ``(page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, archive, offset, length)``. The payload is ``html`` in UTF-8, empty if null. Among
    records with equal payloads of ``min_revisit_bytes`` bytes or more the one with the smallest
    ``page_id`` is a response and all others revisit it; shorter payloads are responses.

    Rows with the smallest ``page_id`` that repeat it with the same payload are all responses.
    Pages without ``page_id`` are responses, and none revisits them. Line breaks and control
    characters in a URL are escaped in the record. ``folder`` must be one that all workers share.

    Each task writes archives of its own, with new names, and only the archives of tasks that
    ended well are in the index, so a lost executor leaves at most a file that nothing names.
    """
    ship(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    named = rows.mapInArrow(_with_digests, "page_id bigint, url string, html string, name string")
    # Only payloads that occur under several ids have anything to refer to. The large side of the
    # join is what Spark can split, should one payload fill much of the web.
    counted = named.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit_bytes)
    first = counted.groupBy("name").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    first = saved(first.filter("first < last").select("name", "first"), "responses")
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit_bytes
    joined = named.join(first, "name", "left")
    refers = F.when(long & (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to")
    archived = joined.select("page_id", "url", "html", "name", refers)
    return saved(archived.mapInArrow(_write(folder, archive_bytes), INDEX), "index")


def ranges(index: DataFrame, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """``(archive, start, end, records)``: the selected records of an index, sorted by place and
    joined to byte ranges; ``records`` lists (offset, length)."""
    order = Window.partitionBy("archive").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    cut = before.isNull() | (F.col("offset") - before > gap_bytes)
    cut |= F.floor(F.col("offset") / range_bytes) != F.floor(F.lag("offset").over(order) / range_bytes)
    marked = index.select("archive", "offset", "length", cut.cast("int").alias("cut"))
    numbered = marked.withColumn("number", F.sum("cut").over(order))
    return numbered.groupBy("archive", "number").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("end"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
    )


_RECORD_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)``: the records
    that the rows of an index name, read from the archives.

    Neighbouring records are read together (see ``ranges``). The digest and size of a response are
    computed from its payload and must agree with its header; those of a revisit come from its
    header, and its ``payload`` is null. With ``payloads=False`` all payloads are null.
    """
    ship(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, object] = {}
        for batch in batches:
            for part in batch.to_pylist():
                file = files.get(part["archive"])
                if file is None:
                    for old in files.values():
                        old.close()
                    system, path = _file_system(part["archive"])
                    files = {part["archive"]: (file := system.open_input_file(path))}
                data = file.read_at(part["end"] - part["start"], part["start"])
                found = []
                for r in part["records"]:
                    at = r["offset"] - part["start"]
                    row = parse(data[at : at + r["length"]])
                    found.append(row if payloads else row | {"payload": None})
                yield pa.RecordBatch.from_pylist(found, schema=_RECORD_ARROW)
        for old in files.values():
            old.close()

    schema = (
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string,"
        " refers_to bigint, payload binary"
    )
    return ranges(index).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages to new archives in the shared folder and read every record back."""
    folder = new_folder(pages.sparkSession, "archives")
    return read_records(write_archives(pages, folder, min_revisit_bytes), payloads=False)
