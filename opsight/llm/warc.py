"""WARC archives: one gzip member for each record, written and read back by tasks.

Writing gives a ``response`` record for each page, or a ``revisit`` record without payload
where an equal payload of at least ``min_bytes`` bytes belongs to a smaller page id. Each
task writes its own files under a temporary name and renames them when they are whole; file
names follow from the partition, so a task that runs again replaces its own files.

Reading goes through a file in order with a fixed amount of memory beside one payload:
chunks are decompressed as they come, the content is framed by its length, and block and
payload digests are verified. A record that fails a check is a row with ``error`` set; after
damage to the gzip stream the rest of that file is one such row.

A record is read whatever the length of its header, so a very long url keeps its page; header
and payload of one record are held at a time. Null html is an empty payload. Null urls have no target header. Pages with a null id are
responses without page id. Rows that repeat an id are written once each; equal ones are all
responses or all revisits. An empty table gives no record. Extra columns are ignored.

The folder must be one that all executors reach under the same name (a shared mount, HDFS
or an object store that pyarrow opens).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.llm.common import arrow_schema, written
from opsight.session import scratch_path

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CHUNK = 1 << 16
FILE_BYTES = 256 << 20
INDEX = "path string, records bigint, bytes bigint"
RECORDS = (
    "path string, offset bigint, record_type string, record_id string, target_uri string, page_id bigint,"
    " payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, error string"
)


def with_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Add ``digest`` and ``refers_to``, the smallest page id with an equal payload.

    Only narrow rows meet by digest, so a payload that a third of the pages share is
    counted in the tasks that read it; pages are joined by their own id.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html")).withColumn(
        "digest", F.sha2(F.col("html").cast("binary"), 256)
    )
    narrow = rows.filter((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull())
    narrow = narrow.select("page_id", "digest")
    shared = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    shared = shared.filter("refers_to < last").drop("last")
    revisits = narrow.join(shared, "digest").filter("page_id > refers_to").distinct()
    # Pages without id can't be revisits: they stay out of the join, in which they would meet.
    known = rows.filter(F.col("page_id").isNotNull()).join(revisits, ["page_id", "digest"], "left")
    unknown = rows.filter(F.col("page_id").isNull()).withColumn("refers_to", F.lit(None).cast("bigint"))
    return known.select(*unknown.columns).unionByName(unknown)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest}')}>"


def record_bytes(page_id, url: str | None, html: str, digest: str, refers_to, date: str) -> bytes:
    """One uncompressed record."""
    payload = html.encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is None:
        block += payload
    else:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    fields += [
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Length", str(len(block))),
    ]
    head = b"\r\n".join([VERSION, *(f"{name}: {value}".encode() for name, value in fields)])
    return head + END + block + END


def gzip_member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write_archives(pages: DataFrame, folder: str, date: str, min_bytes: int = 100) -> DataFrame:
    """Write the archives; the result lists the files (path, records, bytes)."""
    schema = arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        number, attempt = context.partitionId(), context.taskAttemptId()
        store.create_dir(root, recursive=True)
        files: list[tuple[str, int, int]] = []
        out = partial = None
        records = size = 0

        def close():
            nonlocal out
            out.close()
            name = f"part-{number:06d}-{len(files):04d}.warc.gz"
            if store.get_file_info(f"{root}/{name}").type != arrow_fs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")
            store.move(partial, f"{root}/{name}")
            files.append((f"{folder}/{name}", records, size))
            out = None

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))
            for row in zip(*columns, strict=True):
                if out is None:
                    partial = f"{root}/.part-{number:06d}-{attempt}-{len(files)}.tmp"
                    out, records, size = store.open_output_stream(partial, compression=None), 0, 0
                member = gzip_member(record_bytes(*(v.as_py() for v in row), date))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= FILE_BYTES:
                    close()
        if out is not None:
            close()
        if files:
            columns = zip(*files, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return with_revisits(pages, min_bytes).mapInArrow(run, INDEX)


class Member:
    """The decompressed bytes of one gzip member, read on demand."""

    def __init__(self, source, pending: bytes):
        self.source, self.pending = source, pending
        self.inflate = zlib.decompressobj(31)
        self.buffer = b""
        self.used = 0

    def _more(self) -> bool:
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.pending or self.source.read(CHUNK)
            if not self.inflate.unconsumed_tail:
                self.pending = b""
                self.used += len(data)
            got = self.inflate.decompress(data, 4 * CHUNK)
            if not data and not got and not self.inflate.eof:
                raise EOFError("the gzip member is cut off")
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """The bytes up to ``mark``, however many; the mark is passed over."""
        held = bytearray(self.buffer)
        start = 0
        while (at := held.find(mark, start)) < 0:
            start = max(0, len(held) - len(mark))
            self.buffer = b""
            if not self._more():
                self.buffer = bytes(held)
                raise ValueError("the header has no end")
            held += self.buffer
        self.buffer = bytes(held[at + len(mark) :])
        return bytes(held[:at])

    def take(self, count: int) -> Iterator[bytes]:
        """``count`` bytes in pieces."""
        while count:
            if not self.buffer and not self._more():
                raise ValueError("the content is shorter than its length")
            piece, self.buffer = self.buffer[:count], self.buffer[count:]
            count -= len(piece)
            yield piece

    def rest(self) -> tuple[bytes, bytes]:
        """What is left of the member, and the bytes read beyond its end."""
        left = b""
        while True:
            left, self.buffer = left + self.buffer, b""
            if len(left) > CHUNK:
                left = left[:CHUNK]
            if not self._more():
                break
        beyond = self.inflate.unused_data
        self.used -= len(beyond)
        return left, beyond


def _headers(data: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    return first, {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _number(text: str | None) -> int | None:
    return int(text) if text is not None else None


def _record(member: Member, with_payload: bool) -> dict:
    """Read the record of a member; ``error`` tells what does not hold."""
    version, fields = _headers(member.until(END))
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "page_id": _number(fields.get("x-page-id")),
        "refers_to": _number(fields.get("x-refers-to-page-id")),
        "payload_bytes": None,
        "payload_digest": None,
        "payload": None,
        "error": None,
    }
    block, payload = hashlib.sha256(), hashlib.sha256()
    head, parts, size = b"", [], 0
    http = fields.get("content-type", "").startswith("application/http")
    inside = not http
    for piece in member.take(int(fields["content-length"])):
        block.update(piece)
        if not inside:
            head += piece
            at = head.find(END)
            if at < 0:
                continue
            piece, head, inside = head[at + len(END) :], head[:at], True
        payload.update(piece)
        size += len(piece)
        if with_payload:
            parts.append(piece)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if out["record_type"] == "revisit":
        out["payload_bytes"] = _number(_headers(head)[1].get("content-length"))
        out["payload_digest"] = stated
    else:
        out |= {"payload_bytes": size, "payload_digest": payload.hexdigest()}
        out["payload"] = b"".join(parts) if with_payload else None
        if stated and stated != out["payload_digest"]:
            out["error"] = "payload digest"
    if fields.get("warc-block-digest", f"sha256:{block.hexdigest()}") != f"sha256:{block.hexdigest()}":
        out["error"] = "block digest"
    return out


def read_stream(source, with_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order."""
    offset, pending = 0, b""
    while pending or (pending := source.read(CHUNK)):
        member = Member(source, pending)
        empty = dict.fromkeys(x.split()[0] for x in RECORDS.split(", "))
        try:
            try:
                record = _record(member, with_payload)
                error = None
            except (ValueError, KeyError) as problem:
                record, error = {}, f"framing: {problem}"
            left, pending = member.rest()
            if not error and left != END:
                error = "framing: the record does not end where its length says"
        except (zlib.error, EOFError) as problem:
            yield empty | {"offset": offset, "error": f"gzip: {problem}"}
            return
        yield empty | record | {"offset": offset} | ({"error": error} if error else {})
        offset += member.used


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all archives that ``files`` (column ``path``) lists."""
    schema = arrow_schema(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = arrow_fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as source:
                    for record in read_stream(source, with_payload):
                        rows.append(record | {"path": path})
                        held += len(record["payload"] or b"")
                        if len(rows) >= 5000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # A task for each file: the list is short, and adaptive execution would join its parts.
    return files.select("path").repartition(max(files.count(), 1)).mapInArrow(run, RECORDS)


def roundtrip(spark: SparkSession, pages: DataFrame, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 100) -> DataFrame:
    """Write all pages as archives in the shared folder and read their records."""
    folder = scratch_path(spark, "warc")
    return read_archives(written(write_archives(pages, folder, date, min_bytes), "warc-index"))
