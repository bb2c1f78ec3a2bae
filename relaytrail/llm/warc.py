"""WARC archives: records of pages, revisits resolved by payload digest, records read back.

``write_archives`` writes every page as a response record. ``deduplicate_archives`` shuffles only the
headers of such records: the first of each payload digest stays a response, the others become revisits
that refer to it, and every archive is copied record by record, with fresh headers, by one task that
reads it front to back; payloads never move. ``read_archives`` parses archives, checks every payload
against its digest and joins revisits to the responses they refer to.

An archive is a chain of gzip members, one for each record, so any record can be read by its offset.
Archives get new names; the table of captures says which belong to the result, so what an attempt
leaves that was lost half-way is never read. A payload may be a third of all records: its digest's
original is sent to the tasks (there are at most ``HOT`` such digests), all others are joined.

Defined results: null html is an empty payload and null urls have no target; line breaks and blanks
in urls are percent-encoded in headers. Payloads under ``least`` bytes are responses always. Of equal
payloads the smallest id is the response (a null id comes last); rows repeated with one id
are told apart by their place in the archives, so one is the response and the others revisit it. Ids
are kept as numbers (``long``). Very long pages pass through a task one at a time. No pages give no
archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from relaytrail.llm.common import arrow_batches, durable_folder, durable_table, join_hot, out_batches

#: Payloads below it are stored whole each time.
LEAST = 100
#: A task starts another archive beyond so many compressed bytes.
ARCHIVE_BYTES = 512 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The table has no crawl times; records get this one unless another is given.
DATE = "1970-01-01T00:00:00Z"
_READ = 1 << 16

_CAPTURE = "page_id long, url string, digest string, bytes long, type string, refers string, file string, offset long, length long"
_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("type", pa.string()),
    ("refers", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a folder that Spark names, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def record_id(file: str, offset: int) -> str:
    """The same for every attempt to write the record."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}').urn}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, ident: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, original: dict | None, date: str) -> bytes:
    """One record: WARC headers, then a HTTP response whose body a revisit leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _uri(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page_id),
    ]
    if original:
        fields += [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", original["refers"]), ("WARC-Refers-To-Date", date),
            ("WARC-Refers-To-Target-URI", None if original["url"] is None else _uri(original["url"])),
        ]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + len(payload))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return head.encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {name.strip(" ").lower(): value.strip(" ") for name, _, value in (line.partition(":") for line in lines)}


class ArchiveWriter:
    """Archives of one task, each under a name no other attempt has."""

    def __init__(self, folder: str, prefix: str, limit: int) -> None:
        self.system, self.base = file_system(folder)
        self.prefix, self.limit, self.out, self.file, self.at = prefix, limit, None, "", 0

    def place(self) -> tuple[str, int]:
        """Where the next record goes."""
        if self.out is None or self.at >= self.limit:
            self.close()
            self.system.create_dir(self.base, recursive=True)
            self.file, self.at = f"{self.prefix}-{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.system.open_output_stream(f"{self.base}/{self.file}", compression=None)
        return self.file, self.at

    def add(self, data: bytes, level: int) -> int:
        packer = zlib.compressobj(level, wbits=31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        self.at += len(packed)
        return len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def members(source: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(offset, unpacked record) of each gzip member of an archive, front to back."""
    at, rest = 0, b""
    while True:
        unpacker, parts, used = zlib.decompressobj(wbits=31), [], 0
        while not unpacker.eof:
            data = rest or source.read(_READ)
            if not data:
                if used:
                    raise EOFError("an archive ends inside a record")
                return
            parts.append(unpacker.decompress(data))
            rest = unpacker.unused_data
            used += len(data) - len(rest)
        yield at, b"".join(parts)
        at += used


def archive_folder(rows: DataFrame) -> str:
    """A new folder for archives beside the shared intermediate tables."""
    return f"{durable_folder(rows.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a response record for every row; the captures: one row of headers for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, "crawl", archive_bytes)

        def rows():
            for batch in batches:
                for page_id, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                    digest = hashlib.sha256(payload).hexdigest()
                    file, offset = writer.place()
                    length = writer.add(record("response", record_id(file, offset), page_id, url, digest, len(payload), payload, None, date), 1)
                    yield page_id, url, digest, len(payload), "response", None, file, offset, length

        yield from out_batches(rows(), _SCHEMA)
        writer.close()

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    )
    with arrow_batches(pages.sparkSession, rows=500):
        return durable_table(rows.mapInArrow(run, _CAPTURE), "captures")


def resolved(captures: DataFrame, least: int = LEAST) -> DataFrame:
    """The captures with ``first``: the capture whose payload each repeats, null where it is itself that one."""
    order = F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "file", "offset", "url")
    long = captures.where(F.col("bytes") >= least)
    groups = long.groupBy("digest").agg(F.count(F.lit(1)).alias("weight"), F.min(order).alias("first")).where("weight > 1")
    repeats = join_hot(captures, durable_table(groups, "payloads"), ["digest"], "weight", how="left")
    own = (F.col("first.file") == F.col("file")) & (F.col("first.offset") == F.col("offset"))
    return repeats.select(*captures.columns, F.when((F.col("bytes") >= least) & ~own, F.col("first")).alias("first"))


def deduplicate_archives(
    captures: DataFrame, folder: str, into: str, least: int = LEAST, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Copy archives with each payload once; the captures of the copies."""
    plan = durable_table(resolved(captures, least).select(
        "file", "offset", F.col("first.file").alias("first_file"), F.col("first.offset").alias("first_offset"),
        F.col("first.url").alias("first_url"), "page_id", "url",
    ), "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, (system, base) = ArchiveWriter(into, "unique", archive_bytes), file_system(folder)

        def rows():
            name, records = None, iter(())
            for batch in batches:
                for file, offset, first_file, first_offset, first_url, page_id, url in zip(*(c.to_pylist() for c in batch.columns)):
                    if file != name:
                        name, records = file, members(system.open_input_stream(f"{base}/{file}", compression=None))
                    at, data = next(records)
                    if at != offset:
                        raise ValueError(f"{file} has no record at {offset}")
                    fields, http, payload = parse(data)
                    digest, size = fields["warc-payload-digest"].partition(":")[2], int(http["content-length"])
                    kind = "response" if first_file is None else "revisit"
                    original = None if first_file is None else {"refers": record_id(first_file, first_offset), "url": first_url}
                    new_file, new_offset = writer.place()
                    # a record keeps its id, which others may refer to
                    body = payload if kind == "response" else b""
                    length = writer.add(record(kind, fields["warc-record-id"], page_id, url, digest, size, body, original, date), 6)
                    yield page_id, url, digest, size, kind, original and original["refers"], new_file, new_offset, length

        yield from out_batches(rows(), _SCHEMA)
        writer.close()

    files = max(1, plan.select("file").distinct().count())
    with arrow_batches(captures.sparkSession, rows=2000):
        copied = plan.repartition(files, "file").sortWithinPartitions("file", "offset").mapInArrow(run, _CAPTURE)
        return durable_table(copied, "captures")


def read_archives(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(record_id, page_id, url, bytes, digest, type, refers, payload) of every record of the captures' archives.

    Every payload is checked against its record's digest; a revisit has none of its own. ``payloads=False``
    leaves them in the task.
    """
    schema = pa.schema([
        ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()),
        ("type", pa.string()), ("refers", pa.string()), *([("payload", pa.binary())] if payloads else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)

        def rows():
            for batch in batches:
                for file in batch.column(0).to_pylist():
                    with system.open_input_stream(f"{base}/{file}", compression=None) as source:
                        for offset, data in members(source):
                            fields, http, payload = parse(data)
                            kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{file}, record at {offset}: the payload has another digest")
                            page_id = fields.get("x-page-id")
                            body = [payload if kind == "response" else None] if payloads else []
                            yield (
                                fields["warc-record-id"], None if page_id is None else int(page_id), fields.get("warc-target-uri"),
                                int(http["content-length"]), digest, kind, fields.get("warc-refers-to"), *body,
                            )

        yield from out_batches(rows(), schema, size=500)

    files = captures.select("file").distinct()
    tasks = max(1, files.count())
    spec = "record_id string, page_id long, url string, bytes long, digest string, type string, refers string" + ", payload binary" * payloads
    return files.repartition(tasks, "file").mapInArrow(run, spec)


def linked(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits joined to the responses they name."""
    heads = durable_table(records.drop("payload", "url"), "records")
    revisits = heads.where("type = 'revisit'")
    named = revisits.groupBy(F.col("refers").alias("record_id")).agg(F.count(F.lit(1)).alias("weight"))
    responses = heads.where("type = 'response'").select("record_id", F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), F.col("bytes").alias("of_bytes"))
    # a response is one row: no key of this join is popular
    originals = durable_table(responses.join(named, "record_id").withColumnRenamed("record_id", "refers"), "originals")
    met = join_hot(revisits, originals, ["refers"], "weight", how="left")
    out = met.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("of").alias("refers_to"))
    return heads.where("type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(out)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write, deduplicate and read back; one row for each page."""
    raw = archive_folder(pages)
    captures = write_archives(pages, raw)
    unique = archive_folder(pages)
    return linked(read_archives(deduplicate_archives(captures, raw, unique, least), unique, payloads=False))
