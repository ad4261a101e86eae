"""WARC archives written with an index first, and read back by coalesced byte ranges.

Every task writes its records to an archive of its own, one gzip member per record, and returns the index: archive,
offset, length, url and digest of each record. The index is a table that Spark commits; archives of attempts that were
lost or repeated are in no index and are never read. A reader selects records in the index alone, cuts the sorted
byte ranges of each archive into stretches of equal size, deals these to tasks, joins neighbouring ranges and fetches
each run with one request.

Pages are response records with a status line and headers of HTTP; a revisit holds these headers only, and names the
record that has its payload by ``WARC-Refers-To``, as any reader of WARC expects.

Archives are opened through pyarrow's file systems, so the folder may be local to all (shared disk), HDFS or an
object store.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import in_tasks, stored
from cohortry.session import scratch_path

REVISIT_BYTES = 1000
RECORDS_PER_ARCHIVE = 20_000
GAP_BYTES = 64 * 1024
RANGE_BYTES = 4 * 1024 * 1024
TASK_RANGES = 16  # stretches of a read task, on average
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "archive string, offset long, length long"
)
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary"
)


def header_text(value: str | None) -> str:
    """A header value on one line: control characters and percent signs are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c == "%" or ord(c) == 127 else c for c in value or "")


def plain_text(value: str) -> str:
    """The inverse of :func:`header_text`."""
    first, *rest = value.split("%")
    return first + "".join(chr(int(part[:2], 16)) + part[2:] for part in rest)


def record_id(page_id, url: str | None, digest: str) -> str:
    """Named by what the record holds, so revisits can name it without reading it; equal rows have one id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def record_bytes(
    page_id, url, kind: str, refers_to, payload: bytes, digest: str, date: str, refers_url: str | None = None
) -> bytes:
    """One WARC/1.1 record; a revisit of record (``refers_to``, ``refers_url``) has no payload, its size is in a header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = kind == "revisit"
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {header_text(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}",
            *([f"WARC-Refers-To-Target-URI: {header_text(refers_url)}"] if refers_url is not None else []),
            f"WARC-Refers-To-Date: {date}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The columns of ``RECORD_SCHEMA`` from the bytes of one record; sizes and digests of blocks are taken anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    revisit = fields["WARC-Type"] == "revisit"
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: int(fields[name]) if name in fields else None
    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2]  # behind the headers of HTTP
    digest = declared if revisit else hashlib.sha1(payload).hexdigest()
    if digest != declared:
        raise ValueError(f"payload of page {fields.get('X-Page-Id')} does not match its digest")
    return {
        "page_id": number("X-Page-Id"),
        "url": plain_text(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"),
        "payload_bytes": number("X-Payload-Length") if revisit else len(payload),
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def write_archives(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    """(page_id, url, record_type, refers_to, refers_url, payload, digest) to index rows, one archive after the other."""
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    names = [part.strip().split(" ")[0] for part in INDEX_SCHEMA.split(",")]
    partition = TaskContext.get().partitionId()
    archive, out, offset, count = "", None, 0, 0
    try:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or count == RECORDS_PER_ARCHIVE:
                    if out is not None:
                        out.close()
                    archive, offset, count = f"part-{partition:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{archive}", compression=None)
                payload = r["payload"]
                digest = r["digest"]
                data = record_bytes(
                    r["page_id"], r["url"], r["record_type"], r["refers_to"], payload, digest, date, r["refers_url"]
                )
                member = gzip.compress(data, compresslevel=4, mtime=0)
                out.write(member)
                rows.append(
                    (r["page_id"], r["url"], r["record_type"], r["refers_to"], len(payload), digest, archive, offset, len(member))
                )
                offset += len(member)
                count += 1
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names)
    finally:
        if out is not None:
            out.close()


def read_ranges(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(archive, offset, length), sorted, to records: neighbouring ranges are fetched together.

    A run ends where another archive, a larger gap or ``RANGE_BYTES`` is reached, so memory stays bounded.
    """
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    names = [part.strip().split(" ")[0] for part in RECORD_SCHEMA.split(",")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    opened, source = None, None

    def fetched(run: list[tuple[str, int, int]]) -> pa.RecordBatch:
        nonlocal opened, source
        archive, first, _ = run[0]
        if opened != archive:
            if source is not None:
                source.close()
            opened, source = archive, system.open_input_file(f"{root}/{archive}")
        data = source.read_at(max(o + n for _, o, n in run) - first, first)
        # each index entry is one gzip member
        found = [parse_record(zlib.decompress(data[o - first : o - first + n], wbits=31)) for _, o, n in run]
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in zip(names, types, strict=True)], names)

    run: list[tuple[str, int, int]] = []
    end = 0
    for batch in batches:
        for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if run and (archive != run[0][0] or offset > end + GAP_BYTES or offset + length - run[0][1] > RANGE_BYTES):
                yield fetched(run)
                run = []
            end = max(end, offset + length) if run else offset + length
            run.append((archive, offset, length))
    if run:
        yield fetched(run)
    if source is not None:
        source.close()


def roles(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, refers_url, payload, digest): which records hold their payload.

    Digests are counted first; only those that occur again are joined back, so each payload moves once.
    """
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    source = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    counted = source.select("page_id", "url", "digest").where(F.octet_length("payload") >= REVISIT_BYTES)
    groups = counted.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("held"), F.count(F.lit(1)).alias("n"))
    groups = groups.select("digest", "n", F.col("held.page_id").alias("last"), F.col("held.url").alias("last_url"))
    groups = stored(groups.where((F.col("n") > 1) & F.col("last").isNotNull()).drop("n"), "payloads")
    joined = source.join(groups, "digest", "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select(
        "page_id",
        "url",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("last")).alias("refers_to"),
        F.when(again, F.col("last_url")).alias("refers_url"),
        "payload",
        "digest",
    )


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    date: datetime | None = None,
) -> tuple[str, DataFrame]:
    """Write a record per row and return the folder with the index (``INDEX_SCHEMA``).

    Of the rows with equal payloads of at least 1000 bytes the one with the largest page_id is written as a response,
    the others as revisits of it; repeated rows with that id are all responses, and revisits name the one with the
    largest url. Shorter payloads are always responses.
    A null html is an empty payload, a null url leaves its header out, a null page_id is never referred to: it
    revisits a row with an id, or is a response. Further columns are ignored; an empty table gives an empty index.
    Record dates are ``date``, or the time of the call.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = roles(pages, id_column, url_column, html_column)
    index = in_tasks(records, partial(write_archives, folder=f"{folder}/archives", date=stamp), INDEX_SCHEMA)
    index.write.parquet(f"{folder}/index")
    return folder, pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def read_warc(folder: str, selected: DataFrame) -> DataFrame:
    """The records (``RECORD_SCHEMA``) of the index rows in ``selected``, which may be any part of the index.

    Payloads of revisits are null; the record they refer to holds them. Sizes and digests of responses are taken from
    the bytes read, and a record whose digest does not match raises an error.
    """
    spark = selected.sparkSession
    ranges = selected.select("archive", "offset", "length")
    total = ranges.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / (TASK_RANGES * RANGE_BYTES)))
    stretch = max(1, total // (tasks * TASK_RANGES))
    # an archive has a bounded number of records, so the running total takes small groups
    before = F.sum("length").over(Window.partitionBy("archive").orderBy("offset")) - F.col("length")
    dealt = ranges.withColumn("stretch", F.floor(before / stretch)).repartition(tasks, "archive", "stretch")
    runs = dealt.sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return in_tasks(runs, partial(read_ranges, folder=f"{folder}/archives"), RECORD_SCHEMA)
