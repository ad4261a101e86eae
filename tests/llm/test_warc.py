import gzip
import hashlib

import pyarrow.fs
from pyspark.sql import functions as F

from cohortry.llm.warc import parse_record, read_warc, record_bytes, write_warc

BIG = "<p>" + "x" * 2000 + "</p>"


def test_record_round_trip():
    url = "http://a.example/ü?q=1%20\r\nWARC-Type: x"
    data = record_bytes(5, url, "response", None, b"ab\r\n\r\ncd", hashlib.sha1(b"ab\r\n\r\ncd").hexdigest(), "2024-01-01T00:00:00Z")
    back = parse_record(data)
    assert (back["page_id"], back["url"], back["payload"]) == (5, url, b"ab\r\n\r\ncd")


def test_revisits_and_edge_rows(rows):
    pages = rows(
        "page_id long, url string, html string, digest string, archive int",
        (1, "u1", BIG, "x", 0), (2, "u2", BIG, "x", 0), (3, "u3", BIG, "x", 0), (3, "u3", BIG, "x", 0), (None, "u4", BIG, "x", 0),
        (4, None, "short", "x", 0), (5, "u5", "short", "x", 0), (6, "u6", None, "x", 0), (7, "u7", "é" * 500, "x", 0),
        (8, "u8", "é" * 500, "x", 0), (None, "u9", "y" * 1500, "x", 0), (None, "u9", "y" * 1500, "x", 0),
    )
    folder, index = write_warc(pages.repartition(4))
    got = read_warc(folder, index).collect()
    kinds = sorted((str(r.page_id), r.url or "", r.record_type, r.refers_to, r.payload_bytes) for r in got)
    size = len(BIG)
    assert kinds == sorted([
        ("1", "u1", "revisit", 3, size), ("2", "u2", "revisit", 3, size), ("3", "u3", "response", None, size),
        ("3", "u3", "response", None, size), ("None", "u4", "revisit", 3, size), ("4", "", "response", None, 5),
        ("5", "u5", "response", None, 5), ("6", "u6", "response", None, 0), ("7", "u7", "revisit", 8, 1000),
        ("8", "u8", "response", None, 1000), ("None", "u9", "response", None, 1500), ("None", "u9", "response", None, 1500),
    ], key=str)
    for r in got:
        if r.payload is not None:
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes


def test_selected_records_and_standard_files(spark, rows):
    pages = rows("page_id long, url string, html string", *((k, f"u{k}", f"<p>{k}</p>" * 300) for k in range(200)))
    folder, index = write_warc(pages.repartition(3))
    chosen = index.where("page_id % 7 = 0")
    got = {r.page_id: bytes(r.payload).decode() for r in read_warc(folder, chosen).collect()}
    assert got == {k: f"<p>{k}</p>" * 300 for k in range(0, 200, 7)}
    # an archive is a plain sequence of gzip members: it reads from end to end, and offsets follow each other
    name = index.first().archive
    with gzip.open(f"{folder}/archives/{name}") as file:
        assert file.read().count(b"WARC/1.1\r\n") == index.where(index.archive == name).count()
    ends = 0
    for r in index.where(index.archive == name).orderBy("offset").collect():
        assert r.offset == ends
        ends += r.length


def standard_records(data):
    """(headers, block) of every record of an archive, by the standard alone."""
    rest = gzip.decompress(data)
    while rest:
        head, _, rest = rest.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        yield fields, rest[:size]
        rest = rest[size + 4 :]


def test_other_readers_follow_revisits(rows):
    pages = rows("page_id long, url string, html string", *((k, f"http://h/{k}", BIG + str(k % 7)) for k in range(60)), (99, None, "é"))
    folder, index = write_warc(pages.repartition(3))
    system, root = pyarrow.fs.FileSystem.from_uri(f"{folder}/archives")
    names = {r.archive for r in index.collect()}
    found = [x for n in names for x in standard_records(system.open_input_stream(f"{root}/{n}", compression=None).read())]
    held = {}
    for fields, block in found:
        assert fields["Content-Type"] == "application/http; msgtype=response"
        head, _, payload = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK\r\n")
        if fields["WARC-Type"] == "response":
            assert f"Content-Length: {len(payload)}" in head.decode()
            assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
            held[fields["WARC-Record-ID"]] = fields
    revisits = [f for f, _ in found if f["WARC-Type"] == "revisit"]
    assert len(held) == 8 and len(revisits) == 53 and len(found) == 61
    for fields in revisits:
        target = held[fields["WARC-Refers-To"]]
        assert target["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
        assert target["WARC-Target-URI"] == fields["WARC-Refers-To-Target-URI"]
        assert target["WARC-Date"] == fields["WARC-Refers-To-Date"]


def test_many_tasks_read_one_archive(spark, rows):
    pages = rows("page_id long, url string, html string", *((k, f"u{k}", f"<p>{k}</p>" * 300) for k in range(600)))
    folder, index = write_warc(pages.coalesce(1))
    read = read_warc(folder, index)
    used = read.select(F.spark_partition_id().alias("p"), "page_id").groupBy("p").count().collect()
    assert index.select("archive").distinct().count() == 1
    assert len(used) >= spark.sparkContext.defaultParallelism * 3 // 4 and max(r["count"] for r in used) < 600
    assert read.count() == 600


def test_empty_table(spark):
    folder, index = write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and read_warc(folder, index).count() == 0
