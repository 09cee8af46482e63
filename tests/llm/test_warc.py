import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.common import new_path

SCHEMA = "page_id long, url string, html string, record_type string"


def rows_of(n=60):
    big = "<p>é " * 40
    rows = [(i, f"http://x/{i}", [big, f"page {i}", big + str(i % 7), "z" * 99, "z" * 100][i % 5], "clash") for i in range(n)]
    return rows + [(100, None, None, ""), (101, "u\r\nWARC-Type: evil", "", ""), (102, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9, ""), (103, "u", "x" * 300_000, ""), (7, "u", "r" * 200, ""), (7, "u", "r" * 200, "")]


def by_hand(rows):
    first = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h, _ in rows:
        b, low = (h or "").encode(), first.get(h, i)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if low < i else "response", low if low < i else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.op4_warc(spark, spark.createDataFrame(rows_of(), SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows_of())
    assert warc.op4_warc(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def archived(spark, rows, **sizes):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(2)
    types = warc.record_types(pages).withColumnRenamed("page_id", "t_page_id")
    at = new_path(spark, "test-warc")
    warc.write_raw(pages, types, f"{at}/raw", sizes.get("archive_bytes", warc.ARCHIVE_BYTES))
    return at, *warc.normalise(spark, f"{at}/raw", f"{at}/normal", part_bytes=sizes.get("part_bytes", warc.PART_BYTES))


@pytest.mark.parametrize(("archive_bytes", "part_bytes"), [(3_000, 900), (1 << 25, 1 << 22)])
def test_archives_are_bounded_and_read_by_offset(spark, archive_bytes, part_bytes):
    at, archives, index = archived(spark, rows_of(), archive_bytes=archive_bytes, part_bytes=part_bytes)
    raw = {"-".join(r.path.rsplit("/", 2)[-2:]): bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{at}/raw").collect()}
    assert len(raw) > (4 if archive_bytes < 1 << 20 else 0)
    for name, content in raw.items():
        one = zlib.decompressobj(31)
        records = one.decompress(content)
        assert one.eof and not one.unused_data  # a single stream
        own = index.filter(index.archive == name).collect()
        assert len(records) <= archive_bytes or len(own) == 1
        whole = b"".join(warc.archive_bytes(archives, name))
        assert gzip.decompress(whole) == records
        assert sum(r.length for r in own) == len(whole)
        for r in own:
            assert f"<urn:page:{'' if r.page_id is None else r.page_id}>".encode() in gzip.decompress(whole[r.offset : r.offset + r.length])
    got = warc.read_archives(archives, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows_of())


def test_records_are_valid_warc(spark):
    """Mandatory headers of WARC/1.1, and bodies that are HTTP responses."""
    _, archives, index = archived(spark, rows_of(20))
    heads = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Target-URI", "WARC-Payload-Digest"}
    kinds = set()
    for name in {r.archive for r in index.collect()}:
        whole = gzip.decompress(b"".join(warc.archive_bytes(archives, name)))
        for headers, record in warc.normalise_stream(iter([gzip.compress(whole)])):
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and heads <= set(headers)
            size = int(headers["Content-Length"])
            body = record[-4 - size : -4]
            kinds.add(headers["WARC-Type"])
            if headers["WARC-Type"] == "revisit":
                assert size == 0 and headers["WARC-Profile"].endswith("identical-payload-digest") and "WARC-Refers-To" in headers
            else:
                head, _, payload = body.partition(b"\r\n\r\n")
                assert head.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(payload)}".encode() in head.split(b"\r\n")
                assert headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
    assert kinds == {"response", "revisit"}
    urls = {r.page_id: r.url for r in warc.read_archives(archives, index).select("page_id", "url").collect()}
    assert urls[100] is None and urls[3] == "http://x/3"


@pytest.mark.parametrize("wrong", ["offset + 1", "offset - 1"])
def test_a_wrong_offset_fails(spark, wrong):
    _, archives, index = archived(spark, rows_of(5))
    with pytest.raises(Exception, match="PythonException|zlib|records at offset|bytes after"):
        warc.read_archives(archives, index.filter("offset > 0").withColumn("offset", F.expr(wrong))).collect()
    assert warc.read_archives(archives, index.filter("page_id = 3")).count() == 1
