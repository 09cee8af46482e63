"""WARC archives: written as monolithic gzip streams, normalised to one gzip member a record with a sidecar offset index.

1. Records are text (the payloads are UTF-8), so Spark's text sink with gzip writes them: each file is one gzip stream.
2. The normaliser inflates each file once, as a stream, and writes every record as a gzip member of its own. Spark has no
   sink for plain bytes in a shared folder, so an archive is a few rows of a table, each a stretch of its bytes with
   whole members: laid end to end they are a valid .warc.gz (``archive_bytes`` gives them). The sidecar index has a row
   for each record (archive, part, offset, length, record id, type, url).
3. Reading takes each record by its index entry: the archive's bytes from offset on, length of them, parsed alone.

A response's body is an HTTP response, a status line and headers before the payload, as WARC/1.1 asks for; pages come without
theirs, so these say HTML in UTF-8 and its length. A revisit has no body; its digest is that of the payload that it revisits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

#: Payloads below this size are never replaced by a revisit.
LEAST_REVISIT = 100
#: Bytes of records in a raw archive at most, unless one record has more; a file always ends with a record.
ARCHIVE_BYTES = 32 << 20
#: Bytes of an archive that one row of the table holds, about.
PART_BYTES = 4 << 20

_ENTRY = "offset: bigint, length: bigint, page_id: bigint, record_type: string, url: string"
_PARTS = f"archive string, part int, begin long, content binary, entries array<struct<{_ENTRY}>>"


def record_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, refers_to): refers_to is null for responses.

    Digests alone are grouped and joined, so a payload that a third of all pages share is a key that partial
    aggregation shrinks and Spark may split in the join. Rows that repeat the smallest page_id are all responses.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    seen = pages.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    first = seen.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = seen.join(first, F.col("payload_digest") == F.col("digest"), "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", F.when(F.col("low") != F.col("page_id"), F.col("low")).alias("refers_to"))


#: The profile of a revisit whose payload is the same.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: When pages were fetched, where nothing says when.
FETCHED = "1970-01-01T00:00:00Z"
#: Stands for a record's target where a page has none.
NO_TARGET = "urn:page:"


def _record(url: Column, date: str) -> Column:
    """A record without its last line end, which the sink adds."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    # a header value is one line
    safe = F.regexp_replace(url, "[\\x00-\\x20\\x7F]", "%20")
    revisit = F.col("refers_to").isNotNull()
    html = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html)
    body, number = F.when(revisit, F.lit("")).otherwise(http), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.when(url.isNull(), F.concat(F.lit(NO_TARGET), number)).otherwise(safe)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(SAME_PAYLOAD)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n"),
    )


def _numbered(archive_bytes: int):
    """Rows (value) with the number of the task's archive that they go to, by the bytes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, held = 0, 0
        for b in batches:
            numbers = []
            for n in pc.binary_length(b.column("value")).to_pylist():
                if held and held + n > archive_bytes:
                    archive, held = archive + 1, 0
                held += n
                numbers.append(archive)
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(numbers, pa.int32())], ["value", "archive"])

    return run


def write_raw(pages: DataFrame, types: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = FETCHED) -> None:
    """Raw archives under ``path``: gzip files, each one whole-file stream of at most ``archive_bytes`` of records (or one record).

    Rows are dealt by page_id and digest, so each page meets its type with one shuffle of the texts.
    """
    records = pages.select("page_id", "url", "html").join(types.distinct(), F.col("page_id").eqNullSafe(F.col("t_page_id")) & (F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256) == F.col("payload_digest")))
    dealt = records.select(_record(F.col("url"), date).alias("value")).mapInArrow(_numbered(archive_bytes), "value string, archive int")
    dealt.write.partitionBy("archive").option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _parse(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:] if line)


def _urn(value: str | None) -> int | None:
    number = value[len("<urn:page:") : -1] if value else ""
    return int(number) if number else None


def _url(headers: dict[str, str]) -> str | None:
    target = headers["WARC-Target-URI"]
    return None if target.startswith(NO_TARGET) else target


def normalise_stream(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, record) for each record of a gzip stream (of any number of members), inflating as it goes."""
    inflate, held = zlib.decompressobj(31), bytearray()
    need = None
    for chunk in chunks:
        while chunk:
            held += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            at = 0
            while True:
                if need is None:
                    end = held.find(b"\r\n\r\n", at)
                    if end < 0:
                        break
                    headers = _parse(bytes(held[at:end]))
                    need = end + 4 - at + int(headers["Content-Length"]) + 4
                if len(held) - at < need:
                    break
                yield headers, bytes(held[at : at + need])
                at, need = at + need, None
            del held[:at]
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def _normalise(level: int, part_bytes: int):
    names = ["archive", "part", "begin", "content", "entries"]
    entry = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string())]))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), entry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                # the folder is the number of the task's archive, the file is the task
                archive, whole = "-".join(path.as_py().rsplit("/", 2)[-2:]), memoryview(content.as_buffer())
                part, begin, offset, members, entries = 0, 0, 0, [], []
                for headers, record in normalise_stream(bytes(whole[i : i + 65536]) for i in range(0, len(whole), 65536)):
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = pack.compress(record) + pack.flush()
                    members.append(member)
                    entries.append({"offset": offset, "length": len(member), "page_id": _urn(headers["WARC-Record-ID"]), "record_type": headers["WARC-Type"], "url": _url(headers)})
                    offset += len(member)
                    if offset - begin >= part_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((archive, part, begin, b"".join(members), entries), kinds, strict=True)], names)
                        part, begin, members, entries = part + 1, offset, [], []
                if members:
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((archive, part, begin, b"".join(members), entries), kinds, strict=True)], names)

    return run


def normalise(spark: SparkSession, raw: str, out: str, *, level: int = 4, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(archives, index) of the raw archives under ``raw``, written under ``out``.

    ``archives`` is (archive, part, begin, content): stretches of an archive's bytes. A task holds one compressed raw
    archive, one part and one record; an empty folder gives empty tables.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(raw).select("path", "content")
    files.mapInArrow(_normalise(level, part_bytes), _PARTS).write.option("compression", "none").parquet(f"{out}/archives")
    parts = spark.read.parquet(f"{out}/archives")
    parts.select("archive", "part", F.inline("entries")).write.parquet(f"{out}/index")
    return parts.drop("entries"), spark.read.parquet(f"{out}/index")


def archive_bytes(archives: DataFrame, name: str) -> Iterator[bytes]:
    """The bytes of one archive, a part at a time: written to a file, they are its .warc.gz."""
    for r in archives.filter(F.col("archive") == name).orderBy("part").select("content").toLocalIterator():
        yield bytes(r.content)


def read_archives(archives: DataFrame, index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every entry of ``index``, taken at its offset and inflated alone.

    A revisit has no payload of its own; its size and digest are those of the full payload. An entry whose offset and
    length are not those of one record fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for begin, content, wanted in zip(*(batch.column(c) for c in ("begin", "content", "wanted")), strict=True):
                begin, content, rows = begin.as_py(), memoryview(content.as_buffer()), []
                for w in wanted.as_py():
                    at = w["offset"] - begin
                    found = list(normalise_stream(iter([bytes(content[at : at + w["length"]])])))
                    if len(found) != 1:
                        raise ValueError(f"{len(found)} records at offset {w['offset']}, length {w['length']}")
                    headers, record = found[0]
                    body = record[len(record) - 4 - int(headers["Content-Length"]) : -4]
                    own = headers["WARC-Type"] == "response"
                    payload = body[body.index(b"\r\n\r\n") + 4 :] if own else b""
                    digest = hashlib.sha256(payload).hexdigest() if own else headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    full = len(payload) if own else int(headers["X-Payload-Length"])
                    rows.append((_urn(headers["WARC-Record-ID"]), full, digest, headers["WARC-Type"], _urn(headers.get("WARC-Refers-To")), _url(headers), payload if own else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    wanted = index.groupBy("archive", "part").agg(F.collect_list(F.struct("offset", "length")).alias("wanted"))
    taken = archives.join(wanted.hint("merge"), ["archive", "part"]).select("begin", "content", "wanted")
    return taken.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op4_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html; other columns are left out) archived, normalised and read back through the index.

    A null html is an empty payload, a null url a record without target; rows are one record each, repeated ones too. A
    null page_id is a record with an empty number. Without pages there is no archive and no row.
    """
    pages = pages.select("page_id", "url", "html")
    types = written(record_types(pages), "warc-types").withColumnRenamed("page_id", "t_page_id")
    at = new_path(spark, "warc")
    write_raw(pages, types, f"{at}/raw")
    archives, index = normalise(spark, f"{at}/raw", f"{at}/normal")
    return read_archives(archives, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS low FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN low < page_id THEN low END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
