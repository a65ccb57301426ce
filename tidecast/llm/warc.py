"""WARC archives: one gzip member per record, written by Spark's text sink and read back in byte ranges.

Writing. A record becomes a gzip member in a task. The text sink writes the bytes of a column and a separator after
each, with Spark's commit protocol on any file system. A gzip member ends with the size of its data, whose last byte is
zero below 16 MiB: the sink gets the member without that byte and writes a zero byte as the separator. A larger record
is followed by an empty member, which readers of gzip skip.

Reading. Files are cut into byte ranges and each range is a row. A task looks for the three bytes that begin a gzip
member; a candidate counts if it decodes to a WARC record whole, checksum included, and if what follows is the end of
the file or again the start of a member. A record belongs to the range in which it starts, however far it runs on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
LEAST_PAYLOAD = 100
#: Fixed value: profile of a revisit in WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
DATE = "1970-01-01T00:00:00Z"


def plan_records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``(page_id, url, html, digest, refers_to)``; ``refers_to`` is null for responses.

    Of pages with equal payloads of at least ``least`` bytes that with the smallest id is the response; rows that repeat
    it, id included, are responses too, and so is a page without an id unless another one has the payload.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    first = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    again = first.filter("n > 1").select("digest", "first_id")
    later = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(again, "digest", "left").select("page_id", "url", "html", "digest", F.when(later, F.col("first_id")).alias("refers_to"))


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit leaves the payload out but tells its size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {target}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """``data`` as a gzip member that ends with a zero byte; from 16 MiB on with an empty member behind it."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = pack.compress(data) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += pack.flush()
    return out


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")))
        out = [gzip_member(record_bytes(p, u, h.encode(), d, r))[:-1] for p, u, h, d, r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD) -> None:
    """A record for each row of ``pages (page_id, url, html)`` into gzip archives below ``path``.

    A null html is an empty payload, a null id or url is left out of the record; other columns are not archived.
    """
    members = plan_records(pages, least).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse_record(data: bytes) -> dict | None:
    """Fields of a record, or None if ``data`` is not one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        return None
    field = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
    size = field.get("content-length", "")
    if not size.isdigit() or rest[int(size) :] != b"\r\n\r\n":
        return None
    http, _, payload = rest[: int(size)].partition(b"\r\n\r\n")
    http_field = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:]))
    number = lambda x: int(x.strip("<>").rpartition(":")[2]) if x and x.strip("<>").rpartition(":")[2] else None
    revisit = field.get("warc-type") == "revisit"
    told = field.get("warc-payload-digest", "").rpartition(":")[2]
    return {
        "page_id": number(field.get("warc-record-id")), "url": field.get("warc-target-uri"), "record_type": field.get("warc-type"),
        "refers_to": number(field.get("warc-refers-to")),
        "payload_bytes": int(http_field.get("content-length", 0)) if revisit else len(payload),
        "payload_digest": told if revisit else hashlib.sha256(payload).hexdigest(),
        "payload": None if revisit else payload,
    }


class _Window:
    """Bytes of a file from ``start`` on, read as far as they are asked for; what lies behind is let go now and then."""

    def __init__(self, file, start: int, size: int, step: int = 1 << 20):
        self.file, self.start, self.size, self.step, self.data = file, start, size, step, bytearray()

    def upto(self, end: int) -> bytearray:
        """The bytes held, after reading to ``end`` of the file or its last byte."""
        while self.start + len(self.data) < min(end, self.size):
            got = self.file.read_at(self.step, self.start + len(self.data))
            if not got:
                raise OSError("an archive ended before its length")
            self.data += got
        return self.data

    def piece(self, at: int, most: int = 1 << 14) -> bytes:
        """Up to ``most`` bytes from ``at`` of the file; none at its end."""
        held = self.upto(at + 1)
        return bytes(held[at - self.start : at - self.start + most])

    def forget(self, at: int) -> None:
        """Bytes before ``at`` are not needed again."""
        if at - self.start > 2 * self.step:
            del self.data[: at - self.start]
            self.start = at


def _decode(window: _Window, at: int) -> tuple[bytes, int] | None:
    """Data of the gzip member at ``at`` of the file and where it ends; None if there is none."""
    unpack, data, next_at = zlib.decompressobj(31), bytearray(), at
    checked = False
    try:
        while not unpack.eof:
            piece = window.piece(next_at)
            if not piece:
                return None
            data += unpack.decompress(piece)
            next_at += len(piece)
            if not checked and len(data) >= 8:
                if not data.startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    return bytes(data), next_at - len(unpack.unused_data)


def records_of_range(file, size: int, start: int, end: int) -> Iterator[dict]:
    """Records that start in ``[start, end)`` of an open archive of ``size`` bytes."""
    window, at = _Window(file, start, size), start
    while at < end:
        held = window.upto(min(at + window.step, end) + len(MAGIC))
        stop = min(at + window.step, end)
        found = held.find(MAGIC, at - window.start, stop - window.start + len(MAGIC) - 1)
        if found < 0:
            at = stop
            window.forget(at)
            continue
        at = window.start + found
        got = _decode(window, at)
        record = got and parse_record(got[0])
        if record and (got[1] == size or window.piece(got[1], len(MAGIC)) == MAGIC):
            yield record
            at = got[1]
        elif got and not got[0]:
            at = got[1]
        else:
            at += 1
        window.forget(at)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    for batch in batches:
        for path, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start", "end"))):
            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as file:
                rows, held = [], 0
                for r in records_of_range(file, size, start, end):
                    rows.append(r)
                    held += r["payload_bytes"]
                    if held > 1 << 23:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)


def read_archives(spark: SparkSession, path: str, range_bytes: int = 8 << 20) -> DataFrame:
    """Records of all archives below ``path``: ids, type, size and digest of the whole payload, and the payload.

    The digest of a response is computed from the payload that was read. Files are listed by Spark; their bytes are read
    by the tasks through pyarrow's file systems (local, hdfs, s3, gs).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranges = files.filter("length > 0").select(
        "path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start")
    ).withColumn("end", F.least(F.col("start") + range_bytes, F.col("length")))
    n = max(1, ranges.count())
    return ranges.repartition(n, "path", "start").mapInArrow(_scan, RECORD)
