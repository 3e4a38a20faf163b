"""Legacy ARC archives converted to WARC.

An ARC file opens with a version block, whose second line names the fields of all record lines that follow: five in version
1, ten in version 2. A record is such a line, which ends with the declared length, and that many bytes. The converter reads
lines by those names and bodies by their lengths alone, and makes for each record what WARC asks for: an identifier (from the
archive's name and the record's offset, so a second run gives the same), a timestamp from the archive date, a type, and
digests of block and payload. Of records with equal payloads (length, SHA-1 and SHA-256) of ``least`` bytes or more, the one
with the largest page id stays a response; others become revisits that keep their HTTP head and refer to it.

Archives are segments of about ``segment`` bytes, each a file of its own that one task reads whole. Writing, indexing,
converting and reading back are Spark jobs over files in the shared folder; payloads move with their archives only, and which
of them repeat is decided on rows of digests. What a task needs to know of its archive comes by a join on the archive's path.

Defined results: a null html is an empty payload, a null url is written as ``http://unknown.invalid/``; white space and control
characters of a url are percent-encoded; rows without a page id are responses unless their payload repeats one with an id, and
never referred to then; rows that repeat the largest page id are all responses; an empty table gives empty archives; extra
columns are ignored. A line that does not fit its version, or a length beyond the file's end, is an error.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path, small_batches

#: The names of a record line's fields in the two versions, and what a revisit of an equal payload is called.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT = 16 << 20
#: Of equal payloads only those of this many bytes or more are stored once.
LEAST = 1000
_SPEED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 1}


# --- legacy archives ------------------------------------------------------------------------------


def arc_line(version: int, values: dict[str, object]) -> bytes:
    return " ".join(str(values.get(name, "-")) for name in ARC_FIELDS[version].split()).encode()


def _safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "http://unknown.invalid/"


def _arc_segments(version: int, segment: int):
    """Pages in, archives out: a row an archive, without its last line end, which the writer adds."""

    def run(batches):
        number, parts, size, name = itertools.count(), [], 0, ""

        def opened() -> list[bytes]:
            nonlocal name
            name = f"part-{TaskContext.get().partitionId():05d}-{next(number):05d}-v{version}.arc"
            block = f"{version} 0 pulselake\n{ARC_FIELDS[version]}\n".encode()
            head = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20240101000000", "Content-type": "text/plain", "Result-code": 200, "Offset": 0, "Filename": name, "Archive-length": len(block)}
            return [arc_line(version, head), block]

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\n".join(parts)])], names=["archive"])

        for batch in small_batches(batches, "html"):
            for page, url, html, when in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not parts:
                    parts = opened()
                    size = sum(map(len, parts)) + 2
                body = (html or "").encode()
                ids = f"X-Page-Id: {page}\r\n" if page is not None else ""
                doc = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ids}Content-Length: {len(body)}\r\n\r\n".encode() + body
                line = {"URL": _safe_url(url), "IP-address": "192.0.2.1", "Archive-date": when, "Content-type": "text/html", "Result-code": 200, "Checksum": hashlib.md5(body).hexdigest(), "Offset": size, "Filename": name, "Archive-length": len(doc)}
                parts += [arc_line(version, line), doc]
                size += sum(map(len, parts[-2:])) + 2
                if size >= segment:
                    yield closed()
                    parts = []
        if parts:
            yield closed()

    return run


def _write(archives: DataFrame, path: str, line_end: str) -> str:
    archives.select(F.col("archive").cast("string")).write.options(lineSep=line_end, **_SPEED).text(path)
    return path


def write_arc(pages: DataFrame, version: int, segment: int = SEGMENT) -> str:
    """Folder of new archives of ``pages (page_id, url, html, when)``, ``when`` as 14 digits."""
    found = pages.select("page_id", "url", "html", "when").mapInArrow(_arc_segments(version, segment), "archive binary")
    return _write(found, new_path(pages.sparkSession), "\n")


class Arc(NamedTuple):
    offset: int
    fields: dict[str, str]
    body: memoryview


def opened(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def read_arc(data: bytes) -> Iterator[Arc]:
    """The records of an archive, its version block first. Fields are taken from the right, so a url may hold spaces."""
    at, names, view = 0, [], memoryview(data)
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        values = data[at : end if end >= 0 else len(data)].decode("utf-8", "surrogateescape").rstrip("\r")
        if not names and not values.startswith("filedesc://"):
            raise ValueError("an archive opens with its version block")
        length = values.rpartition(" ")[2]
        if end < 0 or not length.isdecimal() or end + 1 + int(length) > len(data):
            raise ValueError(f"no record line with a length that the archive holds at byte {at}")
        body = view[end + 1 : end + 1 + int(length)]
        if not names:
            version, line = bytes(body).split(b"\n")[:2]
            names = line.decode().rstrip("\r").split(" ")
            if names != ARC_FIELDS.get(int(version.split(b" ")[0]), "").split(" "):
                raise ValueError(f"unknown version block {version!r}")
        split = values.rsplit(" ", len(names) - 1)
        if len(split) != len(names):
            raise ValueError(f"a record line of {len(split)} fields at byte {at}, {len(names)} are declared")
        yield Arc(at, dict(zip(names, split, strict=True)), body)
        at = end + 1 + int(length)


def http_parts(block: memoryview | bytes) -> tuple[dict[str, str], bytes, memoryview]:
    """Headers by lower-case name, the head as it stands, and the payload."""
    raw = bytes(block[: 1 << 16])
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raw = bytes(block)
        end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("an HTTP response without an end of its head")
    lines = raw[:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, raw[: end + 4], memoryview(block)[end + 4 :]


# --- conversion -----------------------------------------------------------------------------------


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{archive}#{offset}'.encode()).digest()[:16], version=5)}>"


def warc_date(digits: str) -> str:
    """ISO form of an archive date; the shorter dates of early archives lack seconds or more."""
    full = digits.ljust(14, "0") if len(digits) >= 8 else digits
    return dt.datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def _sha1(data) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(headers: dict[str, object], block) -> bytes:
    """A record up to its block; the two line ends after it are the writer's."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"".join([f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogateescape"), block])


def converted(record: Arc, archive: str, refers: dict | None) -> bytes:
    """The WARC record of an ARC record; ``refers`` (id, uri, date) makes it a revisit."""
    url, headers = record.fields["URL"], {"WARC-Record-ID": record_id(archive, record.offset), "WARC-Date": warc_date(record.fields["Archive-date"])}
    if url.startswith("filedesc://"):
        block = f"software: pulselake\r\nformat: WARC File Format 1.1\r\nconverted-from: {archive}\r\n".encode()
        return warc_record({"WARC-Type": "warcinfo", **headers, "WARC-Filename": re.sub(r"\.arc$", ".warc", archive), "Content-Type": "application/warc-fields"}, block)
    ip = record.fields["IP-address"]
    headers |= {"WARC-Target-URI": url, "WARC-IP-Address": None if ip in ("0.0.0.0", "-") else ip}
    if not re.match("https?:", url):
        return warc_record({"WARC-Type": "resource", **headers, "WARC-Payload-Digest": _sha1(record.body), "Content-Type": record.fields["Content-type"]}, record.body)
    _, head, payload = http_parts(record.body)
    headers |= {"WARC-Payload-Digest": _sha1(payload), "Content-Type": "application/http; msgtype=response"}
    if not refers:
        return warc_record({"WARC-Type": "response", **headers, "WARC-Block-Digest": _sha1(record.body)}, record.body)
    more = {"WARC-Profile": REVISIT, "WARC-Refers-To": refers["record"], "WARC-Refers-To-Target-URI": refers["uri"], "WARC-Refers-To-Date": refers["date"], "WARC-Block-Digest": _sha1(head)}
    return warc_record({"WARC-Type": "revisit", **headers, **more}, head)


def _records(content: bytes) -> tuple[str, list[Arc]]:
    records = list(read_arc(opened(content)))
    return (records[0].fields["URL"].removeprefix("filedesc://") if records else ""), records


def _index(batches):
    """A row a response of each archive: where it stands, whose it is, and what its payload is like."""
    for batch in _few(batches):
        rows = []
        for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            name, records = _records(content)
            for r in records:
                if re.match("https?:", r.fields["URL"]):
                    headers, _, payload = http_parts(r.body)
                    page = headers.get("x-page-id")
                    rows.append((path, r.offset, int(page) if page else None, len(payload), hashlib.sha1(payload).hexdigest() + hashlib.sha256(payload).hexdigest(), record_id(name, r.offset), r.fields["URL"], warc_date(r.fields["Archive-date"])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _INDEX_TYPES, strict=True)], names=[f.split(" ")[0] for f in INDEX.split(", ")])


INDEX = "path string, offset long, page_id long, size long, digests string, record string, uri string, date string"
_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]


def _few(batches):
    """Archives one at a time: each is as large as a batch should be."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _warc_segments(batches):
    for batch in _few(batches):
        for content, revisits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            name, records = _records(content)
            refers = {r["offset"]: r for r in revisits or ()}
            if records:
                archive = b"\r\n\r\n".join(converted(r, name, refers.get(r.offset)) for r in records)
                yield pa.RecordBatch.from_arrays([pa.array([archive])], names=["archive"])


def _files(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(folders).select("path", "content")


def convert(spark: SparkSession, folders: list[str], least: int = LEAST) -> str:
    """Folder of new WARC files, one for each archive in ``folders``."""
    archives = _files(spark, folders)
    index = archives.mapInArrow(_index, INDEX)
    large = index.where(F.col("size") >= least)
    target = F.max_by(F.struct("record", "uri", "date"), F.struct("page_id", "record")).alias("target")
    repeated = large.groupBy("size", "digests").agg(F.count("*").alias("n"), F.max("page_id").alias("last"), target).where("n > 1")
    revisits = large.join(repeated, ["size", "digests"]).where(F.coalesce(F.col("page_id"), F.col("last") - 1) < F.col("last"))
    revisits = revisits.groupBy("path").agg(F.collect_list(F.struct("offset", "target.record", "target.uri", "target.date")).alias("revisits"))
    found = archives.join(revisits, "path", "left").select("content", "revisits").mapInArrow(_warc_segments, "archive binary")
    return _write(found, new_path(spark), "\r\n\r\n")


# --- reading back ---------------------------------------------------------------------------------


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (by lower-case name) and block of each record, by declared lengths alone."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        first, *lines = data[at : max(end, at)].decode("utf-8", "surrogateescape").split("\r\n")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = headers.get("content-length", "")
        if not first.startswith("WARC/") or not length.isdecimal() or end + 4 + int(length) > len(data):
            raise ValueError(f"no record at byte {at}")
        yield headers, view[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length)


READ = "record string, record_type string, page_id long, payload_bytes long, payload_digest string, refers string"
_READ_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _read_back(batches):
    for batch in _few(batches):
        rows = []
        for content in batch.column(1).to_pylist():
            for headers, block in read_warc(opened(content)):
                if headers["warc-type"] not in ("response", "revisit"):
                    continue
                http, _, payload = http_parts(block)
                told = headers["warc-payload-digest"]
                if headers["warc-block-digest"] != _sha1(block) or headers["warc-type"] == "response" and told != _sha1(payload):
                    raise ValueError(f"record {headers['warc-record-id']} does not have its digest")
                page = http.get("x-page-id")
                digest = base64.b32decode(told.removeprefix("sha1:")).hex()
                rows.append((headers["warc-record-id"], headers["warc-type"], int(page) if page else None, int(http["content-length"]), digest, headers.get("warc-refers-to")))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _READ_TYPES, strict=True)], names=[f.split(" ")[0] for f in READ.split(", ")])


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``READ`` for the responses and revisits of WARC files, digests checked; a revisit's size is what its HTTP head declares."""
    return _files(spark, [folder]).mapInArrow(_read_back, READ)


def op13_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.pmod("page_id", F.lit(31_536_000)), F.lit(0))), "yyyyMMddHHmmss")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html", when.alias("when"))
    second = F.coalesce(F.pmod("page_id", F.lit(2)) == 1, F.lit(False))
    folder = convert(spark, [write_arc(pages.where(~second), 1), write_arc(pages.where(second), 2)])
    found = materialize(records(spark, folder))
    targets = found.where("record_type = 'response'").select(F.col("record").alias("refers"), F.col("page_id").alias("refers_to"))
    revisits = found.where("record_type = 'revisit'").join(targets, "refers", "left")
    return found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN coalesce(page_id, last - 1) < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN coalesce(page_id, last - 1) < last THEN last END AS refers_to
FROM m
"""
