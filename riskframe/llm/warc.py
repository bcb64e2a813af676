"""WARC archives: a writer on Spark's text sink and a salvage reader.

Writing.  Payloads of at least ``MIN_REVISIT`` bytes are stored once: the largest page_id of equal
payloads is a ``response``, the others are ``revisit`` records that point at it.  A record is one row of
Spark's text sink, which writes archives in parallel to any folder it can reach: as plain text with the
blank lines between records as line separator, or as one gzip member per record, whose last byte is the
line separator.

Reading.  Archives are read as binary files.  The reader takes record after record and checks version
line, headers, length, end marker and block digest.  After a failed check it searches for the next
version line (or gzip member) that passes all checks, recovers the records behind it, and logs the bytes
in between as a quarantined gap.  Gzip members of any number of records and plain records may follow each
other; of a damaged member the records inflated before the damage are kept.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import ensure_checkpoint_dir

MIN_REVISIT = 1000
# fixed values of the format
VERSION, CRLF = "WARC/1.1", "\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"
CAPTURED = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = ("kind string, archive string, start long, stop long, reason string, page_id long, url string, "
                 "record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, "
                 "inner_start long, inner_stop long")
_FIELDS = [("kind", pa.string()), ("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
           ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
           ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
           ("payload", pa.binary()), ("inner_start", pa.int64()), ("inner_stop", pa.int64())]
_ARROW = pa.schema(_FIELDS)


# ---- writing ----------------------------------------------------------------------------------

def plan_records(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and the page their record refers to (NULL for responses).

    Equal payloads are found by SHA-256.  Only the winners' ids are joined back, so a payload that a
    third of all pages share is a skewed join that Spark splits.  Pages whose id equals the largest of
    their group (repeated rows) are all responses; a NULL id is never the target of a revisit unless the
    whole group has none, then all its rows are responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"),
                             "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    large = F.col("payload_bytes") >= MIN_REVISIT
    rows = rows.withColumn("__key", F.when(large, F.unhex(F.sha2(F.col("payload").cast("binary"), 256))))
    first = rows.where(large).groupBy("__key").agg(F.max("page_id").alias("__first"))
    found = rows.where(large).join(first, "__key").unionByName(
        rows.where(~large).withColumn("__first", F.lit(None).cast("long")))
    same = F.col("__first").isNull() | F.col("page_id").eqNullSafe(F.col("__first"))
    return found.withColumn("refers_to", F.when(~same, F.col("__first"))).drop("__key", "__first")


def _header(name: str, value: Column) -> Column:
    """A header line; nothing when the value is NULL, line breaks in it become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\\r\\n]+", " "), F.lit(CRLF)), F.lit(""))


def record_text(planned: DataFrame) -> DataFrame:
    """One column ``value``: the record of each planned page, without the blank lines behind it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    rows = planned.withColumn("__block", block)
    head = F.concat(
        F.lit(VERSION + CRLF), _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                                           F.lit(">"))),
        _header("WARC-Target-URI", F.col("url")), _header("WARC-Date", F.lit(CAPTURED)),
        _header("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _header("WARC-Refers-To", F.concat(F.lit(f"<{ID_PREFIX}"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("__block").cast("binary")))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length("__block").cast("string")), F.lit(CRLF))
    return rows.select(F.concat(head, "__block").alias("value"))


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, which is always 0."""
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            out = []
            for value in part.column(0):
                member = gzip.compress((value.as_py() + RECORD_END).encode(), 6, mtime=0)
                if member[-1]:  # the size's highest byte, of 16 MB on: an empty member behind it ends in 0
                    member += gzip.compress(b"", mtime=0)
                out.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, compression: str | None = None) -> None:
    """Write ``.warc`` text archives, or with "gzip" archives of one gzip member per record, under ``path``."""
    records = record_text(plan_records(pages))
    if compression == "gzip":
        # the text sink writes a string's bytes as they are
        members = records.mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
        members.write.option("lineSep", "\0").text(path)
    elif compression:
        raise ValueError(f"no archives with compression {compression}")
    else:
        records.write.option("lineSep", RECORD_END).text(path)


# ---- reading ----------------------------------------------------------------------------------

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
FEED = 1 << 16  # bytes a gzip member is inflated by


class _Bad(Exception):
    """A check that a record failed."""


def _page(value: str | None) -> int | None:
    m = re.fullmatch(rf"<{ID_PREFIX}(-?\d+)>", value or "")
    return int(m[1]) if m else None


def _record(data: bytes, at: int) -> tuple[int, dict]:
    """The record at ``at``: where it ends and what it holds."""
    m = _VERSION.match(data, at)
    if not m:
        raise _Bad("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise _Bad("headers do not end")
    fields = {}
    for line in data[m.end():end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("malformed header")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    start = end + 4
    length = fields.get(b"content-length", "")
    if not length.isdigit():
        raise _Bad("no content length")
    stop = start + int(length)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise _Bad("no end marker")
    block = data[start:stop]
    digest = fields.get(b"warc-block-digest")
    if digest is not None and digest != "sha1:" + hashlib.sha1(block).hexdigest():
        raise _Bad("block digest differs")
    return stop + 4, {"fields": fields, "block": block}


def _row(found: dict) -> dict:
    fields, block = found["fields"], found["block"]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get(b"warc-type")
    declared = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    stored = kind == "response"
    digest = hashlib.sha1(payload).hexdigest()
    claimed = fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
    if stored and claimed not in (None, digest):
        raise _Bad("payload digest differs")
    return {"page_id": _page(fields.get(b"warc-record-id")), "url": fields.get(b"warc-target-uri"),
            "record_type": kind, "refers_to": _page(fields.get(b"warc-refers-to")),
            "payload_bytes": len(payload) if stored else int(declared[1]) if declared else None,
            "payload_digest": digest if stored else claimed, "payload": payload if stored else None}


def _member(data: bytes, at: int) -> tuple[int, bytes, str | None]:
    """The gzip member at ``at``: where it (or what can be read of it) ends, its content and what is wrong."""
    inflate, pos, step, parts = zlib.decompressobj(31), at, FEED, []
    while not inflate.eof:
        if pos >= len(data):
            return pos, b"".join(parts), "gzip member is cut off"
        try:
            parts.append(inflate.decompress(data[pos:pos + step]))
        except zlib.error as error:
            if step == 1:
                return pos, b"".join(parts), f"gzip: {error}"
            # an error takes its feed's output along: once more up to here, then byte by byte
            inflate, step = zlib.decompressobj(31), 1
            for i in range(at, pos, FEED):
                inflate.decompress(data[i:i + FEED])
            continue
        pos += min(step, len(data) - pos)
    return pos - len(inflate.unused_data), b"".join(parts), None


def _next(data: bytes, at: int) -> int:
    """Next place from ``at`` on that looks like a version line or a gzip member."""
    m = _VERSION.search(data, at)
    places = [p for p in (m.start() if m else -1, data.find(_GZIP, at)) if p >= 0]
    return min(places, default=len(data))


def salvage(data: bytes, base: int = 0) -> Iterator[dict]:
    """Records and quarantined gaps of an archive, in order.

    ``start`` and ``stop`` are byte positions in the archive.  Records and gaps inside a gzip member carry
    the member's, with ``inner_start`` and ``inner_stop`` for their positions in its content.  A last member cut
    off in its trailer gives its records and a gap from the last byte used to the end.  An empty archive
    gives nothing.
    """
    at, bad_from, reason = 0, None, None
    while at < len(data):
        wrong = None
        try:
            if data.startswith(_GZIP, at):
                stop, content, wrong = _member(data, at)
                rows = [dict(r, inner_start=r["start"], inner_stop=r["stop"], start=base + at, stop=base + stop)
                        for r in salvage(content)] if content else []
                if (content or wrong) and not any(r["kind"] == "record" for r in rows):
                    raise _Bad(wrong or rows[0]["reason"])
            else:
                stop, found = _record(data, at)
                rows = [{"kind": "record", "start": base + at, "stop": base + stop, "reason": None, **_row(found)}]
        except _Bad as error:
            if bad_from is None:
                bad_from, reason = at, str(error)
            at = _next(data, at + 1)
            continue
        if bad_from is not None:
            yield {"kind": "gap", "start": base + bad_from, "stop": base + at, "reason": reason}
            bad_from = None
        yield from rows
        if wrong:
            bad_from, reason = stop, wrong
            stop = _next(data, at + 1)
        at = stop
    if bad_from is not None:  # at the end of the data if all a cut-off member has could be read
        yield {"kind": "gap", "start": base + bad_from, "stop": base + len(data), "reason": reason}


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows, held = [], 0
            for row in salvage(content.as_py() or b""):
                rows.append({"archive": path.as_py(), **row})
                held += len(row.get("payload") or b"")
                if held > 8_000_000 or len(rows) >= 5_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path`` (``kind`` tells them apart).

    An archive is read whole by one task; the writer makes one per shuffle partition.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read, RECORD_SCHEMA)


def gaps(read: DataFrame) -> DataFrame:
    """The quarantine log: archive, start, stop, reason, and positions inside a gzip member."""
    return read.where("kind = 'gap'").select("archive", "start", "stop", "reason", "inner_start", "inner_stop")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives in the shared folder and read back.

    page_id, payload_bytes, payload_digest, record_type, refers_to.  NULL html is an empty payload, a
    NULL url leaves its header out, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, "gzip")
    return read_archives(spark, path).where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
