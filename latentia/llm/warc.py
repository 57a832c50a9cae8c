"""Operator 8: WARC archives with a salvage reader.

``write_warc`` lets Spark's text writer lay out the archives: a record without its closing blank lines is one row, and the
closing ``\\r\\n\\r\\n`` is the line separator, so every part file is a plain WARC file wherever Spark can write.
``read_warc`` reads archives (plain, or gzip members of one or more records) and, after a failed check, searches for the next version
line or member that is valid, goes on there, and logs the bytes between as a quarantined gap.

Defined cases: null html is an empty payload; pages without id are always responses; of repeated ids with equal payloads
each is a response if the id is the least; null urls get a urn; line breaks in urls are escaped; an empty
table writes no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentia.llm.common import BROADCAST_BYTES, checkpoint_folder, cut, drop_folder

EOL = "\r\n"
END = EOL * 2
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Most records and about the most bytes of an archive file, which is read whole.
RECORDS_A_FILE, BYTES_A_FILE = 1500, 64 << 20
#: Bounds of the payloads' size classes.
CLASSES = (1 << 16, 1 << 20, 1 << 24)
MAGIC = b"\x1f\x8b\x08"
RECORD = b"WARC/1."
MEMBER_STEP = 1 << 16


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1 in built-in functions: 5 hex digits are 4 base-32 digits."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, digest, refers_to (null for responses).

    Only payloads that occur more than once are joined back, so the texts themselves are not shuffled while those
    few fit a broadcast; beyond it the join is an ordinary one.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html.cast("binary")).alias("digest"))
    again = own.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.min("page_id").alias("first")).where("c > 1").select("digest", "first")
    again = cut(again)
    found = F.broadcast(again) if again.count() * 80 <= BROADCAST_BYTES else again
    return own.join(found, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")


def records(pages: DataFrame) -> DataFrame:
    """One column ``value``: a whole record but for its closing blank lines."""
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("html")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), page)), "\r", "%0D"), "\n", "%0A")
    pieces = [
        F.lit("WARC/1.1" + EOL),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(page)),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", url),
        F.when(revisit, F.concat(field("WARC-Refers-To", record_id(F.col("refers_to"))), field("WARC-Profile", F.lit(PROFILE)), field("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block.cast("binary")))),
        field("X-Page-Id", page),
        field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(EOL),
        block,
    ]
    return pages.select(F.concat(*pieces).alias("value"))


def size_class(size: Column) -> Column:
    """How many of CLASSES a payload exceeds."""
    over = [(size > c).cast("int") for c in CLASSES]
    return sum(over[1:], over[0])


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives under path in a folder for each size class of payloads, of so few records each that about BYTES_A_FILE bytes is the most.

    A few long payloads so have files of their own and do not thin out all others'; a class's files hold a sixteenth of that at
    least but for the last of a task.
    """
    marked = with_revisits(pages).withColumn("class", size_class(F.col("payload_bytes")))
    held = pages.agg(F.max(F.octet_length("html")).alias("longest"), F.collect_set(size_class(F.coalesce(F.octet_length("html"), F.lit(0)))).alias("classes")).first()
    for c in sorted(held["classes"]) or [0]:
        bound = CLASSES[c] if c < len(CLASSES) else held["longest"]
        most = max(1, min(RECORDS_A_FILE, BYTES_A_FILE // (bound + 2048)))
        records(marked.where(F.col("class") == c)).write.option("lineSep", END).option("maxRecordsPerFile", most).text(f"{path}/{c}")


class Found(NamedTuple):
    offset: int
    length: int
    header: dict[str, str] | None  # None: a gap
    block: bytes
    reason: str


class Broken(ValueError):
    """A record that fails a check."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and the byte after a record that must begin at ``at``."""
    if not data.startswith(RECORD, at):
        raise Broken("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Broken("header cut off")
    lines = data[at:stop].decode("utf-8", "replace").split(EOL)
    header = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    size = header.get("content-length", "")
    if not size.isdigit():
        raise Broken("no content length")
    block = data[stop + 4 : stop + 4 + int(size)]
    end = stop + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Broken("block not closed")
    kind, _, digest = header.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
        raise Broken("block digest")
    return header, block, end + 4


def inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """What a gzip member that must begin at ``at`` holds, and the byte after it."""
    z, parts, view, read = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not z.eof and read < len(data):
            parts.append(z.decompress(view[read : read + MEMBER_STEP]))
            read = min(read + MEMBER_STEP, len(data))
    except zlib.error as e:
        raise Broken("member damaged") from e
    if not z.eof:
        raise Broken("member cut off")
    return b"".join(parts), read - len(z.unused_data)


def in_member(data: bytes, at: int) -> tuple[list[Found], int]:
    """Records and gaps of a gzip member, which may hold several, each with the member's place; without a record it is broken."""
    plain, end = inflated(data, at)
    found = list(salvage(plain, (RECORD,)))
    if not any(f.header for f in found):
        raise Broken(found[0].reason if found else "empty member")
    return [f._replace(offset=at, length=end - at, reason=f.reason and f"in its member: {f.reason}") for f in found], end


def salvage(data: bytes, marks: tuple[bytes, ...] = (MAGIC, RECORD)) -> Iterator[Found]:
    """Records in order; what lies between valid ones comes as one gap with its first failure.

    Each place is read by the mark that stands there, so damage never decides the format of what follows.
    """
    at, gap, reason = 0, None, ""
    ahead = {mark: -1 for mark in marks}  # next place of each mark, the length where none is left
    while at < len(data):
        try:
            if MAGIC in marks and data.startswith(MAGIC, at):
                found, end = in_member(data, at)
            else:
                header, block, end = parse_record(data, at)
                found = [Found(at, end - at, header, block, "")]
        except Broken as e:
            if gap is None:
                gap, reason = at, str(e)
            for mark, place in ahead.items():
                if place <= at:
                    place = data.find(mark, at + 1)
                    ahead[mark] = len(data) if place < 0 else place
            at = min(ahead.values())
            continue
        if gap is not None:
            yield Found(gap, at - gap, None, b"", reason)
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield Found(gap, len(data) - gap, None, b"", reason)


READ = "path string, offset long, length long, gap string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of archives given as (path, content); ``gap`` holds the reason where bytes are quarantined."""

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdigit() and text != "-" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data, rows = batch.column("path")[i].as_py(), batch.column("content")[i].as_py(), []
                for f in salvage(data or b""):
                    if f.header is None:
                        rows.append((path, f.offset, f.length, f.reason, None, None, None, None, None, None))
                        continue
                    kind, body = f.header.get("warc-type"), f.block.partition(b"\r\n\r\n")[2]
                    if kind == "revisit":
                        digest, size = f.header.get("warc-payload-digest", "").partition(":")[2], number(f.header.get("x-payload-length"))
                    else:
                        digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
                    rows.append((path, f.offset, f.length, None, number(f.header.get("x-page-id")), kind, size, digest, number(f.header.get("x-refers-to-page")), body if payloads else None))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return archives.select("path", "content").mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives into the shared folder, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    What was read is stored, so the archives are read once and then deleted.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    try:
        write_warc(pages, path)
        found = cut(read_warc(spark.read.format("binaryFile").load(f"{path}/*"), payloads=False).drop("payload"))
    finally:
        drop_folder(spark, path)
    wrote, seen = pages.count(), found.agg(F.count_if(F.col("gap").isNull()).alias("n"), F.count("gap").alias("gaps")).first()
    if seen["gaps"] or seen["n"] != wrote:
        raise ValueError(f"{wrote} pages were written, {seen['n']} records and {seen['gaps']} gaps read back")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
