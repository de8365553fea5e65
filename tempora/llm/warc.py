"""Web archives: writing records with payload deduplication, and a salvage reader.

Archives are gzip members, one per record, concatenated. The reader checks each member (its checksum), each record (its
version line, headers, length and end) and each payload (its digest); after a failed check it searches for the next
valid member or version line, goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import spool
from tempora.shipping import shipped

#: Bytes of an archive segment; a record isn't divided, so a longer one makes a longer segment.
SEGMENT_BYTES = 512 << 10
#: Bytes of a damaged member that are decoded at a time: so many may be lost before the damage.
STEP_BYTES = 256
#: Payloads of at least so many bytes are deduplicated.
LEAST_PAYLOAD = 0
#: Fixed values of the formats.
GZIP_MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"(?i)^content-length:\s*(\d+)\s*$", re.M)


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1 in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response record, or a revisit record (its block has the response's headers without the payload)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + END


def compress(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _record_at(data: bytes, at: int, proven: bool = False) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record that starts at `at`; None if a check fails. With `proven`, a record without a digest that its payload has fails, too."""
    if not _VERSION_LINE.match(data, at):
        return None
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return None
    lines = data[at:head_end].split(b"\r\n")[1:]
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit() or not length.isascii():
        return None
    start = head_end + 4
    end = start + int(length)
    if data[end : end + 4] != END:
        return None
    block = data[start:end]
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and said.startswith("sha1:"):
        _, found, payload = block.partition(b"\r\n\r\n")
        if not found or payload_digest(payload) != said[5:]:
            return None
    elif proven:
        return None
    return headers, block, end + 4


def _records(plain: bytes, proven: bool = False) -> tuple[list[tuple[dict[str, str], bytes]], list[bytes]]:
    """The records of decoded bytes, and the runs of bytes between that are none: after a failed check the search goes on at the next version line."""
    found, gaps, at, bad = [], [], 0, None
    while at < len(plain):
        record = _record_at(plain, at, proven)
        if record:
            if bad is not None:
                gaps.append(plain[bad:at])
                bad = None
            found.append(record[:2])
            at = record[2]
            continue
        bad = at if bad is None else bad
        line = _VERSION_LINE.search(plain, at + 1)
        at = line.start() if line else len(plain)
    if bad is not None:
        gaps.append(plain[bad:])
    return found, gaps


def _payload_start(data: bytes, at: int) -> int | None:
    """Where the deflated bytes of the gzip member at `at` begin."""
    flags, start = data[at + 3] if at + 10 <= len(data) else 0xFF, at + 10
    if flags & 0xE0:
        return None
    if flags & 4:
        start += 2 + int.from_bytes(data[start : start + 2], "little")
    for bit in (8, 16):  # name, comment
        if flags & bit:
            start = data.find(b"\0", start) + 1
            if not start:
                return None
    return start + (2 if flags & 2 else 0)


def _inflated(data: bytes, at: int) -> tuple[bytes, int | None]:
    """The bytes of the gzip member at `at`, and its end; without an end (it is cut off, or its checksum fails), what could be decoded of it."""
    parts: list[bytes] = []
    member, start = zlib.decompressobj(31), at
    try:
        while start < len(data) and not member.eof:  # in steps: a member copies what it leaves of its last step, not of the segment
            parts.append(member.decompress(memoryview(data)[start : start + STEP_BYTES]))
            start += STEP_BYTES
        if member.eof:
            return b"".join(parts), min(start, len(data)) - len(member.unused_data)
    except zlib.error:
        pass
    start = _payload_start(data, at)
    parts = []
    member = zlib.decompressobj(-15)
    try:
        while start is not None and start < len(data) and not member.eof:
            parts.append(member.decompress(memoryview(data)[start : start + STEP_BYTES]))
            start += STEP_BYTES
    except zlib.error:
        pass
    return b"".join(parts), None


def salvage(data: bytes) -> Iterator[tuple[str, dict[str, str] | None, bytes, int, int]]:
    """("record", headers, block, start, end), ("gap", None, bytes, start, end) and ("inner gap", None, decoded bytes, start, end) in order.

    Records and gaps together cover `data`. A failed check at a position makes the search go on at the next gzip magic or
    version line after it; inside a member whose checksum holds, at the next version line of the decoded bytes, and what
    is skipped there is an inner gap. Of a member that is cut off or damaged the records whose payloads have the digest
    that they tell are recovered, from start to start, and the member's bytes are a gap all the same.
    """
    at, bad, line_at = 0, None, -1
    while at < len(data):
        found: list[tuple[dict[str, str], bytes]] = []
        inner: list[bytes] = []
        recovered: list[tuple[dict[str, str], bytes]] = []
        end = at
        if data.startswith(GZIP_MAGIC, at):
            plain, stop = _inflated(data, at)
            if stop is None:
                recovered, _ = _records(plain, proven=True)
            else:
                found, inner = _records(plain)
                end = stop if found else at
        elif record := _record_at(data, at):
            found, end = [record[:2]], record[2]
        if found:
            if bad is not None:
                yield "gap", None, data[bad:at], bad, at
                bad = None
            for headers, block in found:
                yield "record", headers, block, at, end
            for skipped in inner:
                yield "inner gap", None, skipped, at, end
            at = end
            continue
        for headers, block in recovered:
            yield "record", headers, block, at, at
        bad = at if bad is None else bad
        if line_at <= at and line_at != len(data):
            line = _VERSION_LINE.search(data, at + 1)
            line_at = line.start() if line else len(data)
        member_at = data.find(GZIP_MAGIC, at + 1)
        at = min(line_at, member_at if member_at >= 0 else len(data))
    if bad is not None:
        yield "gap", None, data[bad:], bad, len(data)


def write_archives(pages: DataFrame, least_payload: int = LEAST_PAYLOAD, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """archive, part, bytes: segments of archives that hold a record for every row of `pages` (page_id, url, html).

    A null html is an empty payload, a null url an empty one. Of payloads that are equal and have at least
    `least_payload` bytes, the record with the smallest page_id is the response (rows that repeat this id, too), others
    are revisits. Other columns are ignored; an empty table gives no segment. Only the digests of repeated payloads are
    shuffled to find these; payloads move once, by page_id, so that a payload with very many copies isn't a hot key.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    keys = rows.where(F.octet_length("payload") >= least_payload).select("page_id", F.sha1("payload").alias("digest"))
    repeated = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    revisits = keys.join(repeated, "digest").where("page_id <> refers_to").groupBy("page_id", "digest").agg(F.first("refers_to").alias("refers_to"))
    revisits = spool(revisits, "revisits").withColumnRenamed("page_id", "of_page")
    planned = rows.withColumn("sha", F.sha1("payload")).join(revisits, (F.col("page_id") == F.col("of_page")) & (F.col("sha") == F.col("digest")), "left")

    schema = pa.schema([("archive", pa.string()), ("part", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, part, kept, size = f"part-{TaskContext.get().partitionId():05d}.warc.gz", 0, [], 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                member = compress(build_record(page_id, url, payload, refers_to, refers_to is not None))
                kept.append(member)
                size += len(member)
                if size >= segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([part], pa.int64()), pa.array([b"".join(kept)], pa.binary())], schema=schema)
                    part, kept, size = part + 1, [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([part], pa.int64()), pa.array([b"".join(kept)], pa.binary())], schema=schema)

    return planned.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, part long, bytes binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record or gap in `archives` (archive, part, bytes); also reads binaryFile rows renamed so.

    Columns: archive, part, kind (record, gap or inner gap), start, end, page_id, url, record_type, payload_digest, payload_bytes,
    refers_to, payload (null for revisits; of gaps the quarantined bytes). A
    null segment has no rows.
    """
    schema = pa.schema([
        ("archive", pa.string()), ("part", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
        ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])

    def number(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", name)
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rows = []
                for kind, headers, block, start, end in salvage(data.as_py() or b""):
                    if headers is None:
                        rows.append((archive, part, kind, start, end, *[None] * 6, block))
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = headers.get("warc-type") == "revisit"
                    length = _LENGTH.search(http.replace(b"\r\n", b"\n"))
                    rows.append((
                        archive, part, kind, start, end, number(headers.get("warc-record-id", "")), headers.get("warc-target-uri"), headers.get("warc-type"),
                        headers.get("warc-payload-digest", "").removeprefix("sha1:"), int(length[1]) if length else len(payload), number(headers.get("warc-refers-to", "")), None if revisit else payload,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return archives.select("archive", F.col("part").cast("long"), "bytes").mapInArrow(run, "archive string, part long, kind string, start long, end long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def quarantine(read: DataFrame) -> DataFrame:
    """The log of byte gaps in what `read_archives` gives: archive, part, kind, start, end, bytes (decoded ones of inner gaps)."""
    return read.where("kind <> 'record'").select("archive", "part", "kind", "start", "end", F.col("payload").alias("bytes"))


@shipped
def op7_salvage(spark, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    read = read_archives(spool(write_archives(pages), "archives"))
    return read.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
