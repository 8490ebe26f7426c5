"""Web archives (WARC 1.1): a writer that stores equal payloads once, and a reader that salvages damaged archives.

An archive is a series of gzip members, one for each record, so that damage to one leaves the others readable. The
reader checks each member (magic, checksum) and record (version line, length, payload digest). After a failed check
it searches for the next valid member or version line, goes on there, and logs the bytes between as a gap; it does so
inside the bytes of a member too, so a damaged record costs no other record of its member.

Archives travel as a table (archive_id, n_records, content): its writer and reader are Spark's own, so any store that
Spark reaches will do, and a lost executor's archives are written again from the rows of their partition.

Defined results: a null html is an empty payload; with payloads of at least ``least_bytes`` bytes, the record with the
largest page_id is the response and the others revisit it; repeated rows (page_id and payload alike) are a record each,
the first of them in the archive order being the response; a null page_id sorts below all others; an empty table makes
no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexiloom.llm.common import bounded_batches, slices, text_or_empty, written

VERSION = b"WARC/1.1\r\n"
_MAGIC = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_PART_BYTES = 8 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(value: str) -> str:
    """A header value has no line ends."""
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record in plain bytes. A revisit has the headers of the answer and no payload, but tells its length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if revisit else payload)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_safe(url or '')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` of plain bytes, and where it ends; ValueError if any check fails."""
    if not (m := _LINE.match(data, at)):
        raise ValueError("version line")
    cut = data.find(b"\r\n\r\n", m.end())
    if cut < 0:
        raise ValueError("header")
    head = {}
    for line in data[m.end() : cut].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line")
        head[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        raise ValueError("length")
    begin, end = cut + 4, cut + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    block = data[begin:end]
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    revisit = head.get("warc-type") == "revisit"
    digest = head.get("warc-payload-digest", "").rpartition(":")[2]
    if not revisit and digest and base32_sha1(payload) != digest:
        raise ValueError("payload digest")
    if not digest:
        digest = base32_sha1(payload)
    return head | {"payload": payload, "digest": digest}, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What can be read of the gzip member at ``at``: its bytes, where it ends (None if damaged), and the failed check."""
    z, parts, fed = zlib.decompressobj(31), [], at
    while not z.eof and fed < len(data):
        chunk, before = data[fed : fed + (1 << 16)], z.copy()
        try:
            parts.append(z.decompress(chunk))
        except zlib.error:
            for i in range(0, len(chunk), 64):  # again in small steps, for what stands before the damage
                try:
                    parts.append(before.decompress(chunk[i : i + 64]))
                except zlib.error:
                    break
            return b"".join(parts), None, "gzip member"
        fed += len(chunk)
    return b"".join(parts), fed - len(z.unused_data) if z.eof else None, "" if z.eof else "member end"


def records_of(plain: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The records of a member's bytes that pass their checks, and the gaps between them; after a failed check it goes on
    at the next version line."""
    records, gaps, at = [], [], 0
    while at < len(plain):
        try:
            rec, at = parse_record(plain, at)
            records.append(rec)
        except ValueError as e:
            line = _LINE.search(plain, at + 1)
            after = line.start() if line else len(plain)
            gaps.append((at, after - at, str(e)))
            at = after
    return records, gaps


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """All records that can be read of an archive, and the quarantined gaps: (offset, bytes, failed check). A gap inside a
    readable member has the member's offset and its own uncompressed bytes; of a damaged member, the records before the
    damage are kept and the member's bytes are a gap."""
    records: list[dict] = []
    gaps: list[tuple[int, int, str]] = []
    at = 0
    while at < len(data):
        why = ""
        if data.startswith(_MAGIC, at):
            plain, end, why = inflate(data, at)
            got, lost = records_of(plain)
            records += got
            if end is not None:
                gaps += [(at, n, f"{reason} (inside a member)") for _, n, reason in lost]
                at = end
                continue
        else:
            try:
                rec, at = parse_record(data, at)
                records.append(rec)
                continue
            except ValueError as e:
                why = str(e)
        after = at + 1
        while True:  # the next place where a member or a record begins that can be read
            magic, line = data.find(_MAGIC, after), _LINE.search(data, after)
            places = [x for x in (magic, line.start() if line else -1) if x >= 0]
            if not places:
                after = len(data)
                break
            after = min(places)
            if _begins(data, after):
                break
            after += 1
        gaps.append((at, after - at, why))
        at = after
    return records, gaps


def _begins(data: bytes, at: int) -> bool:
    if not data.startswith(_MAGIC, at):
        return True
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and ``refers_to``: null for responses.

    Only digests that several rows share are joined back, each repeated over ``salts``, so that a payload of a third of
    all pages does not meet in one task.
    """
    salts = 32
    rows = pages.select("page_id", "url", "html", F.sha2(text_or_empty("html"), 256).alias("_d"), F.octet_length(text_or_empty("html")).alias("_n"))
    narrow = rows.filter(F.col("_n") >= least_bytes).select("page_id", "_d")
    shared = narrow.groupBy("_d").agg(F.max("page_id").alias("_first"), F.count("*").alias("_k")).filter("_k > 1")
    shared = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnsRenamed({"_d": "_sd"})
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    out = rows.join(shared, (F.col("_d") == F.col("_sd")) & (F.col("_s") == F.col("_salt")) & (F.col("_n") >= least_bytes), "left")
    # of rows that repeat the response's page_id, one stays the response; they share a digest and salt, so no row moves again
    again = F.row_number().over(W.partitionBy("_d", "_s", "page_id").orderBy("url")) > 1
    refers = F.when(F.col("_first").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("_first")) | again), F.col("_first"))
    return out.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """archive_id, n_records, content: archives of about 8 MB, in the shared folder."""
    bounded_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, members, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part:06d}-{number:06d}"]), pa.array([len(members)], pa.int64()), pa.array([b"".join(members)], pa.binary())],
                names=["archive_id", "n_records", "content"],
            )

        for b in slices(batches, 256):
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in b.columns]):
                payload = (html or "").encode("utf-8", "surrogatepass")
                members.append(gzip_member(record(page_id, url, payload, refers_to, refers_to is not None)))
                size += len(members[-1])
                if size >= _PART_BYTES:
                    yield close()
                    number, members, size = number + 1, [], 0
        if members:
            yield close()

    rows = with_revisits(pages, least_bytes)
    return written(rows.mapInArrow(write, "archive_id string, n_records long, content binary"), "archives")


RECORD_SCHEMA = "archive_id string, kind string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_offset long, gap_bytes long, gap_reason string"
_RECORDS = pa.schema(
    [("archive_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
     ("gap_offset", pa.int64()), ("gap_bytes", pa.int64()), ("gap_reason", pa.string())]
)


def _urn(value: str | None) -> int | None:
    m = re.search(r"urn:page:(-?\d+)", value or "")
    return int(m[1]) if m else None


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record (kind 'record') and per quarantined gap (kind 'gap') of (archive_id, content) rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):  # one row here is an archive
            for archive_id, content in zip(*[c.to_pylist() for c in b.columns]):
                records, gaps = salvage(content or b"")
                rows = []
                for r in records:
                    p = r["payload"]
                    revisit = r.get("warc-type") == "revisit"
                    n = int(r["x-payload-length"]) if revisit and r.get("x-payload-length", "").isdigit() else len(p)
                    rows.append((archive_id, "record", _urn(r.get("warc-record-id")), r.get("warc-target-uri"), n, r["digest"], r.get("warc-type"), _urn(r.get("warc-refers-to")), p if with_payload and not revisit else None, None, None, None))
                rows += [(archive_id, "gap", None, None, None, None, None, None, None, *g) for g in gaps]
                for i in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 512]), _RECORDS)], schema=_RECORDS)

    bounded_batches(archives.sparkSession)
    return archives.select("archive_id", "content").mapInArrow(read, RECORD_SCHEMA)
