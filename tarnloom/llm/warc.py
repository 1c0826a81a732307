"""WARC archives: a writer with revisit records, and a reader that salvages what is readable.

Writing: one gzip member per record. Spark's own text writer lays the members down, parted
by an empty gzip member, which any reader decompresses to nothing; so archives go to
whatever store Spark writes to, with its commit protocol. A file ends after a bounded
number of records and of bytes (a larger record is a file of its own). Equal payloads are
stored once: SHA-256 digests are compared on a narrow table, and only those that occur
twice are joined back. The SHA-1 that a record states decides nothing.

Reading: files are cut at member boundaries; a record counts if its member is whole and
its version line, lengths and digest are right. After a failed check the reader searches
for the next valid member (or, in plain archives, version line), goes on there, and logs
the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordscan import stretches

#: Records of one archive file, and its bytes but for the last record's: what a reading task holds.
RECORDS_PER_FILE = 2_000
FILE_BYTES = 32 << 20
#: Duplicate digests (60 bytes each) up to which they are broadcast instead of joined by a shuffle.
MOST_BROADCAST = 200_000
MEMBER = b"\x1f\x8b\x08"
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff" + "0300" + "0000000000000000")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, at long"
_GAP_SCHEMA = "at long, length long, reason string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line, percent-encoded where it must be."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC 1.1 record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    urn = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}", *([f"Refers-To-Page-Id: {refers_to}"] if refers_to is not None else [])]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _members(file_bytes: int):
    """Members, and the number of the file that each goes to among those of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = filled = 0
        for batch in (x for whole in batches for x in stretches(whole, 2)):
            out, rolls = [], []
            for page_id, url, html, keep, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = gzip_member(record_bytes(page_id, url, html or b"", keep, revisit))
                if filled and filled + len(member) > file_bytes:
                    roll, filled = roll + 1, 0
                filled += len(member)
                out.append(member)
                rolls.append(roll)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(rolls, pa.int32())], ["member", "roll"])

    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for every row of ``pages`` below ``path``.

    Of equal payloads of at least ``least_bytes`` bytes the row with the smallest id is the
    response, the others revisit it; smaller ones are all responses. A null payload is
    empty. Rows that repeat the smallest id are responses too. A null id sorts last: it is
    the response only where no equal payload has an id. Ids must be numbers that fit a long.
    Payloads may be as long as a row can be. Other columns are ignored.
    """
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("html"))
    page = page.withColumn("digest", F.sha2("html", 256)).withColumn("n_bytes", F.octet_length("html"))
    copies = page.filter(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes").agg(F.count("*").alias("n"), F.min("page_id").alias("keep_id")).filter("n > 1 and keep_id is not null").drop("n")
    n_copies = copies.count()
    joined = page.join(F.broadcast(copies) if n_copies <= MOST_BROADCAST else copies, ["digest", "n_bytes"], "left")
    is_revisit = F.col("keep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    members = joined.select("page_id", "url", "html", F.col("keep_id"), is_revisit.alias("revisit")).mapInArrow(_members(file_bytes), "member binary, roll int")
    as_text = members.select(F.col("member").cast("string").alias("value"), "roll")
    as_text.write.partitionBy("roll").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path)


@dataclass
class Gap:
    at: int
    length: int
    reason: str


def parsed(data: bytes, begin: int = 0) -> tuple[dict, int]:
    """The record at ``begin`` and where it ends; ValueError if any check fails."""
    if not _VERSION.match(data, begin):
        raise ValueError("no version line")
    end_of_head = data.find(b"\r\n\r\n", begin)
    if end_of_head < 0:
        raise ValueError("head is cut off")
    head = {}
    for line in data[begin:end_of_head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode(errors="replace")
    length = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", length):
        raise ValueError("no length")
    block_at = end_of_head + 4
    end = block_at + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block is cut off or its length is wrong")
    block = data[block_at:end]
    stated = head.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != base32_sha1(block):
        raise ValueError("block digest differs")
    http_head, split, payload = block.partition(b"\r\n\r\n")
    n_payload = re.search(rb"(?im)^content-length: *([0-9]+)", http_head)
    if not split or not n_payload:
        raise ValueError("no HTTP head")
    kind = head.get("warc-type")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (digest != base32_sha1(payload) or int(n_payload[1]) != len(payload)):
        raise ValueError("payload digest differs")
    whole = lambda k: int(head[k]) if re.fullmatch("-?[0-9]+", head.get(k, "")) else None
    record = {"page_id": whole("page-id"), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": whole("refers-to-page-id"), "payload_bytes": int(n_payload[1]), "payload_digest": digest, "payload": payload if kind == "response" else None, "at": begin}
    return record, end + 4


def salvage(data: bytes) -> Iterator[dict | Gap]:
    """Records and gaps of an archive (gzip members or plain), in order; gaps are in bytes of ``data``."""
    zipped = data[: len(MEMBER)] == MEMBER or not _VERSION.match(data) and MEMBER in data
    at, bad_from, reason = 0, None, ""
    while at < len(data):
        try:
            if zipped:
                content, end = _bounded_member(data, at)
                record = None
                if content:
                    record, used = parsed(content)
                    if used != len(content):
                        raise ValueError("member holds more than a record")
                    record["at"] = at
            else:
                record, end = parsed(data, at)
        except (ValueError, zlib.error) as e:
            if bad_from is None:
                bad_from, reason = at, str(e)
            if zipped:
                nxt = data.find(MEMBER, at + 1)
            else:
                found = _VERSION.search(data, at + 1)
                nxt = found.start() if found else -1
            at = len(data) if nxt < 0 else nxt
            continue
        if bad_from is not None and record is None:
            at = end  # an empty member inside a gap belongs to it
            continue
        if bad_from is not None:
            yield Gap(bad_from, at - bad_from, reason)
            bad_from = None
        if record is not None:
            yield record
        at = end
    if bad_from is not None:
        yield Gap(bad_from, len(data) - bad_from, reason)


def _bounded_member(data: bytes, at: int, piece: int = 1 << 16) -> tuple[bytes, int]:
    """The member at ``at``, fed in pieces so that a file of many members is not copied for each."""
    z, out, view, pos = zlib.decompressobj(31), [], memoryview(data), at
    while not z.eof:
        if pos >= len(data):
            raise ValueError("member is cut off")
        out.append(z.decompress(view[pos : pos + piece]))
        pos += piece
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def _read(what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _ARROW[what]
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size = [], 0
                for x in salvage(data):
                    if isinstance(x, Gap) == (what == "gaps"):
                        held.append({"path": path, **(x.__dict__ if isinstance(x, Gap) else x)})
                        size += len(held[-1].get("payload") or b"")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run


_ARROW = {
    "records": pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("at", pa.int64())]),
    "gaps": pa.schema([("path", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("reason", pa.string())]),
}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every readable record below ``path``: ``path, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, at``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(_read("records"), "path string, " + _RECORD_SCHEMA)


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """The quarantined bytes below ``path``: ``path, at, length, reason``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(_read("gaps"), "path string, " + _GAP_SCHEMA)
