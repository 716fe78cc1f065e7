"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own, so a reader can start at any member.
The reader is handed byte ranges.  A task scans for the gzip magic, validates each
candidate by inflating its beginning and checking for a WARC version line and
headers, and owns the records that start inside its range; the last one may run
past the end.  Compressed data that happens to hold the magic is thereby told
from a real member.  A payload may itself hold gzip records, stored as they are.
So after a member the scan goes on at its end, and it starts before the range by
as much as the archive's longest member: whatever lies inside a member of the
range before is passed over with that member.

Payloads equal to an earlier one are stored once: the record with the smallest
page_id is the response, the others are revisit records that name it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import open_for_read, open_for_write, scratch, settle, spread_join, whole_number

#: Bytes of a range that one task of the reader is given, and of one read within it.
SPLIT_BYTES, READ_BYTES = 8 << 20, 1 << 20
#: Tasks that read ranges, at most; each takes its share of them.
MOST_READERS = 100_000
#: Payloads shorter than this are never revisits.
REVISIT_LEAST = 100
MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_DATE = "2000-01-01T00:00:00Z"  # a fixed one keeps archives reproducible
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame, *, least: int = REVISIT_LEAST) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to.

    A null html is an empty payload.  Of rows that share page_id and payload all
    that have the smallest page_id are responses.  A null page_id sorts after
    every other, so it is a response only where its payload has no other page.
    A page_id that isn't a whole number raises.
    """
    rows = pages.select(whole_number(F.col("page_id")).alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.groupBy("payload_digest").agg(F.min(F.when(F.length("payload") >= least, F.col("page_id"))).alias("first_id"), F.count("*").alias("n"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return spread_join(rows, settle(first, "payloads"), "payload_digest", "page_id").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _header(value) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to, level: int = 4) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP header and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    name = "null" if page_id is None else int(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{int(refers_to)}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    raw = ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    return gzip.compress(raw, level, mtime=0)


def write_warc(records: DataFrame) -> DataFrame:
    """Write the rows of ``with_record_types``; one row per archive: path, n_records, n_bytes.

    A task writes under a name of its own attempt, so that a repeated or lost
    attempt leaves nothing that counts.
    """
    folder = scratch(records.sparkSession, "warc")

    def write(frames):
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, n, size, longest = None, 0, 0, 0
        for batch in frames:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
            for row in zip(*columns):
                out = out or open_for_write(path)
                data = record_bytes(*row)
                out.write(data)
                n, size, longest = n + 1, size + len(data), max(longest, len(data))
        if out:
            out.close()
            yield pa.record_batch({"path": pa.array([path]), "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "longest": pa.array([longest], pa.int64())})

    return settle(records.mapInArrow(write, "path string, n_records long, n_bytes long, longest long"), "warc-manifest")


class _Window:
    """A stretch of a file in memory that moves forward; no byte is read twice."""

    def __init__(self, source, at: int, size: int):
        source.seek(at)
        self.source, self.base, self.size, self.data = source, at, size, b""

    def reach(self, end: int) -> None:
        """Have the bytes up to ``end`` (or the file's end)."""
        while self.base + len(self.data) < min(end, self.size):
            more = self.source.read(READ_BYTES)
            if not more:
                self.size = self.base + len(self.data)
            self.data += more

    def drop(self, at: int) -> None:
        """Forget what lies before ``at``; what is in memory is cut once a whole read's worth may go."""
        if at - self.base >= READ_BYTES:
            self.data, self.base = self.data[at - self.base :], at

    def find(self, at: int, end: int) -> int:
        """Offset of the next gzip magic in [at, end), else -1."""
        while at < end:
            self.drop(at)
            self.reach(at + READ_BYTES)
            hit = self.data.find(MAGIC, at - self.base)
            if hit >= 0:
                return self.base + hit if self.base + hit < end else -1
            if self.base + len(self.data) >= self.size:
                return -1
            at = max(at, self.base + len(self.data) - len(MAGIC) + 1)
        return -1

    def starts_record(self, at: int) -> bool:
        """Whether the gzip member at this offset begins with a WARC version line and a header."""
        self.reach(at + 4096)
        try:
            head = zlib.decompressobj(31).decompress(self.data[at - self.base : at - self.base + 4096], 512)
        except zlib.error:
            return False
        return head.startswith(_VERSION) and b"\r\n" in head and b":" in head.split(b"\r\n", 2)[1]

    def inflate(self, at: int) -> tuple[bytes | None, int]:
        """(content, end) of the member at the offset; no content where it is cut short or fails its checksum."""
        engine, out, step = zlib.decompressobj(31), io.BytesIO(), 64 << 10
        while not engine.eof:
            self.reach(at + step)
            data = self.data[at - self.base : at - self.base + step]
            if not data:
                return None, at
            try:
                out.write(engine.decompress(data))
            except zlib.error:
                return None, at
            at += len(data) - len(engine.unused_data)
        return out.getvalue(), at


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return {"fields": fields, "http": http, "payload": payload, "declared": int(declared[1]) if declared else len(payload)}


def records_in(source, start: int, end: int, size: int, longest: int | None = None):
    """(offset, record) of each record that starts in [start, end).

    ``longest``: bytes of the archive's longest member, as far as is known; else
    the scan starts with the archive.  Records follow each other without gaps, so
    the archive's start and the end of a record must start one; where it doesn't,
    or where a record in the range can't be inflated, this raises.  Before the
    range a candidate may be the rest of something else, and is passed over.
    """
    window = _Window(source, max(0, start - longest) if longest is not None else 0, size)
    at = window.base
    if start == 0 and size and not window.starts_record(0):
        raise ValueError("the archive doesn't start with a record")
    while (at := window.find(at, end)) >= 0:
        if window.starts_record(at):
            raw, after = window.inflate(at)
            if raw is not None:
                if at >= start:
                    yield at, parse_record(raw)
                    if after < min(end, size) and not window.starts_record(after):
                        raise ValueError(f"no record starts at {after}, where one ends")
                at = after
                continue
            if at >= start:
                raise ValueError(f"the record at {at} is cut short or damaged")
        at += 1


def read_warc(archives: DataFrame, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives (path, n_bytes, longest): path, offset, record_id,
    url, record_type, refers_to, payload_digest, payload_length, payload.

    ``longest`` (bytes of an archive's longest member) may be null or missing;
    then an archive is one range.  Ranges are at least four times as long as it,
    so that what two of them read overlaps by a quarter at most.

    The payload of a revisit is null; its length and digest are those of the full
    payload.  Files without records give none.
    """
    longest = F.col("longest") if "longest" in archives.columns else F.lit(None).cast("long")
    known = archives.select("path", "n_bytes", longest.alias("longest"))
    step = F.when(F.col("longest").isNull(), F.greatest("n_bytes", F.lit(1))).otherwise(F.greatest(F.lit(split_bytes), 4 * F.col("longest"))).cast("long")
    ranges = known.withColumn("step", step).select("path", "n_bytes", "longest", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.col("step"))).alias("start"))
    n = ranges.count()
    schema = "path string, offset long, record_id string, url string, record_type string, refers_to string, payload_digest string, payload_length long, payload binary"

    def name(value):
        return value[1:-1] if value and value.startswith("<") else value

    def read(frames):
        for pdf in frames:
            for path, size, longest, step, start in zip(*(pdf[c].tolist() for c in ("path", "n_bytes", "longest", "step", "start"))):
                with open_for_read(path) as source:
                    rows, held = [], 0
                    for at, record in records_in(source, start, min(start + step, size), size, None if longest != longest else int(longest)):
                        f, revisit = record["fields"], record["fields"].get("warc-type") == "revisit"
                        payload = None if revisit else record["payload"]
                        digest = (f.get("warc-payload-digest") or "").rpartition(":")[2]
                        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path} at {at}: the payload isn't what its digest says")
                        rows.append((path, at, name(f.get("warc-record-id")), f.get("warc-target-uri"), f.get("warc-type"), name(f.get("warc-refers-to")), digest, record["declared"] if revisit else len(payload), payload))
                        held += len(payload or b"")
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=_COLUMNS)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=_COLUMNS)

    return ranges.repartition(max(1, min(n, MOST_READERS)), "path", "start").mapInPandas(read, schema)


_COLUMNS = ["path", "offset", "record_id", "url", "record_type", "refers_to", "payload_digest", "payload_length", "payload"]


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write all pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    An empty table gives an empty one; repeated rows are repeated records; extra
    columns of ``pages`` are ignored.
    """
    records = read_warc(write_warc(with_record_types(pages)))

    def number(column: str):
        return F.expr(f"try_cast(regexp_extract({column}, '^urn:page:(-?[0-9]+)$', 1) AS BIGINT)")

    return records.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
