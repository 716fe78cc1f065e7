"""Media columns: payloads kept as images in archives, read back by byte range.

Payload bytes become the 8-bit grey samples of a PNG image (deflate keeps them
without loss), and images become stored members of ZIP archives, one archive per
writing task.  The ``tessera_media`` data source plans byte ranges over the
archives of a folder.  A task reads the archive's own directory at the end of
the file, takes the members whose offsets fall into its range and streams them
in batches through Arrow.  A member that can't be read is tried again by its
offset alone, without reading the others a second time.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.llm.shared import open_for_read, open_for_write, scratch, settle

#: Payloads are padded with bytes 255 to a positive multiple of this; it is an image row.
ROW_SAMPLES = 576
#: Bytes of archive that one task reads, and of payload in one Arrow batch.
SPLIT_BYTES, BATCH_BYTES = 8 << 20, 4 << 20
#: Members and bytes after which a task starts another archive; every range of an archive reads its whole directory.
MOST_MEMBERS, MOST_BYTES = 20_000, 128 << 20
#: Times that one member is tried.
ATTEMPTS = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
SCHEMA = "archive string, member string, offset long, media binary, payload binary"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (ROW_SAMPLES - len(raw) % ROW_SAMPLES if len(raw) % ROW_SAMPLES or not raw else 0)


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A grey 8-bit PNG of ROW_SAMPLES columns; its samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_SAMPLES)
    lines = np.zeros((len(rows), ROW_SAMPLES + 1), np.uint8)  # the first byte of a line: no filter
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW_SAMPLES, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; raises where a checksum fails."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, shape = 8, b"", None
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a grey 8-bit image")
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def read_member(source, offset: int) -> tuple[str, bytes]:
    """(name, bytes) of the stored member whose local header is at the offset."""
    source.seek(offset)
    magic, _, flags, method, _, _, crc, size, _, name_size, extra_size = _LOCAL.unpack(source.read(_LOCAL.size))
    name = source.read(name_size).decode()
    source.seek(offset + _LOCAL.size + name_size + extra_size)
    data = source.read(size)
    if magic != b"PK\x03\x04" or method != 0 or flags & 8 or len(data) != size or zlib.crc32(data) != crc:
        raise OSError(f"member at {offset} can't be read")
    return name, data


class ArchiveWriter:
    """Stored members one after another, whole headers first, on a stream that can't seek."""

    def __init__(self, stream):
        self.stream, self.at, self.members, self.directory = stream, 0, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        common = (20, 0, 0, 0, 33, crc, len(data), len(data), len(raw), 0)  # version, flags, stored, time, date
        self.directory.append(_CENTRAL.pack(b"PK\x01\x02", 20, *common, 0, 0, 0, 0, self.at) + raw)
        self.members += 1
        self._put(_LOCAL.pack(b"PK\x03\x04", *common) + raw)
        self._put(data)

    def full(self) -> bool:
        return self.members >= MOST_MEMBERS or self.at >= MOST_BYTES

    def close(self) -> None:
        start, listing = self.at, b"".join(self.directory)
        self._put(listing)
        self._put(_END.pack(b"PK\x05\x06", 0, 0, self.members, self.members, len(listing), start, 0))
        self.stream.close()


class ArchiveRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.names = [x for x in options.get("archives", "").split("\n") if x]

    def partitions(self):
        """Byte ranges over the archives: their names and sizes are all that is looked at."""
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.folder)
        if self.names:
            found = store.get_file_info([f"{folder}/{x}" for x in self.names])
        else:
            found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [
            ArchiveRange(f"{self.folder}/{x.base_name}", at, at + self.split)
            for x in sorted(found, key=lambda x: x.base_name)
            if x.type == fs.FileType.File and x.base_name.endswith(".zip")
            for at in range(0, x.size, self.split)
        ] or [ArchiveRange("", 0, 0)]

    def member(self, source, path: str, offset: int) -> tuple[str, bytes]:
        for attempt in range(self.attempts):
            try:
                return read_member(source, offset)
            except (OSError, struct.error):
                if attempt == self.attempts - 1:
                    raise
                source = open_for_read(path)
        raise AssertionError

    def read(self, part):
        if not part.path:
            return
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("payload", pa.binary())])
        with open_for_read(part.path) as source:
            with zipfile.ZipFile(source) as archive:
                offsets = sorted(x.header_offset for x in archive.infolist() if part.start <= x.header_offset < part.end)
            rows, held = [], 0
            for offset in offsets:
                name, media = self.member(source, part.path, offset)
                payload = from_png(media)
                rows.append((part.path, name, offset, media, payload))
                held += len(payload) + len(media)
                if held >= BATCH_BYTES:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class MediaSource(DataSource):
    """``spark.read.format("tessera_media").load(folder)``: one row per member."""

    @classmethod
    def name(cls):
        return "tessera_media"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)


def write_archives(docs: DataFrame) -> tuple[str, DataFrame]:
    """Store every text's padded UTF-8 bytes; (folder, rows of archive, n_members, n_bytes).

    The member's name holds doc_id and the number of bytes before the padding.
    A null text is the empty one.  Archives that a lost or repeated attempt left
    aren't among the rows.
    """
    folder = scratch(docs.sparkSession, "media")

    def write(batches):
        context = TaskContext.get()
        task, archive, done = f"part-{context.partitionId():06d}-{context.taskAttemptId()}", None, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    name = f"{task}-{len(done)}.zip"
                    archive = ArchiveWriter(open_for_write(f"{folder}/{name}"))
                raw = (text or "").encode("utf-8", "surrogatepass")
                archive.add(f"{'null' if doc_id is None else doc_id}-{len(raw)}-{archive.members}.png", to_png(padded(raw)))
                if archive.full():
                    archive.close()
                    done.append((name, archive.members, archive.at))
                    archive = None
        if archive is not None:
            archive.close()
            done.append((name, archive.members, archive.at))
        if done:
            yield pa.record_batch({"archive": pa.array([x[0] for x in done]), "n_members": pa.array([x[1] for x in done], pa.int64()), "n_bytes": pa.array([x[2] for x in done], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "archive string, n_members long, n_bytes long")
    return folder, settle(rows, "media-manifest")


def feature(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and their shares in eight equal bands."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n / n.sum()
    level = np.arange(256)
    mean = float(p @ level)
    spread = float(max(0.0, p @ (level - mean) ** 2)) ** 0.5
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum()) + 0.0
    bands = n.reshape(8, 32).sum(1) / n.sum()
    return f"{mean:.3f} {spread:.3f} {entropy:.4f} " + ",".join(f"{x:.4f}" for x in bands)


def read_archives(spark: SparkSession, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """The members of a folder's archives, or of those that ``archives`` lists."""
    spark.dataSource.register(MediaSource)
    reader = spark.read.format("tessera_media")
    if archives is not None:
        reader = reader.option("archives", "\n".join(r[0] for r in archives.select("archive").collect()))  # a row per file
    return reader.load(folder)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store, read back and describe every text of ``docs``.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature.  Null and empty texts have a payload of
    padding alone; null doc_ids and repeated rows are kept; an empty table gives
    an empty one; other columns are ignored.
    """
    folder, archives = write_archives(docs)
    stored = read_archives(docs.sparkSession, folder, archives)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def describe(batches):
        for batch in batches:
            rows = []
            for member, media, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_id, size, _ = member.removesuffix(".png").rsplit("-", 2)
                rows.append((None if doc_id == "null" else int(doc_id), int(size), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return stored.select("member", "media", "payload").mapInArrow(
        describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
