"""Media columns: archives of members in a shared folder, read back by a custom Spark data source.

Stored form: each payload is one 8-bit grey PNG of 64 samples a line. Members lie uncompressed in ZIP archives;
an archive's central directory gives each member's offset, so a range of bytes names the members that start in it.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WIDTH = 64
#: A new archive begins at this size, so that a central directory stays small whatever the table's size.
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 4
SCHEMA = "doc_id long, n_bytes long, archive string, member_offset long, media binary"

_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(WIDTH * max(1, -(-len(data) // WIDTH)) - len(data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG, 64 samples wide, whose samples are the payload; equal payloads give equal bytes."""
    rows = len(payload) // WIDTH
    raw = bytearray(rows * (WIDTH + 1))
    for k in range(WIDTH):
        raw[k + 1 :: WIDTH + 1] = payload[k::WIDTH]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(raw), 4)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a PNG that ``encode_png`` made; any other form, or a bad checksum, is an error."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, body, size = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("bad PNG checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    width, rows = size[:2]
    raw = zlib.decompress(b"".join(body))
    if any(raw[:: width + 1]):
        raise ValueError("filtered PNG lines are not read here")
    out = bytearray(rows * width)
    for k in range(width):
        out[k::width] = raw[k + 1 :: width + 1]
    return width, rows, bytes(out)


class ArchiveWriter:
    """Stored (uncompressed) ZIP members written one after another, then the central directory."""

    def __init__(self, out) -> None:
        self.out, self.at, self.entries = out, 0, []

    def add(self, name: str, comment: bytes, data: bytes) -> None:
        key, crc = name.encode(), zlib.crc32(data)
        self.entries.append((key, comment, crc, len(data), self.at))
        head = _LOCAL + struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, crc, len(data), len(data), len(key), 0) + key
        self.out.write(head)
        self.out.write(data)
        self.at += len(head) + len(data)

    def close(self) -> None:
        begin = self.at
        for key, comment, crc, size, offset in self.entries:
            entry = _CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 20, 20, 0, 0, 0, 33, crc, size, size, len(key), 0, len(comment), 0, 0, 0, offset) + key + comment
            self.out.write(entry)
            self.at += len(entry)
        count = min(len(self.entries), 0xFFFF)
        self.out.write(_END + struct.pack("<HHHHIIH", 0, 0, count, count, self.at - begin, begin, 0))
        self.out.close()


def _split(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(docs: DataFrame, folder: str) -> None:
    """Store each row's text (null: empty) as a member ``<doc_id>.png`` of an archive below ``folder``.

    Every task writes archives of its own under fresh temporary names and renames each when it is whole, so a lost
    executor leaves only files that the reader ignores; a repeated task (same partition, same rows) overwrites
    its archives with equal bytes. A member's comment carries the unpadded length. Rows with a null doc_id are kept
    under an empty name; repeated rows are members of the same name at other offsets; only doc_id and text are stored.
    Texts of any length are whole members. An empty table writes no archive. Memory: one payload at a time beside the
    Arrow batch.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store_fs, root = _split(folder)
        store_fs.create_dir(root, recursive=True)
        part, number, writer, temp, members = TaskContext.get().partitionId(), 0, None, "", 0

        def finish() -> None:
            writer.close()
            store_fs.move(temp, f"{root}/part-{part:06d}-{number:04d}.zip")

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if writer is None:
                    temp = f"{root}/_{uuid.uuid4().hex}.tmp"
                    writer = ArchiveWriter(store_fs.open_output_stream(temp))
                key, data = doc_id.as_py(), (text.as_py() or "").encode("utf-8")
                writer.add("" if key is None else f"{key}.png", str(len(data)).encode(), encode_png(padded(data)))
                members += 1
                if writer.at >= ARCHIVE_BYTES:
                    finish()
                    writer, number = None, number + 1
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"members": pa.array([members], pa.int64())})

    # The count is the action that writes; each task reports one number.
    docs.select("doc_id", "text").mapInArrow(store, "members long").agg({"members": "sum"}).collect()


class ByteRange(InputPartition):
    """Some (archive, first byte, end) ranges for one task; members that start inside belong to it."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        """Plan from the listing alone (names and sizes): large archives are cut, small ones share a task."""
        store_fs, root = _split(self.folder)
        found = store_fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        planned, open_ranges, size = [], [], 0
        for info in sorted((x for x in found if x.path.endswith(".zip")), key=lambda x: x.path):
            for begin in range(0, info.size, self.range_bytes):
                end = min(info.size, begin + self.range_bytes)
                if size and size + end - begin > self.range_bytes:
                    planned.append(ByteRange(open_ranges))
                    open_ranges, size = [], 0
                open_ranges.append((info.path, begin, end))
                size += end - begin
        return planned + [ByteRange(open_ranges)] if open_ranges or not planned else planned

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        store_fs, _ = _split(self.folder)
        rows, size = [], 0
        for path, begin, end in partition.ranges:
            inside = [x for x in directory(store_fs, path) if begin <= x[4] < end]
            block = _block(store_fs, path, inside)
            for name, comment, crc, length, offset in inside:
                first = offset - inside[0][4] + 30 + len(name.encode())
                media = block[first : first + length]
                if len(media) != length or zlib.crc32(media) != crc:
                    media = member(store_fs, path, name, crc, length, offset)
                rows.append((int(name[:-4]) if name else None, int(comment), path.rpartition("/")[2], offset, media))
                size += length
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


class ArchiveSource(DataSource):
    """``spark.read.format("media_archives").load(folder)``: one row per member."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ("doc_id", "n_bytes", "archive", "member_offset", "media")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _retried(what):
    for k in range(ATTEMPTS):
        try:
            return what()
        except (OSError, ValueError):
            if k == ATTEMPTS - 1:
                raise
            time.sleep(0.1 * 2**k)


def directory(store_fs: pafs.FileSystem, path: str) -> list[tuple[str, bytes, int, int, int]]:
    """Name, comment, CRC, length and offset of each member, from the central directory at the archive's end."""

    def load() -> bytes:
        with store_fs.open_input_file(path) as f:
            end = f.size() - 22
            tail = f.read_at(22, end)
            if tail[:4] != _END:
                raise ValueError(f"{path} has no central directory")
            size, begin = struct.unpack_from("<II", tail, 12)
            return f.read_at(size, begin)

    data, at, out = _retried(load), 0, []
    while at < len(data):
        crc, _, length, n, extra, note = struct.unpack_from("<IIIHHH", data, at + 16)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        name, rest = data[at + 46 : at + 46 + n].decode(), at + 46 + n + extra
        out.append((name, data[rest : rest + note], crc, length, offset))
        at = rest + note
    return out


def _block(store_fs: pafs.FileSystem, path: str, inside: list[tuple[str, bytes, int, int, int]]) -> bytes:
    """One read over a range's members; what it misses is fetched member by member."""
    if not inside:
        return b""
    try:
        with store_fs.open_input_file(path) as f:
            name, _, _, length, last = inside[-1]
            return f.read_at(last + 30 + len(name.encode()) + length - inside[0][4], inside[0][4])
    except OSError:
        return b""


def member(store_fs: pafs.FileSystem, path: str, name: str, crc: int, length: int, offset: int) -> bytes:
    """One member's bytes, fetched by its offset; a failed or damaged read is retried for this member alone."""

    def load() -> bytes:
        with store_fs.open_input_file(path) as f:
            data = f.read_at(length, offset + 30 + len(name.encode()))
        if len(data) != length or zlib.crc32(data) != crc:
            raise ValueError(f"{path}: member {name} at {offset} is damaged")
        return data

    return _retried(load)


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members below ``folder``; an empty or missing folder gives no rows."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").option("rangebytes", range_bytes).load(folder)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(members: DataFrame) -> DataFrame:
    """Decode each member and compute digests and features of its samples.

    ``feature``: size, mean sample in thousandths, the number of distinct samples and the most frequent one
    (the smallest on ties), all of the stored samples including padding. Null and empty texts have one row of 64 zeros;
    repeated rows give repeated rows; no members, no rows.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = []
            for doc_id, n, media in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media")):
                media = media.as_py()
                width, height, payload = decode_png(media)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                mean = int(counts @ np.arange(256)) * 1000 // len(payload)
                feature = f"png8:{width}x{height}:mean={mean}:distinct={int((counts > 0).sum())}:mode={int(counts.argmax())}"
                rows.append((doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return members.select("doc_id", "n_bytes", "media").mapInArrow(compute, FEATURES)
