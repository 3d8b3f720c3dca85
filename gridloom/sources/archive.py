"""SRC-11: ZIP archives as a splittable source.

``spark.read.format("zip_members").load(path)`` gives (archive, name, size, content). The driver streams each archive's central directory, the
list of members at its end, and cuts it into pieces of about ``split`` compressed bytes (128 MB unless set); it keeps where a piece of the directory begins,
not the members. A task reads its piece of the directory and then only the bytes of its own members, so one archive is read by many
tasks, whatever its size; a member is one value. Options: ``suffix`` (names that end so), ``split``. ``path`` is a file or a folder, whose files named
*.zip are taken, by any address that pyarrow's file systems know (local, hdfs, s3, gs). Stored and deflated members are read, with 64-bit sizes
and offsets; others (encrypted, other methods) raise an error, as does a content that doesn't match its check sum. Folders in an archive are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, name string, size long, content binary"
SPLIT = 128 << 20
#: Fixed values of the format: signatures and the layout of its records.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
ENTRY_HEAD, LOCAL_HEAD, END_HEAD = struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s5H3I2H"), struct.Struct("<4s4H2IH")
UTF8, ENCRYPTED = 0x800, 0x1


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    offset: int


@dataclass
class Piece(InputPartition):
    """A run of an archive's directory: where it begins and how many members it lists."""

    archive: str
    begin: int
    count: int


def files(path: str) -> list[str]:
    """The archives at an address."""
    where, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if where.get_file_info(at).type == pafs.FileType.File:
        return [path]
    return sorted(prefix + f.path for f in where.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".zip"))


def opened(path: str) -> pa.NativeFile:
    where, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return where.open_input_file(at)


def directory(file: pa.NativeFile) -> tuple[int, int]:
    """(offset of the central directory, members)."""
    length = file.size()
    tail_at = max(0, length - END_HEAD.size - 0xFFFF - 20)
    tail = file.read_at(length - tail_at, tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + END_HEAD.size > len(tail) or at + END_HEAD.size + END_HEAD.unpack_from(tail, at)[-1] != len(tail)):  # the mark may occur in the comment
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP archive")
    *_, count, _, offset, _ = END_HEAD.unpack_from(tail, at)
    if (count == 0xFFFF or offset == 0xFFFFFFFF) and at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        record = file.read_at(56, struct.unpack_from("<Q", tail, at - 12)[0])
        if record[:4] == END64:
            count, offset = struct.unpack_from("<Q", record, 32)[0], struct.unpack_from("<Q", record, 48)[0]
    return offset, count


def entries(file: pa.NativeFile, begin: int, count: int) -> Iterator[tuple[int, Member]]:
    """(place in the file, member) of ``count`` entries of the directory, read a megabyte at a time."""
    at, held, length = begin, b"", file.size()
    for _ in range(count):
        need = ENTRY_HEAD.size
        while True:
            if len(held) < need:
                start = at + len(held)
                held += file.read_at(min(max(1 << 20, need - len(held)), length - start), start)
                if len(held) < need:
                    raise ValueError("the directory ends early")
            head = ENTRY_HEAD.unpack_from(held)
            whole = ENTRY_HEAD.size + head[10] + head[11] + head[12]
            if len(held) >= whole:
                break
            need = whole
        mark, _, _, flags, method, _, _, crc, packed, size, n, extra, _, _, _, _, offset = head
        if mark != ENTRY:
            raise ValueError("no entry where the directory has one")
        name = held[ENTRY_HEAD.size : ENTRY_HEAD.size + n]
        size, packed, offset = _wide(held[ENTRY_HEAD.size + n : ENTRY_HEAD.size + n + extra], size, packed, offset)
        yield at, Member(name.decode("utf-8" if flags & UTF8 else "cp437"), method, flags, crc, packed, size, offset)
        at, held = at + whole, held[whole:]


def _wide(extra: bytes, *numbers: int) -> list[int]:
    """Sizes and offset, from the extra field of 64-bit numbers where they don't fit 32 bits."""
    out = list(numbers)
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<HH", extra)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
            out = [next(values) if x == 0xFFFFFFFF else x for x in out]
        extra = extra[4 + n :]
    return out


def content(file: pa.NativeFile, m: Member) -> bytes:
    if m.flags & ENCRYPTED or m.method not in (0, 8):
        raise ValueError(f"{m.name}: encrypted or packed by method {m.method}")
    head = LOCAL_HEAD.unpack(file.read_at(LOCAL_HEAD.size, m.offset))
    data = file.read_at(m.packed, m.offset + LOCAL_HEAD.size + head[9] + head[10])
    data = zlib.decompress(data, -15) if m.method == 8 else data
    if head[0] != LOCAL or len(data) != m.size or zlib.crc32(data) != m.crc:
        raise ValueError(f"{m.name}: the content doesn't match the directory")
    return data


class ZipReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, split: int):
        self.path, self.suffix, self.split = path, suffix, split

    def partitions(self) -> list[Piece]:
        out = []
        for archive in files(self.path):
            with opened(archive) as file:
                offset, members = directory(file)
                begin, count, packed = offset, 0, 0
                for at, m in entries(file, offset, members):
                    if count and packed + m.packed > self.split:
                        out.append(Piece(archive, begin, count))
                        begin, count, packed = at, 0, 0
                    count, packed = count + 1, packed + m.packed
                if count:
                    out.append(Piece(archive, begin, count))
        return out or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        with opened(partition.archive) as file:
            rows, held = [], 0
            for _, m in entries(file, partition.begin, partition.count):
                if not m.name.endswith(self.suffix) or m.name.endswith("/"):
                    continue
                rows.append((partition.archive, m.name, m.size, content(file, m)))
                held += m.size
                if held > 8 << 20 or len(rows) == 1000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("archive", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ZipReader:
        return ZipReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("split", SPLIT)))


def members(spark: SparkSession, path: str, suffix: str = "", split: int = SPLIT) -> DataFrame:
    """The members of the archives at ``path``, a row each."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("suffix", suffix).option("split", split).load(path)
