"""Lines of block-gzip files and zip archives, read in parallel: a Spark data source whose partitions are ranges of blocks and members.

A block-gzip file is a row of small gzip members that say how long they are. A partition is a range of its bytes and owns the blocks that
begin there, the first of which is found by its mark and checked by the one after it. A line belongs to the partition in whose
blocks it begins: each partition but the first passes over everything up to its first line end, and goes on behind its range to the
first line end there. So a line over any number of borders is read once, by one partition.

A zip archive has a partition a member, since a member can't be entered in the middle.

    spark.dataSource.register(BlockLines)
    spark.read.format("block_lines").option("splitBytes", 1 << 26).load("file:///data/lines.bgz")     value, file, place

place orders the lines of a file: where a line's block begins times 65536 and its place in the block, or in an archive the member's number
times 2**40 and the line's number. Lines are UTF-8, wrong bytes are replaced; a carriage return before the line feed goes.
"""

from __future__ import annotations

import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 1 << 26
#: Fixed values of the format: the mark of a block with extra fields, the field that holds its length, the empty block at the end.
MARK, FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
LARGEST = 1 << 16
IN_BLOCK = 0xFF00
LINES_AT_ONCE = 10_000
SCHEMA = pa.schema([("value", pa.string()), ("file", pa.string()), ("place", pa.int64())])


@dataclass
class Part(InputPartition):
    """Bytes start to end of a file, or the member-th member of an archive."""

    file: str
    start: int = 0
    end: int = 0
    member: int = -1


def _length(head: bytes) -> int | None:
    """The length of the block that begins here; None if none does."""
    if len(head) < 18 or head[:4] != MARK:
        return None
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    at = 0
    while at + 4 <= len(extra):
        if extra[at : at + 4] == FIELD:
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", extra, at + 2)[0]
    return None


def _first_block(f: pa.NativeFile, start: int, size: int) -> int:
    """Where the first block at or after start begins; the file's size if there is none."""
    if not start:
        return 0
    f.seek(start)
    window = f.read(min(2 * LARGEST, size - start))
    at = window.find(MARK)
    while at >= 0:
        f.seek(start + at)
        length = _length(f.read(min(512, size - start - at)))
        if length is not None:
            then = start + at + length
            f.seek(min(then, size))
            if then == size or _length(f.read(min(512, size - then))) is not None:
                return start + at
        at = window.find(MARK, at + 1)
    return size


def _blocks(f: pa.NativeFile, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Where each block begins, and what it holds."""
    while at < size:
        f.seek(at)
        block = f.read(min(LARGEST, size - at))
        length = _length(block)
        if length is None or length > len(block):
            raise ValueError(f"no block at byte {at}")
        extra = struct.unpack_from("<H", block, 10)[0]
        data = zlib.decompress(block[12 + extra : length - 8], wbits=-15)
        if zlib.crc32(data) != struct.unpack_from("<I", block, length - 8)[0]:
            raise ValueError(f"the block at byte {at} is damaged")
        yield at, data
        at += length


def block_lines(f: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[bytes, int]]:
    """The lines that begin in the blocks of a range of bytes, and their places."""
    begun, begins, passing, own = [], None, start > 0, _first_block(f, start, size)
    if own >= end:
        return
    for at, data in _blocks(f, own, size):
        if at >= end and passing:
            return
        first, *rest = data.split(b"\n")
        if begins is None and not passing:
            begins = at << 16
        begun.append(first)
        if rest:
            if not passing:
                yield b"".join(begun), begins
            if at >= end:
                return
            place = (at << 16) + len(first) + 1
            for line in rest[:-1]:
                yield line, place
                place += len(line) + 1
            # What is left may end with the block: then the next line begins in the next one.
            begun, begins, passing = [rest[-1]], place, False
        elif passing:
            begun = []
    if not passing and b"".join(begun):
        yield b"".join(begun), begins


def _opened(file: str) -> tuple[pa.NativeFile, int]:
    fs, path = pafs.FileSystem.from_uri(file)
    return fs.open_input_file(path), fs.get_file_info(path).size


def _listed(file: str) -> list[str]:
    """A file, or the block-gzip files and archives in a folder."""
    fs, path = pafs.FileSystem.from_uri(file)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return [file]
    return [f"{file.rstrip('/')}/{i.base_name}" for i in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda i: i.path) if i.base_name.endswith((".bgz", ".zip"))]


def _lines(part: Part) -> Iterator[tuple[str, int]]:
    f, size = _opened(part.file)
    if part.member < 0:
        found = block_lines(f, size, part.start, part.end)
    else:
        archive = zipfile.ZipFile(f)
        inside = archive.open(archive.infolist()[part.member])
        found = ((line.removesuffix(b"\n"), (part.member << 40) + n) for n, line in enumerate(inside))
    for line, place in found:
        yield line.removesuffix(b"\r").decode("utf-8", "replace"), place


def first_lines(paths: list[str], n: int) -> list[str]:
    """The first n lines of the first file, read by the driver from its beginning."""
    parts = BlockReader({"paths": json.dumps(paths)}).partitions()
    here = (line for p in parts if p.file == parts[0].file for line, _ in _lines(p))
    return list(islice(here, n))


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.files, self.split = [p if "://" in p else f"file://{p}" for p in paths], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Part]:
        out = []
        for file in (f for p in self.files for f in _listed(p)):
            f, size = _opened(file)
            if file.endswith(".zip"):
                out += [Part(file, member=n) for n, m in enumerate(zipfile.ZipFile(f).infolist()) if not m.is_dir()]
            else:
                out += [Part(file, at, min(at + self.split, size)) for at in range(0, size, self.split)]
            f.close()
        return out

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files
            return
        values, places = [], []
        for line, place in _lines(part):
            values.append(line)
            places.append(place)
            if len(values) >= LINES_AT_ONCE:
                yield pa.record_batch([pa.array(values, pa.string()), pa.array([part.file] * len(values)), pa.array(places)], schema=SCHEMA)
                values, places = [], []
        if values:
            yield pa.record_batch([pa.array(values, pa.string()), pa.array([part.file] * len(values)), pa.array(places)], schema=SCHEMA)


class BlockLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_lines"

    def schema(self) -> str:
        return "value string, file string, place bigint"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


def block(data: bytes) -> bytes:
    """One block of up to IN_BLOCK bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = MARK + b"\0\0\0\0\0\xff" + struct.pack("<H", 6) + FIELD + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_lines(lines: DataFrame, folder: str, in_block: int = IN_BLOCK) -> list[str]:
    """Column `value` as block-gzip files in a folder, one a partition, in the order of its rows; the files. A file bears the number of the attempt
    that wrote it, and only those that the job reports count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        file = f"{folder}/lines-{context.partitionId():06d}-{context.taskAttemptId()}.bgz"
        fs, path = pafs.FileSystem.from_uri(file)
        fs.create_dir(path.rsplit("/", 1)[0])
        with fs.open_output_stream(path, compression=None) as out:
            left = b""
            for batch in batches:
                left += b"".join(v.encode() + b"\n" for v in batch.column("value").to_pylist() if v is not None)
                while len(left) >= in_block:
                    out.write(block(left[:in_block]))
                    left = left[in_block:]
            if left:
                out.write(block(left))
            out.write(LAST)
        yield pa.RecordBatch.from_pydict({"file": [file]})

    return sorted(r[0] for r in lines.select("value").mapInArrow(write, "file string").collect())  # a row a file
