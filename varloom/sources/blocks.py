"""Block gzip (BGZF) text: read by byte ranges, one task a range.

A block-gzip file is a row of gzip members of at most 64 KiB of text each, whose headers
say how long the member is. Gzip readers read it from the start, so Spark gives one such
file to one task. Here the file is cut into byte ranges. A task finds the first block
that starts in its range (a header whose chain of lengths leads to further headers),
inflates the blocks that start there, and owns the lines that start after the range's
first byte of text up to the first one past its end; what is before belongs to the range
before. Every line is read once whatever the cuts are, also lines longer than a range.

``block_lines`` is a Python data source: its partitions are the ranges, its rows are the
lines. ``block_index`` lists the blocks themselves, found in the same ranges from the
headers alone. Files are opened where Python can (pyarrow's file systems: local or
mounted folders, HDFS, S3, GCS); ``readable_blocks`` says whether a path is block gzip
and can be opened so, and the readers of ``varloom.sources.text`` use Spark's one-task
gzip reader otherwise.

A task that comes to its range's end also finds the first block of the next range and
compares, so a damaged block cannot fall between two ranges.

Torn files raise with the file and byte: a member cut short, a length that leads to no
header, a checksum that differs, a missing end marker (a cut between blocks leaves no
other trace). Lines end at LF, CR LF or CR, as in Spark's text reader; bytes that are not
UTF-8 become replacement characters. An empty file (the end marker alone) has no lines.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from varloom.session import importable

MAGIC = b"\x1f\x8b\x08\x04"
#: The empty block that ends every block-gzip file.
END_MARKER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: A member's greatest length, and the text that a written block holds.
MAX_BLOCK, BLOCK_TEXT = 1 << 16, 0xFF00
#: Headers that must follow a block found inside a file before it is believed.
CHAIN = 3
#: Compressed bytes of a task's range, as far as the files are large enough for all tasks.
RANGE_BYTES = 32 << 20
#: Text that becomes one Arrow batch, at most (one line may be longer).
BATCH_TEXT = 8 << 20


def open_file(path: str):
    """The file as a seekable pyarrow stream, and its size."""
    if path.startswith("file:"):  # as Spark lists it: a plain path behind the scheme, not percent-encoded
        system, name = fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name), system.get_file_info(name).size


def header_length(head: bytes) -> int:
    return 12 + int.from_bytes(head[10:12], "little")


def member_length(head: bytes) -> int | None:
    """The whole member's length by its header's BC field; None where this is no block's header."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    at, end = 12, header_length(head)
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


class Blocks:
    """The blocks of one file, read forward through a buffer."""

    def __init__(self, path: str, stream, size: int):
        self.path, self.stream, self.size = path, stream, size
        self.at, self.held = 0, b""

    def bytes(self, offset: int, n: int) -> bytes:
        """``n`` bytes from ``offset`` on, fewer at the end of the file."""
        n = min(n, self.size - offset)
        if not (self.at <= offset and offset + n <= self.at + len(self.held)):
            self.stream.seek(offset)
            self.at, self.held = offset, self.stream.read(max(n, 16 * MAX_BLOCK))
        return self.held[offset - self.at : offset - self.at + n]

    def length(self, offset: int) -> int:
        """The length of the block at ``offset``; raises where none is."""
        n = member_length(self.bytes(offset, MAX_BLOCK))
        if n is None or offset + n > self.size:
            raise ValueError(f"{self.path}: torn block at byte {offset}")
        return n

    def first(self, start: int) -> int:
        """The offset of the first block at ``start`` or later; the file's size where none follows."""
        if start == 0:
            return 0
        window = self.bytes(start, 2 * MAX_BLOCK)
        at = window.find(MAGIC)
        while 0 <= at <= MAX_BLOCK:
            if self._chained(start + at):
                return start + at
            at = window.find(MAGIC, at + 1)
        if start + MAX_BLOCK < self.size:
            raise ValueError(f"{self.path}: no block within {MAX_BLOCK} bytes of byte {start}")
        return self.size

    def _chained(self, offset: int) -> bool:
        """Whether a block that inflates stands here, and its length leads to further headers or the file's end."""
        n = member_length(self.bytes(offset, MAX_BLOCK))
        if n is None or offset + n > self.size:
            return False
        try:
            self.text(offset, n)
        except ValueError:
            return False
        for _ in range(CHAIN):
            offset += n
            if offset >= self.size:
                return offset == self.size
            n = member_length(self.bytes(offset, MAX_BLOCK))
            if n is None:
                return False
        return True

    def agree(self, offset: int, end: int) -> None:
        """The block that follows a range must be the one the next range starts with, else blocks were lost between."""
        if end < self.size and self.first(end) != offset:
            raise ValueError(f"{self.path}: torn block at byte {offset}")

    def text(self, offset: int, n: int) -> bytes:
        """The text of the block of ``n`` bytes at ``offset``, its length and checksum verified."""
        raw = self.bytes(offset, n)
        try:
            body = zlib.decompress(raw[header_length(raw) : -8], -15)
        except zlib.error as e:
            raise ValueError(f"{self.path}: torn block at byte {offset}: {e}") from e
        if zlib.crc32(body) != int.from_bytes(raw[-8:-4], "little") or len(body) != int.from_bytes(raw[-4:], "little"):
            raise ValueError(f"{self.path}: torn block at byte {offset}: its checksum or length differs")
        return body

    def end_marker(self) -> bool:
        return self.bytes(max(0, self.size - len(END_MARKER)), len(END_MARKER)) == END_MARKER


def owned_text(blocks: Blocks, start: int, end: int) -> Iterator[bytes]:
    """The text of the lines that the range ``start``..``end`` (bytes of the file) owns, in pieces of whole lines."""
    offset, skipping, carry, size = blocks.first(start), start > 0, [], 0
    if offset >= end:
        return
    agreed = False
    while offset < blocks.size:
        if offset >= end and not agreed:
            blocks.agree(offset, end)
            agreed = True
        n = blocks.length(offset)
        body = blocks.text(offset, n)
        if offset >= end:  # past the range: only what ends the line that starts at its end or before
            cut = body.find(b"\n") + 1
            if skipping:
                return
            carry.append(body[:cut] if cut else body)
            if cut:
                break
        elif skipping:
            cut = body.find(b"\n") + 1
            if cut:
                skipping = False
                carry.append(body[cut:])
        else:
            carry.append(body)
            size += len(body)
            if size >= BATCH_TEXT and b"\n" in body:
                text = b"".join(carry)
                cut = text.rfind(b"\n") + 1
                yield text[:cut]
                carry, size = [text[cut:]], len(text) - cut
        offset += n
    if not skipping and any(carry):
        yield b"".join(carry)


def _strings(lines: list[bytes]) -> pa.Array:
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class BlockGzipReader(DataSourceReader):
    def __init__(self, options: dict, index: bool):
        self.ranges = [_Range(*r) for r in json.loads(options["ranges"])]
        self.index = index

    def partitions(self) -> Sequence[InputPartition]:
        return self.ranges or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        stream, size = open_file(partition.path)
        with stream:
            blocks = Blocks(partition.path, stream, size)
            if partition.end >= size and not blocks.end_marker():
                raise ValueError(f"{partition.path}: torn at byte {size}: the end marker is missing")
            yield from self._index(blocks, partition) if self.index else self._lines(blocks, partition)

    def _lines(self, blocks: Blocks, part: _Range) -> Iterator[pa.RecordBatch]:
        for text in owned_text(blocks, part.start, part.end):
            lines = _strings(text.splitlines())
            files = pa.array([blocks.path], pa.string()).take(pa.array([0] * len(lines), pa.int32()))
            yield pa.RecordBatch.from_arrays([files, lines], names=["file", "value"])

    def _index(self, blocks: Blocks, part: _Range) -> Iterator[pa.RecordBatch]:
        offset, found = blocks.first(part.start), []
        while offset < min(part.end, blocks.size):
            n = blocks.length(offset)
            found.append((offset, n, int.from_bytes(blocks.bytes(offset, n)[-4:], "little")))
            offset += n
        if found:
            blocks.agree(offset, part.end)
        at, n, text = ([f[i] for f in found] for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array([blocks.path] * len(found), pa.string()), pa.array(at, pa.int64()),
             pa.array(n, pa.int64()), pa.array(text, pa.int64())],
            names=["file", "offset", "length", "text_length"],
        )


class BlockGzipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "varloom_block_lines"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema) -> DataSourceReader:
        return BlockGzipReader(self.options, index=False)


class BlockGzipIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "varloom_block_index"

    def schema(self) -> str:
        return "file string, offset long, length long, text_length long"

    def reader(self, schema) -> DataSourceReader:
        return BlockGzipReader(self.options, index=True)


def readable_blocks(path: str) -> bool:
    """Whether the file is block gzip and Python can open it (an empty file or another format is not)."""
    try:
        stream, _ = open_file(path)
        with stream:
            return member_length(stream.read(MAX_BLOCK)) is not None
    except (OSError, NotImplementedError, pa.ArrowException):
        return False


def file_sizes(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """(path, bytes) of every file under ``paths``, listed by Spark; no content is read."""
    listed = spark.read.format("binaryFile").load(list(paths)).select("path", "length")
    return sorted((r["path"], r["length"]) for r in listed.collect())


def cut_ranges(files: Sequence[tuple[str, int]], tasks: int, range_bytes: int | None = None) -> list[tuple[str, int, int]]:
    """(path, start, end) of even ranges: ``RANGE_BYTES`` each, less where the files are too small for ``tasks``."""
    total = sum(size for _, size in files)
    step = range_bytes or max(MAX_BLOCK, min(RANGE_BYTES, -(-total // max(1, tasks))))
    return [(path, at, min(size, at + step)) for path, size in files for at in range(0, size, step)]


def _load(spark: SparkSession, source: type[DataSource], paths: Sequence[str], range_bytes: int | None) -> DataFrame:
    importable(spark)
    spark.dataSource.register(source)
    ranges = cut_ranges(file_sizes(spark, paths), spark.sparkContext.defaultParallelism, range_bytes)
    return spark.read.format(source.name()).option("ranges", json.dumps(ranges)).load()


def block_lines(spark: SparkSession, paths: Sequence[str], range_bytes: int | None = None) -> DataFrame:
    """file, value: every line of block-gzip files, one task a byte range."""
    return _load(spark, BlockGzipLines, paths, range_bytes)


def block_index(spark: SparkSession, paths: Sequence[str], range_bytes: int | None = None) -> DataFrame:
    """file, offset, length, text_length of every block, from the headers (and lengths) alone."""
    return _load(spark, BlockGzipIndex, paths, range_bytes)


def _compress(text: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(text) + squeeze.flush()
    length = 18 + len(body) + 8
    if length > MAX_BLOCK:  # noise that deflate makes longer: store it
        squeeze = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = squeeze.compress(text) + squeeze.flush()
        length = 18 + len(body) + 8
    head = END_MARKER[:16] + (length - 1).to_bytes(2, "little")
    return head + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


def compress_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (binary) of the lines in a batch's first column; a block may end anywhere in a line."""
    held = b""
    for batch in batches:
        held += b"".join((v.as_py() or "").encode("utf-8") + b"\n" for v in batch.column(0))
        full = len(held) // BLOCK_TEXT * BLOCK_TEXT
        out = [_compress(held[i : i + BLOCK_TEXT]) for i in range(0, full, BLOCK_TEXT)]
        held = held[full:]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["block"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([_compress(held)], pa.binary())], names=["block"])


def write_block_lines(lines: DataFrame, path: str) -> None:
    """The first column's lines as block-gzip files under ``path``, one a partition.

    Spark's text writer commits them: a row is a block, the separator after each row an
    empty block, which is a valid part of such a file and, after the last row, its end
    marker. A partition without rows makes a file without content, or none.
    """
    importable(lines.sparkSession)
    blocks = lines.mapInArrow(compress_lines, "block binary").select(F.col("block").cast("string").alias("value"))
    separator = END_MARKER.decode("latin-1")
    blocks.write.mode("overwrite").options(lineSep=separator, encoding="ISO-8859-1", compression="none").text(path)
