"""Lines of compressed and plain files as a Spark data source that streams: any size, in bounded memory.

A file's first bytes tell its format. Plain files are read in ranges of bytes, and zstd files
that end with a seek table (as those written here do) in ranges of frames, so one file keeps all
cores busy; gzip and other zstd files are streamed by one task each. As with any split text, a
range's first line belongs to the range before it, which reads on to that line's end.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from braidlog.session import ship

#: The first bytes of the compressed formats, and the magic numbers of a zstd seek table.
ZSTD, GZIP = b"\x28\xb5\x2f\xfd", b"\x1f\x8b"
SEEK_TABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

#: Bytes, decompressed, of a range; of compressed data read at once; of lines in a batch.
RANGE, CHUNK, BATCH = 32 << 20, 1 << 20, 4 << 20
#: Ranges of all files at most, beside one for each file: larger inputs have larger ranges.
MOST = 100_000
END = 1 << 62


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """A client for a qualified path that works in any Python process, and the path in it."""
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether Python tasks can open files there; else only Spark's own readers can."""
    try:
        file_system(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


@dataclass
class Range(InputPartition):
    """A range of a file: `length` decompressed bytes from `offset` of the stored file, the `part`th of them."""

    file: int
    path: str
    kind: str
    part: int
    offset: int
    length: int

    def __init__(self, file: int, path: str, kind: str, part: int, offset: int, length: int):
        self.file, self.path, self.kind, self.part, self.offset, self.length = file, path, kind, part, offset, length


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists the frames (stored size, size) before it; decoders pass over it."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def frames_of(file: pa.NativeFile) -> list[tuple[int, int]]:
    """The frames that a zstd file's seek table lists; none without one."""
    size = file.size()
    if size < 17:
        return []
    n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    entry = 12 if flags & 0x80 else 8
    if magic != SEEKABLE or size < n * entry + 17:
        return []
    return [struct.unpack_from("<II", table, i * entry) for i in range(n)] if (table := file.read_at(n * entry, size - 9 - n * entry)) is not None else []


def ranges(file: int, path: str, step: int) -> list[Range]:
    system, inner = file_system(path)
    with system.open_input_file(inner) as f:
        head, size = f.read_at(4, 0), f.size()
        if head[:2] == GZIP:
            return [Range(file, path, "gz", 0, 0, END)]
        if head != ZSTD:
            return [Range(file, path, "plain", i, a, step if a + step < size else END) for i, a in enumerate(range(0, max(size, 1), step))]
        out, offset, begin, length = [], 0, 0, 0
        for stored, raw in frames_of(f):
            if length >= step:
                out.append(Range(file, path, "zst", len(out), begin, length))
                begin, length = offset, 0
            offset, length = offset + stored, length + raw
        return [*out, Range(file, path, "zst", len(out), begin, END)]


def _decompressed(kind: str, stored: Iterator[bytes]) -> Iterator[bytes]:
    """What streams or frames one after another hold; one that is cut off is an error."""
    if kind == "plain":
        yield from stored
        return
    new = (lambda: zlib.decompressobj(31)) if kind == "gz" else (lambda: zstandard.ZstdDecompressor().decompressobj())
    stream, begun = new(), False
    for data in stored:
        while data:
            if stream.eof:
                if kind == "gz" and not data.strip(b"\0"):
                    break  # padding
                stream = new()
            begun = True
            if out := stream.decompress(data):
                yield out
            data = stream.unused_data if stream.eof else b""
    if begun and not stream.eof:
        raise ValueError("the compressed data ends early")


def _stored(r: Range) -> Iterator[bytes]:
    system, inner = file_system(r.path)
    with system.open_input_file(inner) as f:
        f.seek(r.offset)
        while data := f.read(CHUNK):
            yield data


def pieces(r: Range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The lines of a range in batches: their bytes without newlines, end to end, and len + 1 offsets."""
    held, at, skip = b"", 0, r.part > 0  # `at` is the place of held[0] from the range's begin
    size, waiting = 0, []

    def cut(data: bytes, last: bool):
        nonlocal held, at, skip
        array = np.frombuffer(data, dtype=np.uint8)
        ends = np.flatnonzero(array == 10)
        begins = np.concatenate(([0], ends + 1))
        if last and begins[-1] < len(data):
            ends = np.append(ends, len(data))  # no newline at the end of the file
        else:
            begins = begins[:-1]
        rest = int(ends[-1]) + 1 if len(ends) else 0
        held = data[rest:]
        if skip and len(begins):
            begins, ends, skip = begins[1:], ends[1:], False
        n = int(np.searchsorted(begins + at, r.length, side="right"))
        done = n < len(begins) or rest + at > r.length
        begins, ends, at = begins[:n], ends[:n], at + rest
        if not n:
            return None, done
        body = array[begins[0] : ends[-1]]
        offsets = np.concatenate(([0], np.cumsum(ends - begins)))
        return (np.delete(body, ends[:-1] - begins[0]), offsets), done

    for data in _decompressed(r.kind, _stored(r)):
        waiting.append(data)
        size += len(data)
        if size >= BATCH:
            out, done = cut(b"".join((held, *waiting)), False)
            size, waiting = 0, []
            if out is not None:
                yield out
            if done:
                return
    out, _ = cut(b"".join((held, *waiting)), True)
    if out is not None:
        yield out


def keys_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each line begins with a timestamp, and it as a number of 14 digits and one of 9 (see functions.lines.timestamp_key)."""
    n, length = len(offsets) - 1, np.diff(offsets)
    padded = np.concatenate((body, np.zeros(32, dtype=np.uint8)))
    c = padded[offsets[:-1, None] + np.arange(31)] if n else np.zeros((0, 31), dtype=np.uint8)
    c[np.arange(31) >= length[:, None]] = 0
    digit = (c >= 48) & (c <= 57)
    marks = {4: 45, 7: 45, 10: 84, 13: 58, 16: 58}
    fine = np.ones(n, dtype=bool)
    for i in range(19):
        fine &= (c[:, i] == marks[i]) if i in marks else digit[:, i]
    dotted = c[:, 19] == 46
    run = np.cumprod(digit[:, 20:30], axis=1).sum(axis=1)  # ten digits are one too many
    fine &= ~dotted | ((run >= 1) & (run <= 9))
    value = c.astype(np.int64) - 48
    seconds = np.zeros(n, dtype=np.int64)
    for i in range(19):
        if i not in marks:
            seconds = seconds * 10 + value[:, i]
    fraction = np.zeros(n, dtype=np.int64)
    for i in range(9):
        fraction = fraction * 10 + np.where(dotted & (i < run), value[:, 20 + i], 0)
    return fine, np.where(fine, seconds, 0), np.where(fine, fraction, 0)


def running(seconds: np.ndarray, fraction: np.ndarray, before: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The largest (seconds, fraction) so far at each place, beginning with `before`."""
    a, b = np.concatenate(([before[0]], seconds)), np.concatenate(([before[1]], fraction))
    order = np.lexsort((b, a))
    rank = np.empty(len(a), dtype=np.int64)
    rank[order] = np.arange(len(a))
    most = order[np.maximum.accumulate(rank)]
    return a[most][1:], b[most][1:]


SCHEMA = "file int, part int, place bigint, line binary, seconds bigint, fraction bigint"


class LineSource(DataSource):
    """Format `braidlog_lines`; option `ranges` is a JSON list of ranges, `keys` whether running keys are wanted, `most` see read_lines."""

    @classmethod
    def name(cls) -> str:
        return "braidlog_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(json.loads(self.options["ranges"]), self.options["keys"] == "true", int(self.options["most"]))


class LineReader(DataSourceReader):
    def __init__(self, listed: list, keys: bool, most: int):
        self.listed, self.keys, self.most = listed, keys, most

    def partitions(self) -> list[Range]:
        return [Range(*x) for x in self.listed]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        n, key = 0, (0, 0)
        try:
            for body, offsets in pieces(r):
                size = len(offsets) - 1
                lines = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])
                seconds = fraction = np.zeros(size, dtype=np.int64)
                if self.keys:
                    _, seconds, fraction = keys_of(body, offsets)
                    seconds, fraction = running(seconds, fraction, key)
                    key = (int(seconds[-1]), int(fraction[-1]))
                constant = lambda x: pa.array(np.full(size, x, dtype=np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([constant(r.file), constant(r.part), pa.array(np.arange(n, n + size)), lines, pa.array(seconds), pa.array(fraction)], names=[x.split()[0] for x in SCHEMA.split(", ")])
                n += size
                if self.most and n >= self.most:
                    return
        except (ValueError, zlib.error, zstandard.ZstdError, OSError) as e:
            raise ValueError(f"{r.path}: {e}") from e


def read_lines(spark: SparkSession, paths: list[str], keys: bool = False, most: int = 0) -> tuple[DataFrame, bool]:
    """(file, part, place, line, seconds, fraction) of files at qualified paths, and whether some are in several parts.

    file is the place in `paths`; lines of a file stand by part and place. With `keys`, seconds
    and fraction are the largest timestamp so far in the part; what comes before the first is zero.
    With `most`, only the first batches of each file are read, up to so many lines.
    """
    ship(spark)
    spark.dataSource.register(LineSource)
    sizes = [system.get_file_info(inner).size or 0 for system, inner in map(file_system, paths)]
    step = max(RANGE, sum(sizes) // MOST)
    listed = [(r.file, r.path, r.kind, r.part, r.offset, r.length) for i, p in enumerate(paths) for r in ranges(i, p, step) if not (most and r.part)]
    rows = spark.read.format("braidlog_lines").option("ranges", json.dumps(listed)).option("keys", "true" if keys else "false").option("most", str(most)).load()
    return rows, any(x[3] for x in listed)


def whole_files(rows: DataFrame, several: bool) -> DataFrame:
    """(file, line_no, line, seconds, fraction) of read_lines: places and running keys over a file's parts.

    Parts are summed up (a number of lines and a key for each), the sums of what comes before
    are carried over a file's parts, and lines meet them by file and part: no line moves for its number.
    """
    if not several:
        return rows.select("file", (F.col("place") + 1).alias("line_no"), "line", "seconds", "fraction")
    sums = rows.groupBy("file", "part").agg(F.count("*").alias("n"), F.max(F.struct("seconds", "fraction")).alias("most"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range, of which there are MOST
    carried = sums.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.max("most").over(before).alias("most"))
    key = F.greatest(F.struct("seconds", "fraction"), F.coalesce("most", F.struct(F.lit(0).cast("long").alias("seconds"), F.lit(0).cast("long").alias("fraction"))))
    out = rows.join(F.broadcast(carried), ["file", "part"]).withColumn("key", key)
    return out.select("file", (F.col("n") + F.col("place") + 1).alias("line_no"), "line", "key.seconds", "key.fraction")
