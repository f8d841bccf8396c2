"""Compressed files out of ordered rows: tasks write frames where every task can write, and commit what they wrote.

A task's files count only if its commit message arrives, so tasks may be tried again. The
driver sees names and sizes, puts files together on the file system, and publishes by a rename.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from braidlog.session import ship
from braidlog.sources.reader import file_system, reachable, seek_table
from braidlog.sources.storage import Storage, temporary

FRAME = 8 << 20  # bytes of lines in a frame
MANIFEST = "_frames.json"


def _compressor(kind: str, level: int):
    if kind == "plain":
        return bytes
    if kind == "zst":
        return zstandard.ZstdCompressor(level=level, write_checksum=True).compress
    return lambda data: (c := zlib.compressobj(level, zlib.DEFLATED, 31)).compress(data) + c.flush()


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (key, file, sizes of its frames: stored and not), in order."""

    partition: int
    files: list[tuple[str, str, list[tuple[int, int]]]]


class FrameSink(DataSource):
    """Format `braidlog_frames` for rows (key string, line binary), sorted over partitions; each line has its newline.

    Options: folder, kind (zst, gz or plain), level, frame.
    """

    @classmethod
    def name(cls) -> str:
        return "braidlog_frames"

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        o = self.options
        return FrameWriter(o["folder"], o["kind"], int(o["level"]), int(o["frame"]))


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, kind: str, level: int, frame: int):
        self.folder, self.kind, self.level, self.frame = folder, kind, level, frame

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        out = Written(context.partitionId() if context else 0, [])
        system, folder = file_system(self.folder)
        key, stream = None, None
        try:
            for k, frame, size in frames(iterator, self.kind, self.level, self.frame):
                if k != key:
                    if stream is not None:
                        stream.close()
                    key, name = k, f"{out.partition:06}-{uuid.uuid4().hex}"
                    out.files.append((key, name, []))
                    stream = system.open_output_stream(f"{folder}/{name}")
                stream.write(frame)
                out.files[-1][2].append((len(frame), size))
        finally:
            if stream is not None:
                stream.close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        parts = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        system, folder = file_system(self.folder)
        with system.open_output_stream(f"{folder}/{MANIFEST}") as f:
            f.write(json.dumps(parts).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """What was written stays in the staging folder, which its owner deletes."""


def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, memoryview]]:
    """The runs of equal keys in a batch: key, offsets of the lines, and the bytes that these are of."""
    lines, keys = batch.column("line"), batch.column("key")
    if not batch.num_rows:
        return
    wide = pa.types.is_large_binary(lines.type)
    _, offsets, data = lines.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[lines.offset : lines.offset + batch.num_rows + 1]
    ends = pa.compute.run_end_encode(keys)
    data, begin = memoryview(data) if data is not None else memoryview(b""), 0
    for k, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
        yield k, offsets[begin : end + 1], data
        begin = end


def frames(batches: Iterator[pa.RecordBatch], kind: str, level: int, frame: int) -> Iterator[tuple[str, bytes, int]]:
    """(key, frame, size of its lines) of batches in order; a frame holds whole lines of one key."""
    compress = _compressor(kind, level)
    held, size, key = [], 0, None
    for batch in batches:
        for k, offsets, data in runs(batch):
            if k != key and held:
                yield key, compress(b"".join(held)), size
                held, size = [], 0
            key, at, last = k, 0, len(offsets) - 1
            while at < last:
                to = max(at + 1, min(last, int(np.searchsorted(offsets, offsets[at] + frame - size, side="left"))))
                held.append(data[offsets[at] : offsets[to]])
                size += int(offsets[to] - offsets[at])
                at = to
                if size >= frame:
                    yield key, compress(b"".join(held)), size
                    held, size = [], 0
    if held:
        yield key, compress(b"".join(held)), size


def _as_rows(kind: str, level: int, frame: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, (key, data, size) in enumerate(frames(batches, kind, level, frame)):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i], type=pa.int64()), pa.array([data], type=pa.binary()), pa.array([size], type=pa.int64())], names=["key", "part", "frame", "size"])

    return run


def stage(ordered: DataFrame, folder: str, kind: str, level: int, frame: int = FRAME) -> str:
    """Frames of `ordered` (key, line), which is sorted over its partitions by key, in a new folder below `folder`.

    Where Python tasks cannot write there, frames are rows that Spark's own writer takes.
    """
    spark = ordered.sparkSession
    ship(spark)
    storage = Storage(spark)
    where = storage.qualified(temporary(f"{folder}/_frames"))
    if reachable(where):
        storage.make_dir(where)
        spark.dataSource.register(FrameSink)
        ordered.select("key", "line").write.format("braidlog_frames").options(folder=where, kind=kind, level=str(level), frame=str(frame)).mode("append").save()
    else:
        rows = ordered.select("key", "line").mapInArrow(_as_rows(kind, level, frame), "key string, part bigint, frame binary, size bigint")
        rows.select(F.spark_partition_id().alias("partition"), "*").write.parquet(where)
    return where


def manifest(spark: SparkSession, staged: str) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(key, file, sizes of its frames) of what is staged, in order; no file's name where frames are rows."""
    if Storage(spark).exists(f"{staged}/{MANIFEST}"):
        return [(k, name, [tuple(f) for f in sizes]) for k, name, sizes in json.loads(Storage(spark).read(f"{staged}/{MANIFEST}"))]
    rows = spark.read.parquet(staged).select("key", "partition", "part", F.octet_length("frame").alias("stored"), "size").orderBy("partition", "part").collect()
    return [(r["key"], "", [(r["stored"], r["size"])]) for r in rows]


def published(spark: SparkSession, staged: str, key: str, path: str, kind: str, head: bytes = b"") -> None:
    """`head` and the frames of one key as the file `path`; a zstd file gets a table of its frames, so that it can be read in ranges."""
    own = [(name, sizes) for k, name, sizes in manifest(spark, staged) if k == key]
    tail = seek_table([f for _, sizes in own for f in sizes]) if kind == "zst" and own else b""
    if all(name for name, _ in own):
        Storage(spark).publish_files(path, [f"{staged}/{name}" for name, _ in own], tail, head)
        return
    rows = spark.read.parquet(staged).where(F.col("key") == key).orderBy("partition", "part").select("frame").toLocalIterator()
    Storage(spark).publish(path, itertools.chain([head], (bytes(r["frame"]) for r in rows), [tail]))
