"""Log files as rows of lines: compressed or plain, any byte but the newline kept."""

from __future__ import annotations

import functools
import gzip
import io
import os
import re
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlog.operators.merging import keyed
from braidlog.session import ship
from braidlog.sources.reader import reachable, read_lines, whole_files
from braidlog.sources.storage import Storage

#: The first bytes of the two compressed formats.
MAGIC = {b"\x28\xb5\x2f\xfd": ".zst", b"\x1f\x8b": ".gz"}

SCHEMA = "file string, line_no bigint, line binary"
_NODE_FILE = re.compile(r"debug\.log-([^-]+)-(.+)\.gz", re.DOTALL)


@dataclass(frozen=True)
class NodeFile:
    """A node's log of one day; `reader` is its place among the day's files."""

    path: str
    name: str
    date: str
    node: str
    reader: int


def discover(spark: SparkSession, folder: str, before: str | None = None) -> list[NodeFile]:
    """The node files of a folder (not below it) by date and name, of days before `before` only.

    Names are compared as bytes, dates as text. Other names are passed over; a node's name
    with a space is an error, as merged lines could not be taken apart again.
    """
    out: list[NodeFile] = []
    seen: dict[str, int] = {}
    for name in Storage(spark).names(folder):
        if not (m := _NODE_FILE.fullmatch(name)) or not is_text(name):
            continue
        date, node = m[1], m[2]
        if " " in node:
            raise ValueError(f"node name has a space: {name}")
        if before is not None and not date.encode() < before.encode():
            continue
        out.append(NodeFile(f"{folder}/{name}", name, date, node, seen.setdefault(date, 0)))
        seen[date] += 1
    return out


def is_text(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def sniff(head: bytes) -> str:
    """Suffix of the format that a file's first bytes show: .zst, .gz or '' for plain."""
    return next((suffix for magic, suffix in MAGIC.items() if head.startswith(magic)), "")


def _opened_by_tasks(spark: SparkSession, paths: list[str]) -> list[str] | None:
    """Qualified paths, if Python tasks can open them all."""
    out = [Storage(spark).qualified(p) for p in paths]
    return out if all(map(reachable, out)) else None


def _numbered(raw: DataFrame) -> DataFrame:
    """Lines with their place in the file, from 1. A file's lines meet in one task; paths tell files apart."""
    order = Window.partitionBy("path").orderBy("block", "place")
    return raw.withColumn("line_no", F.row_number().over(order).cast("long")).select("file", "line_no", F.col("value").cast("binary").alias("line"))


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line_no, line) of files whose suffix tells their format, by Spark's text source.

    Lines end at newlines alone, which are left out; carriage returns, NUL and invalid UTF-8
    stay. An empty file has no rows, and a damaged one fails the query, naming the file.
    """
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    raw = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "false").text([escaped(p) for p in paths])
    return _numbered(raw.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")))


def escaped(path: str) -> str:
    """A path with the characters that Spark's readers would take as a pattern escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _opened(content: bytes) -> io.BufferedIOBase:
    kind = sniff(content[:4])
    raw = io.BytesIO(content)
    if kind == ".gz":
        return gzip.GzipFile(fileobj=raw)
    if kind == ".zst":
        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    return raw


def _sniffed_lines(batches):
    import pandas as pd

    for batch in batches:
        for name, content in zip(batch["file"], batch["content"], strict=True):
            rows: list[bytes] = []
            first = 1
            for line in _opened(content):
                rows.append(line.removesuffix(b"\n"))
                if len(rows) >= 20_000:
                    yield pd.DataFrame({"file": name, "line_no": range(first, first + len(rows)), "line": rows})
                    first, rows = first + len(rows), []
            if rows:
                yield pd.DataFrame({"file": name, "line_no": range(first, first + len(rows)), "line": rows})


def scan_any(spark: SparkSession, paths: list[str], most: int = 0) -> DataFrame:
    """Like scan, but a file's first bytes tell its format, not its name. With `most`, at least so many first lines of each file.

    Files are streamed in ranges (see reader) and keyed by their paths; `file` is a path's last part.
    Where only Spark's own readers can open them, files whose suffix tells the truth go through
    the text source, and the others are read as a whole by the task that takes them apart.
    """
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    if known := _opened_by_tasks(spark, paths):
        lines = whole_files(*read_lines(spark, known, most=most))
        names = spark.createDataFrame([(i, p.rsplit("/", 1)[-1]) for i, p in enumerate(known)], "file int, name string")
        # a row for each file
        return lines.join(F.broadcast(names), "file").select(F.col("name").alias("file"), "line_no", "line")
    ship(spark)
    storage = Storage(spark)
    plain, odd = [], []
    for path in paths:
        suffix = os.path.splitext(path)[1]
        known = suffix if suffix in (*MAGIC.values(), ".bz2", ".lz4", ".snappy", ".deflate", ".zstd") else ""
        (plain if known == sniff(storage.head(path, 4)) else odd).append(path)
    out = scan(spark, plain)
    if odd:
        files = spark.read.format("binaryFile").load([escaped(p) for p in odd])
        out = out.unionAll(files.select(F.col("_metadata.file_name").alias("file"), "content").mapInPandas(_sniffed_lines, SCHEMA))
    return out


def scan_places(spark: SparkSession, paths: list[str], most: int = 0) -> DataFrame:
    """Like scan_any, but `file` is a path's place in `paths`, as text: two paths of one name are two files."""
    if known := _opened_by_tasks(spark, paths):
        return whole_files(*read_lines(spark, known, most=most)).select(F.col("file").cast("string").alias("file"), "line_no", "line")
    out = [scan_any(spark, [p]).withColumn("file", F.lit(str(i))) for i, p in enumerate(paths)]
    return functools.reduce(DataFrame.unionAll, out)


def node_lines(spark: SparkSession, files: list[NodeFile]) -> DataFrame:
    """(date, node, reader, line_no, line, seconds, fraction) of node files, with their running keys as numbers.

    Each part of a file is in one partition, in order.
    """
    known = _opened_by_tasks(spark, [f.path for f in files])
    if known:
        listing = spark.createDataFrame([(i, f.date, f.node, f.reader) for i, f in enumerate(files)], "file int, date string, node string, reader int")
        lines = whole_files(*read_lines(spark, known, keys=True))
        return lines.join(F.broadcast(listing), "file").select("date", "node", "reader", "line_no", "line", "seconds", "fraction")
    listing = spark.createDataFrame([(f.name, f.date, f.node, f.reader) for f in files], "file string, date string, node string, reader int")
    lines = keyed(scan(spark, [f.path for f in files]).join(F.broadcast(listing), "file").select("date", "node", "reader", "line_no", "line"))
    number = lambda at, n: F.translate(F.substring("merge_key", at, n), "-T:", "").cast("long")
    return lines.select("date", "node", "reader", "line_no", "line", number(1, 19).alias("seconds"), number(21, 9).alias("fraction"))
