"""Merging a folder of node files into one file a day, checking it, and splitting it again."""

from __future__ import annotations

import re
from collections.abc import Callable, Container, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.functions.names import day_file_name, node_file_name
from braidlog.operators.merging import checked, demultiplexed, ordered_digests
from braidlog.operators.sinks import manifest, published, stage
from braidlog.sources.lines import NodeFile, discover, node_lines, scan_any
from braidlog.sources.reader import reachable, read_lines
from braidlog.sources.storage import Storage, temporary


@dataclass
class MergeReport:
    """Days published, and (date, node, ok, lines) of each input if a check was asked for."""

    days: list[str] = field(default_factory=list)
    files: list[tuple[str, str, bool, int]] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(f[2] for f in self.files)


#: The order of a merged day: by running key, then by the files' order, then as they stood.
ORDER = ("seconds", "fraction", "reader", "line_no")


def prefixed_lines(lines: DataFrame) -> DataFrame:
    """`lines` with the node before each, and a newline after it."""
    return lines.withColumn("line", F.concat(F.col("node").cast("binary"), F.lit(b" "), F.col("line"), F.lit(b"\n")))


def merged_lines(lines: DataFrame, ranges: int) -> DataFrame:
    """(key, line) with the prefix, in merge order over so many partitions of about equal numbers of lines; key is the date."""
    out = prefixed_lines(lines).repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER)
    return out.select(F.col("date").alias("key"), "line")


def merge(
    spark: SparkSession,
    folder: str,
    output: str | None = None,
    *,
    level: int = 19,
    days_at_once: int = 1,
    before: str | None = None,
    check: bool = False,
    jobs: int = 0,
    frame: int | None = None,
    days: Container[str] | None = None,
    after: Iterable[Callable[[list[str]], None]] = (),
) -> MergeReport:
    """Merge the node files of `folder` into one zstd file a day in `output`.

    With `check` every input is compared with what its day's file, read again, splits into,
    before that is published; a day that differs keeps its temporary file and is not published,
    and the others are. Without `output` only a check is made. `before` leaves out that day and
    later ones. `after` gets the names of what was published, in turn, unless there is none.
    With `days` only those are merged. An input that cannot be read fails the merge and leaves nothing of its day. `jobs` is the
    number of tasks that compress a day, 0 for one on each core; contents do not depend on it.
    """
    files = discover(spark, folder)
    if not files:
        raise FileNotFoundError(f"no node files in {folder}")
    if output is None and not check:
        raise ValueError("an output folder is needed unless only a check is asked for")
    if jobs < 0:
        raise ValueError(f"jobs must not be negative: {jobs}")
    if not 1 <= level <= 22:
        raise ValueError(f"level must be 1 to 22: {level}")
    chosen = discover(spark, folder, before) if before is not None else files
    report, storage = MergeReport(), Storage(spark)
    by_date: dict[str, list[NodeFile]] = {}
    for f in chosen:
        if days is None or f.date in days:
            by_date.setdefault(f.date, []).append(f)
    if output is not None and by_date:
        storage.make_dir(output)

    def one(date: str):
        own = by_date[date]
        lines = node_lines(spark, own)
        ordered = merged_lines(lines, jobs or spark.sparkContext.defaultParallelism)
        if output is None:
            back = ordered.select(F.spark_partition_id().alias("part"), F.expr("substring(line, 1, length(line) - 1)").alias("line"))
            return date, False, _rechecked(spark, own, lines, back)
        target = f"{output}/{day_file_name(date)}"
        options = {} if frame is None else {"frame": frame}
        staged = stage(ordered, output, "zst", level, **options)
        try:
            found: list[tuple[str, str, bool, int]] = []
            if check:
                trial = temporary(target)  # this run's own, kept if it differs
                published(spark, staged, date, trial, "zst")
                found = _rechecked(spark, own, lines, _parts(spark, trial))
                if not all(x[2] for x in found):
                    return date, False, found
                storage.rename(trial, target)
            else:
                published(spark, staged, date, target, "zst")
            return date, True, found
        finally:
            storage.delete(staged)

    at_once = min(len(by_date), days_at_once or spark.sparkContext.defaultParallelism) or 1
    with ThreadPoolExecutor(at_once) as pool:
        for date, done, found in pool.map(one, sorted(by_date, key=str.encode)):
            report.days += [day_file_name(date)] if done else []
            report.files += found
    if report.days:
        for step in after:
            step(report.days)
    return report


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, place, line) of one file: parts of it in order, each in one partition."""
    known = Storage(spark).qualified(path)
    if reachable(known):
        return read_lines(spark, [known])[0].select("part", "place", "line")
    return scan_any(spark, [path]).select(F.lit(0).alias("part"), F.col("line_no").alias("place"), "line").repartition(1).sortWithinPartitions("place")


def _rechecked(spark: SparkSession, files: list[NodeFile], lines: DataFrame, back: DataFrame) -> list[tuple[str, str, bool, int]]:
    """(date, node, ok, lines) of a day's files: their `lines`, and those of its merged file by parts (part, line), digested where they lie."""
    inputs = spark.createDataFrame([(f.date, f.node) for f in files], "date string, node string")
    before = ordered_digests(lines.withColumn("part", F.spark_partition_id()), "date", "node")
    after = ordered_digests(demultiplexed(back.withColumn("line_no", F.lit(0)), "part").withColumn("date", F.lit(files[0].date)), "date", "node")
    return [(r["date"], r["node"], r["ok"], r["lines"]) for r in checked(inputs, before, after).orderBy("date", "node").collect()]


def split(spark: SparkSession, path: str, output: str, *, level: int = 6, jobs: int = 0) -> list[str]:
    """One gzip file for each node of a merged day file; the inverse of merge but for an added last newline.

    Ranges of a node's lines become members of its file, so one node keeps `jobs` tasks busy (0: one for
    each core). All files are made before any takes its place, a line without a node fails the
    whole split, and a node whose name cannot be a file's is an error.
    """
    name = path.rsplit("/", 1)[-1]
    if not (m := re.fullmatch(r"debug\.log-(.+)\.zst", name, re.DOTALL)):
        raise ValueError(f"not a merged log's name: {name}")
    date, storage = m[1], Storage(spark)
    storage.make_dir(output)
    lines = demultiplexed(scan_any(spark, [path]).select("line_no", "line"))
    ranges = jobs or spark.sparkContext.defaultParallelism
    ordered = lines.select(F.col("node").alias("key"), "line_no", F.concat("line", F.lit(b"\n")).alias("line")).repartitionByRange(ranges, "key", "line_no").sortWithinPartitions("key", "line_no")
    staged = stage(ordered, output, "gz", level)
    try:
        nodes = sorted({key for key, _, _ in manifest(spark, staged)})
        for node in nodes:
            if not node or node.startswith(".") or "/" in node:
                raise ValueError(f"node name is not a file name: {node!r}")
        out = [f"{output}/{node_file_name(date, n)}" for n in nodes]
        trials = [temporary(p) for p in out]
        try:
            for node, trial in zip(nodes, trials, strict=True):
                published(spark, staged, node, trial, "gz")
            for trial, target in zip(trials, out, strict=True):
                storage.rename(trial, target)
        finally:
            for trial in trials:
                storage.delete(trial)
        return out
    finally:
        storage.delete(staged)
