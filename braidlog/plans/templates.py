"""From a log to its templates: prefixes, parsing, clustering, reports, the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlog.functions.lines import after_node, decoded, first_space, node_of, sniffed, without_line_end
from braidlog.functions.names import plain
from braidlog.operators.clustering import cluster, folded, slotted
from braidlog.operators.reports import printed, selected
from braidlog.sources.catalogue import SCHEMA, Catalogue, load, save
from braidlog.sources.lines import scan_any, scan_places
from braidlog.sources.storage import Storage

UNKNOWN = "_unknown"


def texts(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) with text: decoded, without a line end.

    Numbering left each file's lines in one task; what follows is most of the work and is dealt
    out over all cores.
    """
    spread = lines.repartition(lines.sparkSession.sparkContext.defaultParallelism, "file", "line_no")
    return spread.withColumn("text", without_line_end(decoded(F.col("line"))))


def verdicts(lines: DataFrame) -> DataFrame:
    """(file_, prefixed_, decided_): what the first line with a timestamp, bare or after a node, says of its file, and its number."""
    return lines.select("file", "line_no", sniffed(F.col("text")).alias("verdict")).where("verdict is not null").groupBy(F.col("file").alias("file_")).agg(F.min_by("verdict", "line_no").alias("prefixed_"), F.min("line_no").alias("decided_"))


def unprefixed(lines: DataFrame, verdict: DataFrame | None = None) -> DataFrame:
    """Takes node prefixes off `text`, in files of (file, line_no, text) that show them.

    A file's verdict holds from the line that decides it; lines before it stay as they are.
    """
    verdict = verdicts(lines) if verdict is None else verdict
    # a row for each file
    out = lines.join(F.broadcast(verdict), F.col("file") == F.col("file_"), "left")
    strip = F.coalesce(F.col("prefixed_") & (F.col("line_no") >= F.col("decided_")), F.lit(False))
    return out.withColumn("text", F.when(strip, after_node(F.col("text"))).otherwise(F.col("text"))).drop("file_", "prefixed_", "decided_")


def sequenced(lines: DataFrame) -> DataFrame:
    """Adds seq: the order of lines over files in byte order of their names, from (file, line_no)."""
    order = lines.select("file").distinct().withColumn("place_", F.row_number().over(Window.orderBy("file")).cast("long") - 1).withColumnRenamed("file", "file_")
    return lines.join(F.broadcast(order), F.col("file") == F.col("file_")).withColumn("seq", F.shiftleft("place_", 40) + F.col("line_no")).drop("file_", "place_")


def empty(spark: SparkSession, depth: int = 4, threshold: float = 0.5) -> Catalogue:
    return Catalogue(spark.createDataFrame([], SCHEMA), depth, threshold)


#: Of so many first lines of a file one nearly always has a timestamp.
HEAD = 1000


def slots_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(category, seq, timestamp, slots) of the lines of files, in byte order of their names.

    Lines are read once: what decides about a file's prefixes is in its first lines, and only
    files where it is not are read for that.
    """
    paths = sorted(paths, key=lambda p: (p.rsplit("/", 1)[-1].encode(), p.encode()))
    found: dict[int, tuple[bool, int]] = {}
    for most in (HEAD, 0):
        open_ = [i for i in range(len(paths)) if i not in found]
        if open_:
            heads = texts(scan_places(spark, [paths[i] for i in open_], most))
            found |= {open_[int(r["file_"])]: (r["prefixed_"], r["decided_"]) for r in verdicts(heads).collect()}
    lines = texts(scan_places(spark, paths))
    told = spark.createDataFrame([(str(i), *v) for i, v in found.items()], "file_ string, prefixed_ boolean, decided_ bigint")
    lines = unprefixed(lines, told).withColumn("seq", F.shiftleft(F.col("file").cast("long"), 40) + F.col("line_no"))
    return slotted(lines, "text").select("category", "seq", "timestamp", "slots")


def ingest(catalogue: Catalogue, lines: DataFrame) -> Catalogue:
    """`catalogue` after raw lines (file, line_no, line)."""
    return folded(catalogue, slotted(sequenced(unprefixed(texts(lines))), "text").select("category", "seq", "timestamp", "slots"))


def ingest_files(catalogue: Catalogue, spark: SparkSession, paths: list[str]) -> Catalogue:
    """`catalogue` after the lines of files, in byte order of their names."""
    return folded(catalogue, slots_of(spark, paths)) if paths else catalogue


def templates(
    spark: SparkSession,
    path: str | None = None,
    *,
    depth: int = 4,
    threshold: float = 0.5,
    min_count: int = 1,
    categories: Sequence[str] = (),
    top: int | None = None,
    load_state: str | None = None,
    save_state: str | None = None,
) -> DataFrame:
    """The report of a log's templates, over those of a loaded catalogue.

    depth and threshold are the catalogue's if one is loaded. A saved catalogue is whole,
    whatever the report leaves out. If none is saved or loaded, lines of other categories than
    those asked for need not be clustered at all: trees and ids are each category's own.
    """
    catalogue = load(spark, load_state) if load_state else empty(spark, depth, threshold)
    if path is not None:
        if categories and not save_state:
            catalogue = folded(catalogue, slots_of(spark, [path]).where(F.col("category").isin(list(categories))))
        else:
            catalogue = ingest_files(catalogue, spark, [path])
    if save_state:
        save(catalogue, save_state)
        catalogue = load(spark, save_state)  # what was written, not computed again
    return selected(catalogue.clusters, min_count, categories, top)


def by_node(lines: DataFrame) -> DataFrame:
    """(node, seq, text) of a merged log's (file, line_no, line): each line is split at its first space.

    A line without a space, or with nothing before it, is of the node `_unknown`. A first
    timestamp without a node before it, or a node that cannot be a file's name, is an error.
    """
    own = texts(lines)
    verdict = own.select("line_no", sniffed(F.col("text")).alias("verdict")).where("verdict is not null").agg(F.min_by("verdict", "line_no").alias("v")).first()
    if verdict["v"] is False:
        raise ValueError("reports by node need a merged log, with a node before each line")
    text = F.col("text")
    out = own.select(F.when(first_space(text) > 1, node_of(text)).otherwise(UNKNOWN).alias("node"), F.col("line_no").alias("seq"), F.when(first_space(text) > 0, after_node(text)).otherwise(text).alias("text"))
    odd = out.where(~plain(F.col("node"))).select("node").limit(1).collect()
    if odd:
        raise ValueError(f"node name is not a file name: {odd[0]['node']}")
    return out


def node_templates(nodes: DataFrame, depth: int = 4, threshold: float = 0.5) -> DataFrame:
    """Clusters of (node, seq, text), each node on its own."""
    return cluster(slotted(nodes, "text").select("node", "category", "seq", "timestamp", "slots"), depth, threshold)


def per_node(
    spark: SparkSession,
    path: str,
    folder: str,
    *,
    depth: int = 4,
    threshold: float = 0.5,
    min_count: int = 1,
    categories: Sequence[str] = (),
    top: int | None = None,
    json: bool = False,
) -> list[str]:
    """One report file `<node>.txt` or `.json` for each node of a merged log; the files written."""
    nodes = by_node(scan_any(spark, [path]))
    every = sorted(r["node"] for r in nodes.select("node").distinct().collect())
    report = selected(node_templates(nodes, depth, threshold), min_count, categories, top).persist()
    storage, out = Storage(spark), []
    try:
        storage.make_dir(folder)
        for node in every:
            target = f"{folder}/{node}.{'json' if json else 'txt'}"
            own = report.where(F.col("node") == node).drop("node")
            storage.publish(target, (f"{line}\n".encode() for line in printed(own, json)))
            out.append(target)
    finally:
        report.unpersist()
    return out
