"""Catalogues that grow with each new log, exactly once, by Structured Streaming, and days merged once."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from braidlog.functions.names import day_file_name
from braidlog.operators.reports import printed, selected
from braidlog.plans.days import MergeReport, merge
from braidlog.plans.templates import empty, ingest_files, per_node
from braidlog.session import ship
from braidlog.sources.catalogue import load, save
from braidlog.sources.lines import discover
from braidlog.sources.storage import Storage
from braidlog.streaming.names import NameSource


def fold_batch(spark: SparkSession, state: str, paths: list[str], batch: int, depth: int, threshold: float) -> bool:
    """Fold the logs at `paths` into the catalogue at `state`, unless it has `batch` already.

    The catalogue names the last batch in it, and both are written by one rename: a batch that
    is tried again after a crash is folded once.
    """
    catalogue = load(spark, state) if Storage(spark).exists(state) else empty(spark, depth, threshold)
    if catalogue.batch is not None and catalogue.batch >= batch:
        return False
    if paths:
        catalogue = ingest_files(catalogue, spark, paths)
    catalogue.batch = batch
    save(catalogue, state)
    return True


def accumulate(
    spark: SparkSession,
    inputs: str | Sequence[str],
    state: str,
    checkpoint: str,
    *,
    pattern: str = "debug.log-*",
    depth: int = 4,
    threshold: float = 0.5,
    files_at_once: int | None = None,
    report: str | None = None,
    node_folder: str | None = None,
    json_report: bool = False,
    on_batch: Callable[[int, list[str]], None] | None = None,
) -> None:
    """Fold every log of `inputs`, files and folders (not below them), that was not there before into the catalogue at `state`.

    The stream's checkpoint remembers which files were taken, so inputs may be added or left out
    later; it ends when all are in. Files of one batch are folded in byte order of their paths. After
    each batch the catalogue's report takes the place of the file `report`, and each new log's
    reports by node those of its nodes in `node_folder`.
    """
    ship(spark)
    spark.dataSource.register(NameSource)
    known = [Storage(spark).qualified(x) for x in ([inputs] if isinstance(inputs, str) else inputs)]
    stream = spark.readStream.format("braidlog_names").options(inputs=json.dumps(known), pattern=pattern, most=str(files_at_once or 0)).load()

    taken = 0

    def run(rows: DataFrame, batch: int) -> None:
        nonlocal taken
        paths = sorted((r["path"] for r in rows.collect()), key=str.encode)
        taken += len(paths)
        folded = fold_batch(spark, state, paths, batch, depth, threshold)
        # reports follow from the catalogue: a batch that is tried again makes them again
        if report:
            lines = printed(selected(load(spark, state).clusters), json_report)
            Storage(spark).publish(report, (f"{x}\n".encode() for x in lines))
        for path in paths if node_folder else ():
            per_node(spark, path, node_folder, depth=depth, threshold=threshold, json=json_report)
        if folded and on_batch:
            on_batch(batch, paths)

    # what is available is settled as a stream begins, and is files_at_once names at most
    while True:
        before = taken
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if not files_at_once or taken == before:
            return


MERGED = "_merged.json"


def merge_new_days(spark: SparkSession, folder: str, output: str, *, today: str | None = None, after: Iterable[Callable[[list[str]], None]] = (), **options) -> MergeReport:
    """Merge the days before today (YYYYMMDD, in UTC) that `output` lacks; the day still being written waits.

    A file in `output` lists the days that are there with the name, size and time of each input. A
    day is merged if it is not listed, its file is gone, or an input is new, gone or changed.
    """
    today = today or datetime.datetime.now(datetime.UTC).strftime("%Y%m%d")
    storage, listed = Storage(spark), f"{output}/{MERGED}"
    done = json.loads(storage.read(listed)) if storage.exists(listed) else {}
    inputs: dict[str, list] = {}
    for f in discover(spark, folder, today):
        inputs.setdefault(f.date, []).append([f.name, *storage.stamp(f.path)])
    new = {d for d, files in inputs.items() if done.get(d) != files or not storage.exists(f"{output}/{day_file_name(d)}")}
    if inputs and not new:
        return MergeReport()

    def remember(days: list[str]) -> None:
        done.update({d: files for d, files in inputs.items() if day_file_name(d) in days})
        storage.publish(listed, [json.dumps(done, sort_keys=True).encode()])

    return merge(spark, folder, output, before=today, days=new, after=[remember, *after], **options)
