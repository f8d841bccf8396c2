"""Filtered, ranked and rendered views of clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlog.functions.text import report_string
from braidlog.functions.tokens import rendered


def selected(clusters: DataFrame, min_count: int = 1, categories: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """`clusters` with at least min_count lines, of the categories asked for (all if none is), the `top` of each.

    rank is by count, most first, then id. A node column, if there is one, ranks apart. Any
    category filter leaves out clusters without a category.
    """
    out = clusters.where(F.col("count") >= min_count)
    if categories:
        out = out.where(F.col("category").isin(list(categories)))
    own = [c for c in ("node", "category") if c in clusters.columns]
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("count"), "id")))
    return out if top is None else out.where(F.col("rank") <= top)


def _order(report: DataFrame) -> list:
    node = [F.col("node").asc_nulls_first()] if "node" in report.columns else []
    return [*node, F.col("category").asc_nulls_first(), F.col("rank")]


def in_order(report: DataFrame) -> DataFrame:
    """Categories by their bytes, none first; then rank."""
    return report.orderBy(*_order(report))


def json_lines(report: DataFrame) -> DataFrame:
    """Adds text: one JSON object for each cluster."""
    parts = ['{"category":', report_string(F.col("category")), ',"count":', F.col("count").cast("string"), ',"first_seen":', report_string(F.col("first_seen")), ',"template":', report_string(rendered(F.col("template"))), "}"]
    return report.withColumn("text", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def text_lines(report: DataFrame) -> DataFrame:
    """Adds text: a right-aligned count and the template; the first of a category has its heading before it."""
    heading = F.concat(F.lit("=== "), F.coalesce("category", F.lit("(no category)")), F.lit(" ===\n"))
    line = F.concat(F.lpad(F.col("count").cast("string"), F.greatest(F.lit(6), F.length(F.col("count").cast("string"))), F.lit(" ")), F.lit(" "), rendered(F.col("template")))
    return report.withColumn("text", F.when(F.col("rank") == 1, F.concat(heading, line)).otherwise(line))


def printed(report: DataFrame, json: bool = False):
    """The report's lines in order, for a file or a terminal; the driver sees one row for each cluster shown."""
    rows = in_order(json_lines(report) if json else text_lines(report)).select("rank", "text").toLocalIterator()
    for i, r in enumerate(rows):
        if i and not json and r["rank"] == 1:
            yield ""
        yield r["text"]


def check_lines(report: DataFrame):
    """The lines of a round-trip report (date, node, ok, lines) in order, then its totals."""
    n_ok = n = 0
    for r in report.orderBy("date", "node").toLocalIterator():
        n, n_ok = n + 1, n_ok + bool(r["ok"])
        yield f"  {r['date']}  {r['node']:<14} {'OK  ' if r['ok'] else 'FAIL'}  {r['lines']} lines"
    yield f"check: {n_ok}/{n} files round-trip identical"
