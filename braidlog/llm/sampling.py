"""Bounded samples of labelled documents for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


DRAW = 1 << 30


def drawn(rows: DataFrame, group: str, per_group: int, columns: list[str]) -> DataFrame:
    """About the first 4 * per_group rows of each group by the hash of doc_id, or all; `draw` is that hash.

    The share is taken from counts, so that what follows is bounded however large the table is
    and over however many tasks.
    """
    counts = rows.groupBy(F.col(group).alias("group_")).agg(F.count("*").alias("n_"))
    # one row for each label or language
    known = rows.join(F.broadcast(counts), F.col(group) == F.col("group_")).withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(DRAW)))
    return known.where(F.col("draw") * F.col("n_") < F.lit(4 * per_group).cast("double") * DRAW).select(*columns, "draw")


def labelled(docs: DataFrame, labels: DataFrame, label: str, trains: Column, per_class: int) -> list[tuple[str, int]]:
    """At most `per_class` texts of each label 0 and 1, of any length, by the hash of their id.

    `trains` says which doc_ids may be learned from. The bounds hold whatever the tables' size;
    they are of the fit alone, never of what is scored.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(trains).select("doc_id", F.col(label).alias("label")).distinct()
    ids = drawn(known, "label", per_class, ["doc_id", "label"])  # ids are drawn before any text moves
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    out = []
    for kind in (0, 1):
        rows = texts.where(F.col("label") == kind).orderBy("draw", "doc_id", "text").limit(per_class).collect()
        out += [(r["text"], kind) for r in rows]
    return out
