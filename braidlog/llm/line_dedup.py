"""Removal of lines that many documents share (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.llm.tables import settled

BLANKS = "\x20\t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """`line` without ASCII blanks at both ends, A-Z lower-cased (other letters stay)."""
    line = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(line) == F.length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase))


def _digest(line: Column, min_chars: int) -> Column:
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))


def drop_common_lines(docs: DataFrame, min_chars: int = 1, min_docs: int = 10) -> DataFrame:
    """Drop every line whose key at least `min_docs` documents hold; order of the rest is kept.

    Returns all rows and columns of `docs` with `text` rebuilt, plus n_lines and n_dropped.
    Null text counts as empty; an empty text is one empty line. Keys shorter than `min_chars`
    code points are never dropped. Repeated rows of one doc_id count as one document, and so
    do all rows without a doc_id; each row loses the lines of its own text. Ties do not arise.
    An empty table gives no rows. Texts of any length a string can have are taken whole, in
    time linear in their lines. A column of `docs` named n_lines or n_dropped is replaced; no
    other name clashes.

    Lines are digested once. Digests are dealt out to count distinct documents (with map-side
    combining, so a line of any frequency makes few rows), and again to find the places of the
    common ones (a join that adaptive execution splits where one line is frequent). Texts move
    once, to meet the dropped places of their own rows.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = lambda row: F.coalesce(row["text"], F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("row_hash"))
    split = rows.select("doc_id", "row_hash", F.posexplode(F.split(text(F.col("row")), "\n", -1)).alias("line_no", "line"))
    lines = settled(split.select("doc_id", "row_hash", "line_no", _digest(F.col("line"), min_chars).alias("digest"))).where(F.col("digest").isNotNull())
    common = (
        lines.groupBy("digest")
        .agg(F.count_distinct(F.struct("doc_id")).alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
        # written anew, or the join would take this side where the aggregate left it and a
        # frequent line's task could not be split
        .select(F.substring("digest", 1, 16).alias("digest"))
    )
    places = lines.join(common, "digest").groupBy(F.col("doc_id").alias("hit_id"), F.col("row_hash").alias("hit_hash")).agg(F.collect_set("line_no").alias("dropped"))
    out = rows.join(places, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_hash") == F.col("hit_hash")), "left")
    row, dropped = F.col("row"), F.col("dropped")
    n_lines = F.octet_length(text(row)) - F.octet_length(F.replace(text(row), F.lit("\n"), F.lit(""))) + 1
    all_lines = F.split(text(row), "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), n_lines - 1), dropped), lambda i: F.get(all_lines, i)), "\n")
    return out.select(
        *(F.when(dropped.isNull(), text(row)).otherwise(kept).alias("text") if c == "text" else row[c].alias(c) for c in columns),
        n_lines.cast("long").alias("n_lines"),
        F.when(dropped.isNull(), 0).otherwise(F.size(dropped)).cast("long").alias("n_dropped"),
    )
