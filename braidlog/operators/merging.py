"""Interleaving of the lines of many nodes, its inverse, and the proof that nothing was lost."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.functions.lines import ZERO_KEY, after_node, first_space, node_of, timestamp_key
from braidlog.operators.scans import scanned
from braidlog.session import ship


def keyed(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """`lines` (date, node, reader, line_no, line) with merge_key: the largest timestamp key so far in the file.

    A line without a timestamp goes with the one before it, and one whose clock stepped back
    goes after it, as in a merge that holds one pending line of each file. Files are cut into
    ranges of lines, and what is largest before each range is carried over them.
    """
    key = timestamp_key(F.decode("line", "ISO-8859-1")) if key is None else key
    out = scanned(lines, ["date", "reader"], ["line_no"], key)
    return out.select(*lines.columns, F.when(F.col("most_") == "", ZERO_KEY).otherwise(F.col("most_")).alias("merge_key"))


ORDER = ("date", "merge_key", "reader", "line_no")


def merged(lines: DataFrame) -> DataFrame:
    """All lines of each date in merge order: by running key, then by the files' order, then as they stood."""
    return keyed(lines).orderBy(*ORDER)


def prefixed(lines: DataFrame) -> DataFrame:
    """Adds merged_line, `<node> <line>` as bytes."""
    return lines.withColumn("merged_line", F.concat(F.col("node").cast("binary"), F.lit(b" "), F.col("line")))


def demultiplexed(merged_lines: DataFrame, *others: str) -> DataFrame:
    """(line_no, line) of a merged log as (node, line_no, line) with the prefix taken off, and the columns `others`; a line without one is an error."""
    # one byte is one character here, so places are those of bytes
    text = F.decode("line", "ISO-8859-1")
    bad = F.raise_error(F.concat(F.lit("line without a node: "), F.col("line_no").cast("string")))
    return merged_lines.select(
        F.when(first_space(text) > 0, F.encode(node_of(text), "ISO-8859-1")).otherwise(bad.cast("binary")).cast("string").alias("node"),
        "line_no",
        F.encode(after_node(text), "ISO-8859-1").alias("line"),
        *others,
    )


#: A Mersenne prime and a base: the digest of lines in order is the value of a polynomial.
PRIME, POINT = (1 << 127) - 1, 0x6A09E667F3BCC908BB67AE8584CAA73B


def joined(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """(lines, digest) of one run of lines and then another."""
    return a[0] + b[0], (a[1] * pow(POINT, b[0], PRIME) + b[1]) % PRIME


def _digested(keys: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[int, int]] = {}
        part = None
        for batch in batches:
            for *key, part, line in zip(*(batch.column(c).to_pylist() for c in (*keys, "part", "line")), strict=True):  # noqa: B007
                own = (*key, part)
                n, value = found.get(own, (0, 0))
                found[own] = n + 1, (value * POINT + int.from_bytes(hashlib.sha256(line).digest()[:15])) % PRIME
        if found:
            columns = [pa.array(list(x)) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in found.values()]), pa.array([f"{v:032x}" for _, v in found.values()])], names=[*keys, "part", "lines", "digest"])

    return run


def _composed(keys: tuple[str, ...]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = (0, 0)
        for n, digest in zip(group["lines"], group["digest"], strict=True):
            total = joined(total, (int(n), int(digest, 16)))
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "lines": [total[0]], "digest": [f"{total[1]:032x}"]})

    return run


def ordered_digests(rows: DataFrame, *keys: str) -> DataFrame:
    """Per string `keys`: lines, and a digest of their bytes and order, of (…, part, line) where parts hold their rows in order.

    A part's rows must be in one partition. Digests of neighbours make the digest of both, so
    parts are digested where they lie, a row for each key of each part is left, and no line gets a number.
    """
    ship(rows.sparkSession)
    schema = ", ".join(f"{k} string" for k in keys)
    parts = rows.select(*keys, F.col("part").cast("long").alias("part"), "line").mapInArrow(_digested(keys), f"{schema}, part bigint, lines bigint, digest string")
    return parts.groupBy(*keys).applyInPandas(_composed(keys), f"{schema}, lines bigint, digest string")


def digests(lines: DataFrame, *keys: str) -> DataFrame:
    """The same of (…, line_no, line) in any order: it is sorted by ranges first."""
    return ordered_digests(lines.repartitionByRange(*keys, "line_no").sortWithinPartitions(*keys, "line_no").withColumn("part", F.spark_partition_id()), *keys)


def checked(inputs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(date, node, ok, lines) for each of `inputs` (date, node): whether its digests before and after agree.

    Either table of digests may lack an input, which is then an empty file there.
    """
    both = inputs.select("date", "node")
    for side, found in (("before", before), ("after", after)):
        both = both.join(found.select("date", "node", F.col("lines").alias(f"lines_{side}"), F.col("digest").alias(f"digest_{side}")), ["date", "node"], "left")
    same = F.coalesce("lines_before", F.lit(0)).eqNullSafe(F.coalesce("lines_after", F.lit(0))) & F.coalesce("digest_before", F.lit("")).eqNullSafe(F.coalesce("digest_after", F.lit("")))
    return both.select("date", "node", same.alias("ok"), F.coalesce("lines_before", F.lit(0)).cast("long").alias("lines"))


def totals(report: DataFrame) -> DataFrame:
    """One row: how many files agree, of how many."""
    return report.agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n_files"))
