"""Places and running maxima of rows within groups that are sorted by ranges: no group passes through one task.

Each partition is summed up by itself, the sums of one row a partition are carried over the
partitions in order, and each partition is then passed over once more with what comes before it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from braidlog.session import settled, ship


Run = tuple[int, int, str]  # a group, its number of rows, its largest value


def carried(summaries: list[tuple[int, Run, Run]]) -> dict[int, tuple[int, str]]:
    """How many rows of its first group come before each partition, and their largest value.

    summaries: partition, its first and its last run.
    """
    out: dict[int, tuple[int, str]] = {}
    last, total, most = None, 0, ""
    for partition, first, final in sorted(summaries):
        out[partition] = (total, most) if first[0] == last else (0, "")
        n, high = out[partition]
        total, most = (n + first[1], max(high, first[2])) if first[0] == final[0] else final[1:]
        last = final[0]
    return out


def _scanned(before: dict[int, tuple[int, str]]):
    """For mapInArrow over partitions in order, (group_, value_, ...): place_ and most_ in their stead."""

    def run(batches):
        group, (n, high) = None, before.get(TaskContext.get().partitionId(), (0, ""))
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            if group is not None and groups[0] != group:
                n, high = 0, ""
            begins = np.concatenate(([0], np.flatnonzero(groups[1:] != groups[:-1]) + 1))
            length = np.diff(np.concatenate((begins, [len(groups)])))
            place = np.arange(len(groups)) - np.repeat(begins, length)
            place[: length[0]] += n
            most = np.empty(len(values), dtype=object)
            for at, size in zip(begins.tolist(), length.tolist(), strict=True):
                most[at : at + size] = np.maximum.accumulate(values[at : at + size])
            most[: length[0]] = np.maximum(most[: length[0]], high)
            n, group, high = int(place[-1]) + 1, groups[-1], most[-1]
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(most, type=pa.string()), *batch.columns[2:]], names=["place_", "most_", *batch.schema.names[2:]])

    return run


def scanned(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column | None = None) -> DataFrame:
    """`rows` with place_, from 0, and most_, the largest string `value` so far, within each `group` by `order`.

    Nulls come first, are a group too, and are '' as values. Rows are dealt out in ranges, so a group of any size is
    spread; the driver holds two runs a partition. Rows equal in group and order stand in no fixed order among themselves.
    """
    ship(rows.sparkSession)
    value = F.lit("") if value is None else F.coalesce(value, F.lit(""))
    keyed = rows.withColumn("group_", F.xxhash64(*(F.col(c) for c in group), *(F.col(c).isNull() for c in group))).withColumn("value_", value)
    sorted_ = settled(keyed.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order))
    at = sorted_.select("group_", "value_", F.spark_partition_id().alias("partition"), F.monotonically_increasing_id().alias("at"))
    each = at.groupBy("partition", "group_").agg(F.count("*").alias("n"), F.max("value_").alias("most"), F.min("at").alias("at"))
    run = F.struct("at", "group_", "n", "most")
    ends = each.groupBy("partition").agg(F.min(run).alias("a"), F.max(run).alias("b")).collect()
    before = carried([(r["partition"], tuple(r["a"][1:]), tuple(r["b"][1:])) for r in ends])
    schema = StructType([StructField("place_", LongType()), StructField("most_", StringType()), *(rows.schema[c] for c in rows.columns)])
    return sorted_.select("group_", "value_", *rows.columns).mapInArrow(_scanned(before), schema)


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str], to: str = "place") -> DataFrame:
    """`rows` with the place, from 0, of each within its `group` by `order`; see scanned."""
    return scanned(rows, group, order).select(*rows.columns, F.col("place_").alias(to))
