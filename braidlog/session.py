"""A session with what the engine relies on: UTC, ANSI arithmetic, adaptive execution."""

from __future__ import annotations

import gc
import os
import tempfile
import time
from functools import partial

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The active session or a new one; `settings` with __ for dots are added."""
    builder = SparkSession.builder.appName("braidlog").config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose machines do not share this folder, submit with --py-files instead.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def settled(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the cluster's shared checkpoint folder.

    Lost executors cost nothing that was settled. Only where spark.checkpoint.dir is unset
    (tests, a single machine) a folder of this machine is used; a cluster's executors could not
    see each other's, so there it is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="braidlog-"))
    return df.checkpoint(eager=True)


#: Bytes of a batch that are zipped as one, at most, but for a longer row.
ZIPPED = 1 << 24


def zipped(batches):
    """Batches, each as one or more rows of a compressed Arrow stream."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for batch in batches:
        step = max(1, batch.num_rows * ZIPPED // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                stream.write_batch(batch.slice(at, step))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["zipped"])


def _unzipped(batches, names: list[str]):
    for batch in batches:
        for row in batch.column(0):
            known = pa.ipc.open_stream(row.as_buffer()).schema.names
            options = pa.ipc.IpcReadOptions(included_fields=[known.index(x) for x in names])
            for part in pa.ipc.open_stream(row.as_buffer(), options=options):
                yield part.select(names)


class Zipped:
    """Rows that are kept compressed on disk, some thousands together; of them only the columns that are asked for are unpacked.

    Shared ones are settled, and stay while a DataFrame needs them; others are on the executors' disks until drop().
    """

    def __init__(self, rows: DataFrame, schema: StructType | None = None, shared: bool = False):
        """schema: that of the rows, if they are zipped already."""
        ship(rows.sparkSession)
        self.schema = schema or rows.schema
        own = rows if schema else rows.mapInArrow(zipped, "zipped binary")
        self.rows = settled(own) if shared else own.persist(StorageLevel.DISK_ONLY)
        self.n = None if shared else self.rows.count()

    def frame(self, *names: str) -> DataFrame:
        names = names or tuple(self.schema.names)
        return self.rows.mapInArrow(partial(_unzipped, names=list(names)), StructType([self.schema[x] for x in names]))

    def drop(self) -> None:
        self.rows.unpersist()


def tidied(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any more go; else Spark drops them after the driver's next full collection."""
    gc.collect()  # DataFrames stand in cycles
    time.sleep(1.5)  # Python tells the JVM once a second what it has let go
    spark.sparkContext._jvm.System.gc()
