"""Connected components of an edge list, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.llm.tables import dealt_anew, settled


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def _settled(edges: DataFrame) -> DataFrame:
    """Settled, without Spark's estimate of its size: joins multiply it, so its digits would double in every round."""
    spark, done = edges.sparkSession, settled(edges)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b), integers: (node, root), root the least node reachable; nodes without edges are absent.

    Loops and repeated edges are allowed. Each round joins edges with the least neighbour of
    their end, which is aggregated before it is dealt out: a hub with very many edges makes
    one row of the aggregate, and adaptive execution splits its side of the join.
    """
    edges = _settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(dealt_anew(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = _settled(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt_anew(least, "a"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = _settled(small.select("e.a", "e.b").where("a <> b").distinct())
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
