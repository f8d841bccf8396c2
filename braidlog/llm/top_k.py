"""Exact top-k search by inner product: ball trees in shards, branch and bound by upper bounds.

Rows are dealt out into shards, each of which gets a ball tree. A query visits a tree's leaves
in the order of their upper bound q.c + |q| r and stops where the bound falls below its kth
score so far. Each query first searches one shard, and takes the kth score found there to all
others, where most leaves are then cut off at once.

Bounds and first scores are floating point, with a slack for their rounding; where products
can pass 2^53, rows within the slack get their score in whole numbers of any size.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlog.llm.tables import settled
from braidlog.session import ship

SHARD, LEAF = 8192, 128
EXACT = 2.0**53
LONG = (-(1 << 63), (1 << 63) - 1)


class BallTree:
    """A tree over integer-valued vectors; nodes are (center, radius, children or the leaf's rows)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.centers, self.radii, self.children, self.rows = [], [], [], []
        if len(ids):
            self._grow(np.arange(len(ids)), leaf)
            self.center_of, self.radius_of = np.array(self.centers), np.array(self.radii)
            self.reach = float(np.sqrt((self.x**2).sum(axis=1)).max())

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        own = self.x[rows]
        center = own.mean(axis=0)
        apart = np.sqrt(((own - center) ** 2).sum(axis=1))
        node = len(self.centers)
        self.centers.append(center)
        self.radii.append(float(apart.max()) * (1 + 1e-9) + 1e-9)
        self.children.append(())
        self.rows.append(rows)
        if len(rows) > leaf and apart.max() > 0:
            one = own[apart.argmax()]
            two = own[((own - one) ** 2).sum(axis=1).argmax()]
            side = own @ (two - one)
            half = np.argsort(side, kind="stable")
            cut = len(rows) // 2
            self.rows[node] = None
            self.children[node] = (self._grow(np.sort(rows[half[:cut]]), leaf), self._grow(np.sort(rows[half[cut:]]), leaf))
        return node

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int, least: np.ndarray, power: int = 0):
        """(query, id, score) of each query's best k by score, then id, none under its `least` and none with its own id.

        All queries go on together: at each turn each one is at the leaf with its next highest
        bound, unless that is under its kth score, and those at one leaf are scored in one
        product. Vectors are whole numbers, or those divided by powers of two, `power` being the
        sum of the tree's and the queries' exponents. Scores are held to a long's range, whose
        least value as `least` stands for none.
        """
        size = np.sqrt((queries**2).sum(axis=1))
        bounds = queries @ self.center_of.T + size[:, None] * self.radius_of
        bounds += 1e-9 * size[:, None] * (np.sqrt((self.center_of**2).sum(axis=1)) + self.radius_of) + math.ldexp(1e-6, -power)
        for node, children in enumerate(self.children):
            for child in children:
                np.minimum(bounds[:, child], bounds[:, node], out=bounds[:, child])
        leaves = np.array([node for node, children in enumerate(self.children) if not children])
        turns = leaves[np.argsort(-bounds[:, leaves], axis=1, kind="stable")]
        top = float(np.abs(self.x).max()) * np.abs(queries).max(axis=1) * queries.shape[1]
        slack = np.where((top < EXACT) & (power == 0), 0.0, queries.shape[1] * 2.0**-51 * size * self.reach)
        kth, under = least.astype(np.int64), _floor(least, power)
        ids, scores = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k), np.int64)
        held = np.zeros((len(queries), k), bool)
        active = np.arange(len(queries))
        for turn in range(len(leaves)):
            at = turns[active, turn]
            going = bounds[active, at] >= under[active]
            active, at = active[going], at[going]
            if not len(active):
                break
            for leaf in np.unique(at):
                group, rows = active[at == leaf], self.rows[leaf]
                near = queries[group] @ self.x[rows].T
                good = (near >= (under - slack)[group, None]) & (self.ids[rows] != own_ids[group, None])
                some = good.any(axis=1)
                if not some.any():
                    continue
                group, near, good = group[some], near[some], good[some]
                whole = np.zeros(near.shape, np.int64)
                exact = good & (slack[group] == 0)[:, None]
                whole[exact] = near[exact]
                for i, j in np.argwhere(good & ~exact):
                    whole[i, j] = _whole(self.x[rows[j]], queries[group[i]], power)
                good &= whole >= kth[group, None]
                every_id = np.hstack([ids[group], np.broadcast_to(self.ids[rows], near.shape)])
                every_score, every_held = np.hstack([scores[group], whole]), np.hstack([held[group], good])
                best = np.lexsort((every_id, ~every_score, ~every_held), axis=1)[:, :k]
                ids[group], scores[group], held[group] = (np.take_along_axis(x, best, axis=1) for x in (every_id, every_score, every_held))
                full = group[held[group, k - 1]]
                kth[full] = np.maximum(kth[full], scores[full, k - 1])
                under[full] = _floor(kth[full], power)
        query, place = np.nonzero(held)
        return own_ids[query], ids[query, place], scores[query, place]


def _floor(kth: np.ndarray, power: int) -> np.ndarray:
    """What floating-point scores and bounds have to reach; all below a long's least value tie with it."""
    near = kth.astype(np.float64)
    near = np.where(np.abs(near) < EXACT, near, np.nextafter(near, -np.inf))
    return np.where(kth <= LONG[0], -np.inf, np.ldexp(near, -power))


def _whole(x: np.ndarray, q: np.ndarray, power: int) -> int:
    """The inner product in whole numbers, held to a long's range."""
    total = sum(Fraction(a) * Fraction(b) for a, b in zip(x.tolist(), q.tolist(), strict=True)) * 2**power
    return min(max(int(total), LONG[0]), LONG[1])


def _scaled_down(x: np.ndarray) -> tuple[np.ndarray, int]:
    """x over a power of two that keeps squares finite, and its exponent, which is 0 unless x is huge."""
    top = float(np.abs(x).max()) if x.size else 0.0
    power = max(0, math.frexp(top)[1] - 400)
    return np.ldexp(x, -power), power


def _searcher(k: int, scale: float):
    """For mapInArrow over rows sorted so that a shard's vectors come before its queries."""

    def run(batches):
        held, tree, where, power = None, None, None, 0
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                values = np.asarray(part.column("embedding").flatten(), dtype=np.float64)
                x = np.floor(scale * values).reshape(hi - lo, -1)
                ids = part.column("vec_id").to_numpy()
                if where != shard[lo]:
                    where, held, tree = shard[lo], [], None
                if not kind[lo]:
                    held.append((ids, x))
                    continue
                if not held:
                    continue
                if tree is None:
                    all_x, power = _scaled_down(np.concatenate([h[1] for h in held]))
                    tree = BallTree(np.concatenate([h[0] for h in held]), all_x)
                x, own_power = _scaled_down(x)
                least = part.column("least").fill_null(LONG[0]).to_numpy()
                found = tree.search(x, ids, k, least, power + own_power)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int, k: int, scale: float = 64.0, shard_rows: int = SHARD) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vector whose vec_id `every` divides, the k best of all others.

    A component x counts as floor(scale * x); the score is the integer inner product, held to
    the range of a long; equal scores rank by vec_id. Vectors that are null or hold a null or
    a non-finite component (times `scale`), or without a vec_id, take no part. Vectors are compared with those
    of their own dimension. Of rows with one vec_id the least vector counts. With fewer than k
    others a query has them all; an empty table gives no rows. Other columns are ignored.

    A task holds a tree over about `shard_rows` vectors and streams the queries past it. The
    result of a query is merged from at most k rows of each shard.
    """
    ship(vectors.sparkSession)
    good = (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float("inf"))))
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
    )
    good = settled(good.withColumn("dims", F.size("embedding")))
    shards = max(1, -(-good.count() // shard_rows))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    # vectors of another dimension have shards of their own
    placed = good.select((F.col("dims").cast("long") * shards + home).alias("shard"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(None).cast("long").alias("least"), "dims")
    queries = good.where(F.pmod("vec_id", F.lit(every)) == 0)
    columns = ["shard", "kind", "vec_id", "embedding", "least"]

    def searched(asked: DataFrame) -> DataFrame:
        both = placed.select(columns).unionAll(asked.select(columns)).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "vec_id")
        return both.mapInArrow(_searcher(k, scale), "query_id bigint, vec_id bigint, score bigint")

    at_home = F.col("dims").cast("long") * shards + home
    first = settled(searched(queries.select(at_home.alias("shard"), F.lit(1).alias("kind"), "vec_id", "embedding", F.lit(None).cast("long").alias("least"))))
    out = first
    if shards > 1:
        kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        away = (
            queries.join(kth, "vec_id", "left")
            .withColumn("home", home)
            .select("dims", "home", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("other"), F.lit(1).alias("kind"), "vec_id", "embedding", "least")
            .where("other <> home")
            .withColumn("shard", F.col("dims").cast("long") * shards + F.col("other"))
        )
        out = first.unionAll(searched(away))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
