"""Sets of word shingles of documents, the nodes that rows with equal sets share, and what links make of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.llm.tables import broadcast_if_few, dealt_anew
from braidlog.llm.words import NOT_BLANK, U64, Texts, grams, lists, mix, over_slices
from braidlog.session import ship

#: Nodes that are broadcast at most: 16 bytes each.
BROADCAST = 500_000


def sets_of(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each has."""
    words = Texts(batch.column("text"), NOT_BLANK)
    g, bounds = grams(words.w, shingle), words.bounds
    out, counts = [], np.zeros(batch.num_rows, dtype=np.int64)
    for i, n in enumerate(words.counts):
        if not n:
            continue
        a = bounds[i]
        own = np.sort(g[a : a + n - shingle + 1]) if n >= shingle else grams(words.w[a : a + n], int(n))
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out.append(own)
        counts[i] = len(own)
    return (np.concatenate(out) if out else np.empty(0, dtype=U64)), counts


def set_keys(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    keys = np.zeros(len(counts), dtype=U64)
    np.add.at(keys, np.repeat(np.arange(len(counts)), counts), mix(values ^ U64(0x5851F42D4C957F2D)))
    return mix(keys + counts.astype(U64))


def _checked_shingles(shingle: int):
    """A kernel: the sets of the texts whose set has the key `node`, each once in a slice."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, counts = sets_of(batch, shingle)
        keys = set_keys(values, counts)
        first = np.zeros(len(keys), dtype=bool)
        first[np.unique(keys, return_index=True)[1]] = True
        out = pa.RecordBatch.from_arrays([batch.column("node"), lists(pa.array(values.view(np.int64)), counts)], names=["node", "shingles"])
        return out.filter(pa.array(first & (keys.view(np.int64) == batch.column("node").to_numpy(zero_copy_only=False))))

    return over_slices(kernel)


def nodes_of(sketch: DataFrame) -> DataFrame:
    """(node, least_id, n_shingles) of rows (doc_id, n_shingles, node): rows with equal sets are one node."""
    return sketch.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n_shingles"))


def sets_of_nodes(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of `nodes` (node, least_id), one row each, however often a node's row is repeated.

    Up to BROADCAST nodes are broadcast, so that no text moves; texts meet more of them by doc_id.
    """
    ship(docs.sparkSession)
    wanted = nodes.select("node", F.col("least_id").alias("doc_id"))
    found = docs.select("doc_id", "text").join(broadcast_if_few(wanted, BROADCAST), "doc_id").select("node", "text")
    return found.mapInArrow(_checked_shingles(shingle), "node bigint, shingles array<bigint>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def with_components(sketch: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n_shingles, component_id) of `sketch`, for the components `roots` (node, root) of its nodes.

    component_id is the least doc_id of a component; a row without a doc_id has none.
    """
    least = nodes.join(roots, "node").groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = nodes.join(roots.join(dealt_anew(least, "root"), "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"))
    return (
        sketch.select("doc_id", "row_hash", "n_shingles", "node")
        .join(dealt_anew(of_node, "node"), "node", "left")
        .select("doc_id", "row_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    )
