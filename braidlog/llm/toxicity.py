"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams of lower-cased characters (code points), a blank before
and after; long texts are taken a stretch at a time.
Each n-gram's feature is its naive Bayes log-count ratio, and a logistic regression over these
features is fitted on labelled texts; ratio and weight are then one number for each n-gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.llm.words import U64, constants, mix, over_slices
from braidlog.session import ship

SIZES, BITS = (3, 4, 5), 20

#: Characters whose n-grams are hashed at once.
STRETCH = 1 << 18


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(U64)
    codes[(codes >= 0x09) & (codes <= 0x0D)] = 0x20
    return codes


_stamp = np.zeros(1 << BITS, dtype=np.int32)


def distinct(found: np.ndarray) -> np.ndarray:
    """`found` without repeats, in linear time: of equal values the last to stamp its place stays."""
    places = np.arange(len(found), dtype=np.int32)
    _stamp[found] = places
    return found[_stamp[found] == places]


def features(text: str) -> np.ndarray:
    """The distinct features of a text."""
    out, c, most = np.empty(0, dtype=np.int32), constants(max(SIZES), 31), max(SIZES)
    padded = f" {text} "
    for at in range(0, len(padded), STRETCH):
        data = _codes(padded[at : at + STRETCH + most - 1])
        parts, partial = [out], None
        for n in range(1, most + 1):
            if len(data) < n:
                break
            last = data[n - 1 :] * c[n - 1]
            partial = last if partial is None else partial[: len(data) - n + 1] + last
            if n in SIZES:
                parts.append((mix(partial + U64(n)) >> U64(64 - BITS)).astype(np.int32))
        out = distinct(np.concatenate(parts))
    return out


def train(sample: list[tuple[str, int]], rounds: int = 150, penalty: float = 1e-4, certain: float = 3.5) -> tuple[np.ndarray, float]:
    """Weight of each feature and the bias.

    A ratio counts if it is `certain` standard errors from 0. A sample without one of the labels gives the other's rate alone.
    """
    size = 1 << BITS
    labels = np.array([y for _, y in sample], dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        return np.zeros(size, dtype=np.float32), float(np.log(rate / (1 - rate)))
    rows = [features(t) for t, _ in sample]
    up, down = np.ones(size), np.ones(size)
    for found, label in zip(rows, labels, strict=True):
        (up if label else down)[found] += 1
    ratio = np.log(up / labels.sum()) - np.log(down / (len(labels) - labels.sum()))
    # within its own sampling error a ratio tells nothing
    used = np.flatnonzero(np.abs(ratio) >= certain * np.sqrt(1 / up + 1 / down))
    to = np.full(size, -1, dtype=np.int32)
    to[used] = np.arange(len(used))
    rows = [(p := to[found])[p >= 0] for found in rows]
    counts, place = np.array([len(p) for p in rows]), np.concatenate(rows)
    r, w, bias = ratio[used], np.zeros(len(used)), 0.0
    owner = np.repeat(np.arange(len(labels)), counts)
    scaled = r[place]
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam on the whole sample
        z = np.bincount(owner, weights=scaled * w[place], minlength=len(labels)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        g, gb = np.bincount(place, weights=scaled * error[owner], minlength=len(used)) + penalty * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.02 / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size, dtype=np.float32)
    weights[used] = r * w
    return weights, float(bias)


def score(weights: np.ndarray, bias: float, text: str) -> float:
    """The probability that `text` is toxic."""
    z = bias + float(weights[features(text)].sum(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """Per row of `docs`: all its columns, then score (0 to 1) and predicted (1 if score >= threshold, else 0).

    The whole of each text is scored, in memory of a few times its size. Null and empty texts
    have no n-gram and get the bias's score; repeated rows are scored alike; an empty table
    gives no rows. Columns of `docs` named score or predicted are replaced. The model has a
    fixed size.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, bias = shared.value
        got = [score(weights, bias, x or "") for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, type=pa.float64())], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(over_slices(kernel), f"{fields}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
