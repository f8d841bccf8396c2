"""Document quality by a byte-level convolutional network in numpy.

Bytes come in cells of CELL: for each byte its class, one of eight, and for the cell how well it
repeats the bytes a few places earlier. Learned filters, two cells wide, slide over all cells;
their outputs are averaged over overlapping chunks that cover the whole document, each filter's
largest chunk is taken (max-pooling), and one logistic unit combines the filters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.llm.words import over_slices
from braidlog.session import ship

CELL, LAGS, FILTERS, HALF = 8, 24, 16, 32  # a chunk is two halves of HALF cells
#: Cells of a long text that are held at once, a multiple of HALF.
STRETCH = 1 << 16
WIDTH = CELL * 8 + 2


def _classes() -> np.ndarray:
    """For each byte a one-hot row of its class, packed into 64 bits."""
    kind = np.full(256, 5)  # other ASCII symbols
    for i, members in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), (0x20, 0x0A), map(ord, ".,;:'\"-?()"))):
        kind[list(members)] = i
    kind[0x80:] = 6
    kind[[b for b in range(0x20) if b != 0x0A] + [0x7F]] = 7
    rows = np.zeros((256, 8), dtype=np.uint8)
    rows[np.arange(256), kind] = 1
    return rows.view(np.uint64).reshape(-1)


_CLASSES = _classes()


def cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of all cells, with an empty one after each text, and the number of cells of each text, that one included."""
    counts = np.array([-(-len(t) // CELL) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(t.ljust(int(n) * CELL, b"\0") for t, n in zip(texts, counts, strict=True)), dtype=np.uint8)
    place = np.concatenate([np.arange(int(n) * CELL, dtype=np.int32) for n in counts]) if texts else np.empty(0, dtype=np.int32)
    real = place < np.repeat([len(t) for t in texts], counts * CELL)
    x = np.zeros((len(data) // CELL, WIDTH), dtype=np.float32)
    x[:, : CELL * 8] = np.where(real, _CLASSES[data], np.uint64(0)).view(np.uint8).reshape(-1, CELL * 8)
    best = np.zeros(len(x), dtype=np.uint8)
    for lag in range(1, LAGS + 1):
        if lag >= len(data):
            break
        same = np.zeros(len(data), dtype=bool)
        np.equal(data[lag:], data[:-lag], out=same[lag:])
        same &= real & (place >= lag)  # of the same text
        np.maximum(best, np.bitwise_count(same.view(np.uint64)), out=best)
    x[:, CELL * 8] = best / CELL
    x[:, CELL * 8 + 1] = best == CELL
    return x, counts


class Network:
    """Weights: two cells by FILTERS, their biases, and the combining unit's."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "w": rng.normal(0, 0.25, (2, WIDTH, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, dtype=np.float32),
            "u": rng.normal(0, 0.3, FILTERS).astype(np.float32),
            "c": np.zeros(1, dtype=np.float32),
        }

    @staticmethod
    def _halves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each half-chunk begins among the cells, how many each text has, and how long each is."""
        per_text = -(-counts // HALF)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        begins = np.repeat(first, per_text) + HALF * (np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        return begins, per_text, np.diff(np.concatenate((begins, [counts.sum()])))

    def forward(self, x: np.ndarray, counts: np.ndarray, keep: bool = False):
        """Probability of label 1 of each text."""
        a = self._activations(x, np.cumsum(counts) - 1)
        begins, per_text, sizes = self._halves(counts)
        return self._pooled(np.add.reduceat(a, begins, axis=0), per_text, sizes, (a, begins) if keep else None)

    def _activations(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Outputs of the filters at each cell; those of a text's `last` cell see no other text's."""
        after = x[1:] @ self.p["w"][1]
        after[last[last < len(after)]] = 0
        a = x @ self.p["w"][0] + self.p["b"]
        a[:-1] += after
        return np.maximum(a, 0, out=a)

    def score(self, text: bytes) -> float:
        """Probability of label 1 of one text, however long, a stretch of cells at a time."""
        n, sums = -(-len(text) // CELL) + 1, []
        for at in range(0, n, STRETCH):
            m, lead = min(STRETCH, n - at), min(LAGS // CELL, at)
            # the cells before tell of repetition, the one after belongs to the last filter's width
            x = cells([text[(at - lead) * CELL : (at + m + 1) * CELL]])[0][lead : lead + m + 1]
            a = self._activations(x, np.array([len(x) - 1]))[:m]
            sums.append(np.add.reduceat(a, np.arange(0, m, HALF), axis=0))
        sizes = np.full(-(-n // HALF), HALF)
        sizes[-1] = n - HALF * (len(sizes) - 1)
        return float(self._pooled(np.concatenate(sums), np.array([len(sizes)]), sizes)[0])

    def _pooled(self, sums: np.ndarray, per_text: np.ndarray, sizes: np.ndarray, keep: tuple | None = None):
        last = np.cumsum(per_text) - 1
        follows = np.ones(len(sums), dtype=bool)
        follows[last] = False
        after = np.concatenate((sums[1:], sums[-1:])) * follows[:, None]
        total = (sizes + np.concatenate((sizes[1:], [0])) * follows)[:, None]
        # a text's last half makes no chunk of its own unless it is the only one
        chunk = (sums + after) / total
        alone = np.repeat(per_text == 1, per_text)
        chunk[~follows & ~alone] = 0
        top = np.maximum.reduceat(chunk, np.concatenate(([0], last[:-1] + 1)), axis=0)
        z = top @ self.p["u"] + self.p["c"]
        prob = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
        return (prob, (*keep, per_text, sizes, follows, total, chunk, top)) if keep else prob

    def gradients(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        prob, (a, begins, per_text, sizes, follows, total, chunk, top) = self.forward(x, counts, keep=True)
        error = ((prob - labels) / len(labels)).astype(np.float32)
        g = {"u": top.T @ error, "c": error.sum(keepdims=True)}
        text = np.repeat(np.arange(len(counts)), per_text)
        chosen = chunk == top[text]
        share = chosen / np.maximum(np.add.reduceat(chosen, np.concatenate(([0], np.cumsum(per_text)[:-1])), axis=0), 1)[text]
        d = share * (error[:, None] * self.p["u"])[text] / total
        d[1:] += d[:-1] * follows[:-1, None]
        da = np.repeat(d, sizes, axis=0).astype(np.float32) * (a > 0)
        g["b"] = da.sum(axis=0)
        inner = da[:-1].copy()
        inner[np.cumsum(counts)[:-1] - 1] = 0
        g["w"] = np.stack((x.T @ da, x[1:].T @ inner))
        return g


def train(sample: list[tuple[str, int]], epochs: int = 12, batch: int = 32, seed: int = 7) -> Network:
    """Fit by Adam on shuffled batches. A sample without one of the labels leaves only the bias, at the other's rate."""
    net, rng = Network(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in sample], dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        net.p["u"][:] = 0
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        net.p["c"][0] = np.log(rate / (1 - rate))
        return net
    texts = [t.encode() for t, _ in sample]
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    epochs = max(epochs, -(-300 * batch // len(texts)))  # few texts: more rounds, 300 batches at least
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            grads = net.gradients(*cells([texts[i] for i in own]), labels[own])
            step += 1
            for k, g in grads.items():
                g = g + 1e-5 * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] -= (0.01 * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def quality(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """Per row of `docs`: all its columns, then score (0 to 1) and predicted (1 if score >= threshold, else 0).

    The whole of each text is scored, long ones a stretch at a time, in memory of a few times
    the text. Null and empty texts are one empty cell and get its score; repeated rows are scored
    alike; an empty table gives no rows. Columns of `docs` named score or predicted are
    replaced. The network has a fixed size.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        net, texts = shared.value, [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        got = [net.score(texts[0])] if len(texts) == 1 else net.forward(*cells(texts))  # a long text is a slice by itself
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, type=pa.float64())], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(over_slices(kernel), f"{fields}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
