"""Vectorised splitting and hashing of the words of many texts at once, for Arrow-batched kernels.

A kernel sees a slice of a batch as one byte string, texts joined by a space, and works on
arrays over all its words; slices end after about SLICE bytes, so memory follows the slice (or
the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE = 1 << 20
U64 = np.uint64

_BYTES = np.arange(256)
#: Bytes of words that end at ASCII blanks, and of words of ASCII letters, digits and anything beyond ASCII.
NOT_BLANK = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
LETTERS_DIGITS = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) + U64(salt) * U64(1_000_003)) | U64(1)


_LOWERED = mix(np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(U64) + U64(77))
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(2 * SLICE, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes with a space between, and where each begins (null: empty)."""
    parts = [x or b"" for x in texts.cast(pa.binary() if texts.type != pa.large_string() else pa.large_binary()).to_pylist()]
    begins = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=begins[1:])
    return np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8), begins


def spans(data: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of each maximal run of bytes that belong to words."""
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = in_word[data]
    edges = np.flatnonzero(np.diff(flags))
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, of_symbol: np.ndarray = _LOWERED) -> np.ndarray:
    """64-bit hash of each word by the values of its symbols; by default of bytes, A-Z taken as a-z."""
    out = np.empty(len(begins), dtype=U64)
    lo = 0
    while lo < len(begins):  # long texts in pieces
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + 2 * SLICE, side="right")))
        start, stop = int(begins[lo]), int(ends[hi - 1])
        up, down = _power_tables(stop - start)
        values = of_symbol[data[start:stop]]
        values *= up[: stop - start]
        at = begins[lo:hi] - start
        # bytes between two words add to the first one's sum; their sums are taken off
        sums = np.zeros(stop - start + 1, dtype=U64)
        np.cumsum(values, out=sums[1:])
        out[lo:hi] = (sums[ends[lo:hi] - start] - sums[at]) * down[at]
        lo = hi
    return mix(out)


class Texts:
    """The words of a slice of texts: `w` their hashes, `bounds[i]:bounds[i + 1]` those of text i."""

    def __init__(self, texts: pa.Array, in_word: np.ndarray):
        data, text_begins = joined(texts)
        begins, ends = spans(data, in_word)
        self.w = hashes(data, begins, ends)
        self.bounds = np.searchsorted(begins, text_begins)
        self.counts = np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; the last n - 1 places have none."""
    if len(w) < n:
        return np.empty(0, dtype=U64)
    c = constants(n, 1000 + n)
    out = w[: len(w) - n + 1] * c[0]
    for i in range(1, n):
        out += w[i : len(w) - n + 1 + i] * c[i]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` in order, in slices of about `limit` bytes of text."""
    sizes = np.nan_to_num(np.array(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.float64))
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n + 1
    if lo < batch.num_rows:
        yield batch.slice(lo)


def over_slices(kernel: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text") -> Callable:
    """`kernel` for mapInArrow: it sees slices of bounded size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                yield kernel(part)

    return run


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Consecutive runs of `values`, `counts[i]` for row i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), type=pa.int32()), values)
