"""Packing of tokenised documents into sequences of fixed length, by bound-certified repacking.

Best-fit decreasing runs in each of many partitions. Dual-feasible functions bound the number
of sequences a partition needs from below; where best fit reaches the bound, its packing is
proved optimal and stays. Where it does not, sequences are filled anew by subset sums, and the
better packing counts. Partitions that still have gaps keep their full sequences; those with
room are dealt out into new partitions and packed again, until every bound is met or a round
gains next to nothing. A partition has about the same number of pieces in every round.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.llm.tables import settled
from braidlog.llm.words import slices
from braidlog.session import ship

#: Pieces in a partition, in every round.
PIECES = 8_000
#: A round that saves less than this share of the open sequences is the last.
WORTH = 0.001

#: The word pattern of the byte-level vocabulary's own pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def byte_symbols() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(vocabulary: str):
    """A function from text to the token ids of a byte-level BPE file's content; special tokens in texts are their ids."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        plain = Tokenizer.from_str(vocabulary)
        content, symbols = json.loads(vocabulary), byte_symbols()
        special = {x["content"]: x["id"] for x in content["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}
        # the same merges and pattern, several times faster; its pattern matcher cannot take very long runs of blanks
        fast, blanks = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), re.compile(r"\s{5000}")
        _encoders[key] = lambda text: plain.encode(text, add_special_tokens=False).ids if len(text) >= 5000 and blanks.search(text) else fast.encode(text, allowed_special="all")
    return _encoders[key]


def _pieces(vocabulary, end: int, size: int):
    """For mapInArrow: cut each row's tokens into pieces."""

    def run(batches):
        encode = encoder(vocabulary.value)
        for batch in (part for whole in batches for part in slices(batch=whole)):
            keys, out = [], {x: [] for x in ("piece", "start", "length", "ids_crc32")}
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = array("I", encode(text or ""))
                ids.append(end)
                cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    keys.append(i)
                    for name, value in (("piece", piece), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(ids[a:b].tobytes()))):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keys, type=pa.int64())), pa.array(out["piece"], type=pa.int32()), *(pa.array(out[x], type=pa.int64()) for x in ("start", "length", "ids_crc32"))],
                names=["doc_id", *out],
            )

    return run


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of lengths in the order given: each one's bin and offset, and the level of each bin."""
    bins, offsets, levels = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: a bin has room r
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(levels), size
            levels.append(0)
        bins[i], offsets[i] = b, levels[b]
        levels[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(levels, dtype=np.int64)


def fill_by_sums(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best_fit, but each bin takes the longest length left and the set of others that fills it best."""
    bins, offsets, levels = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), []
    of_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        of_length.setdefault(n, []).append(i)
    left = sorted(of_length, reverse=True)
    while left:
        room, taken = size - left[0], [(left[0], 1)]
        of_first = len(of_length[left[0]]) - 1
        sums, steps = 1, []  # bit s: lengths tried so far can sum up to s
        for n in left:
            if n > room:
                continue
            copies, part = min(of_first if n == left[0] else len(of_length[n]), room // n), 1
            while copies:
                part = min(part, copies)
                more = (sums | sums << n * part) & ((1 << room + 1) - 1)
                if more != sums:
                    steps.append((n, part, sums))
                    sums = more
                copies, part = copies - part, part * 2
            if sums >> room:
                break
        rest = sums.bit_length() - 1
        for n, part, before in reversed(steps):
            if not before >> rest & 1:
                taken.append((n, part))
                rest -= n * part
        at = 0
        for n, part in taken:
            for _ in range(part):
                i = of_length[n].pop()
                bins[i], offsets[i] = len(levels), at
                at += n
        levels.append(at)
        left = [n for n in left if of_length[n]]
    return bins, offsets, np.array(levels, dtype=np.int64)


def least_bins(lengths: np.ndarray, size: int) -> int:
    """A lower bound of the bins needed: the largest over two families of dual-feasible functions.

    One rounds lengths over size - t up to a whole bin and those under t down to nothing, for
    every t up to half a bin; the other rounds each length down to a multiple of size / k
    unless it is one already, for k up to 20. The identity is among the first (t = 0).
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1)
    mass = count * np.arange(size + 1)
    count_up, mass_up = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(mass)))
    t = np.arange(size // 2 + 1)
    whole = count_up[-1] - count_up[size - t + 1]
    between = mass_up[size - t + 1] - mass_up[t]
    best = int((whole + -(-between // size)).max())
    x = np.arange(size + 1)
    for k in range(1, 21):
        scaled = np.where((k + 1) * x % size == 0, x * k, (k + 1) * x // size * size)  # k * size in a bin
        best = max(best, -(-int((count * scaled).sum()) // (k * size)))
    return best


def _repack(size: int, round_no: int):
    """For applyInArrow: pack one pool; rows that shall be packed again come back open."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths, pool = table.column("length").to_numpy(), table.column("pool")[0].as_py()
        bins, offsets, levels = best_fit(lengths, size)
        n, bound = len(levels), least_bins(lengths, size)
        if n > bound:
            other = fill_by_sums(lengths, size)
            if len(other[2]) < n:
                bins, offsets, levels = other
                n = len(levels)
        sequence = (np.int64(round_no) << 57) + (np.int64(pool) << 24) + bins
        before = table.column("sequence_id").to_numpy()
        if round_no and len(np.unique(before)) <= n:  # no gain: as it was
            sequence, offsets = before, table.column("offset").to_numpy()
            _, bins = np.unique(before, return_inverse=True)
            levels = np.bincount(bins, weights=lengths).astype(np.int64)
            n = len(levels)
        # a proved pool still gives its emptiest sequence away: pools' last ones may share
        open_bins = (levels < size) if n > bound else (levels < size) & (np.arange(n) == levels.argmin())
        again = open_bins[bins]
        for name, values in (("sequence_id", sequence), ("offset", offsets), ("open", again)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
        return table

    return run


def pack(docs: DataFrame, vocabulary: str, end: int = 2, size: int = 1024, pieces: int = PIECES) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of `docs` (doc_id, text).

    vocabulary: the content of a byte-level BPE tokenizer file. A document is its token ids
    and then `end`; one longer than `size` is cut so that all pieces but the first are full.
    sequence_id tells sequences of at most `size` tokens apart, which their pieces fill from
    offset 0 on without gaps. Null and empty texts are documents of one token; every row of
    `docs` is packed, repeated ones and those without a doc_id too; other columns are ignored.

    An empty table gives no rows. Texts are tokenized whole, one at a time; of equal lengths the
    smaller doc_id goes first. A partition packs about `pieces` pieces in every round, whatever
    the size of `docs` and however badly lengths fit.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    cut = settled(docs.select("doc_id", "text").mapInArrow(_pieces(spark.sparkContext.broadcast(vocabulary), end, size), schema))
    pools = -(-cut.count() // pieces) or 1
    work = cut.withColumns({"pool": F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(pools)), "sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "open": F.lit(True)})
    done, round_no, before = [], 0, None
    while True:
        packed = settled(work.groupBy("pool").applyInArrow(_repack(size, round_no), f"{schema}, pool bigint, sequence_id bigint, offset bigint, open boolean"))
        # every sequence begins with a piece at 0
        n_sequences, n_open, open_pieces = packed.agg(*(F.coalesce(F.sum(x.cast("long")), F.lit(0)) for x in (F.col("offset") == 0, F.col("open") & (F.col("offset") == 0), F.col("open")))).first()
        if pools == 1 or n_open < 2 or before is not None and before - n_sequences < WORTH * before:
            done.append(packed)
            break
        done.append(packed.where("not open"))
        pools, round_no, before = -(-open_pieces // pieces), round_no + 1, n_open
        # whole sequences move, so that a pool that gains nothing can leave them as they are
        work = packed.where("open").withColumn("pool", F.pmod(F.xxhash64("sequence_id", F.lit(round_no)), F.lit(pools)))
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
