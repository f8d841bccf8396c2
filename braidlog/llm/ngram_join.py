"""Jaccard join of documents over word n-grams, by blocks of a sparse matrix product.

The sets of all documents are the rows of a matrix with a column for each n-gram; the product of
it with its own transpose holds the size of every intersection. It is taken block by block, and
only of rows that can be linked:

1. Two linked sets of a and b grams differ in at most d(a, b) of them. A size class cuts the range
   of gram hashes into more stripes than that, so linked sets hold the same grams in one stripe at
   least, and that stripe's content is a bucket that has both. This is exact: no link is lost.
2. Sets of a bucket stay candidates if parities of their grams in cells, which differ in at most
   d(a, b) cells, allow it. What candidates connect is a row block.
3. In a row block, overlap counts are accumulated over stripes of columns. A pair is given up, or
   not begun, where its count and what is left of its smaller row cannot reach the size that the
   bound asks for. Pairs that reach it are links.

Buckets and blocks of any number of sets are dealt out in tiles of bounded weight. Each tile also
gets the group's hub, so that a group of copies of one text is one component after the tiles by
themselves; then only members outside the main component meet those of other tiles. A tile gives
edges that span what its links connect, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.llm.components import components
from braidlog.llm.shingles import nodes_of, set_keys, sets_of, sets_of_nodes, with_components
from braidlog.llm.tables import dealt_anew, settled
from braidlog.llm.words import U64, lists, mix, over_slices
from braidlog.session import ship

#: Size classes span so many steps of the largest ratio that sizes of linked sets can have: with
#: one, stripes hold five grams or more on average, so that sets with a passage in common rarely meet.
STEPS = 1
#: Cells of the parities of a set, at least: it has a power of two that is twice its size or more.
CELLS = 1024
#: Sets, and grams, of a tile at most (a single larger set is a tile by itself).
TILE_SETS, TILE_GRAMS = 4096, 500_000
#: The largest set whose counts, times 200, are exact in 32 bits.
EXACT = 8_000_000
#: Sets of a run that is multiplied by itself, at least.
ALONE = 64
#: Pairs that are expanded at once, and columns multiplied at once.
EXPANDED, COLUMNS = 1_000_000, 512


def apart(both, percent: int):
    """In how many grams two linked sets of `both` grams in all can differ."""
    return (100 - percent) * both // (100 + percent)


def needed(both, percent: int):
    """How many grams two sets of `both` in all have to share."""
    return -(-percent * both // (100 + percent))


def spare(differing):
    """Stripes beyond those that sets can differ in: so many empty ones a set may leave out of its buckets. Hardly one has more."""
    return 3 + differing // 16


def class_bounds(percent: int, most: int) -> np.ndarray:
    """Least size of each size class, up to the one that `most` is in and one more."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * (100 / percent) ** STEPS))))
    return np.array([*out, max(out[-1] + 1, int(np.ceil(out[-1] * (100 / percent) ** STEPS)))], dtype=np.int64)


def stripes(values: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of each set (sorted hashes, end to end), and how many each has.

    A set is in its own size class and in those of larger sets that it can be linked with. A
    class whose sets can only be linked if they are equal has no buckets.
    """
    if not len(counts):
        return np.empty(0, dtype=U64), np.zeros(0, dtype=np.int64)
    lows = class_bounds(percent, int(counts.max()) * 100 // percent + 1)
    own, last = (np.searchsorted(lows, x, side="right") - 1 for x in (counts, counts * 100 // percent))
    found, owners = [], []
    begins = np.concatenate(([0], np.cumsum(counts)))
    for step in range(int((last - own).max()) + 1):
        rank = own + step
        differing = apart(2 * (lows[rank + 1] - 1), percent)
        chosen = np.flatnonzero((rank <= last) & (differing > 0) & (counts > 0))
        if not len(chosen):
            continue
        most_empty = spare(differing[chosen])
        n, size = differing[chosen] + 1 + most_empty, counts[chosen]
        place = np.repeat(np.arange(len(chosen)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins[chosen], size)
        hashes = values[at]
        # stripes are ranges of hashes, and hashes are sorted: a stripe's grams are neighbours
        stripe = (((hashes >> U64(32)) * n[place].astype(U64)) >> U64(32)).astype(np.int64)
        offset = np.cumsum(n) - n
        cell = offset[place] + stripe
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        content, filled, who = np.add.reduceat(mix(hashes ^ U64(0x2545F4914F6CDD1D)), first), cell[first], place[first]
        empty = n - np.bincount(who, minlength=len(chosen))
        for i in np.flatnonzero(empty > most_empty):  # sets of few grams in few stripes
            rest = np.setdiff1d(np.arange(offset[i], offset[i] + n[i]), filled[who == i])
            content, filled, who = np.concatenate((content, np.zeros(len(rest), dtype=U64))), np.concatenate((filled, rest)), np.concatenate((who, np.full(len(rest), i)))
        name = (rank[chosen][who].astype(U64) << U64(40)) + (filled - offset[who]).astype(U64)
        found.append(mix(mix(name) + content))
        owners.append(chosen[who])
    if not found:
        return np.empty(0, dtype=U64), np.zeros(len(counts), dtype=np.int64)
    keys, owner = np.concatenate(found), np.concatenate(owners)
    return keys[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(counts))


def parities(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A bit for each cell of each set: whether the number of its grams there is odd. Sets differ in no more cells than grams."""
    cell, begins = mix(values + U64(0x632BE59BD9B4E019)), np.concatenate(([0], np.cumsum(counts)))
    out = []
    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        cells = max(CELLS, 1 << (2 * (hi - lo) - 1).bit_length()) if hi > lo else CELLS
        out.append(np.packbits(np.bincount((cell[lo:hi] & U64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes())
    return out


def _sketch(shingle: int, percent: int):
    """A kernel: per row n_shingles, the key of its set, and of the first of equal sets its buckets and parities."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, counts = sets_of(batch, shingle)
        keys = set_keys(values, counts)
        alone = (counts == 0) | np.asarray(batch.column("doc_id").is_null())
        some = np.flatnonzero(~alone)
        lead = np.sort(some[np.unique(keys[some], return_index=True)[1]])
        begins = np.concatenate(([0], np.cumsum(counts)))
        buckets, bits, listed = [], [], np.zeros(len(counts), dtype=np.int64)
        for block in np.split(lead, range(500, len(lead), 500)):
            own = np.concatenate([values[begins[i] : begins[i + 1]] for i in block] or [values[:0]])
            found, n = stripes(own, counts[block], percent)
            buckets.append(found)
            listed[block] = n
            bits += parities(own, counts[block])
        shown = np.full(len(counts), None, dtype=object)
        shown[lead] = bits
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row_hash"),
                pa.array(counts),
                pa.array(keys.view(np.int64), mask=alone),
                lists(pa.array(np.concatenate(buckets).view(np.int64)), listed),
                pa.array(shown, type=pa.binary()),
            ],
            names=["doc_id", "row_hash", "n_shingles", "node", "buckets", "parity"],
        )

    return over_slices(kernel)


def _shared(batches):
    """For mapInArrow over (bucket, node), sorted: the distinct rows whose bucket has another node.

    A partition's first and last bucket may go on in its neighbours and are kept.
    """
    kept_bucket = kept_node = np.empty(0, dtype=np.int64)  # the last distinct row, and the one before it
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, node = (np.concatenate((k, batch.column(c).to_numpy())) for k, c in ((kept_bucket, "bucket"), (kept_node, "node")))
        new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])))
        bucket, node = bucket[new], node[new]
        same = bucket[1:] == bucket[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        # rows before the last are settled; the first of them was seen with the row before it
        lo = 1 if len(kept_bucket) == 2 else 0
        first = bucket[0] if first is None else first
        keep |= bucket == first
        hi = max(len(bucket) - 1, lo)
        mask = np.flatnonzero(keep[lo:hi]) + lo
        yield pa.RecordBatch.from_arrays([pa.array(bucket[mask]), pa.array(node[mask])], names=["bucket", "node"])
        kept_bucket, kept_node = bucket[-2:] if len(bucket) > 1 and hi else bucket[-1:], node[-2:] if len(node) > 1 and hi else node[-1:]
    if len(kept_bucket):
        yield pa.RecordBatch.from_arrays([pa.array(kept_bucket[-1:]), pa.array(kept_node[-1:])], names=["bucket", "node"])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same of n members as the edges (a, b) do: each member with the least of its component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, label[end], low)
        label = label[label]
        if (label == before).all():
            break
    ends = np.flatnonzero(label != np.arange(n))
    return ends, label[ends]


class Parities:
    """The parities of many sets; of two, the one of more cells is folded to the other's."""

    def __init__(self, rows: list[bytes]):
        self.width = np.array([len(x) // 8 for x in rows])
        self.of_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # words of all sets of this width or more, and their places
        place, words = np.empty(0, dtype=np.int64), np.empty((0, 0), dtype=U64)
        for width in sorted(set(self.width.tolist()), reverse=True):
            while len(place) and words.shape[1] > width:
                half = words.shape[1] // 2
                words = words[:, :half] ^ words[:, half:]
            own = np.flatnonzero(self.width == width)
            new = np.frombuffer(b"".join(rows[i] for i in own), dtype=U64).reshape(len(own), width)
            words, place = np.concatenate((words, new)) if len(place) else new, np.concatenate((place, own))
            at = np.full(len(rows), -1)
            at[place] = np.arange(len(place))
            self.of_width[width] = at, words

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many cells the sets i and j differ, pair by pair."""
        out, least = np.zeros(len(i), dtype=np.int64), np.minimum(self.width[i], self.width[j])
        for width in np.unique(least).tolist():
            own = np.flatnonzero(least == width)
            at, words = self.of_width[width]
            for part in np.array_split(own, max(1, len(own) * width // EXPANDED)):
                out[part] = np.bitwise_count(words[at[i[part]]] ^ words[at[j[part]]]).sum(axis=1)
        return out


def allowed_pairs(group: np.ndarray, size: np.ndarray, parity: Parities, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span, in each run of `group`, the pairs whose parities let them be linked."""
    begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    length = np.diff(np.concatenate((begins, [len(group)])))

    def fit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = percent * np.maximum(size[i], size[j]) <= 100 * np.minimum(size[i], size[j])
        near = np.flatnonzero(out)
        out[near] = parity.differing(i[near], j[near]) <= apart(size[i[near]] + size[j[near]], percent)
        return out

    found_a, found_b = [], []
    run = np.repeat(length, length)
    for step in range(1, min(32, int(length.max(initial=1)))):  # runs of up to 32, all at once
        i = np.flatnonzero((group[step:] == group[:-step]) & (run[step:] <= 32))
        i = i[fit(i, i + step)] if len(i) else i
        found_a.append(i)
        found_b.append(i + step)
    for lo, n in zip(begins[length > 32].tolist(), length[length > 32].tolist(), strict=True):
        label = np.arange(n)
        for i in range(n):  # members of one component need no comparison
            others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            if len(others) and len(alike := others[fit(np.full(len(others), lo + i), lo + others)]):
                found_a.append(np.full(len(alike), lo + i))
                found_b.append(lo + alike)
                label[np.isin(label, label[alike])] = label[i]
    return spanning(len(group), np.concatenate(found_a or [begins[:0]]), np.concatenate(found_b or [begins[:0]]))


def linked_pairs(group: np.ndarray, size: np.ndarray, values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span, in each run of `group`, the links of its sets: `size[i]` of `values` each, end to end.

    Runs of many sets are multiplied one by one, all others together.
    """
    begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    length = np.diff(np.concatenate((begins, [len(group)])))
    at = np.concatenate(([0], np.cumsum(size)))
    found = []
    for lo, n in zip(begins[length > ALONE].tolist(), length[length > ALONE].tolist(), strict=True):
        a, b = _product(group[lo : lo + n], size[lo : lo + n], values[at[lo] : at[lo + n]], percent)
        found.append((lo + a, lo + b))
    rest = np.flatnonzero(np.repeat(length <= ALONE, length))
    if len(rest):
        of_rest = np.repeat(np.isin(np.arange(len(size)), rest), size)
        a, b = _product(group[rest], size[rest], values[of_rest], percent)
        found.append((rest[a], rest[b]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (begins[:0], begins[:0])


def _product(group: np.ndarray, size: np.ndarray, values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(size)), size)
    gram = mix(values + mix(group.astype(np.int64).view(U64))[row])  # no two groups have a column in common
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    begins = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    length = np.diff(np.concatenate((begins, [len(gram)])))
    begins, length = begins[length > 1], length[length > 1]  # a column of one row has no part in the product
    if not len(begins):
        return spanning(0, begins, begins)
    at = np.repeat(begins - np.cumsum(length) + length, length) + np.arange(length.sum())
    row, column = row[at], np.repeat(np.arange(len(begins)), length)
    # counts of sets beyond EXACT are not taken in single precision
    if (group == group[0]).all() and size.max() <= EXACT and (length * (length - 1) // 2).sum() > 4 * len(size) ** 2:
        found = _dense(row, column, len(begins), size, percent)
    else:
        found = _sparse(row, length, size, percent)
    return spanning(len(size), *found)


def _dense(row: np.ndarray, column: np.ndarray, n_columns: int, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that share enough, where most rows share many columns: stripes of the matrix multiplied whole."""
    n = len(size)
    small = size.astype(np.int32)
    need = needed(small[:, None] + small[None, :], percent).astype(np.float32)
    shared, left = np.zeros((n, n), dtype=np.float32), np.bincount(row, minlength=n).astype(np.float32)
    bounds = np.searchsorted(column, np.arange(0, n_columns + COLUMNS, COLUMNS))
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        stripe = np.zeros((n, COLUMNS), dtype=np.float32)
        stripe[row[lo:hi], column[lo:hi] - k * COLUMNS] = 1
        shared += stripe @ stripe.T
        left -= stripe.sum(axis=1)
        if not (np.triu(shared + np.minimum(left[:, None], left[None, :]) >= need, 1)).any():
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.nonzero(np.triu(shared >= need, 1))


def _sparse(row: np.ndarray, length: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The same where few rows share a column: pairs of each column, counted stripe by stripe."""
    n = len(size)
    left = np.bincount(row, minlength=n)
    order = np.argsort(length, kind="stable")  # rare columns first: frequent ones begin no pair that they cannot end
    begins = (np.cumsum(length) - length)[order]
    length = length[order]
    pairs_of = length * (length - 1) // 2
    stripe_of = np.cumsum(pairs_of) // EXPANDED
    codes, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for stripe in np.unique(stripe_of):
        own = np.flatnonzero(stripe_of == stripe)
        before, new = left.copy(), []
        for size_of in np.unique(length[own]):
            of_size = own[length[own] == size_of]
            members = row[begins[of_size][:, None] + np.arange(size_of)]
            np.subtract.at(left, members.reshape(-1), 1)
            block = max(1, EXPANDED // (size_of * size_of))
            first, second = np.triu_indices(size_of, 1)
            for part in np.split(members, range(block, len(members), block)):
                i, j = part[:, first].reshape(-1), part[:, second].reshape(-1)
                code = np.minimum(i, j) * n + np.maximum(i, j)
                begin = np.minimum(before[i], before[j]) >= needed(size[i] + size[j], percent)
                if len(codes):
                    begin |= codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
                new.append(np.unique(code[begin], return_counts=True))
        code, of = np.concatenate([codes, *(x[0] for x in new)]), np.concatenate([counts, *(x[1] for x in new)])
        codes, inverse = np.unique(code, return_inverse=True)
        counts = np.bincount(inverse, weights=of, minlength=len(codes)).astype(np.int64)
        i, j = codes // n, codes % n
        alive = counts + np.minimum(left[i], left[j]) >= needed(size[i] + size[j], percent)
        codes, counts = codes[alive], counts[alive]
    i, j = codes // n, codes % n
    linked = counts >= needed(size[i] + size[j], percent)
    return i[linked], j[linked]


def _tiles(compare: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]], weight: str, most: int):
    """For mapInArrow over rows sorted by (group, tile): the edges (a, b) of whole tiles, many small ones at a time."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        key = mix(rows.column("group").to_numpy().view(U64)) + mix(rows.column("tile").to_numpy().view(U64) + U64(1))
        a, b = compare(rows, key.view(np.int64))
        node = rows.column("node").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group, tile = batch.column("group").to_numpy(), batch.column("tile").to_numpy()
            ends = np.flatnonzero((group[1:] != group[:-1]) | (tile[1:] != tile[:-1])) + 1
            if held and (held[-1].column("group")[-1].as_py(), held[-1].column("tile")[-1].as_py()) != (int(group[0]), int(tile[0])):
                ends = np.concatenate(([0], ends))
            heavy = np.concatenate(([0], np.cumsum(batch.column(weight).to_numpy())))
            lo = 0
            for hi in ends:  # a tile ends here
                if total + heavy[hi] - heavy[lo] >= most:
                    yield done([*held, batch.slice(lo, hi - lo)])
                    held, total, lo = [], 0, hi
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
                total += heavy[-1] - heavy[lo]
        if held:
            yield done(held)

    return run


def _connected(members: DataFrame, payload: DataFrame, weight: str, limit: int, compare: Callable) -> DataFrame:
    """Edges (a, b) that connect what the links within groups of `members` (group, node, weight) do.

    Groups are dealt out in tiles of about `limit` of weight and TILE_SETS members, each with
    the group's hub, its largest set. Where that leaves a group in several components, what is
    outside the main one is tiled again, and each such tile is compared with every tile.
    `payload` (node, ...), what sets are compared by, only moves to the tiles.
    """
    kernel = _tiles(compare, weight, limit)
    members = members.select("group", "node", weight)
    sizes = settled(members.groupBy("group").agg(F.ceil(F.greatest(F.sum(weight) / limit, F.count("*") / TILE_SETS)).cast("long").alias("n_tiles"), F.max(F.struct(weight, "node"))["node"].alias("hub")))
    many = sizes.where("n_tiles > 1")
    tiled = members.join(dealt_anew(sizes, "group"), "group").withColumn("tile", F.pmod(F.xxhash64("node"), "n_tiles"))
    again = not many.isEmpty()
    if again:  # the only case in which it is used twice
        payload, tiled = settled(payload), settled(tiled)

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.select("group", "node", weight, "tile").join(payload, "node")
        return rows.repartition("group", "tile").sortWithinPartitions("group", "tile").mapInArrow(kernel, "a bigint, b bigint")

    if not again:
        return settled(compared(tiled))
    every_tile = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hubs = tiled.where("node = hub and n_tiles > 1").withColumn("own", F.col("tile")).withColumn("tile", every_tile("n_tiles")).where("tile <> own")
    edges = settled(compared(tiled.drop("n_tiles", "hub").unionByName(hubs.drop("n_tiles", "hub", "own"))))
    roots = settled(components(edges))
    rooted = settled(tiled.where("n_tiles > 1").join(dealt_anew(roots, "node"), "node", "left").select("group", "node", F.coalesce("root", "node").alias("root")))
    main = rooted.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("n_roots")).where("n_roots > 1")
    minor = settled(rooted.join(dealt_anew(main, "group"), "group").where("root <> main").select("group", "node"))
    if minor.isEmpty():
        return edges
    n_minor = settled(minor.groupBy("group").agg(F.ceil(F.count("*") / (TILE_SETS // 2)).cast("long").alias("n_minor")))
    beside = settled(tiled.join(dealt_anew(n_minor, "group"), "group"))
    others = beside.withColumn("minor", every_tile("n_minor"))
    asking = beside.join(dealt_anew(minor, "node"), ["group", "node"], "left_semi").withColumn("minor", F.pmod(F.xxhash64("node", F.lit(7)), "n_minor"))
    asking = asking.withColumn("own", F.col("tile")).withColumn("tile", every_tile("n_tiles")).where("tile <> own").drop("own")
    pairs = others.unionByName(asking).withColumn("tile", F.col("tile") * F.col("n_minor") + F.col("minor"))
    return settled(edges.unionAll(compared(pairs)))


def _shrunk(met: DataFrame) -> DataFrame:
    """(group, node): `met` (bucket, node) with buckets of the same nodes as one group; copies share very many."""
    one = F.xxhash64(F.bit_xor(F.xxhash64("node")), F.count("*"), F.min("node"), F.max("node")).alias("group")
    groups = met.groupBy("bucket").agg(one, F.count("*").alias("n")).where("n > 1").drop("n")
    return met.join(dealt_anew(groups, "bucket"), "bucket").select("group", "node").distinct()


def _by_parity(percent: int):
    def compare(rows: pa.Table, key: np.ndarray):
        return allowed_pairs(key, rows.column("size").to_numpy(), Parities(rows.column("parity").to_pylist()), percent)

    return compare


def _by_product(percent: int):
    def compare(rows: pa.Table, key: np.ndarray):
        values = rows.column("shingles").combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        return linked_pairs(key, rows.column("size").to_numpy(), values.flatten().to_numpy().view(U64), percent)

    return compare


def ngram_join(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """Per row of `docs` (doc_id, text): row_hash, n_shingles, component_id.

    Two documents are linked if their sets of `shingle`-word shingles have 100 * intersection >=
    percent * union; no link is lost. Words are runs of anything but ASCII blanks, A-Z
    lower-cased; a text of fewer words, but not none, has its whole word sequence as its one
    shingle. component_id is the least doc_id reachable over links. Null, empty and blank texts
    are linked with nothing. Each row has the component of its own text, so repeated rows share
    it and a doc_id with several texts can have several; a row without a doc_id takes no part and
    has no component. row_hash, xxhash64 of the text, tells an id's rows apart. An empty table gives
    no rows, other columns are ignored, and texts are taken whole: a task's memory follows a
    slice of them, or the longest one. Shingles are compared by 64-bit hashes.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"percent must be 50 to 100: {percent}")
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    sketch = settled(docs.mapInArrow(_sketch(shingle, percent), "doc_id bigint, row_hash bigint, n_shingles bigint, node bigint, buckets array<bigint>, parity binary"))
    nodes = nodes_of(sketch)
    in_buckets = sketch.where(F.size("buckets") > 0)
    met = settled(in_buckets.select(F.explode("buckets").alias("bucket"), "node").repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node").mapInArrow(_shared, "bucket bigint, node bigint"))
    groups = settled(_shrunk(met)).withColumn("one", F.lit(1).cast("long"))
    bits = in_buckets.groupBy("node").agg(F.max("n_shingles").alias("size"), F.max("parity").alias("parity"))
    blocks = settled(components(_connected(groups, bits, "one", TILE_SETS, _by_parity(percent))))
    held = nodes.join(blocks, "node")
    rows = settled(held.select(F.col("root").alias("group"), "node", F.col("n_shingles").alias("size")))
    sets = sets_of_nodes(docs, held, shingle)
    links = _connected(rows, sets, "size", TILE_GRAMS, _by_product(percent))
    return with_components(sketch, nodes, components(links))
