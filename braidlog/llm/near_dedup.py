"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets,
star-shaped candidate edges, and an exact check on whole shingle sets.

One hash of every shingle fills BANDS * ROWS bins with the least value that falls in each; an
empty bin takes the value of the first filled bin along its own fixed pseudo-random walk
(optimal densification), so two sets agree in a bin with the probability of their similarity.
ROWS bins make a band, and equal bands a bucket. Every two sets of a bucket are candidates. Of
buckets of up to SMALL sets all pairs are taken; in a larger one a hub is joined with every member,
which makes a star. What the stars leave out is taken next: all pairs of a bucket that links do
not have in one component, but for those that a bound on what they can share shows to be too
different (see _left_out). No number of sets or pairs is a limit. A candidate within one
component cannot change any result; every other one is checked on full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.llm.components import components
from braidlog.llm.shingles import nodes_of, set_keys, sets_of, sets_of_nodes, with_components
from braidlog.llm.tables import dealt_anew, settled
from braidlog.llm.words import U64, constants, lists, mix, over_slices
from braidlog.session import ship

BANDS, ROWS = 64, 6
#: Buckets of so many sets are compared whole; in larger ones a hub is compared first.
SMALL = 5
#: A shingle that so many sets of a cluster hold at most is rare there.
RARE = 8
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def _signatures(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation MinHash of each non-empty set: rows of `bins` values."""
    n = len(counts)
    bin_of = (((values >> U64(32)) * U64(bins)) >> U64(32)).astype(np.int64)  # sets are sorted: the first value of a bin is its least
    cell = np.repeat(np.arange(n), counts) * bins + bin_of
    first = np.concatenate(([True], cell[1:] != cell[:-1]))
    filled = np.full(n * bins, EMPTY, dtype=U64)
    filled[cell[first]] = values[first]
    out, empty, attempt = filled.copy(), np.flatnonzero(filled == EMPTY), 0
    while len(empty):
        attempt += 1
        at = empty % bins
        walk = (mix(at.astype(U64) * U64(0x1F123BB5) + U64(attempt * 0x9E3779B97F4A7C15 % (1 << 64))) % U64(bins)).astype(np.int64)
        got = filled[empty - at + walk]
        out[empty] = got
        empty = empty[got == EMPTY]
    return out.reshape(n, bins)


def _bands(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature; keys of different bands never mean the same."""
    parts = signatures.reshape(len(signatures), bands, rows)
    return mix((parts * constants(rows, 7)).sum(axis=2, dtype=U64) + constants(bands, 8))


def _sketch(shingle: int, bands: int, rows: int):
    """A kernel: per row n_shingles, the key of its set, and its bands.

    Of rows with equal sets in one slice only the first lists its bands.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, counts = sets_of(batch, shingle)
        keys = set_keys(values, counts)
        alone = (counts == 0) | np.asarray(batch.column("doc_id").is_null())
        some = np.flatnonzero(~alone)
        lead = np.sort(some[np.unique(keys[some], return_index=True)[1]])
        begins = np.concatenate(([0], np.cumsum(counts)))
        found = []
        for block in np.split(lead, range(1000, len(lead), 1000)):  # 4 kB of bins a set
            own = np.concatenate([values[begins[i] : begins[i + 1]] for i in block] or [values[:0]])
            found.append(_bands(_signatures(own, counts[block], bands * rows), bands, rows).reshape(-1))
        listed = np.zeros(len(counts), dtype=np.int64)
        listed[lead] = bands
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_hash"), pa.array(counts), pa.array(keys.view(np.int64), mask=alone), lists(pa.array(np.concatenate(found).view(np.int64)), listed)],
            names=["doc_id", "row_hash", "n_shingles", "node", "bands"],
        )

    return over_slices(kernel)


def _members(sketch: DataFrame) -> DataFrame:
    """(bucket, node, n), distinct, of the buckets of two sets or more; n is the bucket's size."""
    members = sketch.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket")
    # most buckets hold one set: from here on only the others move
    members = settled(members.join(dealt_anew(shared, "bucket"), "bucket", "left_semi").distinct())
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    return settled(members.join(dealt_anew(sizes, "bucket"), "bucket").select("bucket", "node", "n"))


def _all_pairs(small: DataFrame) -> DataFrame:
    """(node, hub): all pairs of buckets of at most SMALL sets."""
    nodes = small.groupBy("bucket").agg(F.collect_list("node").alias("nodes"))
    return nodes.select("nodes", F.explode("nodes").alias("node")).select("node", F.explode(F.filter("nodes", lambda x: x > F.col("node"))).alias("hub"))


def _with_company(large: DataFrame) -> DataFrame:
    """(bucket, node, company): how many others a set meets over all its buckets."""
    company = large.groupBy("node").agg(F.sum("n").alias("company"))
    return settled(large.join(dealt_anew(company, "node"), "node").select("bucket", "node", "company"))


def _stars(large: DataFrame) -> DataFrame:
    """(node, hub): the hub of each bucket with every other member.

    The member with the most company is the hub: of a group of copies that were edited
    independently it is the text they come from.
    """
    hubs = large.groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    return large.join(dealt_anew(hubs, "bucket"), "bucket").where("node <> hub").select("node", "hub")


def _met(pairs: DataFrame) -> DataFrame:
    """Edges (a, b, shared): the pairs of sets (node, hub), and how often each met."""
    return pairs.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.count("*").alias("shared"))


def _open(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, company, root, main) of the buckets in `large` whose members are in several components.

    main is the root of the bucket's most frequent component.
    """
    rooted = settled(large.join(dealt_anew(roots, "node"), "node", "left").select("bucket", "node", "company", F.coalesce("root", "node").alias("root")))
    groups = rooted.groupBy("bucket", "root").agg(F.count("*").alias("of_root"))
    main = groups.groupBy("bucket").agg(F.max_by("root", F.struct("of_root", "root")).alias("main"), F.count("*").alias("n_roots")).where("n_roots > 1")
    return settled(rooted.join(dealt_anew(main, "bucket"), "bucket").select("bucket", "node", "company", "root", "main"))


def _bit_set(values: str, word: int) -> Column:
    """A bit for each of the hashes in `values` that belong to `word`, by their low bits, of a set of four words."""

    def add(bits: Column, x: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 2).bitwiseAND(F.lit(63)).cast("int"))
        return F.when(x.bitwiseAND(F.lit(3)) == word, bits.bitwiseOR(bit)).otherwise(bits)

    return F.aggregate(values, F.lit(0).cast("long"), add)


def _crowded(placed: DataFrame, own: DataFrame) -> DataFrame:
    """(cluster): those whose buckets have more pairs of sets to compare than the cluster's sets (`own`) have shingles."""
    pairs = placed.groupBy("cluster", "bucket").agg((F.count("*") * F.count_if(F.col("root") != F.col("cluster"))).alias("pairs")).groupBy("cluster").agg(F.sum("pairs").alias("pairs"))
    held = own.groupBy("cluster").agg(F.sum(F.size("shingles")).alias("held"))
    return settled(pairs.join(held, "cluster").where("pairs > held").select("cluster"))


def _left_out(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the components that links within buckets of `placed` (see _open) join; none of its links is missed.

    Buckets with one main component make a cluster. Of most clusters, whose buckets have no more
    pairs than their sets have shingles, all pairs are taken: sets that meet by chance are in many
    such clusters, and to list their shingles in each would be more work than the pairs are.

    The others, the crowded ones, do without comparing all pairs of a bucket. A shingle is
    rare if at most RARE sets of its cluster hold it and its center does not (see below). Two sets that
    share s rare shingles share at most s + min(c_a, c_b) in all, c being how many of a set's
    are not rare. Pairs with s > 0 come from joining rare shingles, which makes few pairs for
    each. Those with s = 0 have to pass the bound by their sizes t and c alone: sets are put
    into cells of nearly equal t and c, cells are compared by their best members, and only
    members of cells that pass are compared in their buckets. Copies of one text with edits of
    their own have many rare shingles, and so only the most edited ones have such partners.

    A pair is compared by what its sets lack of, and have beyond, a center of their cluster,
    which for copies is little: first by bit sets of it, which bound how much of it they share,
    then by itself, which tells the size of their intersection exactly.
    """
    placed = placed.withColumnRenamed("main", "cluster")
    of_node = placed.groupBy("cluster", "node", "root").agg(F.max("company").alias("company"))
    own = settled(sets.join(dealt_anew(of_node, "node"), "node").select("cluster", "node", "root", "company", "shingles"))
    center = own.where("root = cluster").groupBy("cluster").agg(F.max_by("shingles", F.struct("company", "node")).alias("center"))
    lacks, beyond = F.array_except("center", "shingles"), F.array_except("shingles", "center")
    apart = settled(
        own.join(dealt_anew(center, "cluster"), "cluster")
        .select("cluster", "node", "root", F.size("shingles").cast("long").alias("t"), F.concat(lacks, beyond).alias("apart"), beyond.alias("beyond"))
        .select("cluster", "node", "root", "t", "apart", "beyond", F.size("apart").cast("long").alias("d"), *(_bit_set("apart", i).alias(f"bits{i}") for i in range(4)))
        .withColumn("alike", F.col("d") - sum(F.bit_count(f"bits{i}") for i in range(4)))
    )
    crowded = _crowded(placed, own)
    # by a key of its own: dealt out by the cluster, all of its shingles would be counted in one task
    listed = dealt_anew(apart.withColumn("key", F.col("cluster")), "key").join(crowded.withColumnRenamed("cluster", "key"), "key", "left_semi")
    each = listed.select("cluster", "node", F.explode("beyond").alias("shingle"))
    seldom = each.groupBy("cluster", "shingle").agg(F.count("*").alias("n")).where(F.col("n") <= RARE)
    rare = settled(each.join(dealt_anew(seldom, "shingle"), ["cluster", "shingle"]))
    bin_of = lambda x: F.floor(F.log(x) / float(np.log(1.01)))
    known = settled(
        apart.drop("apart", "beyond")
        .join(rare.groupBy("cluster", "node").agg(F.count("*").alias("u")), ["cluster", "node"], "left")
        .withColumn("c", F.col("t") - F.coalesce("u", F.lit(0)))
        .withColumns({"t_bin": bin_of(F.col("t")), "c_bin": F.when(F.col("c") > 0, bin_of(F.col("c"))).otherwise(-1)})
        .drop("u")
        .join(dealt_anew(crowded, "cluster").withColumn("crowded", F.lit(True)), "cluster", "left")
        .withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    )
    can = lambda s: (100 + percent) * (F.least("c", "other_c") + s) >= percent * (F.col("t") + F.col("other_t"))
    other = lambda df: df.select(*(F.col(x) if x in ("cluster", "shingle", "block", "bucket") else F.col(x).alias(f"other_{x}") for x in df.columns))

    def linked(same, t: str, d: str, other_t: str, other_d: str):
        """Whether sets of t and other_t shingles are linked if `same` of the d and other_d by which they differ from the center are the same."""
        both = F.col(t) + F.col(other_t)
        return (100 + percent) * (both - F.col(d) - F.col(other_d) + 2 * same) >= 2 * percent * both

    # a bit stands for what both have of it, but for what shares a bit with more of its own set
    same_bits = sum(F.bit_count(F.col(f"bits{i}").bitwiseAND(F.col(f"other_bits{i}"))) for i in range(4))
    may = linked(same_bits + F.least("alike", "other_alike"), "t", "d", "other_t", "other_d")

    holders = rare.where("n > 1").select("cluster", "shingle", "node").join(known.drop("t_bin", "c_bin", "crowded"), ["cluster", "node"])
    by_rare = (
        holders.join(other(holders), ["cluster", "shingle"])
        .where(F.expr("node < other_node and root <> other_root") & may)
        .groupBy("cluster", F.col("node").alias("a"), F.col("other_node").alias("b"))
        .agg(F.count("*").alias("shared"), *(F.first(x).alias(x) for x in ("t", "c", "other_t", "other_c")))
        .where(can(F.col("shared")))
        .select("cluster", "a", "b")
    )

    # a set whose rare shingles are too many has no partner without sharing some; beside the crowded clusters none is rare
    fit = known.where(100 * F.col("c") >= percent * F.col("t"))
    cells = fit.where("crowded").groupBy("cluster", "t_bin", "c_bin").agg(F.min("t").alias("t"), F.max("c").alias("c"), F.min("root").alias("root"), F.max("root").alias("last_root"))
    # sets of one link differ by the share `percent` in size at most: they are in neighbouring blocks
    width = int(np.ceil(np.log(100 / percent) / np.log(1.01))) + 2
    block = F.floor(F.col("t_bin") / width)
    asking_cells = cells.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    passing = (
        asking_cells.join(other(cells.withColumn("block", block)), ["cluster", "block"])
        .where(can(F.lit(0)) & ((F.col("root") != F.col("other_root")) | (F.col("root") != F.col("last_root")) | (F.col("root") != F.col("other_last_root"))))
        .select("cluster", "t_bin", "c_bin", "other_t_bin", "other_c_bin")
    )
    here = settled(placed.select("bucket", "cluster", "node", (F.col("root") != F.col("cluster")).alias("minor")).join(dealt_anew(fit, "node"), ["cluster", "node"]))
    asked = other(here.drop("cluster"))
    asking = here.where("minor")

    def compared(pairs: DataFrame) -> DataFrame:
        return pairs.where(can(F.lit(0)) & may & F.expr("root <> other_root and (not other_minor or node < other_node)")).select(
            "cluster", F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")
        )

    by_size = compared(asking.join(dealt_anew(passing, "t_bin"), ["cluster", "t_bin", "c_bin"]).join(asked, ["bucket", "other_t_bin", "other_c_bin"]))
    whole = compared(asking.where("not crowded").join(asked.where("not other_crowded"), "bucket"))
    side = lambda end: apart.select("cluster", F.col("node").alias(end), *(F.col(x).alias(f"{x}_{end}") for x in ("root", "t", "d", "apart")))
    both = by_rare.unionAll(by_size).unionAll(whole).distinct().join(side("a"), ["cluster", "a"]).join(side("b"), ["cluster", "b"])
    same = F.size(F.array_intersect("apart_a", "apart_b")).cast("long")
    return both.where(linked(same, "t_a", "d_a", "t_b", "d_b")).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()


def _linked(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose full sets are similar enough."""
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    small, large = F.least(F.size("of_a"), F.size("of_b")), F.greatest(F.size("of_a"), F.size("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return both.where(100 * small.cast("long") >= percent * large).where(100 * common >= percent * (small + large - common)).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of `docs` (doc_id, text): row_hash, n_shingles, component_id, kept.

    Two documents are linked if their sets of `shingle`-word shingles have 100 * intersection
    >= percent * union. Words are runs of anything but ASCII blanks, A-Z lower-cased; a text of
    fewer words, but not none, has its whole word sequence as its one shingle. component_id is
    the least doc_id reachable over links, and kept marks the row of that doc_id.
    Null, empty and blank texts are linked with nothing. Each row has the component of its own
    text: repeated rows share it and carry the same kept, and a doc_id with several texts can have
    several components. A row without a doc_id takes no part: it has no component and is kept.
    row_hash is xxhash64 of the text and tells an id's rows apart. An empty table gives no
    rows; texts are taken whole, a slice of some at a time; other columns are ignored.

    Rows with equal sets are one node throughout, so thousands of copies cost one.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    sketch = settled(docs.mapInArrow(_sketch(shingle, bands, rows), "doc_id bigint, row_hash bigint, n_shingles bigint, node bigint, bands array<bigint>"))
    nodes = nodes_of(sketch)
    members = _members(sketch)
    large = _with_company(members.where(F.col("n") > SMALL))
    edges = settled(_met(_all_pairs(members.where(F.col("n") <= SMALL)).unionAll(_stars(large))))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = settled(sets_of_nodes(docs, nodes.join(ends, "node"), shingle))
    roots = components(_linked(edges, sets, percent))
    placed = _open(large, roots)
    if not placed.isEmpty():
        joins = settled(_left_out(placed, sets, percent))
        if not joins.isEmpty():
            # components that the rest joins: their roots get new ones, and lone sets among them too
            new = settled(components(joins).select(F.col("node").alias("root"), F.col("root").alias("new_root")))
            alone = new.join(roots, new["root"] == roots["node"], "left_anti").select(F.col("root").alias("node"), F.col("new_root").alias("root"))
            roots = roots.join(dealt_anew(new, "root"), "root", "left").select("node", F.coalesce("new_root", "root").alias("root")).unionAll(alone)
    return with_components(sketch, nodes, roots).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
