"""Templates of log lines by fixed-depth online clustering, exact and distributed.

The sequential definition: lines of one category, in order, fall into leaves by their number
of slots and their first depth - 2 slots. In its leaf a line joins the most similar cluster
(the first of equals; none if nothing is alike), if that is similar enough, and each slot in
which they differ becomes a wildcard for good; otherwise it starts a cluster of its own.

Three facts make this a DataFrame job. Leaves do not touch each other. A repeat of slots seen
before in its leaf changes no template, so only first occurrences run in sequence. And a
repeat joins another cluster than its first occurrence only after an earlier cluster has come
to fit it wholly, so assignments are intervals of the sequence. The fold streams over leaves
and counts each leaf's distinct slots in their clusters; only those that move come out as
intervals, over which their lines are counted. Where all slots have to agree nothing is folded.

Slots move as one packed string. What is read again is kept compressed, and new clusters get
their ids by their keys alone, so their templates move once more only, to the ids.
"""

from __future__ import annotations

from array import array
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from braidlog.functions.lines import with_parsed
from braidlog.functions.tokens import RECOGNIZERS, STAR, n_packed, packed, unpacked, with_slots, with_tokens
from braidlog.operators.scans import placed
from braidlog.session import Zipped, settled, ship, tidied, zipped
from braidlog.sources.catalogue import Catalogue

#: A loaded cluster's place in its leaf comes before every line's.
LOADED = -1
END = (1 << 63) - 1


def slotted(lines: DataFrame, line: str, recognizers=RECOGNIZERS) -> DataFrame:
    """`lines` with timestamp, category and slots of the text column `line`."""
    out = with_parsed(lines, line, ("timestamp", "category", "content"))
    return with_slots(with_tokens(out, "content", "tokens_", recognizers), "tokens_").drop("content", "tokens_")


def leaf_of(slots: Column, depth: int) -> Column:
    """What a line is routed by, beside its category."""
    return F.struct(F.size(slots).alias("n"), F.slice(slots, 1, max(depth, 2) - 2).alias("prefix") if depth > 2 else F.array().cast("array<string>").alias("prefix"))


#: So many clusters, or rows, are compared as they are; the index is for more.
FEW = 64


class Index:
    """Which rows hold a slot at a position; a row's slots may turn into wildcards, which hold any."""

    def __init__(self, width: int):
        self.width = width
        self.holding: dict[tuple[int, int], array] = {}
        self.wild = [array("q") for _ in range(width)]

    def add(self, row: int, slots: np.ndarray) -> None:
        for place, code in enumerate(slots.tolist()):
            (self.wild[place] if code < 0 else self.holding.setdefault((place, code), array("q"))).append(row)

    def widened(self, row: int, places: np.ndarray) -> None:
        for place in places.tolist():  # where it was listed before it stays: who asks compares
            self.wild[place].append(row)

    def at(self, place: int, code: int) -> list[array]:
        return [x for x in (self.holding.get((place, code)), self.wild[place]) if x]

    def alike(self, slots: np.ndarray, least: int) -> np.ndarray:
        """Rows, in order, with all of those that agree with `slots` in `least` places or more.

        Such a row agrees in one at least of any width - least + 1 places; those with the fewest rows are asked.
        """
        lists = sorted((self.at(p, c) for p, c in enumerate(slots.tolist())), key=lambda x: sum(map(len, x)))
        found = [np.frombuffer(x, dtype=np.int64) for own in lists[: self.width - least + 1] for x in own]
        return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


class Leaf:
    """The sequential fold over one leaf's first occurrences; slots are small integers, a wildcard -1, what no template has -2."""

    def __init__(self, width: int, threshold: float):
        self.width, self.threshold = width, threshold
        self.templates = np.empty((0, width), dtype=np.int32)
        self.n, self.index = 0, None
        # how many places have to agree
        self.least = next((k for k in range(1, width + 1) if k / width >= threshold), 1) if width else 0

    def add(self, template: np.ndarray) -> int:
        self.templates = _room(self.templates, self.n)
        self.templates[self.n] = template
        if self.index is not None:
            self.index.add(self.n, template)
        self.n += 1
        return self.n - 1

    def near(self, slots: np.ndarray) -> np.ndarray:
        if self.n <= FEW:
            return np.arange(self.n)
        if self.index is None:
            self.index = Index(self.width)
            for i in range(self.n):
                self.index.add(i, self.templates[i])
        return self.index.alike(slots, self.least)

    def place(self, slots: np.ndarray) -> tuple[int | None, bool]:
        """Cluster of a line, none if it is to be a new one, and whether its template changed."""
        if not self.width:
            return (0 if self.n else None), False
        near = self.near(slots)
        if len(near):
            own = self.templates[near]
            alike = ((own == slots) | (own < 0)).sum(axis=1)
            best = int(alike.argmax())
            if alike[best] >= self.least:
                cluster = int(near[best])
                changed = np.flatnonzero((own[best] != slots) & (own[best] >= 0))
                self.templates[cluster, changed] = -1
                if self.index is not None:
                    self.index.widened(cluster, changed)
                return cluster, bool(len(changed))
        return None, False


def _room(table: np.ndarray, n: int) -> np.ndarray:
    """`table` with room for row n."""
    if n < len(table):
        return table
    grown = np.empty((max(8, 2 * n), *table.shape[1:]), dtype=table.dtype)
    grown[:n] = table[:n]
    return grown


class Rows:
    """The rows of a leaf that may yet move, each with its cluster and since when."""

    def __init__(self, width: int):
        self.coded, self.index, self.n = np.empty((0, width), dtype=np.int32), None, 0
        # cluster, since, last occurrence
        self.at = np.empty((0, 3), dtype=np.int64)
        self.about: list[tuple] = []
        self.moved: set[int] = set()

    def add(self, coded: np.ndarray, cluster: int, since: int, last: int, about: tuple) -> None:
        self.coded, self.at = _room(self.coded, self.n), _room(self.at, self.n)
        self.coded[self.n], self.at[self.n] = coded, (cluster, since, last)
        self.about.append(about)
        if self.index is not None:
            self.index.add(self.n, coded)
        self.n += 1

    def later(self, cluster: int, template: np.ndarray, seq: int) -> list[int]:
        """Rows in later clusters than `cluster` that its `template` fits wholly and that come again after `seq`."""
        if not self.n:
            return []
        fixed = np.flatnonzero(template >= 0)
        near = np.arange(self.n)
        if self.n > FEW and len(fixed):
            if self.index is None:
                self.index = Index(self.coded.shape[1])
                for i in range(self.n):
                    self.index.add(i, self.coded[i])
            lists = [self.index.holding.get((p, c), array("q")) for p, c in zip(fixed.tolist(), template[fixed].tolist(), strict=True)]
            near = np.frombuffer(min(lists, key=len), dtype=np.int64) if all(lists) else near[:0]
        near = near[(self.at[near, 0] > cluster) & (self.at[near, 2] > seq)]
        return near[(self.coded[near][:, fixed] == template[fixed]).all(axis=1)].tolist()


class Part:
    """A batch of rows: slots as places in its own list of words."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        slots = batch.column("slots")
        values = slots.values.dictionary_encode()
        self.words, self.flat, self.offsets = values.dictionary.to_pylist(), values.indices.to_numpy(zero_copy_only=False), slots.offsets.to_numpy()
        self.seq, self.last, self.n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seq", "last", "n"))
        self.first_seen, self.last_seen, self.seed = (batch.column(c) for c in ("first_seen", "last_seen", "seed"))

    def slots(self, row: int) -> list[str]:
        return [self.words[i] for i in self.flat[self.offsets[row] : self.offsets[row + 1]].tolist()]

    @cached_property
    def numbers(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}

    def fitting(self, rows: np.ndarray, template: list[str]) -> np.ndarray:
        """Which of a leaf's `rows` `template` fits wholly."""
        fit = self.seq[rows] >= 0
        for place, word in enumerate(template):
            if word != STAR:
                fit &= self.flat[self.offsets[rows] + place] == self.numbers.get(word, -1)
        return fit


class Fold:
    """A leaf while its rows come by: clusters with what they count; of its rows, only those that may move are kept."""

    def __init__(self, width: int, threshold: float, node: str | None, category: str | None):
        self.leaf, self.rows, self.node, self.category = Leaf(width, threshold), Rows(width), node, category
        self.codes: dict[str, int] = {}
        self._names: list[str] = []
        self.clusters: list[list] = []  # seed, spawned at, count, first seen, last seen
        self.pieces: list[tuple[list[str], int, int, int]] = []  # slots, cluster, from, to

    def start(self, slots: list[str], seed: int | None, seq: int) -> int:
        # templates alone give words their codes; one that comes later is in no earlier cluster
        coded = [-1 if w == STAR else self.codes.setdefault(w, len(self.codes)) for w in slots]
        self.clusters.append([seed, seq, 0, None, None])
        return self.leaf.add(np.array(coded, dtype=np.int32))

    def count(self, cluster: int, n: int, first: str | None, last: str | None) -> None:
        own = self.clusters[cluster]
        own[2] += n
        own[3] = min((x for x in (own[3], first) if x is not None), default=None)
        own[4] = max((x for x in (own[4], last) if x is not None), default=None)

    def template(self, cluster: int) -> list[str]:
        return [STAR if v < 0 else self.names[v] for v in self.leaf.templates[cluster].tolist()]

    @property
    def names(self) -> list[str]:
        if len(self._names) != len(self.codes):
            self._names = list(self.codes)
        return self._names

    def take(self, part: Part, begin: int, end: int) -> None:
        """Rows come in order, loaded clusters (seq < 0) first.

        What the first cluster fits wholly stays there and changes nothing, so it is counted at once.
        """
        rows = np.arange(begin, end)
        while len(rows):
            if self.leaf.n and len(rows) > FEW:
                fit = part.fitting(rows, self.template(0))
                own = rows[fit]
                if len(own):
                    first, last = (pc.min_max(x.take(pa.array(own))).as_py() for x in (part.first_seen, part.last_seen))
                    self.count(0, int(part.n[own].sum()), first["min"], last["max"])
                rows = rows[~fit]
            done = len(rows)
            for i, row in enumerate(rows.tolist()):
                if self.step(part, row) and len(rows) - i > FEW:
                    done = i + 1
                    break
            rows = rows[done:]

    def step(self, part: Part, row: int) -> bool:
        """Whether the first cluster began or changed."""
        slots, seq, last = part.slots(row), int(part.seq[row]), int(part.last[row])
        if seq < 0:
            return self.start(slots, part.seed[row].as_py(), LOADED) == 0
        coded = np.array([self.codes.get(w, -2) for w in slots], dtype=np.int32)
        cluster, changed = self.leaf.place(coded)
        if cluster is None:
            cluster = self.start(slots, None, seq)
            coded = self.leaf.templates[cluster].copy()
            began = cluster == 0
        else:
            began = False
        if changed:
            for k in self.rows.later(cluster, self.leaf.templates[cluster], seq):
                self.pieces.append((self.rows.about[k][0], int(self.rows.at[k, 0]), int(self.rows.at[k, 1]), seq))
                self.rows.at[k, :2] = cluster, seq
                self.rows.moved.add(k)
        counts = (int(part.n[row]), part.first_seen[row].as_py(), part.last_seen[row].as_py())
        if cluster and last > seq:
            self.rows.add(coded, cluster, seq, last, (slots, *counts))
        else:
            self.count(cluster, *counts)
        return began or (changed and cluster == 0)

    def out(self) -> list[tuple]:
        """Rows of FOLDED: clusters, then what moved."""
        for k, (slots, *counts) in enumerate(self.rows.about):
            if k in self.rows.moved:
                self.pieces.append((slots, int(self.rows.at[k, 0]), int(self.rows.at[k, 1]), END))
            else:
                self.count(int(self.rows.at[k, 0]), *counts)
        head = (self.node, self.category)
        own = [(*head, *self.clusters[c][:2], self.template(c), *self.clusters[c][2:], None, None, None) for c in range(self.leaf.n)]
        return own + [(*head, *self.clusters[c][:2], None, 0, None, None, slots, since, until) for slots, c, since, until in self.pieces]


_TYPES = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
FOLDED = "node string, category string, seed bigint, spawn_seq bigint, template array<string>, n bigint, first_seen string, last_seen string, slots array<string>, from_seq bigint, to_seq bigint"
_FIELDS = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in FOLDED.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


def _joined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """`batch` with its lists packed."""

    def text(lists: pa.Array) -> pa.Array:
        if lists.null_count == len(lists):
            return pa.nulls(len(lists), pa.string())
        values = pc.replace_substring(pc.replace_substring(lists.values, "\x01", "\x01a"), "\n", "\x01b")
        plain = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, values, mask=lists.is_null()), "\n")
        return pc.if_else(pc.equal(pc.list_value_length(lists), 0), plain, pc.binary_join_element_wise(plain, "", "\n"))

    return pa.RecordBatch.from_arrays([text(x) if pa.types.is_list(x.type) else x for x in batch.columns], names=batch.schema.names)


def _lone(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
    """Rows that are all of their leaf are clusters as they stand."""
    own = batch.take(pa.array(rows))
    found = {"node": "node", "category": "category", "seed": "seed", "spawn_seq": "seq", "template": "slots", "n": "n", "first_seen": "first_seen", "last_seen": "last_seen"}
    return pa.RecordBatch.from_arrays([own.column(found[f.name]).cast(f.type) if f.name in found else pa.nulls(len(rows), f.type) for f in _FIELDS], schema=_FIELDS)


def _fold(threshold: float):
    """For mapInArrow over whole leaves, each in order: rows of FOLDED."""

    def run(batches):
        fold, key, out = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            part, keys = Part(batch), batch.column("key").to_numpy(zero_copy_only=False)
            begins = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
            ends = np.append(begins[1:], len(keys))
            # the last run may go on in the next batch
            lone = (ends - begins == 1) & (ends < len(keys))
            lone[0] &= fold is None or key != keys[0]
            if lone.any():
                yield _lone(batch, begins[lone])
            for begin, end in zip(begins[~lone].tolist(), ends[~lone].tolist(), strict=True):
                if fold is None or key != keys[begin]:
                    out += fold.out() if fold else []
                    width = int(part.offsets[begin + 1] - part.offsets[begin])
                    fold, key = Fold(width, threshold, *(batch.column(c)[begin].as_py() for c in ("node", "category"))), keys[begin]
                fold.take(part, begin, end)
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
        out += fold.out() if fold else []
        if out:
            yield _batch(out)

    return run


def _kernel(threshold: float):
    """The fold of one leaf's rows (node, category, seq, slots, loaded_id), any of which may come again."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["seq", "loaded_id"], kind="stable")
        seeds = pd.array([None if x is None else int(x) for x in group["loaded_id"]], dtype="Int64")
        rows = group.assign(key="", last=END, n=(group["seq"] >= 0).astype("int64"), first_seen=None, last_seen=None, seed=seeds)
        types = {"node": pa.string(), "category": pa.string(), "slots": pa.list_(pa.string()), "seq": pa.int64(), "first_seen": pa.string(), "last_seen": pa.string(), "seed": pa.int64()}
        whole = pa.RecordBatch.from_pandas(rows[["key", "last", "n", *types]], preserve_index=False)
        whole = pa.RecordBatch.from_arrays([x.cast(types.get(c, x.type)) for c, x in zip(whole.schema.names, whole.columns, strict=True)], names=whole.schema.names)
        return pa.Table.from_batches(list(_fold(threshold)([whole])), _FIELDS).to_pandas()

    return run


def cluster(lines: DataFrame, depth: int = 4, threshold: float = 0.5, loaded: DataFrame | None = None) -> DataFrame:
    """Clusters of `lines` (node, category, seq, timestamp, slots) over those `loaded`.

    node may be null throughout; else each node is clustered on its own. seq, distinct and not
    negative, is the order of lines. loaded has a catalogue's columns and belongs to all-null
    nodes. Returns (node, category, id, count, first_seen, last_seen, template); ids run from 1
    in the order in which clusters of a category began, after the largest loaded one.
    threshold must be in [0, 1]. With no lines the loaded clusters come back.

    Lines are aggregated to distinct slots before they move, which takes off the frequent
    templates' weight. A leaf's distinct slots pass through one task in order, as the fold over
    them is sequential by definition; it holds the leaf's clusters and what may yet move. There
    an index by position and slot leaves few clusters to compare. Slots that have to agree in all
    places, as all do at threshold 1, are grouped and joined with what is loaded instead.
    """
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold must be in [0, 1]: {threshold}")
    ship(lines.sparkSession)
    lines = lines.select("node", "category", "seq", "timestamp", packed(F.col("slots")).alias("slots"))
    if threshold == 1:  # they are read once
        return _agreed(lines, depth, loaded)
    # reading and parsing are the dear part and run once; a lost executor's share is made again
    kept = Zipped(lines)
    try:
        return _clustered(kept, depth, threshold, loaded)
    finally:
        kept.drop()


#: Shuffle files of so few zipped batches of lines are not worth the wait for their removal.
SMALL = 16

#: What a cluster is known by, and what it counts.
_KEY = ["node", "category", "seed", "spawn_seq"]
_COUNTS = ["n", "first_seen", "last_seen"]


def _whole(slots: Column, threshold: float) -> Column:
    """Whether so many packed slots have to agree in all places."""
    n = n_packed(slots)
    return F.when(n > 0, (n - 1) / F.when(n > 0, n) < threshold).otherwise(True)


def _seeds(loaded: DataFrame, depth: int) -> DataFrame:
    """Loaded clusters, each with a number, `seed`, and its place in its leaf."""
    own = settled(loaded.withColumn("seed", F.monotonically_increasing_id())).withColumn("leaf", leaf_of(F.col("template"), depth)).withColumn("slots", packed(F.col("template")))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("category", "leaf").orderBy("id", "template", "seed")))


def _fitted(rows: DataFrame, seeds: DataFrame | None, depth: int) -> DataFrame:
    """Clusters of rows whose slots have to agree in all places: a loaded one's if it fits, else each row's own."""
    if seeds is None:
        return rows.select("node", "category", F.lit(None).cast("long").alias("seed"), F.col("seq").alias("spawn_seq"), F.col("slots").alias("template"), *_COUNTS)
    own = seeds.select(F.col("category").alias("c_"), F.col("leaf").alias("leaf_"), F.col("template").alias("p_"), F.col("slots").alias("t_"), F.struct("place", "seed").alias("s_"))
    wild = F.array_contains("p_", STAR)
    exact = own.where(~wild).groupBy("c_", "t_").agg(F.min("s_").alias("s_"))
    rows = rows.join(exact, F.col("category").eqNullSafe(F.col("c_")) & (F.col("slots") == F.col("t_")), "left").drop("c_", "t_")
    wide = own.where(wild).drop("t_")
    if not wide.isEmpty():
        # only catalogues of another threshold have such clusters; each is held against its leaf's rows
        fits = F.forall(F.zip_with("own_", "p_", lambda x, p: (x == p) | (p == STAR)), lambda x: x)
        near = rows.select("category", "slots", unpacked(F.col("slots")).alias("own_")).withColumn("leaf", leaf_of(F.col("own_"), depth))
        near = near.join(wide, F.col("category").eqNullSafe(F.col("c_")) & (F.col("leaf") == F.col("leaf_")) & fits)
        near = near.groupBy(F.col("category").alias("c_"), F.col("slots").alias("t_")).agg(F.min("s_").alias("w_"))
        rows = rows.join(near, F.col("category").eqNullSafe(F.col("c_")) & (F.col("slots") == F.col("t_")), "left").withColumn("s_", F.least("s_", "w_"))
    seed = F.col("s_.seed")
    return rows.select("node", "category", seed.alias("seed"), F.when(seed.isNull(), F.col("seq")).otherwise(LOADED).alias("spawn_seq"), F.when(seed.isNull(), F.col("slots")).alias("template"), *_COUNTS)


def _loose(rows: DataFrame, seeds: DataFrame | None, depth: int, threshold: float) -> Zipped:
    """FOLDED, its lists packed, of rows that are folded in sequence, leaf by leaf."""
    rows = rows.select("node", "category", "slots", "seq", "last", *_COUNTS, F.lit(None).cast("long").alias("seed"), F.lit(0).alias("place"))
    if seeds is not None:
        none = F.lit(None).cast("string")
        rows = rows.unionAll(seeds.select(none.alias("node"), "category", "slots", F.lit(LOADED).cast("long"), F.lit(LOADED).cast("long"), F.lit(0).cast("long"), none, none, "seed", "place"))
    # keys and slots are written out after the exchange only
    prefix = F.substring_index("slots", "\n", depth - 2) if depth > 2 else F.lit("")
    key = F.to_json(F.struct("node", "category", n_packed(F.col("slots")).alias("n"), prefix.alias("prefix")))
    rows = rows.repartition(key).withColumn("key", key).sortWithinPartitions("key", "seq", "place").withColumn("slots", unpacked(F.col("slots")))
    fold = _fold(threshold)
    return Zipped(rows.drop("place").mapInArrow(lambda batches: zipped(map(_joined, fold(batches))), "zipped binary"), StructType.fromDDL(FOLDED.replace("array<string>", "string")), shared=True)


def _moved(folded_: Zipped, lines: Zipped) -> DataFrame | None:
    """Counts, line by line, of slots that changed clusters, if any did; only they go back to their lines."""
    apart = folded_.frame(*_KEY, "slots", "from_seq", "to_seq").where("from_seq is not null")
    if apart.isEmpty():
        return None
    same = F.col("p.node").eqNullSafe(F.col("s.node")) & F.col("p.category").eqNullSafe(F.col("s.category")) & (F.col("p.slots") == F.col("s.slots"))
    moved = apart.alias("p").join(lines.frame().alias("s"), same & (F.col("s.seq") >= F.col("p.from_seq")) & (F.col("s.seq") < F.col("p.to_seq")))
    return moved.select(*(f"p.{c}" for c in _KEY), F.lit(1).cast("long").alias("n"), F.col("s.timestamp").alias("first_seen"), F.col("s.timestamp").alias("last_seen"))


def _numbered(fresh: DataFrame) -> DataFrame:
    """New clusters with ids, from 1, in the order in which they began; a category of any size is spread."""
    return placed(fresh, ["node", "category"], ["spawn_seq"], "place_").withColumn("id", (F.col("place_") + 1).cast("decimal(20,0)")).drop("place_")


def _catalogued(numbered: DataFrame) -> DataFrame:
    return numbered.select("node", "category", "id", F.col("n").cast("decimal(20,0)").alias("count"), "first_seen", "last_seen", unpacked(F.col("template")).alias("template"))


def _distinct(lines: DataFrame) -> DataFrame:
    return lines.groupBy("node", "category", "slots").agg(F.min("seq").alias("seq"), F.max("seq").alias("last"), F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def _agreed(lines: DataFrame, depth: int, loaded: DataFrame | None) -> DataFrame:
    """Clusters where all slots have to agree."""
    if loaded is None:
        return _catalogued(_numbered(_fitted(_distinct(lines), None, depth).drop("seed")))
    seeds = _seeds(loaded, depth)
    found = settled(_fitted(_distinct(lines), seeds, depth))
    return _over(seeds, _numbered(found.where("seed is null").drop("seed")), found.where("seed is not null"))


def _clustered(lines: Zipped, depth: int, threshold: float, loaded: DataFrame | None) -> DataFrame:
    seeds = None if loaded is None else _seeds(loaded, depth)
    some = lambda of, whole: None if of is None else of.where(_whole(F.col("slots"), threshold) == whole)
    spark = lines.rows.sparkSession
    tidy = lambda: lines.n > SMALL and tidied(spark)
    rows = Zipped(_distinct(lines.frame()), shared=True)
    tidy()
    fitted = _fitted(some(rows.frame(), True), some(seeds, True), depth)
    folded_ = _loose(some(rows.frame(), False), some(seeds, False), depth, threshold)
    counted = folded_.frame(*_KEY, *_COUNTS, "from_seq").where("from_seq is null").drop("from_seq")
    moved = _moved(folded_, lines)
    if moved is not None:
        tidy()
        counted = counted.unionAll(moved).groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    counted = settled(fitted.select(*_KEY, *_COUNTS).unionAll(counted))
    lines.drop()
    tidy()
    texts = folded_.frame(*_KEY, "template", "from_seq").where("from_seq is null").drop("from_seq")
    texts = fitted.select(*_KEY, "template").unionAll(texts)
    numbers = _numbered(counted.where("seed is null").drop("seed"))
    own = texts.where("seed is null").select(F.col("node").alias("node_"), F.col("category").alias("category_"), F.col("spawn_seq").alias("spawn_"), "template")
    same = F.col("node").eqNullSafe(F.col("node_")) & F.col("category").eqNullSafe(F.col("category_")) & (F.col("spawn_seq") == F.col("spawn_"))
    fresh = numbers.join(own, same).drop("node_", "category_", "spawn_")
    if loaded is None:
        return _catalogued(fresh)
    known = texts.where("seed is not null and template is not null").select(F.col("seed").alias("seed_"), "template")
    gains = counted.where("seed is not null").join(known, F.col("seed") == F.col("seed_"), "left").drop("seed_")
    return _over(seeds, fresh, gains)


def _over(seeds: DataFrame, fresh: DataFrame, gains: DataFrame) -> DataFrame:
    """Loaded clusters with what was folded into them, and new ones with ids after theirs."""
    top = seeds.groupBy(F.col("category").alias("top_category")).agg(F.max("id").alias("top"))
    limit = F.lit(str((1 << 64) - 1)).cast("decimal(21,0)")
    fresh = _catalogued(fresh).join(top, F.col("category").eqNullSafe(F.col("top_category")), "left").select(
        "node",
        "category",
        F.least(F.col("id").cast("decimal(21,0)") + F.coalesce("top", F.lit(0)).cast("decimal(20,0)"), limit).cast("decimal(20,0)").alias("id"),
        "count",
        "first_seen",
        "last_seen",
        "template",
    )
    gains = gains.groupBy(F.col("seed").alias("s_")).agg(F.sum("n").alias("n"), F.min("first_seen").alias("f_"), F.max("last_seen").alias("l_"), F.max("template").alias("t_"))
    old = seeds.join(gains, F.col("seed") == F.col("s_"), "left").select(
        F.lit(None).cast("string").alias("node"),
        "category",
        "id",
        (F.col("count") + F.coalesce("n", F.lit(0))).cast("decimal(20,0)").alias("count"),
        F.least("first_seen", "f_").alias("first_seen"),
        F.greatest("last_seen", "l_").alias("last_seen"),
        F.coalesce(unpacked(F.col("t_")), "template").alias("template"),
    )
    return fresh.unionAll(old)


def folded(catalogue: Catalogue, lines: DataFrame) -> Catalogue:
    """`catalogue` after `lines` (category, seq, timestamp, slots)."""
    lines = lines.withColumn("node", F.lit(None).cast("string"))
    out = cluster(lines, catalogue.depth, catalogue.threshold, catalogue.clusters)
    return Catalogue(out.drop("node"), catalogue.depth, catalogue.threshold, catalogue.batch)


def exact_catalogue(lines: DataFrame) -> DataFrame:
    """What cluster returns at threshold 1.0 with nothing loaded: no wildcard ever appears, so grouping does it."""
    lines = lines.withColumn("slots", packed(F.col("slots")))
    return _catalogued(_numbered(_distinct(lines).withColumnsRenamed({"seq": "spawn_seq", "slots": "template"}).drop("last")))
