"""Detection of benchmark passages in documents, by winnowed fingerprints.

Every run of WINDOW words holds WINDOW - K + 1 runs of K words, of which winnowing picks the
one with the least hash (the last, if several). The pick depends on those words alone, so a
passage of WINDOW words in a document and in an item makes the same fingerprint in both, and
joining fingerprints misses none. Each fingerprint carries the words beside it, as far as the
window could reach; comparing them extends a hit and proves or refutes it without going back
to the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.llm.tables import settled
from braidlog.llm.words import LETTERS_DIGITS, U64, Texts, grams, lists, over_slices
from braidlog.session import ship

SLOT_BITS = 23  # the filter of item fingerprints: 2^23 bits, 1 MB, at any size of the benchmark


def _winnowed(words: Texts, k: int, window: int) -> np.ndarray:
    """Places of the picked k-grams."""
    n = len(words.w) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    g, owner = grams(words.w, k), words.owner()
    best, offset = g[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, window - k + 1):
        here = g[j : n + j]
        less = here <= best
        best[less] = here[less]
        offset[less] = j
    valid = np.flatnonzero(owner[:n] == owner[window - 1 : window - 1 + n])
    picked = np.zeros(len(g), dtype=bool)
    picked[valid + offset[valid]] = True
    return np.flatnonzero(picked)


def _schema(k: int, window: int) -> tuple[str, list[str]]:
    beside = [f"{side}{i}" for side in "lr" for i in range(window - k)]
    return "prints array<struct<print:bigint,at:int,size:int," + ",".join(f"{x}:bigint" for x in beside) + ">>", beside


def _fingerprints(keys: list[str], k: int, window: int, short: list[int] | None, slots: bytes | None, edge: int):
    """A kernel: per text n_words and its fingerprints.

    short: the lengths under `window` for which every run counts; None: those of the whole
    text, if it is that short (an item). slots: a bit for each fingerprint value that may match;
    None: all may. edge: stands for words before the first and after the last.
    """
    reach = window - k
    table = None if slots is None else np.unpackbits(np.frombuffer(slots, dtype=np.uint8), bitorder="little").view(bool)

    def may_match(values: np.ndarray) -> np.ndarray:
        return np.ones(len(values), dtype=bool) if table is None else table[(values >> U64(64 - SLOT_BITS)).astype(np.int64)]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Texts(batch.column("text"), LETTERS_DIGITS)
        w, bounds, owner = words.w, words.bounds, words.owner()
        at = _winnowed(words, k, window)
        values = grams(w, k)[at]
        keep = may_match(values)
        found = [(at[keep], values[keep], k)]
        for m in range(1, window) if short is None else short:
            g = grams(w, m)
            if short is None:
                at = bounds[:-1][words.counts == m]
            else:
                at = np.flatnonzero(owner[: len(g)] == owner[m - 1 :]) if len(g) else np.empty(0, dtype=np.int64)
                at = at[may_match(g[at])]
            found.append((at, g[at], m))
        at = np.concatenate([x[0] for x in found]).astype(np.int64)
        values = np.concatenate([x[1] for x in found])
        sizes = np.concatenate([np.full(len(x[0]), x[2], dtype=np.int32) for x in found])
        full = np.concatenate([np.full(len(x[0]), i == 0) for i, x in enumerate(found)])
        order = np.argsort(at, kind="stable")
        at, values, sizes, full = at[order], values[order], sizes[order], full[order]
        # a whole short item is told from a k-gram of the same length by its size's sign
        text = owner[at]
        sides = []
        for step in [-1 - i for i in range(reach)] + [k + i for i in range(reach)]:
            place = at + step
            inside = (place >= bounds[text]) & (place < bounds[text + 1])
            side = np.full(len(at), edge, dtype=U64)
            side[inside] = w[place[inside]]
            sides.append(pa.array(side.view(np.int64)))
        signed = np.where(full, sizes, -sizes).astype(np.int32)
        struct = pa.StructArray.from_arrays(
            [pa.array(values.view(np.int64)), pa.array((at - bounds[text]).astype(np.int32)), pa.array(signed), *sides],
            names=["print", "at", "size", *_schema(k, window)[1]],
        )
        per_text = np.bincount(text, minlength=batch.num_rows)
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in keys), pa.array(words.counts.astype(np.int64)), lists(struct, per_text)], names=[*keys, "n_words", "prints"])

    return over_slices(kernel)


def _run(side: str, reach: int) -> Column:
    """How many words beside the fingerprint are equal, going outwards."""
    same, total = F.lit(True), F.lit(0)
    for i in range(reach):
        same = same & (F.col(f"{side}{i}") == F.col(f"item_{side}{i}"))
        total = total + same.cast("int")
    return total


def _covered(found: Column) -> Column:
    """Words in a union of sorted [begin, end) intervals."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).cast("int").alias("reached"))
    return F.aggregate(
        found,
        start,
        lambda acc, x: F.struct(
            (acc["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], acc["reached"]))).cast("long").alias("total"),
            F.greatest(acc["reached"], x["end"]).alias("reached"),
        ),
        lambda acc: acc["total"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of `window` consecutive words of an item (item_id,
    text); an item of fewer words, but not none, has to occur whole. Words are runs of ASCII
    letters, digits and all beyond ASCII, A-Z lower-cased. Null text has no words, nor has
    an empty one; an empty table of items hits nothing; items without an item_id hit words like
    any other, but count among no ids; repeated rows each get their result; texts are taken
    whole; an empty table gives no rows; other columns are ignored.

    What goes to every task is a bit set of fixed size. Only fingerprints that pass it are
    dealt out and joined, in a join that adaptive execution can split where a passage is in
    very many documents.
    """
    ship(docs.sparkSession)
    schema, beside = _schema(k, window)
    reach = window - k
    item_prints = settled(
        items.select(F.col("item_id").cast("string").alias("item_id"), "text")
        .mapInArrow(_fingerprints(["item_id"], k, window, None, None, 0), f"item_id string, n_words bigint, {schema}")
        .select("item_id", F.inline("prints"))
        .groupBy("print", "size", *beside)
        .agg(F.collect_set("item_id").alias("items"))
        .select("print", "size", *(F.col(x).alias(f"item_{x}") for x in beside), "items")
    )
    slot = F.shiftrightunsigned("print", 64 - SLOT_BITS)
    bits = np.zeros(1 << (SLOT_BITS - 6), dtype=U64)
    # at most 2^17 rows, whatever the benchmark's size
    for r in item_prints.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - SLOT_BITS}) & 63 as int))")).alias("bits")).toLocalIterator():
        bits[r["word"]] = U64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    short = sorted(-r["size"] for r in item_prints.where("size < 0").select("size").distinct().collect())
    base = settled(
        docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text").mapInArrow(
            _fingerprints(["doc_id", "row_hash"], k, window, short, bits.tobytes(), 1), f"doc_id bigint, row_hash bigint, n_words bigint, {schema}"
        )
    )
    left, right = F.when(F.col("size") > 0, _run("l", reach)).otherwise(0), F.when(F.col("size") > 0, _run("r", reach)).otherwise(0)
    hits = (
        base.where(F.size("prints") > 0)
        .select("doc_id", "row_hash", F.inline("prints"))
        .join(item_prints, ["print", "size"])
        .select("doc_id", "row_hash", "items", "size", (F.col("at") - left).alias("begin"), (F.col("at") + F.abs("size") + right).alias("end"))
        .where((F.col("size") < 0) | (F.col("end") - F.col("begin") >= window))
        .groupBy("doc_id", "row_hash")
        .agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select(F.col("doc_id").alias("hit_id"), F.col("row_hash").alias("hit_hash"), _covered(F.col("found")).alias("n_hit"), "items")
    )
    return (
        base.select("doc_id", "row_hash", "n_words")
        .join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_hash") == F.col("hit_hash")), "left")
        .select(
            "doc_id",
            "row_hash",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )
