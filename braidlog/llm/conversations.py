"""Repair of conversations whose turns are blank, repeated, cut off or out of role order, by the cheapest edits.

Each turn is a symbol of its role and its first fault, and a conversation a signature of these.
Edits are priced by a dynamic program over the states of a legal role order, and most
conversations have few signatures: distinct ones are sorted, which is the order in which a walk
over their prefix trie meets them. The walk keeps the layers of the path that it is on, so every
prefix that signatures share is computed once, and a terminal node gives its answer.

Long conversations are cut into signatures of SEGMENT turns. Such a part is solved from each
state to each, and parts are put together PARTS at a time. Places and repeats are found over
ranges of all rows, so that only the last step, one SHA-256 of a whole repaired conversation
that has to be taken in order, goes through one task; it streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.llm.tables import settled
from braidlog.operators.scans import placed
from braidlog.session import ship

#: Costs of the edits, and what a turn that stays cut off adds.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Symbols of a turn without fault, cut off, and to be deleted, for the roles s, u, a and any other.
FINE, CUT, GONE = "suao", "SUAO", "wxyz"
BLANK = " \t\n\x0b\x0c\r"
#: States: nothing yet, a system turn, a user turn, an assistant turn; legal ends are the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
SEGMENT, PARTS = 512, 64

_TO_USER, _TO_ASSISTANT = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), ((USER, ASSISTANT),)
_KEEPS = {"s": ((START, SYSTEM),), "u": _TO_USER, "a": _TO_ASSISTANT, "o": ()}
Layer = list  # of each state: (cost, audit), or None where it cannot be reached


def _better(layer: Layer, state: int, cost: int, audit: str) -> None:
    """Of equal costs the least audit stays. Equal costs never belong to an audit and its own prefix, so what follows cannot change the order."""
    if layer[state] is None or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def inserted(layer: Layer) -> Layer:
    """`layer` with the turns that may be inserted at its place; two at most are of use."""
    out = list(layer)
    for a, b in (*_TO_USER, *_TO_ASSISTANT):
        if out[a] is not None:
            _better(out, b, out[a][0] + INSERT, out[a][1] + "I")
    return out


def advanced(layer: Layer, symbol: str) -> Layer:
    """`layer` (see inserted) after a turn: deleted, kept, or given another role."""
    out = [None if x is None else (x[0] + DELETE, x[1] + "D") for x in layer]
    if symbol in GONE:
        return out
    more, role = (0, symbol) if symbol in FINE else (CUT_OFF, symbol.lower())
    for letter, cost, ways in (("K", more, _KEEPS[role]), ("R", more + REROLE, (*_TO_USER, *_TO_ASSISTANT))):
        for a, b in ways:
            if layer[a] is not None:
                _better(out, b, layer[a][0] + cost, layer[a][1] + letter)
    return out


def role_of(symbol: str) -> str:
    return FINE[GONE.index(symbol)] if symbol in GONE else symbol.lower()


def illegal(a: str, b: str) -> bool:
    return role_of(a) + role_of(b) not in ("su", "ua", "au")


def solved(signatures: Iterator[str], entries: tuple[int, ...]) -> Iterator[tuple[list[Layer], int]]:
    """Of each of the sorted `signatures`: the last layer from each entry state, and how many neighbours are out of order.

    `path` is the branch of the trie from its root to the node just visited.
    """
    first = [inserted([(0, "") if s == e else None for s in range(4)]) for e in entries]
    path, before = [(first, 0)], ""
    for signature in signatures:
        shared = 0
        for a, b in zip(before, signature, strict=False):
            if a != b:
                break
            shared += 1
        del path[shared + 1 :]
        for i in range(shared, len(signature)):
            layers, odd = path[-1]
            path.append(([inserted(advanced(x, signature[i])) for x in layers], odd + (i > 0 and illegal(signature[i - 1], signature[i]))))
        before = signature
        yield path[-1]


_SOLVED = "signature string, costs array<bigint>, audits array<string>, illegal bigint"


def _solve(entries: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for signature, (layers, odd) in zip(batch["signature"], solved(iter(batch["signature"]), entries), strict=True):
                flat = [x for layer in layers for x in layer]
                rows.append((signature, [None if x is None else x[0] for x in flat], [None if x is None else x[1] for x in flat], odd))
            yield pd.DataFrame(rows, columns=["signature", "costs", "audits", "illegal"])

    return run


def _solutions(signatures: DataFrame, entries: tuple[int, ...]) -> DataFrame:
    """(signature, costs, audits, illegal) of the distinct `signatures`, sorted so that neighbours share prefixes."""
    return signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInPandas(_solve(entries), _SOLVED)


_PART = "key string, seg bigint, costs array<bigint>, audits array<string>, illegal bigint, first string, last string"


def _put_together(group: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring parts of one conversation as one part."""
    group = group.sort_values("seg")
    out, odd, last = None, 0, None
    for row in group.itertuples():
        own = [[None if a is None else (int(row.costs[4 * e + s]), a) for s, a in enumerate(row.audits[4 * e : 4 * e + 4])] for e in range(4)]
        odd += int(row.illegal) + (last is not None and illegal(last, row.first))
        last = row.last
        if out is None:
            out = own
            continue
        joined = []
        for layer in out:
            new: Layer = [None] * 4
            for middle, x in enumerate(layer):
                for end, y in enumerate(own[middle]):
                    if x is not None and y is not None:
                        _better(new, end, x[0] + y[0], x[1] + y[1])
            joined.append(new)
        out = joined
    flat = [x for layer in out for x in layer]
    head = group.iloc[0]
    return pd.DataFrame([(head["key"], int(head["seg"]) // PARTS, [None if x is None else x[0] for x in flat], [None if x is None else x[1] for x in flat], odd, head["first"], last)], columns=["key", "seg", "costs", "audits", "illegal", "first", "last"])


def _answers(segments: DataFrame) -> DataFrame:
    """(key, cost, audit, illegal) of each conversation of `segments` (key, seg, signature)."""
    parts = segments.groupBy("key").agg(F.max("seg").alias("most"))
    segments = settled(segments.join(parts, "key"))
    single, several = segments.where("most = 0"), segments.where("most > 0")
    done = single.join(_solutions(single, (START,)), "signature").select("key", "costs", "audits", "illegal")
    most = several.agg(F.max("most")).first()[0] or 0
    if most:
        ends = (F.substring("signature", 1, 1).alias("first"), F.substring("signature", -1, 1).alias("last"))
        parts = settled(several.join(_solutions(several, (START, SYSTEM, USER, ASSISTANT)), "signature").select("key", "seg", "costs", "audits", "illegal", *ends))
        while most:
            parts = settled(parts.groupBy("key", F.floor(F.col("seg") / PARTS).alias("of")).applyInPandas(_put_together, _PART))
            most //= PARTS
        done = done.unionAll(parts.select("key", F.slice("costs", 1, 4).alias("costs"), F.slice("audits", 1, 4).alias("audits"), "illegal"))
    end = lambda s: F.when(F.element_at("costs", s + 1).isNotNull(), F.struct(F.element_at("costs", s + 1).alias("cost"), F.element_at("audits", s + 1).alias("audit")))
    # least skips what is null
    return done.select("key", F.least(end(START), end(ASSISTANT)).alias("best"), "illegal").select("key", "best.cost", "best.audit", "illegal")


def _edits(turns: bool):
    """For mapInArrow over (key, audit, role, text), each conversation's audit before its turns: what the edits leave, as turns or as its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = audit = digest = None
        at = n = 0
        state = START
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal n
            if turns:
                out.append((key, n, role, text))
            else:
                digest.update(("\n" if n else "").encode() + f"{role}:{text}".encode())
            n += 1

        def step(letter: str, role: str, text: str) -> None:
            nonlocal state
            if letter == "D":
                return
            if letter == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            else:
                state = ASSISTANT if state == USER else USER
                role = "assistant" if state == ASSISTANT else "user"
            put(role, text)

        def insertions() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                step("I", "", "")
                at += 1

        def end() -> None:
            insertions()
            if not turns:
                out.append((key, digest.hexdigest()))

        def flushed() -> pa.RecordBatch:
            names = ["key", "place", "role", "text"] if turns else ["key", "repaired_sha256"]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            types = [pa.string(), pa.int64(), pa.string(), pa.string()] if turns else [pa.string()] * 2
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for k, found, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "audit", "role", "text")), strict=True):
                if found is not None:
                    if key is not None:
                        end()
                    key, audit, at, n, state, digest = k, found, 0, 0, START, hashlib.sha256()
                    continue
                insertions()
                step(audit[at], role, text)
                at += 1
            yield flushed()
        if key is not None:
            end()
            yield flushed()

    return run


def _prepared(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with key, order columns and flags, without and with their texts."""
    key = F.when(F.col("conv_id").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("conv_id").cast("string")))
    bare = F.rtrim("text_", F.lit(BLANK))
    found = (
        turns.select(key.alias("key"), "conv_id", "turn", "copy", "missing", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text_"), "tie")
        .withColumn("bare", bare)
        .withColumn("fault", F.when(F.length("bare") == 0, "blank").when(~F.substring("bare", -1, 1).isin(".", "!", "?"), "truncated"))
        .drop("bare")
    )
    light = found.select("key", "turn", "tie", "copy", "missing", "role", "fault", F.unhex(F.sha2("text_", 256)).alias("digest"))
    return light, found.select("key", "turn", "tie", "copy", "missing", "role", F.col("text_").alias("text"))


ORDER = ("turn", "tie", "copy")


def _repaired(turns: DataFrame, as_turns: bool) -> tuple[DataFrame, DataFrame]:
    ship(turns.sparkSession)
    for name, default in (("copy", F.lit(0)), ("missing", F.lit(False)), ("tie", F.sha2(F.concat(F.coalesce("role", F.lit(" ")), F.lit("\0"), F.coalesce("text", F.lit(" "))), 256))):
        if name not in turns.columns:
            turns = turns.withColumn(name, default)
    light, full = _prepared(turns)
    light = light.where(~F.col("missing")).drop("missing")
    # a repeat is a row of its role and text that is not the first by place
    nth = placed(light, ["key", "role", "digest"], ORDER, "nth").drop("digest")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("nth") > 0, "duplicate").otherwise(F.col("fault"))
    kind = F.array_position(F.array(*(F.lit(c) for c in "sua")), F.substring("role", 1, 1))
    kind = F.when(kind > 0, kind).otherwise(4).cast("int")
    signs = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(FINE)
    rows = nth.withColumn("fault", fault).select("key", *ORDER, "fault", F.substring(signs, kind, F.lit(1)).alias("symbol"))
    rows = settled(placed(rows, ["key"], ORDER))
    segments = rows.groupBy("key", F.floor(F.col("place") / SEGMENT).alias("seg")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "symbol")))["symbol"], "").alias("signature"))
    answers = settled(_answers(segments))
    counts = [F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")]
    of_turns = rows.groupBy("key", "turn").agg(*counts)
    summary = of_turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated"))).join(answers, "key")
    none = lambda kind: F.lit(None).cast(kind)
    heads = answers.select("key", none("long").alias("turn"), none("string").alias("tie"), F.lit(-1).alias("copy"), "audit", none("string").alias("role"), none("string").alias("text"))
    body = full.where(~F.col("missing")).select("key", "turn", "tie", F.col("copy").cast("int").alias("copy"), none("string").alias("audit"), "role", "text")
    stream = heads.unionByName(body).repartition("key").sortWithinPartitions("key", F.col("audit").isNull(), "turn", "tie", "copy")
    schema = "key string, place bigint, role string, text string" if as_turns else "key string, repaired_sha256 string"
    return summary, stream.select("key", "audit", "role", "text").mapInArrow(_edits(as_turns), schema)


def repair(turns: DataFrame) -> DataFrame:
    """Per conv_id of `turns` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows stand by turn, null first; of equal turns by a digest of role and text, or by the columns
    `tie` and `copy` if there are any. Rows whose column `missing` is true are
    not there, but their conversation is. A row's first fault counts: blank (nothing but ASCII blanks), duplicate (role
    and text of an earlier row), truncated (its last other character is not one of .!?). Roles are told by their first
    letter. Keeping a turn is free, giving it the role user or assistant costs 1, deleting it 2,
    inserting an empty one 5; blank and repeated turns must go, and truncated ones that stay add 5.
    The result is empty or an optional system turn and then user and assistant in turns. audit
    names the cheapest edits (K, R, D, I), the least such text of equal costs; repaired_sha256 is of
    `role:text` lines. gaps counts turn numbers that are missing between the first and the last.

    Null roles and texts are one space; null conv_ids are one conversation. Repeated rows are
    duplicates. A conversation without rows has zeros, an empty audit and the digest of nothing. An empty table gives no
    rows, other columns are ignored, texts and conversations of any length are taken whole.
    """
    summary, digests = _repaired(turns.select(*(c for c in turns.columns if c in ("conv_id", "turn", "role", "text", "tie", "copy", "missing"))), False)
    every = turns.select("conv_id").distinct().withColumn("key", F.when(F.col("conv_id").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("conv_id").cast("string"))))
    out = every.join(summary, "key", "left").join(digests, "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations, as repair prices and digests them."""
    _, out = _repaired(turns.select(*(c for c in turns.columns if c in ("conv_id", "turn", "role", "text", "tie", "copy", "missing"))), True)
    of_key = F.when(F.col("key") != "0", F.substring("key", 2, 40)).cast(turns.schema["conv_id"].dataType)
    return out.select(of_key.alias("conv_id"), "place", "role", "text")


def damaged(turns: DataFrame, rolls: Column) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with the fault that `rolls` names: 0 missing, 1 empty, 2 without its ends of sentences, 3 repeated, 4 of role user."""
    own = F.sha2(F.concat(F.coalesce("role", F.lit(" ")), F.lit("\0"), F.coalesce("text", F.lit(" "))), 256)
    out = turns.select("conv_id", "turn", "role", "text", own.alias("tie"), rolls.alias("roll"))
    text = F.when(F.col("roll") == 1, "").when(F.col("roll") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("roll") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", F.when(F.col("roll") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "tie", F.explode(copies).alias("copy"), (F.col("roll") == 0).alias("missing"))
