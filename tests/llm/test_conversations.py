import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def tie(role, text):
    return hashlib.sha256(f"{' ' if role is None else role}\0{' ' if text is None else text}".encode()).hexdigest()


def after_damage(rows):
    """(conv_id, turn, role, text) by conversation, in order, as the contract damages and orders them."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, tie(r[2], r[3]))):
        own = out.setdefault(conv, [])
        roll = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if roll:
            text = "" if roll == 1 else re.sub("[.!?]", "", text) if roll == 2 else text
            own += [(turn, "user" if roll == 4 else role, text)] * (2 if roll == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, turns) by trying every edit: a search over (row, turns so far), cheapest and least first."""
    best = None
    heads, n = [(0, "", 0, ())], len(rows)
    seen = {}
    while heads:
        heads.sort(reverse=True)
        cost, audit, i, turns = heads.pop()
        text = "".join(r[:1] for r, _ in turns)
        if best and (cost, audit) > best[:2]:
            break
        if i == n and re.fullmatch("(s?(ua)+)?", text):
            return cost, audit, turns
        if not re.fullmatch("s?(ua)*u?", text):
            continue
        key = (i, text[-1:])
        if seen.setdefault(key, (cost, audit)) < (cost, audit):
            continue
        if audit[-3:] != "III":
            heads += [(cost + 5, audit + "I", i, (*turns, (r, ""))) for r in ("user", "assistant")]
        if i < n:
            _, role, text = rows[i]
            heads.append((cost + 2, audit + "D", i + 1, turns))
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] else 0
                if role[:1] in ("s", "u", "a"):
                    heads.append((cost + more, audit + "K", i + 1, (*turns, (role, text))))
                heads += [(cost + more + 1, audit + "R", i + 1, (*turns, (r, text))) for r in ("user", "assistant")]


def expected(rows):
    out = []
    for conv, own in after_damage(rows).items():
        found = faults(own)
        cost, audit, turns = cheapest(own, found)
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        odd = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), odd, cost, audit, digest))
    return sorted(out, key=repr)


def made_up(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", "useful", None])
            text = rng.choice(["Fine.", "Fine!", "Cut", "", " \t\n", None, f"Own {turn}?", f"own {conv} x", "Ends. \n", "é…"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None, 0]), role, text))
    return rows + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, None, "assistant", "b."), (10**6, 0, "user", "x.")]


def query(df):
    from braidlog.llm.conversations import damaged, repair
    from braidlog.llm.queries import conversation_rolls

    return repair(damaged(df, conversation_rolls()))


@pytest.mark.parametrize("segment,parts", [(512, 64), (2, 2)])
def test_equals_trying_every_edit(spark, monkeypatch, segment, parts):
    from braidlog.llm import conversations as c

    monkeypatch.setattr(c, "SEGMENT", segment)
    monkeypatch.setattr(c, "PARTS", parts)
    rows = made_up(random.Random(segment), 300)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({x: F.lit("clash") for x in ("key", "place", "audit", "fault", "symbol", "digest", "nth")})
    assert sorted(map(tuple, query(table).collect()), key=repr) == expected(rows)


def test_layers_are_computed_once_for_shared_prefixes(monkeypatch):
    from braidlog.llm import conversations as c

    steps = []
    plain = c.advanced
    monkeypatch.setattr(c, "advanced", lambda layer, symbol: steps.append(symbol) or plain(layer, symbol))
    rng = random.Random(1)
    signatures = sorted({"".join(rng.choice(c.FINE + c.CUT + c.GONE) for _ in range(rng.randrange(7))) for _ in range(500)})
    found = list(c.solved(iter(signatures), (c.START,)))
    prefixes = {s[:i] for s in signatures for i in range(1, len(s) + 1)}
    assert len(steps) == len(prefixes) < sum(map(len, signatures))
    for signature, (layers, odd) in zip(signatures, found, strict=True):
        ((alone, again),) = list(c.solved(iter([signature]), (c.START,)))
        assert (layers, odd) == (alone, again)


def test_long_conversation_in_parts(spark):
    from braidlog.llm import conversations as c

    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"t{i}.", ""])) for i in range(3000)] + [(2, 0, "user", "x." * 500_000)]
    table = spark.createDataFrame(rows, SCHEMA)
    out = {r["conv_id"]: r for r in c.repair(table).collect()}
    own = [(t, r, x) for conv, t, r, x in rows if conv == 1]
    found = faults(own)
    signature = "".join((c.GONE if f in ("blank", "duplicate") else c.CUT if f else c.FINE)["sua".index(r[0])] for (_, r, _), f in zip(own, found, strict=True))
    ((layers, odd),) = list(c.solved(iter([signature]), (c.START,)))
    assert (out[1]["cost"], out[1]["audit"]) == min(x for x in (layers[0][c.START], layers[0][c.ASSISTANT]) if x)
    assert out[1]["illegal"] == odd
    turns = c.repaired_turns(table).where("conv_id = 1").orderBy("place").collect()
    assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in turns))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == out[1]["repaired_sha256"]
    assert (out[2]["cost"], out[2]["audit"]) == (2, "D")


def test_no_rows(spark):
    assert query(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in query(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
