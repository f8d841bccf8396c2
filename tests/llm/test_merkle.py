import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(level, arity):
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def path(levels, i, arity):
    for level in levels[:-1]:
        begin = i // arity * arity
        yield level[begin:i], level[i + 1 : begin + arity]
        i //= arity


def expected(rows, arity=8):
    of = {}
    for d, s, lang, n, t in rows:
        changed = t is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        of.setdefault(lang, []).append((d, leaf(d, s, lang, n, t), leaf(d, s, lang, n, t.translate(LOW)) if changed else None))
    langs = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[1] for r in sorted(of[x], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))], arity) for x in langs}
    top = tree([trees[x][-1][0] for x in langs], arity)
    out = []
    for k, x in enumerate(langs):
        for i, (d, own, other) in enumerate(sorted(of[x], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
            proof, acc = [*path(trees[x], i, arity), *path(top, k, arity)], other or own
            for left, right in proof:
                acc = h(*left, acc, *right)
            out.append((d, own, trees[x][-1][0], top[-1][0], h(*(s for step in proof for side in step for s in side)), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def made_up(rng, n_hot):
    text = lambda i: rng.choice([None, "", f"Text {i}", "lower only", "É" * rng.randrange(20) + "ß"])
    rows = [(i, "s", "hot", i, text(i)) for i in range(n_hot)]
    rows += [(i, None, rng.choice([None, "", "b", "é", "z"]), None, text(i)) for i in range(60)]
    return rows + [(7, "s", "lone", 1, "A b"), (None, None, None, None, None), (5, "s", "hot", 5, "again"), (5, "s", "hot", 5, "again")] + [(i, "s", f"l{i:03}", i, "One") for i in range(70)]


@pytest.mark.parametrize("arity,n_hot", [(8, 700), (2, 130), (8, 8), (8, 9)])
def test_equals_a_plain_tree(spark, arity, n_hot):
    from braidlog.llm.merkle import manifest

    rows = made_up(random.Random(n_hot), n_hot)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("tree", "place", "digest", "level", "root", "leaf", "other", "path", "n")})
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    out = manifest(docs, tampered, arity)
    assert sorted((tuple(r[:4]) + tuple(r[5:]) for r in out.collect()), key=repr) == expected(rows, arity)


def test_small_tables(spark):
    from braidlog.llm.merkle import manifest

    no_change = F.lit(None).cast("string")
    assert manifest(spark.createDataFrame([], SCHEMA), no_change).count() == 0
    one = manifest(spark.createDataFrame([(1, None, None, 3, "abc")], SCHEMA), no_change).collect()
    assert [(r["root"], r["proof"], r["verified"]) for r in one] == [(leaf(1, None, None, 3, "abc"), [], True)]
    assert one[0]["proof_sha256"] == h()
    big = manifest(spark.createDataFrame([(1, None, "x", 3, "é" * 3_000_000), (2, None, "x", 3, "abc")], SCHEMA), no_change)
    assert big.where("verified").count() == 2
