import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, texts
from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def expected(rows, n, percent):
    """(doc_id, n_shingles, component_id) of each row, by all pairs; rows of one id are each their own text's."""
    sets = collections.defaultdict(set)
    for i, t in rows:
        if i is not None and (s := shingles(t, n)):
            sets[s].add(i)
    keys = sorted(sets, key=len)
    parent = {s: s for s in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            if 100 * len(a & b) >= percent * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for s in keys:
        least[root(s)] = min(least.get(root(s), 1 << 60), *sets[s])
    out = []
    for i, t in rows:
        s = shingles(t, n)
        out.append((i, len(s), None if i is None else least[root(s)] if s else i))
    return sorted(out, key=repr)


def edited(rng, base, share):
    return [w if rng.random() >= share else f"e{rng.randrange(9999)}" for w in base]


def made_up(rng):
    rows = texts()
    for g in range(14):  # groups around the threshold
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 9, 14, 40, 160]))]
        rows += [(100 + g * 10 + c, " ".join(edited(rng, base, 0.008 * c))) for c in range(7)]
    base = [f"h{rng.randrange(900)}" for _ in range(120)]
    # one large group: copies that are linked with the base alone, and some that are with none
    rows += [(1000 + i, " ".join(edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.05, 0.1])))) for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))  # shared by documents that are not linked
    rows += [(2000 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.choice([3, 20, 60]))) + " " + passage) for i in range(40)]
    return rows


@pytest.mark.parametrize("n,percent,tile", [(4, 85, 2048), (4, 85, 8), (2, 60, 16)])
def test_equals_all_pairs(spark, monkeypatch, n, percent, tile):
    from braidlog.llm import ngram_join as j

    monkeypatch.setattr(j, "TILE_SETS", tile)
    rows = made_up(random.Random(tile))
    docs = documents(spark, rows).withColumn("n_shingles", F.lit(1)).withColumn("node", F.lit("x"))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.ngram_join(docs, n, percent).collect()), key=repr)
    assert got == expected(rows, n, percent)


def test_no_rows_and_no_links(spark):
    from braidlog.llm.ngram_join import ngram_join

    assert ngram_join(documents(spark, [])).count() == 0
    assert [r["component_id"] for r in ngram_join(documents(spark, [(1, "a b c d e"), (2, None), (3, "a b c d e f g")])).orderBy("doc_id").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        ngram_join(documents(spark, []), percent=40)


def test_shared_buckets_whatever_the_batches():
    from braidlog.llm.ngram_join import _shared

    rng = np.random.default_rng(2)
    for _ in range(60):
        rows = np.unique(rng.integers(0, 30, (rng.integers(1, 60), 2)), axis=0)
        rows = np.repeat(rows, rng.integers(1, 3, len(rows)), axis=0)
        cuts = np.sort(rng.integers(0, len(rows) + 1, 6))
        batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["bucket", "node"]) for x in np.split(rows, cuts)]
        got = [(b, n) for out in _shared(batches) for b, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
        of = collections.defaultdict(set)
        for b, n in rows.tolist():
            of[b].add(n)
        edge = {rows[0, 0], rows[-1, 0]}
        assert got == sorted((b, n) for b, ns in of.items() for n in ns if len(ns) > 1 or b in edge)


def test_large_and_small_runs_in_one_call():
    from braidlog.llm import ngram_join as j

    rng = np.random.default_rng(3)
    sets, group = [], []
    for g, n in enumerate((3, 150, 2, 90, 1)):
        base = rng.integers(0, 1 << 62, 60)
        sets += [np.unique(np.concatenate((base[rng.integers(0, 5) :], rng.integers(0, 1 << 62, rng.integers(0, 6))))).astype(np.uint64) for _ in range(n)]
        group += [g] * n
    size, values, group = np.array([len(s) for s in sets]), np.concatenate(sets), np.array(group)
    a, b = np.triu_indices(len(sets), 1)
    keep = group[a] == group[b]
    linked = [(i, k) for i, k in zip(a[keep].tolist(), b[keep].tolist(), strict=True) if 100 * (x := len(np.intersect1d(sets[i], sets[k], assume_unique=True))) >= 85 * (size[i] + size[k] - x)]
    want = j.spanning(len(sets), *(np.array(x) for x in zip(*linked, strict=True)))
    got = j.linked_pairs(group, size, values, 85)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip(*(x.tolist() for x in want), strict=True))


def test_product_both_ways_and_in_stripes(monkeypatch):
    from braidlog.llm import ngram_join as j

    rng = np.random.default_rng(7)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 1 << 62, 80)
        sets += [np.unique(np.concatenate((base[rng.integers(0, 6) :], rng.integers(0, 1 << 62, rng.integers(0, 8))))).astype(np.uint64) for _ in range(8)]
    size, values = np.array([len(s) for s in sets]), np.concatenate(sets)
    want = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * (x := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (size[a] + size[b] - x)]
    assert 20 < len(want) < len(sets) * len(sets) // 2
    unique, column = np.unique(values, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = np.repeat(np.arange(len(sets)), size)[order], column[order]
    for expanded, columns in ((4_000_000, 1024), (50, 16)):
        monkeypatch.setattr(j, "EXPANDED", expanded)
        monkeypatch.setattr(j, "COLUMNS", columns)
        for found in (j._dense(row, column, len(unique), size, 85), j._sparse(row, np.bincount(column), size, 85)):
            assert sorted(zip(*(x.tolist() for x in found), strict=True)) == want
