import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from cases import documents, texts
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_top_k_equals_sorting(spark):
    from braidlog.llm.top_k import top_k

    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    vectors += [(300 + i, [0.5] * 8) for i in range(80)] + [(400, None), (401, [1.0] * 7 + [float("nan")]), (402, [1.0] * 7 + [None]), (403, [float("inf")] * 8), (None, [1.0] * 8), (404, [])]
    vectors += [(20, vectors[20][1]), (420, [1.0, 2.0]), (421, [3.0, 4.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id bigint, embedding array<float>, rank int, score int").repartition(3)
    good = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(np.float64)).astype(int) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 20 == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    for shard_rows in (8192, 60):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(table, 20, 20, shard_rows=shard_rows).collect())
        assert got == sorted(want)
    assert top_k(table.limit(0), 20, 20).count() == 0


def test_top_k_beyond_exact_floats(spark):
    from braidlog.llm.top_k import top_k

    rows = [(0, [2.0**40, 3.0]), (1, [2.0**40, 1.0]), (2, [2.0**40, 2.0]), (3, [1e30, 1.0])]
    out = top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 20, 3).collect()
    # all scores are beyond a long, so they tie at its end
    assert [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(i, (1 << 63) - 1) for i in (1, 2, 3)]
    rng = np.random.default_rng(4)
    for power in (23, 26, 40, 600):
        # beyond 2^53 scores that differ by little, and by rounding alone; 2^600 would overflow squares
        rows = [(i, [float(v) * 2.0**power for v in rng.integers(-9, 9, 5)] + [float(rng.integers(-3, 3)), 1.0]) for i in range(300)]
        whole = {i: [math.floor(64 * v) for v in x] for i, x in rows}
        want = []
        for q in range(0, 300, 20):
            scores = {i: min(max(sum(a * b for a, b in zip(whole[q], x, strict=True)), -(1 << 63)), (1 << 63) - 1) for i, x in whole.items() if i != q}
            want += [(q, i, -s) for s, i in sorted((-s, i) for i, s in scores.items())[:20]]
        got = top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 20, 20, shard_rows=120).collect()
        assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def vocabulary(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def test_token_counts_equal_greedy_matching(spark):
    from braidlog.llm.token_counts import pieces_of, token_counts

    content = vocabulary("byte_bpe_50k.tiktoken")
    firsts, rests = (set(p) | {bytes([b]) for b in range(256)} for p in pieces_of(content))

    def cut(word):
        n, at, own = 0, 0, firsts
        while at < len(word):
            end = min(len(word), at + 160)
            while word[at:end] not in own:
                end -= 1
            n, at, own = n + 1, end, rests
        return n

    rng = random.Random(4)
    rows = texts() + [(60, " ".join("".join(rng.choice("abetionñ1.") for _ in range(rng.randrange(1, 25))) for _ in range(200)))]
    want = collections.Counter()
    for i, t in rows:
        each = [cut(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        want[i, len(each), sum(each), max(each, default=0)] += 1
    assert collections.Counter(tuple(r) for r in token_counts(documents(spark, rows), content).collect()) == want
    assert token_counts(documents(spark, []), content).count() == 0


@pytest.mark.parametrize("pieces", [8000, 4])
def test_packing_round_trip(spark, pieces):
    from tokenizers import Tokenizer

    from braidlog.llm.packing import least_bins, pack

    content = vocabulary("byte_bpe_50k.json").decode()
    plain = Tokenizer.from_str(content)
    rows = texts() + [(70, "<|endoftext|> " * 300), (72, "a <|endoftext|> b<|endoftext|>"), (73, "x  <|endoftext|>\n y"), (71, " " * 60_000)] + [(80 + i, "some words " * (50 * i)) for i in range(12)]
    size, out = 1024, pack(documents(spark, rows), content, pieces=pieces).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    bound = least_bins(np.array([r["length"] for r in out]), size)
    assert bound <= len(sequences) <= bound + 2 + (pieces == 4)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    assert pack(documents(spark, []), content).count() == 0


def test_bounds_and_best_fit():
    from braidlog.llm.packing import best_fit, fill_by_sums, least_bins

    rng = np.random.default_rng(8)
    for _ in range(200):
        lengths = np.sort(rng.integers(1, 101, rng.integers(1, 40)))[::-1]
        bins, offsets, levels = best_fit(lengths, 100)
        for bins, offsets, levels in ((bins, offsets, levels), fill_by_sums(lengths, 100)):
            assert levels.max() <= 100 and (np.bincount(bins, weights=lengths) == levels).all()
            for b in range(len(levels)):
                own = np.argsort(offsets[bins == b])
                assert (np.cumsum(lengths[bins == b][own]) - lengths[bins == b][own] == offsets[bins == b][own]).all()
            assert least_bins(lengths, 100) <= len(levels)
        assert -(-lengths.sum() // 100) <= least_bins(lengths, 100) <= len(levels)
    assert least_bins(np.array([60] * 5), 100) == 5
    assert least_bins(np.array([34] * 9), 100) == 5


INSULTS = ["blockhead", "numskull", "grubworm"]


def labelled_texts(n=240):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ta", "lo", "mi", "ren", "sul") for b in ("ka", "no", "pi", "dor", "ve", "as")]
    out = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        if i % 3 == 0:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(INSULTS))
        out.append((" ".join(own), int(i % 3 == 0)))
    return out


def test_toxicity_held_out_and_edges(spark):
    from braidlog.llm import toxicity as t

    known = labelled_texts()
    model = t.train(known[:180])
    assert [int(t.score(*model, x) >= 0.5) for x, _ in known[180:]] == [y for _, y in known[180:]]
    out = t.toxicity(documents(spark), model)
    assert out.columns.count("score") == 1 and out.count() == len(texts())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.collect())
    assert t.score(*t.train([]), "x") == 0.5
    assert t.score(*t.train([("a", 0), ("b", 0)]), "x") < 0.5
    # a text's features, in one stretch or several, are those of its n-grams one by one
    text, whole = "Über <Ÿ>\tabc abc \U0001f600 end", t.features("Über <Ÿ>\tabc abc \U0001f600 end")
    grams = {f" {text.lower()} ".replace("\t", " ")[i : i + n] for n in t.SIZES for i in range(len(text) + 3 - n)}
    assert len(whole) == len(set(whole.tolist())) == len(grams)
    stretch, t.STRETCH = t.STRETCH, 5
    assert sorted(t.features(text)) == sorted(whole)
    t.STRETCH = stretch
    assert t.toxicity(documents(spark, []), model).count() == 0
    found = np.array([3, 1, 3, 2, 1], dtype=np.int32)
    assert sorted(t.distinct(found)) == [1, 2, 3]


def test_quality_held_out_and_edges(spark):
    from braidlog.llm import quality as q

    rng = random.Random(1)
    known = []
    for i, (text, _) in enumerate(labelled_texts(200)):
        bad = i % 2 == 0
        own = text.split()
        if bad and i % 4:
            text = " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in own)
        elif bad:
            text = " ".join(w for w in own[:12] for _ in range(25))
        known.append((text, int(not bad)))
    net = q.train(known[:150])
    got = net.forward(*q.cells([x.encode() for x, _ in known[150:]]))
    assert ((got >= 0.3) == np.array([y for _, y in known[150:]])).mean() > 0.95
    # a text's score does not depend on its neighbours in the batch
    alone = [float(net.forward(*q.cells([x.encode()]))[0]) for x, _ in known[150:160]]
    assert np.allclose(alone, got[:10], atol=1e-4)
    out = q.quality(documents(spark), net).collect()
    assert len(out) == len(texts()) and all(0 <= r["score"] <= 1 for r in out)
    assert q.train([("a", 1)]).forward(*q.cells([b"zz"]))[0] > 0.5


def test_quality_gradients():
    from braidlog.llm import quality as q

    net = q.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["b"] += np.random.default_rng(3).normal(0, 0.1, q.FILTERS)  # away from the kink at 0
    x, counts = q.cells([b"some text of words " * 40, b"###$$$ ab", b""])
    labels = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-(labels * np.log(p := net.forward(x, counts)) + (1 - labels) * np.log(1 - p)).mean())
    grads = net.gradients(x, counts, labels)
    for name, at in (("u", (3,)), ("c", (0,)), ("b", (5,)), ("w", (0, 12, 2)), ("w", (1, 30, 7))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-3


def test_language_id_held_out_and_edges(spark):
    from braidlog.llm.language_id import Model, identify, sample_of

    rng = random.Random(2)
    parts = {"xx": ["thing", "er", "ation", "ly"], "yy": ["ción", "que", "ado", "ñar"], "zz": ["keit", "ung", "sch", "über"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30))
    rows = [(i, make(lang), lang) for i, lang in enumerate(list(parts) * 40)] + [(900, None, "xx"), (901, "text", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = Model(sample_of(table, F.col("doc_id") % 4 != 1, per_language=20))
    assert model.languages == ["xx", "yy", "zz"]
    out = {r["doc_id"]: r for r in identify(table, model).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows if i < 900)
    assert out[900]["lang_pred"] == "und"
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 --"), (4, "\U0001f600 —"), (5, "é"), (6, "thingation" * 4000)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(odd, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5][0] != "und" and got[6][0] == "xx"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in identify(odd, Model([])).collect()} == {"und"}


def test_samples_are_bounded(spark):
    from braidlog.llm.sampling import fold, labelled

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(None, "x"), (7, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    got = labelled(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, 30)
    assert collections.Counter(y for _, y in got) == {0: 30, 1: 30}
    assert all(zlib.crc32(t.split()[1].encode()) % 5 for t, _ in got)
