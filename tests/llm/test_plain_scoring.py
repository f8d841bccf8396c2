"""Scores against plain loops over dictionaries and lists."""

import collections
import math
import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest


def words_of(text):
    out, word = [], ""
    for c in text + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            out.append(word)
            word = ""
    return out


def own_grams(word, n):
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + (n > 1))]


def table(counts, least):
    """By key a row of log frequencies, for keys that one language has `least` times."""
    keys = {k for c in counts.values() for k, n in c.items() if n >= least}
    return {k: [math.log((c[k] + 0.1) / (sum(c.values()) + 0.1 * max(1, len(keys)))) for c in counts.values()] for k in keys}


def test_language_id_equals_plain_backoff(spark, monkeypatch):
    from braidlog.llm.language_id import SIZES, Model, identify

    rng = random.Random(2)
    stems = {"de": ["über", "keit", "schön", "und"], "en": ["the", "tion", "and", "over"], "el": ["και", "λόγος", "Το"]}
    made = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice(["", "", rng.choice(stems[lang])]) for _ in range(n))
    sample = [(made(lang, rng.randrange(1, 30)), lang) for lang in stems for _ in range(12)]
    langs = sorted(stems)
    words = table({x: collections.Counter(w for t, y in sample if y == x for w in words_of(t)) for x in langs}, 2)
    grams = {n: table({x: collections.Counter(g for t, y in sample if y == x for w in words_of(t) for g in own_grams(w, n)) for x in langs}, 3) for n in SIZES}

    def scores(word):
        if word in words:
            return words[word]
        for n in SIZES:
            if known := [grams[n][g] for g in own_grams(word, n) if g in grams[n]]:
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return [0.0] * len(langs)

    texts = [made(rng.choice(langs), rng.randrange(1, 40)) + rng.choice(["", " Unseen wörds", "12 3?"]) for _ in range(60)] + ["", "12 34", None, "ζζζ 日本語", "ÜBERKEIT"]
    monkeypatch.setattr("braidlog.llm.language_id.STRETCH", 7)
    rows = identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Model(sample)).collect()
    for r in rows:
        found = [scores(w) for w in words_of(r["text"] or "")]
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        means = [sum(x) / len(found) for x in zip(*found, strict=True)]
        z = [math.exp((m - max(means)) * min(len(found), 20)) for m in means]
        assert r["lang_pred"] == langs[means.index(max(means))]
        assert r["score"] == pytest.approx(max(z) / sum(z), abs=2e-4)


def test_toxicity_fit_and_score_equal_plain_loops(spark):
    from braidlog.llm import toxicity as t

    rng = random.Random(4)
    sample = [(" ".join(rng.choices(["vile", "scum", "day", "walk", "tree"], k=6)), 1) for _ in range(9)] + [(" ".join(rng.choices(["day", "walk", "tree", "sun"], k=6)), 0) for _ in range(11)]
    weights, bias = t.train(sample, rounds=25, certain=0.8)
    sets = [set(t.features(x).tolist()) for x, _ in sample]
    of = {y: [s for s, (_, z) in zip(sets, sample, strict=True) if z == y] for y in (0, 1)}
    every = set().union(*sets)
    up, down = ({f: 1 + sum(f in s for s in of[y]) for f in every} for y in (1, 0))
    ratio = {f: math.log(up[f] / len(of[1])) - math.log(down[f] / len(of[0])) for f in every}
    used = sorted(f for f in every if abs(ratio[f]) >= 0.8 * math.sqrt(1 / up[f] + 1 / down[f]))
    w, m, v = ({f: 0.0 for f in used} for _ in range(3))
    b = mb = vb = 0.0
    for k in range(1, 26):
        errors = []
        for s, (_, y) in zip(sets, sample, strict=True):
            z = sum(ratio[f] * w[f] for f in used if f in s) + b
            errors.append((1 / (1 + math.exp(-z)) - y) / len(sample))
        rate = 0.02 / (1 - 0.9**k)
        for f in used:
            g = sum(e * ratio[f] for e, s in zip(errors, sets, strict=True) if f in s) + 1e-4 * w[f]
            m[f], v[f] = 0.9 * m[f] + 0.1 * g, 0.999 * v[f] + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * sum(errors), 0.999 * vb + 0.001 * sum(errors) ** 2
        for f in used:
            w[f] -= rate * m[f] / (math.sqrt(v[f] / (1 - 0.999**k)) + 1e-8)
        b -= rate * mb / (math.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    assert used and bias == pytest.approx(b, abs=1e-6)
    assert np.flatnonzero(weights).tolist() == used
    assert [weights[f] for f in used] == pytest.approx([ratio[f] * w[f] for f in used], abs=1e-5)
    texts = ["vile day", "sun", "", None, "scum " * 50]
    for r in t.toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (weights, bias)).collect():
        z = b + sum(ratio[f] * w[f] for f in set(t.features(r["text"] or "").tolist()) if f in w)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5) and r["predicted"] == (r["score"] >= 0.5)


def test_quality_of_a_text_is_its_own_and_long_texts_go_in_stretches(monkeypatch):
    from braidlog.llm import quality as q

    rng, net = random.Random(9), q.Network()
    net.p["c"][0] = 0.3
    texts = [bytes(rng.choices(b"ab, Z9\n\xc3", k=n)) * k for n, k in ((0, 1), (3, 1), (8, 9), (31, 40), (255, 1), (256, 3), (257, 20), (5000, 1), (12_345, 2))]
    together = net.forward(*q.cells(texts))
    monkeypatch.setattr(q, "STRETCH", 2 * q.HALF)
    for text, score in zip(texts, together, strict=True):
        assert net.forward(*q.cells([text]))[0] == pytest.approx(score, abs=1e-6)
        assert net.score(text) == pytest.approx(score, abs=1e-5)
    # plain loops over cells and chunks
    w0, w1, b = net.p["w"][0].astype(float), net.p["w"][1].astype(float), net.p["b"].astype(float)
    for text, score in zip(texts, together, strict=True):
        x = q.cells([text])[0].astype(float)
        a = [np.maximum(x[i] @ w0 + (x[i + 1] @ w1 if i + 1 < len(x) else 0) + b, 0) for i in range(len(x))]
        chunks = [a[i : i + 2 * q.HALF] for i in range(0, len(a), q.HALF)]
        chunks = chunks[:-1] if len(chunks) > 1 else chunks
        top = np.max([np.mean(c, axis=0) for c in chunks], axis=0)
        assert score == pytest.approx(1 / (1 + math.exp(-(top @ net.p["u"] + net.p["c"][0]))), abs=1e-5)
        for i, row in enumerate(x[:-1]):
            own = text[i * q.CELL : (i + 1) * q.CELL]
            repeats = max(sum(i * q.CELL + k >= lag and text[i * q.CELL + k] == text[i * q.CELL + k - lag] for k in range(len(own))) for lag in range(1, q.LAGS + 1))
            assert row[-2] == repeats / q.CELL


def test_long_words_take_linear_time():
    from braidlog.llm import token_counts as c

    rng = random.Random(6)
    pieces = [bytes(rng.choices(b"abc", k=n)) for n in (2, 2, 3, 3, 4, 5, 7)]
    machine = c.Automaton(pieces[::2], pieces[1::2])

    def greedy(word):
        at, n = 0, 0
        while at < len(word):
            own = [p for p in (pieces[::2] if at == 0 else pieces[1::2]) if word.startswith(p, at)]
            at, n = at + max(map(len, own), default=1), n + 1
        return n

    words = [bytes(rng.choices(b"abcd", k=n)) for n in (1, 3, 257, 300, 5000, 20_000, 20_001, 256)]
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    begins = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    assert machine.counts(data, begins, begins + np.array([len(w) for w in words])).tolist() == list(map(greedy, words))
    long = np.frombuffer(bytes(rng.choices(b"abcd", k=1_000_000)), dtype=np.uint8)
    began = time.process_time()
    machine.counts(long, np.array([0]), np.array([len(long)]))
    assert time.process_time() - began < 10


SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
from braidlog.llm.near_dedup import near_duplicates
print([r["component_id"] for r in near_duplicates(docs).collect()])
"""


def test_operators_run_on_a_users_own_rows_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split("\n")[-2] == "[1, 1]", done.stderr[-2000:]
