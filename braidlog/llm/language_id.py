"""Language identification, words first: known words by their frequency in each language, others by n-grams.

A word the model knows scores its smoothed log frequency in each language. An unseen one, with
a blank at both ends, scores the mean of those of its character n-grams that are known, at the
longest size that has any, from the longest down to single characters. Words are runs of
letters, whatever the script, in lower case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlog.llm.sampling import drawn
from braidlog.llm.words import U64, constants, hashes, mix, over_slices, spans
from braidlog.session import ship

SIZES = (5, 4, 3, 2, 1)
#: Words that are scored at once.
STRETCH = 100_000
_tables: dict[str, np.ndarray] = {}


def _characters() -> dict[str, np.ndarray]:
    """By code point: whether it is a letter, its lower case where that is one character, and a value for hashes."""
    if not _tables:
        every = [chr(i) for i in range(0x110000)]
        lower = [x.lower() for x in every]
        _tables["letter"] = np.array([x.isalpha() for x in every])
        _tables["lower"] = np.array([ord(y) if len(y) == 1 else ord(x) for x, y in zip(every, lower, strict=True)], dtype=np.uint32)
        _tables["value"] = mix(_tables["lower"].astype(U64) + U64(77))
    return _tables


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts with a blank between, where each text begins, and begin and end of each word."""
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t or "") + 1 for t in texts], out=begins[1:])
    codes = np.frombuffer((" ".join(t or "" for t in texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, begins, *spans(codes, _characters()["letter"])


def _word_hashes(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hashes(codes, begins, ends, _characters()["value"])


UNDETERMINED = "und"


class Table:
    """Rows of one number for each language, found by a hash."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], languages: list[str], least: int):
        keys = np.unique(np.concatenate([k[c >= least] for k, c in counts.values()] or [np.empty(0, dtype=U64)]))
        found = np.zeros((len(keys), len(languages)), dtype=np.float64)
        total = np.zeros(len(languages))
        for j, name in enumerate(languages):
            k, c = counts[name]
            at = np.searchsorted(keys, k)
            known = at < len(keys)
            known[known] = keys[at[known]] == k[known]
            found[at[known], j] = c[known]
            total[j] = c.sum()
        self.keys = keys
        self.rows = np.log((found + 0.1) / (total + 0.1 * max(1, len(keys)))).astype(np.float32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


def _padded(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words end to end with a blank before each and after the last, and where each one's first blank is."""
    sizes = ends - begins + 1
    first = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(first[-1] + 1, 0x20, dtype=np.uint32)
    inside = np.ones(first[-1], dtype=bool)
    inside[first[:-1]] = False
    source = np.repeat(begins - first[:-1] - 1, sizes) + np.arange(first[-1])
    out[:-1][inside] = _characters()["lower"][data[source[inside]]]
    return out, first


def _grams(padded: np.ndarray, n: int) -> np.ndarray:
    c = constants(n, 500 + n)
    out = padded[: len(padded) - n + 1].astype(U64) * c[0]
    for i in range(1, n):
        out += padded[i : len(padded) - n + 1 + i].astype(U64) * c[i]
    return mix(out + U64(n))


def _own_grams(padded: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes that lie within a word and its two blanks, and the word of each."""
    g = _grams(padded, n)[: first[-1]]
    word = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(g)]
    inside = np.arange(len(g)) + n <= first[word + 1] + 1
    return g[inside], word[inside]


class Model:
    """Word and n-gram tables of each language."""

    def __init__(self, sample: list[tuple[str, str]], least_word: int = 2, least_gram: int = 3):
        self.languages = sorted({lang for _, lang in sample})
        words, grams = {}, {n: {} for n in SIZES}
        for lang in self.languages:
            data, _, begins, ends = _joined([t for t, x in sample if x == lang])
            words[lang] = np.unique(_word_hashes(data, begins, ends), return_counts=True)
            padded, first = _padded(data, begins, ends)
            for n in SIZES:
                grams[n][lang] = np.unique(_own_grams(padded, first, n)[0], return_counts=True)
        self.words = Table(words, self.languages, least_word)
        self.grams = {n: Table(grams[n], self.languages, least_gram) for n in SIZES}

    def word_scores(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word a row of scores; 0 for words of which nothing is known."""
        out = np.zeros((len(begins), len(self.languages)), dtype=np.float32)
        at = self.words.find(_word_hashes(data, begins, ends))
        known = at >= 0
        out[known] = self.words.rows[at[known]]
        left = np.flatnonzero(~known)
        for n in SIZES:
            if not len(left):
                break
            padded, first = _padded(data, begins[left], ends[left])
            if len(padded) < n:
                continue
            g, word = _own_grams(padded, first, n)
            at = self.grams[n].find(g)
            word, at = word[at >= 0], at[at >= 0]
            count = np.bincount(word, minlength=len(left))
            for j in range(len(self.languages)):
                total = np.bincount(word, weights=self.grams[n].rows[at, j], minlength=len(left))
                out[left, j] = np.where(count, total / np.maximum(count, 1), out[left, j])
            left = left[count == 0]
        return out


def sample_of(docs: DataFrame, trains: Column, per_language: int = 400) -> list[tuple[str, str]]:
    """At most `per_language` texts of each language, of any length, by the hash of their id; repeated rows count as texts."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(trains)
    rows = drawn(known, "lang", per_language, ["lang", "doc_id", "text"])
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("text", "lang")
    return sorted((r["text"], r["lang"]) for r in rows.collect())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of `docs`: all its columns, then lang_pred and score (0 to 1).

    lang_pred is `und`, with score 0, if text is null, empty or has no letter, or the model has
    learned no language. Else it is the language with the largest mean over all words of the
    text, the first in order of equals, and score its share of the exponentials of the sums
    over at most 20 words' worth. Repeated rows fare alike; an empty table gives no rows; columns
    of `docs` named lang_pred or score are replaced. Texts are taken whole, their words a stretch at a
    time, in memory of some ten times the longest one's. The model is as large as its sample's bound allows.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        data, text_begins, begins, ends = _joined(batch.column("text").to_pylist())
        counts = np.diff(np.searchsorted(begins, text_begins))
        owner = np.repeat(np.arange(len(counts)), counts)
        sums = np.zeros((len(counts), max(1, len(model.languages))))
        for at in range(0, len(begins) if model.languages else 0, STRETCH):
            part = slice(at, at + STRETCH)
            scores = model.word_scores(data, begins[part], ends[part])
            for j in range(scores.shape[1]):
                sums[:, j] += np.bincount(owner[part], weights=scores[:, j], minlength=len(counts))
        means = sums / np.maximum(counts, 1)[:, None]
        best = means.argmax(axis=1)
        z = np.exp((means - means.max(axis=1, keepdims=True)) * np.minimum(counts, 20)[:, None])
        sure = z.max(axis=1) / z.sum(axis=1)
        fine = (counts > 0) & bool(model.languages)
        names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, fine, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(names, type=pa.string()), pa.array(np.where(fine, sure, 0.0).astype(np.float64))], names=[*batch.schema.names, "lang_pred", "score"]
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(over_slices(kernel), f"{fields}, lang_pred string, score double")
