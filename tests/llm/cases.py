"""Awkward documents that every operator has to take, and tables made of them."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, score double, n_words int, open boolean"


def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "über", "naïve", "ciónque", "x1", "the", "of"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base = prose(60)
    near = base.split()
    near[30] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (7, "word"), (8, "WORD"), (9, prose(20_000)), (10, "a" * 50_000),
        (11, "line one\nline two\n\nline one\n"), (12, "é" * 300 + "\U0001f600 done"), (13, "nul \0 and \r\n end"), (None, base), (1, base), (2, "other text of a repeated id"), (14, prose(1)),
    ]


def documents(spark, rows=None):
    """With clashing extra columns, in more than one partition."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", 0.5, 7, True) for i, t in rows], SCHEMA).repartition(3)
