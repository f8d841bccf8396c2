"""A corpus pipeline of the operators in braidlog.llm: each stage takes what the one before it kept.

toxicity      documents that the classifier, trained on `labels`, rejects go
line_dedup    lines that 10 or more documents share go; a document left without any line stays, empty
near_dedup    of each group of near duplicates (five-word shingles, similarity 0.8) the least doc_id stays
decontaminate documents that hold 10 consecutive words of a `benchmark` item go
pack          what is left becomes pieces in sequences of 1024 tokens

All stages but the last return the columns of `documents`, whatever further ones it has, with
their own values: names that operators use for results do not clash. n_chars is kept true to
the text. Null texts are empty from line_dedup on; empty ones are no one's duplicates and stay.
Stages decide about rows by their id and text: of rows that share an id, each goes or stays for
its own text, and equal rows fare alike. Rows without a doc_id pass every filter that their text
passes; near_dedup keeps them, as it cannot name them. Texts of any length are taken whole, and
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.llm import toxicity
from braidlog.llm.decontaminate import contamination
from braidlog.llm.line_dedup import drop_common_lines
from braidlog.llm.near_dedup import near_duplicates
from braidlog.llm.packing import pack
from braidlog.llm.queries import vocabulary
from braidlog.llm.sampling import labelled
from braidlog.llm.tables import settled, table

#: Cannot be SQL: classifier, tokenizer and packing. Tests hold each stage against brute force.
ORACLE_SQL = None


def _own_names(docs: DataFrame) -> dict[str, str]:
    """A name for each column of `docs` that no operator's results have."""
    return {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}


def _renamed(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`").alias(own) for c, own in _own_names(docs).items()))


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(own).alias(c) for c, own in _own_names(docs).items()))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` (by its own names) that are not in `gone` (doc_id, row_hash): an id's other texts stay."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_hash")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti")


def _nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", F.lit(True), per_class=1500)
    return _restored(toxicity.toxicity(_renamed(docs), toxicity.train(sample)).where("predicted = 0"), docs)


def _without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _restored(drop_common_lines(_renamed(docs), min_chars=1, min_docs=10), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _first_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
    return _restored(_without(_renamed(docs), groups.where(~F.col("kept"))), docs)


def _uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), window=10)
    return _restored(_without(_renamed(docs), found.where("contaminated")), docs)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json").decode(), end=2, size=1024)


STAGES = [
    ("toxicity", _nontoxic),
    ("line_dedup", _without_common_lines),
    ("near_dedup", _first_of_each_group),
    ("decontaminate", _uncontaminated),
    ("pack", _packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the table `documents`; each one's result is settled before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settled(docs)
    return docs
