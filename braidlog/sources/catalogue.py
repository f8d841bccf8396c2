"""Catalogue files: a header and one cluster a line, read strictly and written reproducibly."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.functions.text import catalogue_string, state_float
from braidlog.functions.tokens import KINDS, STAR, TEXT, TYPED
from braidlog.operators.sinks import published, stage
from braidlog.session import settled, ship
from braidlog.sources.lines import scan_any
from braidlog.sources.storage import Storage

VERSION = 1
U64 = (1 << 64) - 1
SCHEMA = "category string, id decimal(20,0), count decimal(20,0), first_seen string, last_seen string, template array<string>"


@dataclass
class Catalogue:
    """Clusters of templates with the settings they were made by; `batch` is the last one folded in."""

    clusters: DataFrame
    depth: int = 4
    threshold: float = 0.5
    batch: int | None = None


class _Text:
    """Strict reading of one line, piece by piece."""

    _STRING = re.compile(r'"((?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
    _NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
    _BLANK = re.compile(r"[ \t\n\r]*")
    _PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}

    def __init__(self, line: str):
        self.line, self.at = line, 0

    def fail(self, wanted: str):
        raise ValueError(f"catalogue: expected {wanted} at {self.at}: {self.line[:120]!r}")

    def blank(self) -> None:
        self.at = self._BLANK.match(self.line, self.at).end()

    def peek(self, text: str) -> bool:
        self.blank()
        return self.line.startswith(text, self.at)

    def take(self, text: str) -> None:
        if not self.peek(text):
            self.fail(repr(text))
        self.at += len(text)

    def match(self, pattern: re.Pattern, wanted: str) -> re.Match:
        self.blank()
        m = pattern.match(self.line, self.at)
        if not m:
            self.fail(wanted)
        self.at = m.end()
        return m

    def key(self, name: str) -> None:
        self.take(f'"{name}"')
        self.take(":")

    def string(self) -> str:
        def plain(m: re.Match) -> str:
            if m[1][0] != "u":
                return self._PLAIN.get(m[1], m[1])
            code = int(m[1][1:], 16)
            if 0xD800 <= code <= 0xDFFF:
                self.fail("a character that is no surrogate")
            return chr(code)

        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", plain, self.match(self._STRING, "a string")[1], flags=re.DOTALL)

    def string_or_null(self) -> str | None:
        if self.peek("null"):
            self.take("null")
            return None
        return self.string()

    def unsigned(self) -> int:
        n = int(self.match(re.compile("[0-9]+"), "digits")[0])
        if n > U64:
            self.fail("a number of 64 bits")
        return n

    def number(self) -> float:
        x = float(self.match(self._NUMBER, "a number")[0])
        if not math.isfinite(x):
            self.fail("a finite number")
        return x

    def end(self) -> None:
        self.blank()
        if self.at != len(self.line):
            self.fail("the end of the line")


def parse_header(line: str) -> tuple[int, float, int | None]:
    """depth, threshold and the last batch folded in, if any."""
    t = _Text(line)
    t.take("{")
    t.key("_meta")
    t.take("{")
    t.key("version")
    if t.unsigned() > VERSION:
        raise ValueError(f"catalogue: made by a later version: {line[:120]!r}")
    t.take(",")
    t.key("depth")
    depth = t.unsigned()
    t.take(",")
    t.key("threshold")
    threshold, batch = t.number(), None
    if t.peek(","):
        t.take(",")
        t.key("batch")
        batch = t.unsigned()
    t.take("}")
    t.take("}")
    t.end()
    return depth, threshold, batch


def _slot(t: _Text) -> str:
    t.take("{")
    t.key("t")
    tag, out = t.string(), STAR
    if tag in ("L", "W"):
        t.take(",")
        t.key("v" if tag == "L" else "k")
        value = t.string()
        if tag == "W" and value not in KINDS:
            t.fail("the label of a kind")
        out = TEXT + value if tag == "L" else f"{TYPED}{KINDS.index(value):02d}"
    elif tag != "S":
        t.fail("a slot's tag")
    t.take("}")
    return out


def parse_cluster(line: str) -> tuple:
    """One row of SCHEMA."""
    t = _Text(line)
    t.take("{")
    row: dict = {}
    for i, (name, read) in enumerate((("id", t.unsigned), ("category", t.string_or_null), ("count", t.unsigned), ("first_seen", t.string_or_null), ("last_seen", t.string_or_null))):
        if i:
            t.take(",")
        t.key(name)
        row[name] = read()
    t.take(",")
    t.key("template")
    t.take("[")
    template: list[str] = []
    while not t.peek("]"):
        if template:
            t.take(",")
        template.append(_slot(t))
    t.take("]")
    t.take("}")
    t.end()
    return row["category"], Decimal(row["id"]), Decimal(row["count"]), row["first_seen"], row["last_seen"], template


def parse(text: str) -> tuple[int, float, int | None, list[tuple]]:
    lines = text.split("\n")
    if not text:
        raise ValueError("catalogue: empty input")
    depth, threshold, batch = parse_header(lines[0].removesuffix("\r"))
    return depth, threshold, batch, [parse_cluster(x.removesuffix("\r")) for x in lines[1:] if x.strip()]


def _clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([parse_cluster(x.removesuffix("\r")) for x in batch["text"] if x.strip()], columns=[c.split()[0] for c in SCHEMA.split(", ")])


def clusters_of(lines: DataFrame) -> DataFrame:
    """The clusters on the catalogue lines `text`, without the header, parsed where they lie."""
    ship(lines.sparkSession)
    return lines.select("text").mapInPandas(_clusters, SCHEMA)


def load(spark: SparkSession, path: str) -> Catalogue:
    """A catalogue file: the driver reads its header, tasks parse its clusters."""
    lines = scan_any(spark, [path])
    header = lines.where("line_no = 1").first()
    if header is None:
        raise ValueError("catalogue: empty input")
    depth, threshold, batch = parse_header(bytes(header["line"]).decode().removesuffix("\r"))
    # whole, before the file is replaced
    clusters = settled(clusters_of(lines.where("line_no > 1").select(F.col("line").cast("string").alias("text"))))
    return Catalogue(clusters, depth, threshold, batch)


def header(catalogue: Catalogue) -> str:
    batch = "" if catalogue.batch is None else f',"batch":{catalogue.batch}'
    return f'{{"_meta":{{"version":{VERSION},"depth":{catalogue.depth},"threshold":{state_float(catalogue.threshold)}{batch}}}}}'


def _slot_text(slot: Column) -> Column:
    label = F.element_at(F.array(*map(F.lit, KINDS)), F.substring(slot, 2, 2).cast("int") + 1)
    typed = F.concat(F.lit('{"t":"W","k":"'), label, F.lit('"}'))
    return F.when(slot == STAR, '{"t":"S"}').when(slot.startswith(TYPED), typed).otherwise(F.concat(F.lit('{"t":"L","v":'), catalogue_string(F.substring(slot, F.lit(2), F.length(slot))), F.lit("}")))


def with_lines(clusters: DataFrame) -> DataFrame:
    """Adds text: the line of a catalogue file for each cluster."""
    number = lambda c: F.col(c).cast("decimal(20,0)").cast("string")
    parts = ['{"id":', number("id"), ',"category":', catalogue_string(F.col("category")), ',"count":', number("count")]
    parts += [',"first_seen":', catalogue_string(F.col("first_seen")), ',"last_seen":', catalogue_string(F.col("last_seen"))]
    parts += [',"template":[', F.array_join(F.transform("template", _slot_text), ","), "]}"]
    return clusters.withColumn("text", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)))


def ordered(clusters: DataFrame) -> DataFrame:
    """By category (null first), id and template, so that equal catalogues are equal files."""
    return clusters.orderBy(F.col("category").asc_nulls_first(), "id", "template")


def save(catalogue: Catalogue, path: str) -> None:
    """Write a catalogue file beside `path`, then put it in its place: tasks make its lines, in ranges of its order."""
    spark = catalogue.clusters.sparkSession
    lines = ordered(with_lines(catalogue.clusters)).select(F.lit("").alias("key"), F.encode(F.concat("text", F.lit("\n")), "UTF-8").alias("line"))
    staged = stage(lines, path.rpartition("/")[0] or ".", "plain", 0)
    try:
        published(spark, staged, "", path, "plain", f"{header(catalogue)}\n".encode())
    finally:
        Storage(spark).delete(staged)
