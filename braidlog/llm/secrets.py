"""Secrets in texts: three fixed patterns, and character Markov models for the rest (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of base spans in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")

_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, _KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # its longest run is taken, so a shorter one never hides it
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"

#: What a token of the Markov models is made of; a place in this text is a state.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

#: Parts of ordinary identifiers, for the sample below.
PARTS = (
    "account address amount array async author batch block body bucket buffer build byte cache call category chain check child class client cluster code "
    "collect column command commit common config connect content context count create current data date default delete depth detail device document domain "
    "driver edge element entry error event example factory field file filter first flag folder format frame function gather global graph group handle header "
    "height history host image index info input install instance interval issue item join json key label language last layer length level library line link "
    "list local lock logger machine main manager map market match member memory merge message method metric model module month name network node number object "
    "offset option order output owner package page parent parse part path pattern people place plan point pool position prefix price process product profile "
    "project property query queue random range rate reader record region register report request resource response result return river room root route row "
    "sample schema score search section select sequence server service session setting shape share signal size source space span stage start state station "
    "status storage stream string style system table target task template test text thread time title total trace transfer tree type union unit update user "
    "value vector version view visit volume water weight width window word worker writer year zone"
).split()


def labelled_sample(spark: SparkSession, n: int = 4000) -> DataFrame:
    """n made-up rows (token, is_random): digests in three spellings, and identifiers, paths and numbers in five styles.

    It depends on nothing but n, which bounds it.
    """
    part = lambda i: F.element_at(F.split(F.lit(" ".join(PARTS)), " "), (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(PARTS))) + 1).cast("int"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    style = F.pmod(F.col("id"), F.lit(8))
    number = F.regexp_replace(F.conv(F.substring(digest, 1, 12), 16, 10), "^(.{4})(.{2})(.{2})(.{2})", "$1-$2-$3/$4_")
    words = F.array(*(part(i) for i in range(5)))
    token = (
        F.when(style == 0, F.base64(F.unhex(digest)))
        .when(style == 1, F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""), 1, 36))
        .when(style == 2, F.substring(digest, 1, 40))
        .when(style == 3, F.array_join(words, "_"))
        .when(style == 4, F.array_join(words, "-"))
        .when(style == 5, F.regexp_replace(F.initcap(F.array_join(words, " ")), " ", ""))
        .when(style == 6, F.upper(F.array_join(words, "_")))
        .otherwise(F.concat(F.array_join(F.slice(words, 1, 3), "/"), F.lit("/"), number))
    )
    return spark.range(n).select(token.alias("token"), (style < 3).alias("is_random"))


def train(sample: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of each character after each other one.

    `sample` has (token, is_random). What comes to the driver is a count for each pair of
    characters, at most twice the square of the alphabet. Rows with nulls and characters
    beyond the alphabet are left out; with no rows at all every ratio is 0.
    """
    n = len(ALPHABET)
    code = lambda at: F.instr(F.lit(ALPHABET), F.substring("token", at, 1)) - 1
    places = sample.where("token is not null and is_random is not null and length(token) > 1").select("token", "is_random", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("at"))
    pairs = places.select("is_random", code(F.col("at")).alias("x"), code(F.col("at") + 1).alias("y")).where("x >= 0 and y >= 0").groupBy("is_random", "x", "y").count().collect()
    counts = {kind: [smoothing] * (n * n) for kind in (True, False)}
    for r in pairs:
        counts[r["is_random"]][r["x"] * n + r["y"]] += r["count"]
    total = {kind: [sum(c[x * n : x * n + n]) for x in range(n)] for kind, c in counts.items()}
    return [math.log(counts[True][i] / total[True][i // n]) - math.log(counts[False][i] / total[False][i // n]) for i in range(n * n)]


def _placed(matches: Column, parts: Column, kept: Column, kind: str) -> Column:
    """(start, kind, end) of matches, from the text between them; those not kept are left out."""
    span = "struct<start:int,ord:int,kind:string,end:int>"
    ends = F.zip_with(F.zip_with(parts, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"))), kept, lambda x, k: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), k.alias("kept")))
    order = F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS))
    return F.aggregate(
        F.filter(ends, lambda x: x["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(
                x["kept"],
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), order.alias("ord"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["size"]).alias("end")))),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _runs(token: Column, ratios: list[float], per_char: float, least: float) -> Column:
    """(start, end) of the runs in a token that look random, stretched to whole runs of letters, digits and +.

    A run is as long as its sum of ratios, less `per_char` for each pair, stays above 0; it ends
    at the pair where that sum is greatest, and counts if it is `least` or more there.
    """
    n = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    weights = F.split(F.lit(",".join(repr(r - per_char) for r in ratios)), ",").cast("array<double>")
    steps = lambda codes: F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda x, y: F.element_at(weights, x * n + y + 1))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    ended = lambda s: F.when(s["most"] >= least, F.concat(s["out"], F.array(span(s["start"], s["end"])))).otherwise(s["out"])

    def state(at, sum_, start, most, end, out):
        return F.struct(at.alias("at"), sum_.alias("sum"), start.alias("start"), most.alias("most"), end.alias("end"), out.alias("out"))

    def step(s, weight):
        start = F.when(s["sum"] > 0, s["start"]).otherwise(s["at"])
        higher = s["sum"] + weight > s["most"]
        return F.when(
            s["sum"] + weight > 0,
            state(s["at"] + 1, s["sum"] + weight, start, F.when(higher, s["sum"] + weight).otherwise(s["most"]), F.when(higher, s["at"] + 2).otherwise(s["end"]), s["out"]),
        ).otherwise(state(s["at"] + 1, F.lit(0.0), s["at"], F.lit(0.0), s["end"], ended(s)))

    none = F.array().cast("array<struct<start:int,end:int>>")
    # codes are made once for a token: a step at a place of a long string would walk to that place
    found = F.flatten(F.transform(F.array(codes), lambda c: F.aggregate(steps(c), state(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), none), step, ended)))
    stretch = lambda text: F.length(F.regexp_extract(text, "^[A-Za-z0-9+]*", 0))
    wide = F.transform(found, lambda r: span(r["start"] - stretch(F.reverse(F.substring(token, F.lit(1), r["start"]))), r["end"] + stretch(F.substring(token, r["end"] + 1, F.length(token)))))
    return F.array_distinct(wide)


def find_secrets(docs: DataFrame, ratios: list[float], per_char: float = 0.5, least: float = 16.0) -> DataFrame:
    """All columns of `docs` with n_assign, n_access, n_hex, base_spans, spans.

    Base spans: whole matches of the three patterns, leftmost and non-overlapping for each
    kind, of which an `assign` needs 6 characters of value. In a token of 20 or more characters
    of ALPHABET, a run whose log-likelihood ratio under `ratios` (see train), less `per_char`
    for each pair of characters, comes to `least` is a `markov` span, if no base span touches
    it; so a random part is found beside any ordinary text that it is joined to.
    Spans are kind:start:end in code points, end exclusive, by start, then kind, joined by
    commas. Null text is empty and has no spans; texts and tokens are taken whole at any
    length; repeated rows stay, each with its own spans; an empty table gives no rows. Columns
    of `docs` with names of the results are replaced.
    """
    results = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]
    keep = [c for c in docs.columns if c not in results]
    pad = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name, so names of steps clash with none
    text = f"text{pad}"
    out = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce("text", F.lit("")).alias(text))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": TOKEN}
    for kind, pattern in patterns.items():
        out = out.withColumn(kind + pad, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    for kind, pattern in patterns.items():
        matches = F.col(kind + pad)
        if kind == "assign":
            kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.length(v) >= 6)
        else:
            kept = F.transform(matches, lambda t: F.lit(True))
        placed = _placed(matches, F.split(text, pattern, -1), kept, kind)
        if kind == "markov":
            within = lambda s, r: F.struct((s["start"] + r["start"]).alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), (s["start"] + r["end"]).alias("end"))
            placed = F.flatten(F.zip_with(placed, matches, lambda s, t: F.transform(_runs(t, ratios, per_char, least), lambda r: within(s, r))))
        out = out.withColumn(kind + pad, F.when(F.size(matches) > 0, placed).otherwise(F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")))
    out = out.withColumn("base" + pad, F.concat("assign" + pad, "access" + pad, "hex" + pad))
    added = F.filter("markov" + pad, lambda m: ~F.exists("base" + pad, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])))
    return out.select(
        *(F.col(f"`{c}`") for c in keep),
        *(F.size(k + pad).cast("long").alias(f"n_{k}") for k in KINDS),
        _listed(F.col("base" + pad)).alias("base_spans"),
        _listed(F.concat("base" + pad, added)).alias("spans"),
    )
