"""Content of a line as typed tokens: atoms, recognizers, and the slots that templates are made of."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlog.functions.lines import ASCII_WHITE

#: The labels of typed tokens in their sort order.
KINDS = (
    "PEER", "HEIGHT", "INT", "FLOAT", "HASH", "HEX", "IPv4", "IPv4:PORT", "IPv6", "IPv6:PORT",
    "ONION", "ONION:PORT", "I2P", "I2P:PORT", "BYTES", "DUR", "BECH32", "BASE58",
)

_PORT = r"0*(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[0-9]{1,4})"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_QUAD = "[0-9A-Fa-f]{0,4}"
_FLOAT = r"[+-]?[0-9]+\.[0-9]+(?:[eE][+-]?[0-9]+)?"
_INT = r"[+-]?[0-9]+"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def _ipv6(end: str) -> str:
    """Groups of up to four hex digits between colons, up to `end`: eight of them, or one `::` and at most seven that are not empty."""
    whole = rf"(?![^{end}]*::){_QUAD}(?::{_QUAD}){{7}}" if end else rf"(?!.*::){_QUAD}(?::{_QUAD}){{7}}"
    any_ = f"[^{end}]" if end else "."
    short = rf"(?={any_}*::)(?!{any_}*(?:::{any_}*::|:::))(?!:*[0-9A-Fa-f]+(?::+[0-9A-Fa-f]+){{7}}){_QUAD}(?::{_QUAD})*"
    return f"(?:{whole}|{short})"


#: A bracketed IPv6 address with a port, a run of plain characters, or a single delimiter.
_SEGMENT = rf"\[{_ipv6(chr(92) + ']')}\]:{_PORT}(?![0-9])|[^=()\[\]'/]+\[?|[=()\[\]'/]"
_DELIMITERS = r"[=()\[\]'/]"

Recognizer = tuple[str, Callable[[Column], Column]]


def _is(pattern: str, guard: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    whole = rf"(?s)\A(?:{pattern})\z"
    return lambda atom: atom.rlike(whole) if guard is None else guard(atom) & atom.rlike(whole)


def _size(low: int, high: int) -> Callable[[Column], Column]:
    return lambda atom: F.length(atom).between(low, high)


#: What recognizes each kind, first match wins. BYTES needs its neighbour and is not in this
#: list; it ranks after HEIGHT. Users may pass a list of their own to `with_tokens`.
RECOGNIZERS: tuple[Recognizer, ...] = (
    ("PEER", _is(r"peer=[+-]?[0-9]+", lambda a: a.startswith("peer="))),
    ("HEIGHT", _is(r"height=[0-9]+", lambda a: a.startswith("height="))),
    ("HASH", _is(r"[0-9a-f]{64}", _size(64, 64))),
    ("DUR", _is(rf"(?:{_INT}|{_FLOAT})(?:\x{{3BC}}s|ns|us|ms|s|m|h|d)")),
    ("IPv6:PORT", _is(rf"\[{_ipv6(chr(92) + ']')}\]:{_PORT}", lambda a: a.startswith("["))),
    ("IPv6", _is(rf"(?=.*:){_ipv6('')}", lambda a: a.contains(":"))),
    ("IPv4:PORT", _is(rf"{_IPV4}:{_PORT}", lambda a: a.contains(":"))),
    ("IPv4", _is(_IPV4, lambda a: a.contains("."))),
    ("ONION:PORT", _is(rf"(?:[a-z2-7]{{16}}|[a-z2-7]{{56}})\.onion:{_PORT}", lambda a: a.contains(".onion:"))),
    ("ONION", _is(r"(?:[a-z2-7]{16}|[a-z2-7]{56})\.onion", lambda a: a.endswith(".onion"))),
    ("I2P:PORT", _is(rf"[a-z2-7]{{52}}\.b32\.i2p:{_PORT}", lambda a: a.contains(".i2p:"))),
    ("I2P", _is(r"[a-z2-7]{52}\.b32\.i2p", lambda a: a.endswith(".i2p"))),
    ("BECH32", _is(rf"(?:bc1|tb1|bcrt1)[{_BECH32}]{{6,}}", lambda a: a.startswith("bc") | a.startswith("tb"))),
    ("HEX", _is(r"0x[0-9A-Fa-f]+|(?=.*[A-Fa-f])[0-9A-Fa-f]{8,63}", lambda a: F.length(a) >= 3)),
    ("BASE58", _is(rf"(?=.*[A-Za-z])[{_BASE58}]{{26,35}}", _size(26, 35))),
    ("FLOAT", _is(_FLOAT, lambda a: a.contains("."))),
    ("INT", _is(_INT)),
)


def _pieces(body: Column) -> Column:
    """The atoms of a word whose last colon or comma is off."""
    whole = body.startswith("peer=") | body.startswith("height=") | ~body.rlike(_DELIMITERS)
    cut = F.flatten(
        F.transform(
            F.regexp_extract_all(body, F.lit(_SEGMENT), F.lit(0)),
            lambda m: F.when(m.startswith("[") & (F.length(m) > 1), F.array(m)).otherwise(F.regexp_extract_all(m, F.lit(rf"[^=()\[\]'/]+|{_DELIMITERS}"), F.lit(0))),
        )
    )
    return F.when(whole, F.array(body)).otherwise(cut)


def atoms_of(content: Column) -> Column:
    """array<string>: content cut at ASCII white space, then at punctuation."""
    words = F.filter(F.split(content, f"[{ASCII_WHITE}]+", -1), lambda w: F.length(w) > 0)
    # one lambda for each step, so that no step is written out, and run, more than once
    tails = F.transform(words, lambda w: F.struct(w.alias("word"), F.when(F.length(w) > 1, F.when(w.endswith(":"), ":").when(w.endswith(","), ",")).alias("tail")))
    bodies = F.transform(tails, lambda x: F.struct(F.when(x["tail"].isNull(), x["word"]).otherwise(F.substring(x["word"], F.lit(1), F.length(x["word"]) - 1)).alias("body"), x["tail"].alias("tail")))
    return F.flatten(F.transform(bodies, lambda x: F.when(x["tail"].isNull(), _pieces(x["body"])).otherwise(F.concat(_pieces(x["body"]), F.array(x["tail"])))))


def kind_of(atom: Column, following: Column, recognizers: Sequence[Recognizer] = RECOGNIZERS) -> Column:
    """Label of an atom, null for plain text. `following` is the atom after it, or ''."""
    maybe = (F.length(atom) >= 8) | atom.rlike("[0-9:]")  # most words end here
    chain = None
    for label, test in recognizers:
        chain = F.when(test(atom), label) if chain is None else chain.when(test(atom), label)
        if label == "HEIGHT":
            chain = chain.when(F.when(following == "bytes", atom.rlike(r"\A[0-9]+\z")).otherwise(False), "BYTES")
    return F.when(maybe, chain)


def with_atoms(df: DataFrame, content: str = "content", to: str = "atoms") -> DataFrame:
    return df.withColumn(to, atoms_of(F.col(content)))


def with_tokens(df: DataFrame, content: str = "content", to: str = "tokens", recognizers: Sequence[Recognizer] = RECOGNIZERS) -> DataFrame:
    """`df` with array<struct<kind,text>>: kind null for plain text; a byte count has its `bytes` folded in."""
    out = df.withColumn("atoms__", atoms_of(F.col(content)))
    # neighbours are zipped in, not looked up: a lambda that names a column may have its whole expression copied into it
    pairs = F.zip_with("atoms__", F.slice("atoms__", F.lit(2), F.size("atoms__")), lambda a, f: F.struct(a.alias("atom"), F.coalesce(f, F.lit("")).alias("following")))
    trios = F.zip_with(pairs, F.concat(F.array(F.lit("")), "atoms__"), lambda t, p: F.when(t.isNotNull(), F.struct(t["atom"].alias("atom"), t["following"].alias("following"), p.alias("preceding"))))
    out = out.withColumn("around__", F.filter(trios, lambda t: t.isNotNull() & ~((t["atom"] == "bytes") & t["preceding"].rlike(r"\A[0-9]+\z"))))
    kinds = F.transform("around__", lambda t: F.struct(kind_of(t["atom"], t["following"], recognizers).alias("kind"), t["atom"].alias("text")))
    return out.withColumn(to, kinds).drop("atoms__", "around__")


TEXT, TYPED, STAR = "0", "1", "2"


def slot_of(token: Column) -> Column:
    """A token's slot: '0' and the text, or '1' and its kind's two-digit place; '2' is the wildcard. Byte order is slot order."""
    place = F.lpad((F.array_position(F.array(*map(F.lit, KINDS)), token["kind"]) - 1).cast("string"), 2, "0")
    return F.when(token["kind"].isNull(), F.concat(F.lit(TEXT), token["text"])).otherwise(F.concat(F.lit(TYPED), place))


def with_slots(df: DataFrame, tokens: str = "tokens", to: str = "slots") -> DataFrame:
    return df.withColumn(to, F.transform(tokens, slot_of))


def packed(slots: Column) -> Column:
    """Slots as one string, each with a line feed after it: a third of an array's bytes where rows are moved."""
    plain = F.array_join(slots, "\n")
    as_is = (n_packed(plain) == F.size(slots) - 1) & ~F.contains(plain, F.lit("\x01"))
    escaped = F.transform(slots, lambda s: F.replace(F.replace(s, F.lit("\x01"), F.lit("\x01a")), F.lit("\n"), F.lit("\x01b")))
    return F.when(F.size(slots) == 0, "").when(as_is, F.concat(plain, F.lit("\n"))).otherwise(F.concat(F.array_join(escaped, "\n"), F.lit("\n")))


def n_packed(text: Column) -> Column:
    """How many slots were packed."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def unpacked(text: Column) -> Column:
    """What packed made a string of."""
    parts = F.split(F.substring(text, F.lit(1), F.length(text) - 1), "\n", -1)
    back = F.transform(parts, lambda s: F.replace(F.replace(s, F.lit("\x01b"), F.lit("\n")), F.lit("\x01a"), F.lit("\x01")))
    return F.when(text == "", F.array().cast("array<string>")).when(F.contains(text, F.lit("\x01")), back).otherwise(parts)


def rendered(template: Column) -> Column:
    """A template as text: literals, <LABEL>, <*>, joined by a space."""
    label = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), F.substring(s, 2, 2).cast("int") + 1)
    return F.array_join(F.transform(template, lambda s: F.when(s == STAR, "<*>").when(s.startswith(TYPED), F.concat(F.lit("<"), label(s), F.lit(">"))).otherwise(F.substring(s, F.lit(2), F.length(s)))), " ")
