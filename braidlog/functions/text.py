"""JSON text as reports and catalogue files spell it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The short escapes of a report; a catalogue also has those of SHORTER.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
SHORTER = {"\b": "\\b", "\f": "\\f"}


def _json_string(text: Column, short: dict[str, str]) -> Column:
    """A JSON string with the escapes of `short`, \\u00xx for other control characters; null is null."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, escaped in short.items():
        if plain != "\\":
            out = F.replace(out, F.lit(plain), F.lit(escaped))
    rare = out  # a pass for each character, so that time grows with the text
    for code in range(32):
        if chr(code) not in short:
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    out = F.when(out.rlike(r"[\x00-\x1F]"), rare).otherwise(out)
    return F.when(text.isNull(), "null").otherwise(F.concat(F.lit('"'), out, F.lit('"')))


def report_string(text: Column) -> Column:
    """A JSON string as reports spell it."""
    return _json_string(text, SHORT)


def catalogue_string(text: Column) -> Column:
    """The same for catalogue files: \\b and \\f are short too."""
    return _json_string(text, SHORT | SHORTER)


def state_float(x: float) -> str:
    """A finite number with at least one decimal and never an exponent."""
    if not math.isfinite(x):
        raise ValueError(f"not a finite number: {x}")
    text = repr(float(x))
    if "e" not in text:
        return text
    digits, _, power = text.partition("e")
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    whole, _, part = digits.partition(".")
    places, shift = len(part) if part != "0" else 0, int(power)
    number = whole + (part if part != "0" else "")
    point = len(number) - places + shift
    if point <= 0:
        return f"{sign}0.{'0' * -point}{number}"
    number = number.ljust(point, "0")
    return f"{sign}{number[:point]}.{number[point:] or '0'}"
