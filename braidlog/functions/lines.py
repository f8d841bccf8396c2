"""Columns that take one log line apart. All are codegen-friendly expressions, null in, null out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, and ASCII white space without the vertical tab.
WHITE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ASCII_WHITE = r" \t\n\f\r"

_STAMP = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(\.([0-9]*))?"
_BRACKETS = rf"\A\[([^\]{ASCII_WHITE}:]*)\]"

#: The key of lines before a file's first timestamp: less than any other.
ZERO_KEY = "0000-00-00T00:00:00.000000000"


def timestamp_key(line: Column) -> Column:
    """Sort key of a line that begins with a timestamp, else null; byte order is time order.

    Seconds with an optional fraction of 1 to 9 digits, no range checks; a dot with no or with
    more than 9 digits is no timestamp, and whatever follows is ignored.
    """
    head, fraction = F.regexp_extract(line, _STAMP, 1), F.regexp_extract(line, _STAMP, 3)
    dotted = F.length(F.regexp_extract(line, _STAMP, 2)) > 0
    fine = (F.length(head) > 0) & (~dotted | F.length(fraction).between(1, 9))
    return F.when(fine, F.concat(head, F.lit("."), F.rpad(fraction, 9, "0")))


def looks_stamped(line: Column) -> Column:
    """Whether a line begins with four digits and a dash: weaker than timestamp_key on purpose."""
    return line.rlike(r"\A[0-9]{4}-")


def without_line_end(line: Column) -> Column:
    return F.regexp_replace(line, r"[\r\n]+\z", "")


def decoded(line: Column) -> Column:
    """Bytes as text, U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(line.cast("string"))


def with_parsed(df: DataFrame, line: str, fields: tuple[str, ...] = ("timestamp", "thread", "category", "content")) -> DataFrame:
    """Adds timestamp, thread, category and content of the text column `line`, or those of them in `fields`.

    A line that looks stamped has its timestamp up to the first ASCII white space, then up to
    two bracket groups: two are thread and category, a single one is the category. Any other
    line is content as a whole. An empty group is the category '', which is not null.

    The steps are columns of their own, each used more than once, so that each runs once a row.
    """
    out = df.withColumn("body_", without_line_end(F.col(line)))
    out = out.withColumn("stamp_", F.when(looks_stamped(F.col("body_")), F.regexp_extract("body_", rf"\A[^{ASCII_WHITE}]*", 0)))
    # null where the line is not stamped, and so is all that follows from it
    out = out.withColumn("rest_", F.regexp_replace(F.substring("body_", F.length("stamp_") + 1, F.length("body_")), rf"\A{WHITE}+", ""))
    out = out.withColumn("after_", F.when(F.col("rest_").rlike(_BRACKETS), F.regexp_replace("rest_", _BRACKETS + WHITE + "*", "")))
    out = out.withColumn("last_", F.when(F.col("after_").rlike(_BRACKETS), F.regexp_replace("after_", _BRACKETS + WHITE + "*", "")))
    one, two = F.col("after_").isNotNull(), F.col("last_").isNotNull()
    first, second = F.regexp_extract("rest_", _BRACKETS, 1), F.regexp_extract("after_", _BRACKETS, 1)
    found = {
        "timestamp": F.col("stamp_"),
        "thread": F.when(two, first),
        "category": F.when(two, second).when(one, first),
        "content": F.coalesce("last_", "after_", "rest_", "body_"),
    }
    return out.withColumns({k: v for k, v in found.items() if k in fields}).drop("body_", "stamp_", "rest_", "after_", "last_")


def first_space(line: Column) -> Column:
    """Place of the first space, from 1; 0 without one."""
    return F.instr(line, " ")


def node_of(line: Column) -> Column:
    """What stands before the first space; null without a space."""
    return F.when(first_space(line) > 0, F.substring(line, F.lit(1), first_space(line) - 1))


def after_node(line: Column) -> Column:
    """What stands after the first space; the whole line without one."""
    return F.when(first_space(line) > 0, F.substring(line, first_space(line) + 1, F.length(line))).otherwise(line)


def sniffed(line: Column) -> Column:
    """True if a line shows a node prefix before a timestamp, false if it shows a timestamp, else null."""
    return F.when(timestamp_key(line).isNotNull(), False).when((first_space(line) > 1) & timestamp_key(after_node(line)).isNotNull(), True)
