"""File names: debug.log-<date>-<node>.gz for a node's day, debug.log-<date>.zst for a merged one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NODE_FILE = r"\Adebug\.log-([^-]+)-(.+)\.gz\z"
_DAY_FILE = r"\Adebug\.log-(.+)\.zst\z"


def node_file(name: Column) -> Column:
    """struct(date, node) of a node's file, null for any other name. The date ends at the first dash."""
    return F.when(name.rlike(f"(?s){_NODE_FILE}"), F.struct(F.regexp_extract(name, f"(?s){_NODE_FILE}", 1).alias("date"), F.regexp_extract(name, f"(?s){_NODE_FILE}", 2).alias("node")))


def day_of(name: Column) -> Column:
    """Date of a merged file's name; an error for any other name."""
    return F.when(name.rlike(f"(?s){_DAY_FILE}"), F.regexp_extract(name, f"(?s){_DAY_FILE}", 1)).otherwise(F.raise_error(F.concat(F.lit("not a merged log's name: "), name)).cast("string"))


def plain(node: Column) -> Column:
    """Whether a node's name can be a file's: not empty, no leading dot, no slash."""
    return (F.length(node) > 0) & ~node.startswith(".") & ~node.contains("/")


def node_file_name(date: str, node: str) -> str:
    return f"debug.log-{date}-{node}.gz"


def day_file_name(date: str) -> str:
    return f"debug.log-{date}.zst"
