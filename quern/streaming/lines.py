"""Lines of a device, framed and routed to commands; works on streams and tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a command's line begins.
PREFIXES = {"prompt": "{", "shoot": "SHOOT", "key": "KEY", "transfer": "XFER", "query": "RAGQ", "scan": "BTSCAN", "log": "LOGD"}


def commands(line: Column) -> Column:
    """The command of a line; lines of no command are text."""
    out = F.lit("text")
    for name, prefix in reversed(PREFIXES.items()):
        out = F.when(line.startswith(prefix), name).otherwise(out)
    return out


def routed(lines: DataFrame, column: str = "value", most: int = 50) -> DataFrame:
    """(command, argument, ids, most): what a line asks for; a prompt's ids and bounded maximum, null where its JSON is broken. Blank lines are dropped."""
    text = F.trim(F.regexp_replace(column, r"[\r\n]", ""))
    named = lines.select(text.alias("line")).where("line <> ''").withColumn("command", commands(F.col("line")))
    asked = F.from_json(F.when(F.col("command") == "prompt", F.col("line")), "ids array<int>, max int")
    return named.select("command", F.trim(F.regexp_extract("line", r"^\S+\s+(.*)$", 1)).alias("argument"), asked["ids"].alias("ids"), F.when(asked["max"].isNotNull(), F.least(asked["max"], F.lit(most))).alias("most"))
