"""Texts and their lines: array expressions, exploded tables, islands of equal neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"(?U)^\s*$"


def lines_of(text: Column) -> Column:
    """Lines of a text: ended by \\n or \\r\\n, a final line end starts no line, no text has no lines."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def left_trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+", "")


def is_blank(line: Column) -> Column:
    return line.rlike(BLANK)


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, n, line`; documents without lines give no rows."""
    return docs.select(key, F.posexplode(lines_of(F.col(text))).alias("n", "line"))


def ordered(key: str = "doc_id") -> Window:
    return Window.partitionBy(key).orderBy("n")


def islands(lines: DataFrame, starts: Column, key: str = "doc_id") -> DataFrame:
    """Numbers runs of neighbouring lines: `starts` tells where a run begins. One exchange by key serves all such steps."""
    return lines.withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(ordered(key).rowsBetween(Window.unboundedPreceding, 0)))


def assemble(lines: DataFrame, key: str = "doc_id", order: str = "n", line: str = "line") -> DataFrame:
    """`key, text` from lines in their order."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("v"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(gathered, lambda x: x["v"]), "\n").alias("text"))
