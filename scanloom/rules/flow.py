"""Data from outside followed through assignments, by lines, and functions that clean it, from a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A name as the languages have it.
NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"


def _names(lines: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """(keys, line, name) of the names on lines, each once a line."""
    return lines.select(*keys, F.col("line_no").alias(line), F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(1)))).alias("name")).filter("name is not null")


def assigned(lines: DataFrame, keys: Sequence[str], source: str, sink: str, within: int = 50) -> DataFrame:
    """(keys, name, source_line, line_no) of the lines that match `sink` and hold a name that a line fewer than `within` lines before
    is given from what matches `source`. The name is part of the join's key, so that lines meet only where it stands on both."""
    given = F.regexp_extract("text", NAME + r"\s*:?=[^=]", 1)
    starts = lines.filter(F.col("text").rlike(source)).select(*keys, F.col("line_no").alias("source_line"), given.alias("name")).filter("name <> ''")
    ends = _names(lines.filter(F.col("text").rlike(sink)), keys, "line_no")
    near = (F.col("source_line") < F.col("line_no")) & (F.col("line_no") - F.col("source_line") < within)
    return starts.join(ends, [*keys, "name"]).filter(near).select(*keys, "name", "source_line", "line_no").distinct()


def uncleaned(flows: DataFrame, lines: DataFrame, keys: Sequence[str], cleaners: DataFrame) -> DataFrame:
    """flows (keys, name, source_line, line_no) but for those whose name stands, after its source and up to the sink, on a line
    with a function of cleaners (function): people's own sanitizers. A null function cleans nothing."""
    wanted = cleaners.select(F.col("function").alias("other")).dropna().distinct()
    clean = _names(lines, keys, "clean_line").join(wanted, F.col("name") == F.col("other"), "left_semi").select(*keys, "clean_line").distinct()
    there = _names(lines.withColumnRenamed("line_no", "clean_line").join(clean, [*keys, "clean_line"], "left_semi").withColumnRenamed("clean_line", "line_no"), keys, "clean_line")
    same = [F.col(f"f.{k}") == F.col(f"c.{k}") for k in [*keys, "name"]]
    on = (F.col("c.clean_line") > F.col("f.source_line")) & (F.col("c.clean_line") <= F.col("f.line_no"))
    for s in same:
        on = on & s
    return flows.alias("f").join(there.alias("c"), on, "left_anti")
