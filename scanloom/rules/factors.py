"""Sinks judged by how many factors of risk they have."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scored(lines: DataFrame, keys: Sequence[str], sink: str, factors: Mapping[str, tuple[str, int]], source: str, within: int = 50, least: int = 1) -> DataFrame:
    """(keys, line_no, n_factors, points, near_source, level) of the lines that match `sink` and have `least` points.

    factors: name -> (pattern over the line, points). A line that matches `source` fewer than `within` lines before, or on the
    line itself, is a factor of 2 points. Level is high with a source near or two factors and more, else medium.
    """
    text = F.col("text")
    near = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(1 - within, 0)
    rows = lines.withColumn("near_source", F.max(text.rlike(source)).over(near)).filter(text.rlike(sink))
    hits = [(text.rlike(pattern), points) for pattern, points in factors.values()]
    add = lambda cols: reduce(lambda a, b: a + b, cols, F.lit(0))
    n: Column = add([hit.cast("int") for hit, _ in hits]) + F.col("near_source").cast("int")
    points = add([hit.cast("int") * p for hit, p in hits]) + 2 * F.col("near_source").cast("int")
    level = F.when(F.col("near_source") | (n >= 2), "high").otherwise("medium")
    return rows.select(*keys, "line_no", n.alias("n_factors"), points.alias("points"), "near_source", level.alias("level")).filter(F.col("points") >= least)
