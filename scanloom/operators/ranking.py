"""One row of each group, rows beside a row, rows in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.plans.names import fresh


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order; Spark drops the rest of a group before it shuffles."""
    [n] = fresh(df, "n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) == 1).drop(n)


def best_per_line(findings: DataFrame, keys: Sequence[str], priority: Column, message: str, tie: Sequence[str]) -> DataFrame:
    """Of the findings on one line the one of highest priority; of those the one with the longest message, then by tie."""
    return keep_first(findings, keys, [priority.desc_nulls_last(), F.length(message).desc_nulls_last(), *map(F.col, tie)])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "n") -> DataFrame:
    """Rows numbered from 1 within their group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def spaced(df: DataFrame, keys: Sequence[str], line: str, gap: int = 1) -> DataFrame:
    """Rows more than `gap` lines after the row before, of all rows (not of those kept), so that no state is needed."""
    [before] = fresh(df, "before")
    rows = df.withColumn(before, F.lag(line).over(Window.partitionBy(*keys).orderBy(line)))
    return rows.filter(F.col(before).isNull() | (F.col(line) - F.col(before) > gap)).drop(before)


def spaced_emitted(df: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Rows more than one line after the row last kept, from the first on, one for each line.

    Kept rows depend on each other, but not beyond a gap: within an island of neighbouring lines every second one is kept.
    """
    before, island, first = fresh(df, "before", "island", "first")
    order = Window.partitionBy(*keys).orderBy(line)
    rows = df.dropDuplicates([*keys, line]).withColumn(before, F.lag(line).over(order))
    rows = rows.withColumn(island, F.count_if(F.col(before).isNull() | (F.col(line) - F.col(before) > 1)).over(order))
    rows = rows.withColumn(first, F.min(line).over(Window.partitionBy(*keys, island)))
    return rows.filter((F.col(line) - F.col(first)) % 2 == 0).drop(before, island, first)


def with_context(lines: DataFrame, keys: Sequence[str], line: str, text: str, around: int, name: str = "context") -> DataFrame:
    """Each line with the lines up to `around` before and after it, joined by line feeds."""
    near = Window.partitionBy(*keys).orderBy(line).rowsBetween(-around, around)
    return lines.withColumn(name, F.array_join(F.collect_list(text).over(near), "\n"))


def last_before(lines: DataFrame, keys: Sequence[str], line: str, value: Column, name: str) -> DataFrame:
    """Each line with the last value that isn't null at or before it: the enclosing function, when value is a header's name."""
    upto = Window.partitionBy(*keys).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def first_after(lines: DataFrame, keys: Sequence[str], line: str, value: Column, name: str) -> DataFrame:
    """Each line with the first value that isn't null at or after it."""
    onward = Window.partitionBy(*keys).orderBy(line).rowsBetween(0, Window.unboundedFollowing)
    return lines.withColumn(name, F.first(value, ignorenulls=True).over(onward))


def near_median(df: DataFrame, keys: Sequence[str], line: str, width: int) -> DataFrame:
    """Rows within `width` of their group's median line; all rows of a group of which none is."""
    [median, hit, any_hit] = fresh(df, "median", "hit", "any_hit")
    group = Window.partitionBy(*keys)
    rows = df.withColumn(median, F.percentile(line, F.lit(0.5)).over(group)).withColumn(hit, F.abs(F.col(line) - F.col(median)) <= width)
    rows = rows.withColumn(any_hit, F.max(hit).over(group))
    return rows.filter(F.col(hit) | ~F.col(any_hit)).drop(median, hit, any_hit)
