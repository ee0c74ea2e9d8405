"""Joins by nearness, containment and substrings."""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def within_lines(sinks: DataFrame, sources: DataFrame, keys: Sequence[str], line: str, most: int, how: str = "inner") -> DataFrame:
    """Pairs of a sink and a source of one group where the source comes before by fewer than `most` lines.

    Sources come with their columns named source_*. A band of `most` lines is part of the join's key, so rows
    that are far apart never meet and a huge group is spread over its bands.
    """
    s = sources.select(*keys, *[F.col(c).alias(f"source_{c}") for c in sources.columns if c not in keys])
    s = s.withColumn("band", F.explode(F.array(F.floor(F.col(f"source_{line}") / most), F.floor(F.col(f"source_{line}") / most) + 1)))
    t = sinks.withColumn("band", F.floor(F.col(line) / most))
    near = (F.col(f"s.source_{line}") < F.col(f"t.{line}")) & (F.col(f"t.{line}") - F.col(f"s.source_{line}") < most)
    on = near & (F.col("t.band") == F.col("s.band"))
    for k in keys:
        on = on & (F.col(f"t.{k}") == F.col(f"s.{k}"))
    kept = [F.col(f"t.{c}") for c in sinks.columns]
    if how in ("left_semi", "left_anti"):
        return t.alias("t").join(s.alias("s"), on, how).drop("band")
    return t.alias("t").join(s.alias("s"), on, how).select(*kept, *[F.col(f"s.source_{c}") for c in sources.columns if c not in keys])


def nearest_before(sinks: DataFrame, sources: DataFrame, keys: Sequence[str], line: str, name: str = "source_line") -> DataFrame:
    """Each sink with the line of the last source before it, null if there is none: an as-of join by one sort."""
    both = sinks.select("*", F.lit(None).cast("int").alias(name), F.lit(1).alias("kind")).unionByName(sources.select(*keys, F.col(line), F.col(line).cast("int").alias(name), F.lit(0).alias("kind")), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy(line, F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(upto)).filter(F.col("kind") == 1).drop("kind")


def outside_ranges(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Rows whose line is in none of the group's ranges (start, end), the ends counted in."""
    r = ranges.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    on = F.col(line).between(F.col("r_start"), F.col("r_end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return rows.join(r, on, "left_anti")


def lines_with_needles(lines: DataFrame, text: str, needles: DataFrame, needle: str, most: int = 10_000) -> DataFrame:
    """Each line with each needle that it contains. needles are rules kept by people; a table of more than `most` is refused.

    One alternation of all needles goes over the lines first, so that only lines with a hit meet the needles.
    """


    words = [r[0] for r in needles.select(needle).filter(F.length(needle) > 0).distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} needles")
    hit = F.col(text).rlike("|".join(re.escape(w) for w in sorted(words))) if words else F.lit(False)
    return lines.filter(hit).join(F.broadcast(needles.filter(F.length(needle) > 0)), F.col(text).contains(F.col(needle)))


def likeness(left: Column, right: Column, least: float = 0.0) -> Column:
    """The share of characters in common blocks of two texts, as difflib counts it; 0 if either is null or if the signs that
    they have in common, in whatever order, make it less than `least`."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, match = [], difflib.SequenceMatcher(None, autojunk=False)
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(0.0)
                continue
            match.set_seqs(x, y)
            out.append(match.ratio() if match.quick_ratio() >= least else 0.0)
        return pd.Series(out, dtype="float64")

    return run(left, right)


def likest_lines(lines: DataFrame, wanted: DataFrame, keys: Sequence[str], text: str, least: float = 0.5) -> DataFrame:
    """For each wanted text the lines of its group that are likest to it, ties kept, from `least` on.

    Rows whose lengths alone rule the likeness out don't reach Python.
    """
    a, b = lines.alias("a"), wanted.select(*keys, F.col(text).alias("wanted")).alias("b")
    n, m = F.length(f"a.{text}"), F.length("b.wanted")
    on = (2 * F.least(n, m) >= F.lit(least) * (n + m)) & (n > 0)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, on).select("a.*", "wanted").withColumn("likeness", likeness(F.trim(text), F.trim("wanted"), least))
    best = Window.partitionBy(*keys, "wanted")
    return pairs.filter(F.col("likeness") >= least).withColumn("best", F.max("likeness").over(best)).filter(F.col("likeness") == F.col("best")).drop("best")


def place_of(code: Column, snippet: Column) -> Column:
    """(start_line, end_line) of the first place of a snippet in code, blanks and line ends aside; null if it isn't there."""
    bare, wanted = F.regexp_replace(code, r"\s+", ""), F.regexp_replace(snippet, r"\s+", "")
    at = F.instr(bare, wanted)
    sizes = F.transform(F.split(code, r"\r\n|\n|\r"), lambda x: F.length(F.regexp_replace(x, r"\s+", "")))

    def line_of(place: Column) -> Column:
        """One more than the lines that end before a place, counted as their signs are summed up."""
        start = F.struct(F.lit(0).alias("sum"), F.lit(1).alias("line"))
        return F.aggregate(sizes, start, lambda s, n: F.struct((s["sum"] + n).alias("sum"), (s["line"] + (s["sum"] + n < place).cast("int")).alias("line")), lambda s: s["line"])

    return F.when((F.length(wanted) > 0) & (at > 0), F.struct(line_of(at).alias("start_line"), line_of(at + F.length(wanted) - 1).alias("end_line")))
