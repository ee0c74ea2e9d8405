"""Rules over lines of code.

One alternation of all sinks of a language goes over the lines; only lines that pass meet the rules, a table of a
few hundred rows that every executor holds. What comes from outside and what makes safe is looked for in the lines
around, which are taken from the array of the file's lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.rules.catalogue import RULES, Rule

#: Lines that begin so hold no code.
LINE_END = r"\r\n|\n|\r"
COMMENT = r"^\s*(?://|/\*|\*|#(?!\s*(?:include|define))|<!--|--)"


def lines_of_files(files: DataFrame, keys: Sequence[str], text: str = "content") -> DataFrame:
    """(keys, language, line_no, text) of the lines of files (keys, language, text), numbered from 1."""
    return files.filter(F.col(text).isNotNull()).select(*keys, "language", F.posexplode(F.split(F.col(text), LINE_END)).alias("pos", "text")).select(*keys, "language", (F.col("pos") + 1).alias("line_no"), "text")


def _quoted(text: str) -> str:
    """A text as a literal of an expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_sink(rules: Sequence[Rule], text: Column) -> Column:
    by: dict[str, list[str]] = {}
    for r in rules:
        by.setdefault(r.language, []).append(f"(?:{r.sink})")
    return reduce(lambda a, b: a | b, ((F.col("language") == lang) & text.rlike("|".join(p)) for lang, p in by.items()), F.lit(False))


def findings(files: DataFrame, keys: Sequence[str], rules: Sequence[Rule] = RULES, around: int = 20, text: str = "content") -> DataFrame:
    """(keys, language, line_no, rule_id, kind, level, cwe, text) of files (keys, language, text): one finding for each rule and line.

    A rule with a source needs it on the line or fewer than `rule.within` lines before; one with a safe pattern
    is silent if that stands within `around` lines before or after. A file's lines stay one array: the lines around are
    joined for lines with a sink alone, and nothing is shuffled. A null text or language has no finding.
    """
    rows = files.filter(F.col(text).isNotNull() & F.col("language").isin(sorted({r.language for r in rules}))).select(*keys, "language", F.split(F.col(text), LINE_END).alias("all"))
    withins = sorted({max(1, r.within) for r in rules if r.source})
    sinks = F.filter(F.transform("all", lambda x, i: F.when(_any_sink(rules, x) & ~x.rlike(COMMENT), i)), lambda i: i.isNotNull())

    def around_line(i: Column, before: int, after: int) -> Column:
        start = F.greatest(i - before, F.lit(0))
        return F.array_join(F.slice("all", start + 1, i + after - start + 1), "\n")

    near = [around_line(F.col("i"), w - 1, 0).alias(f"before_{w}") for w in withins]
    # explode would make Spark check each list first, and so build it twice.
    hit = rows.select(*keys, "language", "all", F.explode_outer(sinks).alias("i")).filter("i is not null")
    marked = hit.select(*keys, "language", (F.col("i") + 1).alias("line_no"), F.get("all", F.col("i")).alias("text"), *near, around_line(F.col("i"), around, around).alias("about"))
    # Patterns as literals, each compiled once; a pattern that comes from a row would be compiled for every row. As one text, since
    # thousands of calls into the JVM take seconds.
    hits = [
        f"CASE WHEN language = {_quoted(r.language)} AND text RLIKE {_quoted(r.sink)}"
        + (f" AND before_{max(1, r.within)} RLIKE {_quoted(r.source)}" if r.source else "")
        + (f" AND NOT about RLIKE {_quoted(r.safe)}" if r.safe else "")
        + f" THEN {_quoted(r.rule_id)} END"
        for r in rules
    ]
    found = marked.select(*keys, "language", "line_no", "text", F.explode_outer(F.expr(f"array_compact(array({', '.join(hits)}))")).alias("rule_id")).filter("rule_id is not null")
    table = files.sparkSession.createDataFrame([(r.rule_id, r.kind, r.level, r.cwe) for r in rules], "rule_id string, kind string, level string, cwe string")
    return found.join(F.broadcast(table), "rule_id").select(*keys, "language", "line_no", "rule_id", "kind", "level", "cwe", "text")


def finish(found: DataFrame, keys: Sequence[str], catalogue: DataFrame, known: DataFrame | None = None, place: Sequence[str] | None = None) -> DataFrame:
    """Findings once for each line and kind, with the level that the catalogue (name_cn, level) gives the kind, their own if
    it doesn't know it, and without those that are known (place, line_no, kind) already. place: the columns that name a
    file, keys if not given; a null in them is no place. Kinds are compared without spaces at both ends, in lower case."""
    once = Window.partitionBy(*keys, "line_no", "kind").orderBy("rule_id")
    first = found.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n")
    names = catalogue.select(F.trim("name_cn").alias("kind"), F.col("level").alias("listed")).groupBy("kind").agg(F.max("listed").alias("listed"))
    out = first.join(names, "kind", "left").withColumn("level", F.coalesce("listed", "level")).drop("listed")
    if known is None:
        return out
    at, kind = [*(place or keys), "line_no"], F.lower(F.trim("kind"))
    return out.withColumn("known_kind", kind).join(known.select(*at, kind.alias("known_kind")), [*at, "known_kind"], "left_anti").drop("known_kind")


def complexity(code: Column) -> Column:
    """About the number of independent ways through a text of code: one and one more for each branch."""
    return F.regexp_count(code, F.lit(r"\b(?:if|for|while|case|catch|elif|except|foreach)\b|&&|\|\||\?[^?:\n]*:")) + 1
