"""What other tools and people hand over: lists of repositories, reports of scanners, graphs as CSV, logins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def repositories(rows: DataFrame, url: str, branch: str | None = None) -> DataFrame:
    """(url, branch, name) of the rows of a list that name a repository, once each; name is the last part of the address without
    its suffix. A row whose address has neither http nor git in it is passed over, and so is a null one; no branch is ""."""
    address = F.trim(F.col(url))
    of = F.coalesce(F.trim(F.col(branch)), F.lit("")) if branch else F.lit("")
    named = F.regexp_extract(F.regexp_replace(address, r"/+$", ""), r"([^/:]+?)(?:\.git)?$", 1)
    return rows.filter(address.rlike("(?i)http|git")).select(address.alias("url"), of.alias("branch"), named.alias("name")).distinct()


def scanner_findings(cells: DataFrame, text: str) -> DataFrame:
    """cells with file, line, sink, enclosing_method and source as a scanner's report writes them into a cell: the file with its line,
    then what follows the words Sink:, Enclosing Method: and Source:. A cell without a file and line has no finding."""
    place = r"([^\s:]+\.(?:java|c|cpp|py|php|cs|go|js|sql)):(\d+)"

    def after(word: str, end: str) -> Column:
        return F.trim(F.regexp_extract(F.col(text), rf"(?s){word}:\s*(.*?)\s*(?:{end})", 1))

    return cells.filter(F.col(text).rlike(place)).withColumns(
        {
            "file": F.regexp_extract(F.col(text), place, 1),
            "line": F.regexp_extract(F.col(text), place, 2).cast("int"),
            "sink": after("Sink", "Enclosing Method:"),
            "enclosing_method": after("Enclosing Method", "Source:"),
            "source": after("Source", r"\z"),
        }
    )


def property_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(id, label, name, code, line, source_file) and (src, dst, label) of CSV files with a header whose columns :ID and :LABEL, and
    :START_ID, :END_ID and :TYPE, say what a graph of code is made of; a column that is missing is null, a row without ids is none."""
    n = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(nodes)
    e = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(edges)

    def column(df: DataFrame, name: str, as_: str, kind: str = "string") -> Column:
        return (F.expr(f"try_cast(`{name}` as {kind})") if name in df.columns else F.lit(None).cast(kind)).alias(as_)

    kept = n.select(column(n, ":ID", "id", "bigint"), column(n, ":LABEL", "label"), column(n, "NAME", "name"), column(n, "CODE", "code"), column(n, "LINE_NUMBER", "line", "int"), column(n, "FILENAME", "source_file"))
    linked = e.select(column(e, ":START_ID", "src", "bigint"), column(e, ":END_ID", "dst", "bigint"), column(e, ":TYPE", "label"))
    return kept.filter("id is not null"), linked.filter("src is not null and dst is not null")


def login_outcome(status: Column) -> Column:
    """(level, outcome) of a login by its status: "1" succeeded, "0" failed, "" was only tried; all else, null too, is unknown."""
    return (
        F.when(status == "1", F.struct(F.lit("info").alias("level"), F.lit("succeeded").alias("outcome")))
        .when(status == "0", F.struct(F.lit("warning").alias("level"), F.lit("failed").alias("outcome")))
        .when(status == "", F.struct(F.lit("info").alias("level"), F.lit("tried").alias("outcome")))
        .otherwise(F.struct(F.lit("error").alias("level"), F.lit("unknown").alias("outcome")))
    )
