"""Source trees, archives and the reports of other tools as DataFrames, and tables as files."""

from __future__ import annotations

import os
import tarfile
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.operators.paths import SUFFIXES, language_of


@F.pandas_udf(T.StringType())
def _older(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are that, else GB 18030, which reads the older Chinese encodings too; only
    the latter go through Python."""
    plain = F.is_valid_utf8(content.cast("string"))
    text = F.coalesce(F.when(plain, content.cast("string")), _older(F.when(~plain, content)))
    return F.regexp_replace(text, "^﻿", "")


def source_files(spark: SparkSession, folder: str, languages: tuple[str, ...] | None = None) -> DataFrame:
    """(path, language, content, size) of the files of some languages below a folder, all of them if none are named."""
    wanted = languages or tuple(SUFFIXES)
    glob = "*.{" + ",".join(s for x in wanted for s in SUFFIXES[x]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", language_of(F.col("path")).alias("language"), decoded(F.col("content")).alias("content"), F.col("length").alias("size"))


def unpack(archive: str, folder: str) -> list[str]:
    """The members of a zip, jar, war or tar archive, unpacked below a folder; one that would land elsewhere is refused.

    Names of zip members that aren't UTF-8 are read as GBK, as such archives are written.
    """
    root = Path(folder).resolve()
    out = []

    def place(name: str) -> Path:
        at = (root / name).resolve()
        if at != root and root not in at.parents:
            raise ValueError(f"{name!r} would leave the folder")
        at.parent.mkdir(parents=True, exist_ok=True)
        return at

    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for m in z.infolist():
                name = m.filename
                if not m.flag_bits & 0x800:
                    raw = name.encode("cp437", "replace")
                    for code in ("utf-8", "gbk"):
                        try:
                            name = raw.decode(code)
                            break
                        except UnicodeDecodeError:
                            continue
                if not m.is_dir():
                    at = place(name)
                    at.write_bytes(z.read(m))
                    out.append(os.path.relpath(at, root))
    else:
        with tarfile.open(archive) as t:
            for m in t.getmembers():
                if m.isfile():
                    at = place(m.name)
                    at.write_bytes(t.extractfile(m).read())
                    out.append(os.path.relpath(at, root))
    return sorted(out)


def complexity_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, ncss, ccn, functions) of the files that an XML report of complexity measures."""
    rows = spark.read.text(path, wholetext=True)
    names = rows.select("value", F.posexplode(F.expr("xpath(value, '//measure[@type=\"File\"]/item/@name')")).alias("i", "file"))
    numbers = F.expr("xpath(value, '//measure[@type=\"File\"]/item/value/text()')")
    at = names.withColumn("v", numbers)
    number = lambda k: F.try_element_at("v", F.col("i") * 4 + k).cast("int")
    return at.select("file", number(2).alias("ncss"), number(3).alias("ccn"), number(4).alias("functions"))


def table_of_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A catalogue as CSV with a header, one row a line, in UTF-8 or an older Chinese encoding."""
    text = spark.read.format("binaryFile").load(path).select(decoded(F.col("content")).alias("t"))
    lines = text.select(F.posexplode(F.split("t", r"\r\n|\n|\r")).alias("k", "line")).filter("k > 0 and line <> ''")
    return lines.select(F.from_csv("line", F.lit(schema)).alias("r")).select("r.*")


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def write_findings(df: DataFrame, folder: str) -> None:
    """Findings as parquet by task, so that what asks for one task reads no other."""
    df.write.mode("append").partitionBy("taskid").parquet(folder)
