"""Paths of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The suffixes of each language.
SUFFIXES = {
    "java": ("java", "jsp"),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp"),
    "python": ("py",),
    "javascript": ("js", "jsx", "ts", "vue"),
    "php": ("php",),
    "go": ("go",),
    "csharp": ("cs",),
    "ruby": ("rb",),
    "xml": ("xml",),
    "properties": ("properties",),
    "yaml": ("yml", "yaml"),
    "text": ("txt",),
}


def normal_path(path: Column) -> Column:
    """With slashes only, none doubled."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(normal_path(path), "/"), -1)


def suffix_of(path: Column) -> Column:
    """The suffix in lower case, "" if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def language_of(path: Column) -> Column:
    """The language that a file's suffix means, null for others."""
    out = F.when(F.lit(False), F.lit(""))
    for language, suffixes in SUFFIXES.items():
        out = out.when(suffix_of(path).isin(*suffixes), F.lit(language))
    return out


def common_folder(df: DataFrame, keys: list[str], path: str, name: str = "folder") -> DataFrame:
    """The longest folder that all paths of a group have in common, "" if none; null paths don't count.

    What the least and the greatest list of parts have in common, all lists between them have too, so
    that two partial aggregates are enough for any number of paths.
    """
    parts = F.slice(F.split(normal_path(F.col(path)), "/"), 1, F.greatest(F.size(F.split(normal_path(F.col(path)), "/")) - 1, F.lit(0)))
    ends = df.filter(F.col(path).isNotNull()).groupBy(*keys).agg(F.min(parts).alias("least"), F.max(parts).alias("most"))
    n = F.least(F.size("least"), F.size("most"))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
        lambda acc, i: F.struct(F.when(acc["on"] & (i <= n) & (F.get(F.col("least"), i - 1) == F.get(F.col("most"), i - 1)), i).otherwise(acc["k"]).alias("k"), (acc["on"] & (i <= n) & F.coalesce(F.get(F.col("least"), i - 1) == F.get(F.col("most"), i - 1), F.lit(False))).alias("on")),
        lambda acc: acc["k"],
    )
    return ends.select(*keys, F.array_join(F.slice("least", 1, same), "/").alias(name))
