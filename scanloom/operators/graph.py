"""Import graphs and graphs of code properties, as tables of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.plans.lineage import cut


def clean_edges(edges: DataFrame, source: str = "source_file", target: str = "imported_file", keys: tuple[str, ...] = ("taskid",)) -> DataFrame:
    """Edges once each, without those from a file to itself or to all files of a folder."""
    return edges.select(*keys, source, target).dropna().filter((F.col(source) != F.col(target)) & ~F.col(target).endswith("*")).distinct()


def importers(edges: DataFrame, name: str, source: str = "source_file", target: str = "imported_file") -> DataFrame:
    """The files that import one whose path ends with name, or the folder that holds it."""
    folder = name.rsplit("/", 1)[0] + "/*" if "/" in name else "*"
    return edges.filter(F.col(target).endswith(name)).unionByName(edges.filter(F.col(target) == folder)).select(source).distinct()


def reach(edges: DataFrame, depth: int, source: str = "source_file", target: str = "imported_file", keys: tuple[str, ...] = ("taskid",)) -> DataFrame:
    """(keys, source, target, depth): all files reached in at most `depth` steps, by the fewest; never the file itself.

    Each step joins only what the last step found anew, so cycles end and no pair is walked twice.
    """
    step = cut(clean_edges(edges, source, target, keys))
    known = step.withColumn("depth", F.lit(1))
    last = known
    for d in range(2, depth + 1):
        on = [*keys, "via"]
        further = last.select(*keys, source, F.col(target).alias("via")).join(step.select(*keys, F.col(source).alias("via"), target), on).filter(F.col(source) != F.col(target)).select(*keys, source, target).distinct()
        last = cut(further.join(known, [*keys, source, target], "left_anti").withColumn("depth", F.lit(d)))
        known = known.unionByName(last)
    return known


def imports_of(code: Column) -> Column:
    """The modules that a text of code imports or includes, in any of the common languages."""
    pattern = r"""(?m)^\s*(?:import\s+(?:static\s+)?([\w.*]+)\s*;|from\s+([\w.]+)\s+import\b|#include\s*[<"]([^>"]+)[>"]|(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]|import\s+.*?from\s+['"]([^'"]+)['"])"""
    found = [F.regexp_extract_all(code, F.lit(pattern), F.lit(k)) for k in range(1, 6)]
    return F.array_distinct(F.filter(F.flatten(F.array(*found)), lambda x: F.length(x) > 0))


def resolved_imports(imports: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("taskid",)) -> DataFrame:
    """(keys, path, module, target, how) of imports (keys, path, module): the file of files (keys, path) that a module means.

    First the file whose path, without its suffix, ends with the module's parts; else one of that name in the same folder; else
    one of that name anywhere. Of equals the first by path; a file doesn't import itself. "a.b.*" is the folder a/b,
    and all its files are targets. Modules and files meet by their last part, a key, so that no pair is tried in vain.
    """
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    f = files.select(*keys, F.col("path").alias("target"), stem.alias("stem"), F.element_at(F.split(stem, "/"), -1).alias("name"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
    dots = F.when(F.col("module").contains("/"), F.regexp_replace("module", r"\.[A-Za-z]+$", "")).otherwise(F.translate(F.regexp_replace("module", r"\.(?:h|hpp)$", ""), ".", "/"))
    m = imports.select(*keys, "path", "module", dots.alias("parts")).distinct()
    single = m.filter(~F.col("module").endswith("*")).withColumn("name", F.element_at(F.split("parts", "/"), -1))
    met = single.join(f, [*keys, "name"]).filter(F.col("target") != F.col("path"))
    ends = F.concat(F.lit("/"), F.col("stem")).endswith(F.concat(F.lit("/"), F.col("parts")))
    how = F.when(ends & F.col("parts").contains("/"), 1).when(F.col("folder") == F.regexp_extract("path", r"^(.*)/[^/]*$", 1), 2).otherwise(3)
    best = met.withColumn("how", how).groupBy(*keys, "path", "module").agg(F.min(F.struct("how", "target")).alias("best"))
    one = best.select(*keys, "path", "module", F.col("best.target").alias("target"), F.col("best.how").alias("how"))
    last = F.element_at(F.split("folder", "/"), -1)
    wild = m.filter(F.col("module").endswith("*")).withColumn("parts", F.regexp_replace("parts", r"/\*$", "")).withColumn("name", F.element_at(F.split("parts", "/"), -1))
    every = wild.join(f.drop("name").withColumn("name", last), [*keys, "name"]).filter((F.col("target") != F.col("path")) & F.concat(F.lit("/"), F.col("folder")).endswith(F.concat(F.lit("/"), F.col("parts"))))
    return one.unionByName(every.select(*keys, "path", "module", "target", F.lit(0).alias("how")))


def kept_by_importers(found: DataFrame, edges: DataFrame, code: DataFrame, function: str, keys: tuple[str, ...] = ("taskid",)) -> DataFrame:
    """Rows of found (keys, path, function) unless files import their path and none of those mentions the function.

    edges: (keys, source_file, imported_file); code: (keys, path, content). A row without a function, or whose path nobody
    imports, is kept, and so is one of whose importers no code is known.
    """
    asked = found.select(*keys, "path", function).dropna().distinct()
    importers_of = clean_edges(edges, keys=keys).select(*keys, F.col("imported_file").alias("path"), F.col("source_file").alias("importer"))
    texts = code.filter(F.col("content").isNotNull()).select(*keys, F.col("path").alias("importer"), "content")
    told = asked.join(importers_of, [*keys, "path"]).join(texts, [*keys, "importer"])
    silent = told.groupBy(*keys, "path", function).agg(F.max(F.col("content").contains(F.col(function))).alias("said")).filter(~F.col("said"))
    return found.join(silent.drop("said"), [*keys, "path", function], "left_anti")


def neighbours(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst) within so many hops in either direction, once each, the node itself left out."""
    one = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    out = one
    last = one
    for _ in range(hops - 1):
        last = last.select("src", F.col("dst").alias("via")).join(one.select(F.col("src").alias("via"), "dst"), "via").filter("src <> dst").select("src", "dst").distinct()
        out = out.unionByName(last).distinct()
    return out


def unguarded(nodes: DataFrame, edges: DataFrame, subject: Column, guard: Column, hops: int = 2) -> DataFrame:
    """Nodes that meet `subject` and have no node that meets `guard` within `hops`: a cookie made and never made secure."""
    near = neighbours(edges, hops)
    guarded = near.join(nodes.filter(guard).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return nodes.filter(subject).join(guarded, "id", "left_anti")


def adjacent(nodes: DataFrame, edges: DataFrame, subject: Column, other: Column) -> DataFrame:
    """Nodes that meet `subject` and touch one that meets `other`."""
    near = neighbours(edges, 1).join(nodes.filter(other).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return nodes.filter(subject).join(near, "id", "left_semi")


def without_local(nodes: DataFrame, arguments: Column) -> DataFrame:
    """Identifiers that are arguments of a call and have no local of the same name in their file."""
    local = nodes.filter("label = 'LOCAL'").select("source_file", "name").distinct()
    return nodes.filter((F.col("label") == "IDENTIFIER") & arguments).join(local, ["source_file", "name"], "left_anti")
