"""Queries that clean, rank, compare and change tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import values as V
from scanloom.operators import changes, graph, paths, ranking
from scanloom.plans import sqltext
from scanloom.plans.broadcasts import broadcast_if_small
from scanloom.sources.tables import table


def findings_once(spark, d):
    """Findings delivered again count once: the row created first."""
    f = table(spark, d, "vulfile").select("id", "taskid", "fileid", "vultype", "createtime", "repair_status", "is_fp", "remarks")
    return ranking.keep_first(f, ["id"], [F.col("createtime").asc_nulls_last(), F.col("repair_status"), F.col("is_fp"), F.col("remarks")])


def best_of_place(spark, d):
    """Of the findings on one place of a file the one of the highest level; of those the one with the longest remark."""
    f = table(spark, d, "vulfile").filter("location is not null").select("id", "fileid", "location", "risk_level", "remarks")
    rank = F.when(V.level_code(F.col("risk_level")) == "high", 3).when(V.level_code(F.col("risk_level")) == "medium", 2).otherwise(1)
    return ranking.best_per_line(f, ["fileid", "location"], rank, "remarks", ["id", "remarks", "risk_level"]).select("fileid", "location", "id", "risk_level")


def places_spread(spark, d):
    """Each finding's place as a list of lines in one text, and how many they are."""
    f = table(spark, d, "vulfile").select("id", "location").distinct()
    return f.select("id", V.spread_range(F.col("location")).alias("line_list"), F.element_at(V.lines_of(F.col("location")), 1).alias("first_line"))


def scan_modes(spark, d):
    """Tasks by how they were scanned."""
    t = table(spark, d, "vuldetail").distinct()
    return t.groupBy(V.mode_of_scan(F.col("type")).alias("mode")).agg(F.count("*").alias("n_tasks"))


def durations(spark, d):
    """How long each task took, in seconds and as text."""
    t = table(spark, d, "vuldetail").distinct().filter("endtime is not null and starttime is not null")
    s = F.unix_timestamp(F.col("endtime").cast("timestamp")) - F.unix_timestamp(F.col("starttime").cast("timestamp"))
    return t.select("taskid", "itemid", s.alias("seconds"), V.duration_text(s).alias("took"))


def sizes_of_tasks(spark, d):
    """Lines and bytes of each task as numbers."""
    t = table(spark, d, "vuldetail").distinct()
    return t.select("taskid", "itemid", V.leading_number(F.col("code_size")).alias("n_lines"), V.size_in_bytes(F.col("file_size")).alias("n_bytes"))


def folders_of_tasks(spark, d):
    """The folder that all files of a task have in common."""
    f = table(spark, d, "vulfile").filter("taskid is not null")
    return paths.common_folder(f, ["taskid"], "filepath")


def languages_of_files(spark, d):
    """Files and findings by the language that the suffix means."""
    f = table(spark, d, "vulfile").filter("filename is not null")
    return f.groupBy(paths.language_of(F.col("filename")).alias("language")).agg(F.countDistinct("fileid").alias("n_files"), F.count("*").alias("n_findings"))


def file_statistics(spark, d):
    """Code of each task: files, lines and characters of what its findings hold."""
    f = table(spark, d, "vulfile").filter("taskid is not null and source_code is not null").select("taskid", "fileid", "source_code").distinct()
    n = f.groupBy("taskid").agg(F.countDistinct("fileid").alias("n_files"), F.sum(F.size(F.split("source_code", "\n"))).alias("n_lines"), F.sum(F.length("source_code")).alias("n_chars"))
    return n.withColumn("size", V.readable_size(F.col("n_chars")))


def complexity_of_tasks(spark, d):
    """Mean complexity of each task weighted by functions, and its greatest; NaN counts as null, none as 0."""
    f = table(spark, d, "vulfile").filter("taskid is not null").select("taskid", "id", "avgccn", "max_ccn", "function_count").distinct()
    ccn = F.when(~F.isnan("avgccn"), F.col("avgccn"))
    n = F.when(ccn.isNotNull(), F.col("function_count"))
    mean = F.try_divide(F.sum(ccn * n), F.sum(n))
    return f.groupBy("taskid").agg(F.coalesce(F.round(mean, 6), F.lit(0.0)).alias("mean_ccn"), F.max("max_ccn").alias("max_ccn"), F.sum("function_count").alias("n_functions"))


def near_median_place(spark, d):
    """Findings of a file within 50 lines of the median of its findings; all if none is."""
    f = table(spark, d, "vulfile").select("id", "fileid", F.element_at(V.lines_of(F.col("location")), 1).alias("line")).filter("line is not null").distinct()
    return ranking.near_median(f, ["fileid"], "line", 50)


def spaced_places(spark, d):
    """Findings of a file more than a line after the one before."""
    f = table(spark, d, "vulfile").select("fileid", F.element_at(V.lines_of(F.col("location")), 1).alias("line")).filter("line is not null and fileid is not null").distinct()
    return ranking.spaced(f, ["fileid"], "line", 1)


def after_deleting(spark, d):
    """Rows left of the three tables after projects without a language are deleted with all that hangs on them."""
    p, t, f = (table(spark, d, n) for n in ("itemdetail", "vuldetail", "vulfile"))
    doomed = p.filter("(language is null or trim(language) = '') and itemid is not null").select("itemid").distinct()
    left = changes.cascade(p, t, f, doomed)
    out = None
    for name, x in zip(("projects", "tasks", "findings"), left):
        n = x.agg(F.lit(name).alias("what"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


def reviewed_levels(spark, d):
    """Findings with the level of their last review in place of their own."""
    f = table(spark, d, "vulfile").select("id", "taskid", "risk_level").distinct()
    a = table(spark, d, "audit_log").filter("new_value in ('高危', '中危', '低危') and fileid is not null")
    last = ranking.keep_first(a, ["fileid"], [F.desc("update_time"), F.col("new_value")]).select(F.col("fileid").alias("id"), F.col("new_value").alias("risk_level"))
    return changes.updated(f, last, ["id"])


def real_changes(spark, d):
    """Reviews that changed something, null counting as a value."""
    a = table(spark, d, "audit_log").distinct()
    return a.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("taskid", "fileid", "old_value", "new_value", "update_time")


def imports_clean(spark, d):
    """Imports once each, without those of a file by itself or of a whole folder, by how often a file is imported."""
    e = graph.clean_edges(table(spark, d, "import_relation"))
    return e.groupBy("taskid", "imported_file").agg(F.count("*").alias("n_importers"))


def imports_reached(spark, d):
    """What each file reaches by imports in three steps, and in how many at least."""
    return graph.reach(table(spark, d, "import_relation"), 3)


def importers_of_pom(spark, d):
    """Files that import one named pom.xml."""
    return graph.importers(table(spark, d, "import_relation"), "pom.xml")


def events_by_hour(spark, d):
    """Events and their values in windows of an hour: the batch form of the stream."""
    from scanloom.streaming.events import hourly

    return hourly(table(spark, d, "events"))


def label_centres(spark, d):
    """How many vectors are nearest, by angle, to the centre of their own label, by label."""
    e = table(spark, d, "embeddings").filter("label is not null and embedding is not null")
    at = e.select("vec_id", "label", F.posexplode("embedding").alias("k", "x"))
    centre = at.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("c"))
    length = centre.groupBy("label").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("length"))
    unit = centre.join(length, "label").select(F.col("label").alias("guess"), "k", (F.col("c") / F.col("length")).alias("c"))
    score = at.join(broadcast_if_small(unit), "k").groupBy("vec_id", "label", "guess").agg(F.round(F.sum(F.col("x").cast("double") * F.col("c")), 9).alias("score"))
    best = ranking.keep_first(score, ["vec_id"], [F.desc("score"), F.col("guess")])
    return best.groupBy("label").agg(F.count("*").alias("n_vectors"), F.count_if(F.col("guess") == F.col("label")).alias("n_own"))


QUERIES = {f.__name__: f for f in (findings_once, best_of_place, places_spread, scan_modes, durations, sizes_of_tasks, folders_of_tasks, languages_of_files, file_statistics, complexity_of_tasks, near_median_place, spaced_places, after_deleting, reviewed_levels, real_changes, imports_clean, imports_reached, importers_of_pom, events_by_hour, label_centres)}

_T = "(SELECT DISTINCT * FROM vuldetail)"
_LEVEL = sqltext.level("risk_level")
_NUMBERS = "regexp_extract_all(location, '\\d+')"
_FIRST = f"{_NUMBERS}[1]::INT"

ORACLE_SQL = {
    "findings_once": "SELECT id, taskid, fileid, vultype, createtime, repair_status, is_fp, remarks FROM vulfile QUALIFY row_number() OVER (PARTITION BY id ORDER BY createtime NULLS LAST, repair_status NULLS FIRST, is_fp NULLS FIRST, remarks NULLS FIRST) = 1",
    "best_of_place": f"""
        SELECT fileid, location, id, risk_level FROM vulfile WHERE location IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY fileid, location ORDER BY CASE {_LEVEL} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, length(remarks) DESC NULLS LAST, id NULLS FIRST, remarks NULLS FIRST, risk_level NULLS FIRST) = 1""",
    "places_spread": f"""
        WITH a AS (SELECT DISTINCT id, location, {_NUMBERS} AS n FROM vulfile), b AS (SELECT id, location, n, list_min([x::INT FOR x IN n]) AS lo, list_max([x::INT FOR x IN n]) AS hi FROM a)
        SELECT id, CASE WHEN len(n) > 0 THEN array_to_string(range(lo, hi + 1), ', ') END AS line_list, n[1]::INT AS first_line FROM b""",
    "scan_modes": f"""
        WITH t AS (SELECT CASE WHEN type IS NULL THEN NULL ELSE regexp_extract_all(type, '[''"]([^''"]*)[''"]', 1) END AS l FROM {_T})
        SELECT CASE WHEN list_contains(l, 'r4') THEN 'thinking' WHEN l[2] = 'false' THEN 'fast' WHEN l IS NOT NULL THEN 'careful' END AS mode, count(*) AS n_tasks FROM t GROUP BY 1""",
    "durations": f"""
        WITH t AS (SELECT taskid, itemid, (epoch_us(endtime) // 1000000 - epoch_us(starttime) // 1000000)::BIGINT AS s FROM {_T} WHERE endtime IS NOT NULL AND starttime IS NOT NULL)
        SELECT taskid, itemid, s AS seconds, (s // 3600) || '时' || (s % 3600 // 60) || '分' || (s % 60) || '秒' AS took FROM t""",
    "sizes_of_tasks": f"""
        SELECT taskid, itemid, nullif(regexp_extract(trim(code_size), '^(\\d+)', 1), '')::BIGINT AS n_lines,
        round(nullif(regexp_extract(file_size, '^\\s*([0-9.]+)', 1), '')::DOUBLE * CASE upper(regexp_extract(file_size, '([KMGT]?B)\\s*$', 1)) WHEN 'KB' THEN 1024.0 WHEN 'MB' THEN 1048576.0 WHEN 'GB' THEN 1073741824.0 WHEN 'TB' THEN 1099511627776.0 ELSE 1 END)::BIGINT AS n_bytes FROM {_T}""",
    "folders_of_tasks": """
        WITH p AS (SELECT taskid, string_split(regexp_replace(replace(filepath, '\\', '/'), '/+', '/', 'g'), '/') AS a FROM vulfile WHERE taskid IS NOT NULL AND filepath IS NOT NULL),
        q AS (SELECT taskid, a[1:len(a) - 1] AS a FROM p), s AS (SELECT taskid, array_to_string(a[1:k], '/') AS f, k FROM q, range(0, 40) t(k) WHERE k <= len(a)),
        n AS (SELECT taskid, count(*) AS n FROM q GROUP BY 1), c AS (SELECT taskid, f, k, count(*) AS c FROM s GROUP BY 1, 2, 3)
        SELECT taskid, max_by(f, k) AS folder FROM c JOIN n USING (taskid) WHERE c = n GROUP BY 1""",
    "languages_of_files": f"SELECT {sqltext.language('filename')} AS language, count(DISTINCT fileid) AS n_files, count(*) AS n_findings FROM vulfile WHERE filename IS NOT NULL GROUP BY 1",
    "file_statistics": """
        WITH n AS (SELECT taskid, count(DISTINCT fileid) AS n_files, sum(length(source_code) - length(replace(source_code, chr(10), '')) + 1)::BIGINT AS n_lines, sum(length(source_code))::BIGINT AS n_chars FROM (SELECT DISTINCT taskid, fileid, source_code FROM vulfile WHERE taskid IS NOT NULL AND source_code IS NOT NULL) GROUP BY 1)
        SELECT *, CASE WHEN n_chars < 1024 THEN round(n_chars::DOUBLE, 1) || ' B' WHEN n_chars < 1048576 THEN round(n_chars / 1024.0, 1) || ' KB' WHEN n_chars < 1073741824 THEN round(n_chars / 1048576.0, 1) || ' MB' ELSE round(n_chars / 1073741824.0, 1) || ' GB' END AS size FROM n""",
    "complexity_of_tasks": """
        WITH f AS (SELECT DISTINCT taskid, id, CASE WHEN isnan(avgccn) THEN NULL ELSE avgccn END AS c, max_ccn, function_count AS n FROM vulfile WHERE taskid IS NOT NULL)
        SELECT taskid, coalesce(round(sum(c * n) / nullif(sum(n) FILTER (c IS NOT NULL), 0), 6), 0) AS mean_ccn, max(max_ccn) AS max_ccn, sum(n)::BIGINT AS n_functions FROM f GROUP BY 1""",
    "near_median_place": f"""
        WITH f AS (SELECT DISTINCT id, fileid, {_FIRST} AS line FROM vulfile WHERE len({_NUMBERS}) > 0), m AS (SELECT *, abs(line - quantile_cont(line, 0.5) OVER (PARTITION BY fileid)) <= 50 AS h FROM f)
        SELECT id, fileid, line FROM m QUALIFY h OR NOT bool_or(h) OVER (PARTITION BY fileid)""",
    "spaced_places": f"""
        WITH f AS (SELECT DISTINCT fileid, {_FIRST} AS line FROM vulfile WHERE len({_NUMBERS}) > 0 AND fileid IS NOT NULL), l AS (SELECT *, lag(line) OVER (PARTITION BY fileid ORDER BY line) AS b FROM f)
        SELECT fileid, line FROM l WHERE b IS NULL OR line - b > 1""",
    "after_deleting": """
        WITH d AS (SELECT DISTINCT itemid FROM itemdetail WHERE (language IS NULL OR trim(language) = '') AND itemid IS NOT NULL), t AS (SELECT taskid FROM vuldetail WHERE itemid IN (SELECT itemid FROM d))
        SELECT 'projects' AS what, count(*) AS n_rows FROM itemdetail WHERE itemid IS NULL OR itemid NOT IN (SELECT itemid FROM d)
        UNION ALL SELECT 'tasks', count(*) FROM vuldetail WHERE itemid IS NULL OR itemid NOT IN (SELECT itemid FROM d)
        UNION ALL SELECT 'findings', count(*) FROM vulfile f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.taskid = f.taskid)""",
    "reviewed_levels": """
        WITH l AS (SELECT fileid AS id, new_value FROM audit_log WHERE new_value IN ('高危', '中危', '低危') AND fileid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fileid ORDER BY update_time DESC NULLS LAST, new_value NULLS FIRST) = 1)
        SELECT f.id, f.taskid, coalesce(l.new_value, f.risk_level) AS risk_level FROM (SELECT DISTINCT id, taskid, risk_level FROM vulfile) f LEFT JOIN l ON f.id = l.id""",
    "real_changes": "SELECT DISTINCT taskid, fileid, old_value, new_value, update_time FROM (SELECT DISTINCT * FROM audit_log) WHERE old_value IS DISTINCT FROM new_value",
    "imports_clean": "SELECT taskid, imported_file, count(DISTINCT source_file) AS n_importers FROM import_relation WHERE taskid IS NOT NULL AND source_file <> imported_file AND NOT suffix(imported_file, '*') GROUP BY 1, 2",
    "imports_reached": """
        WITH RECURSIVE e AS (SELECT DISTINCT taskid, source_file, imported_file FROM import_relation WHERE taskid IS NOT NULL AND source_file <> imported_file AND NOT suffix(imported_file, '*')),
        r AS (SELECT *, 1 AS depth FROM e UNION SELECT r.taskid, r.source_file, e.imported_file, depth + 1 FROM r JOIN e ON r.taskid = e.taskid AND r.imported_file = e.source_file WHERE depth < 3)
        SELECT taskid, source_file, imported_file, min(depth)::INT AS depth FROM r WHERE source_file <> imported_file GROUP BY 1, 2, 3""",
    "importers_of_pom": "SELECT DISTINCT source_file FROM import_relation WHERE suffix(imported_file, 'pom.xml') OR imported_file = '*'",
    "events_by_hour": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events, round(sum(value), 6) AS sum_value FROM events GROUP BY 1, 2",
    "label_centres": """
        WITH a AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL),
        c AS (SELECT label, k, avg(x) AS c FROM a GROUP BY 1, 2), u AS (SELECT label AS guess, k, c / sqrt(sum(c * c) OVER (PARTITION BY label)) AS c FROM c),
        s AS (SELECT vec_id, label, guess, round(sum(x * c), 9) AS score FROM a JOIN u USING (k) GROUP BY 1, 2, 3),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, guess) = 1)
        SELECT label, count(*) AS n_vectors, count(*) FILTER (guess = label) AS n_own FROM b GROUP BY 1""",
}
