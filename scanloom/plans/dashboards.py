"""Queries behind overviews, lists and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import values as V
from scanloom.operators import filters, ranking
from scanloom.plans import sqltext
from scanloom.sources.tables import table


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks once each."""
    return table(spark, d, "vuldetail").distinct()


def _projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "itemdetail").distinct()


def top_kinds(spark, d):
    """The ten kinds of finding that occur most; equal counts in the order of their names."""
    rows = table(spark, d, "vulfile").filter(F.col("vultype").isNotNull())
    return rows.groupBy("vultype").agg(F.count("*").alias("n_findings")).orderBy(F.desc("n_findings"), "vultype").limit(10)


def top_kinds_of_year(spark, d):
    """The same of one year of tasks, the year as a range that reaches the scan."""
    tasks = _tasks(spark, d).filter(filters.in_year("starttime", 2023)).select("taskid")
    rows = table(spark, d, "vulfile").filter(F.col("vultype").isNotNull()).join(tasks, "taskid", "left_semi")
    return rows.groupBy("vultype").agg(F.count("*").alias("n_findings")).orderBy(F.desc("n_findings"), "vultype").limit(10)


def totals(spark, d):
    """One row of totals over all tasks."""
    t = _tasks(spark, d)
    risk = F.col("high_risk") + F.col("med_risk") + F.col("low_risk")
    return t.agg(
        F.count("*").alias("n_tasks"),
        F.coalesce(F.sum(V.leading_number(F.col("code_size"))), F.lit(0)).alias("n_lines"),
        F.coalesce(F.sum(risk), F.lit(0)).alias("n_findings"),
        F.count_if(F.col("endtime").isNotNull()).alias("n_done"),
        F.count_if(F.col("review_status") == "已审核").alias("n_reviewed"),
        F.max("ccn").alias("max_ccn"),
    )


def tasks_by_month(spark, d):
    """Tasks and their findings by month of start."""
    t = _tasks(spark, d).filter(F.col("starttime").isNotNull())
    risk = F.coalesce("high_risk", F.lit(0)) + F.coalesce("med_risk", F.lit(0)) + F.coalesce("low_risk", F.lit(0))
    return t.groupBy(F.year("starttime").alias("year"), F.month("starttime").alias("month")).agg(F.count("*").alias("n_tasks"), F.sum(risk).alias("n_findings"))


def levels_by_year(spark, d):
    """Findings by year and level, spellings put together, unknown levels as high."""
    f = table(spark, d, "vulfile").filter(F.col("createtime").isNotNull())
    return f.groupBy(F.year("createtime").alias("year"), V.level_code(F.col("risk_level")).alias("level")).agg(F.count("*").alias("n_findings"))


def yearly_series(spark, d):
    """Projects, tasks, findings and reviews by year, 0 where there are none."""
    parts = {
        "n_projects": _projects(spark, d).select(F.year("createtime").alias("year")),
        "n_tasks": _tasks(spark, d).select(F.year("starttime").alias("year")),
        "n_findings": table(spark, d, "vulfile").select(F.year("createtime").alias("year")),
        "n_reviews": table(spark, d, "audit_log").select(F.year("update_time").alias("year")),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.withColumn("what", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.filter(F.col("year").isNotNull()).groupBy("year").agg(*[F.count_if(F.col("what") == n).alias(n) for n in parts])


def project_page(spark, d):
    """The first page of projects with a text in their name, with the findings of their tasks."""
    p = _projects(spark, d).filter(filters.matching(contains={"itemname": "a", "url": "git"}))
    t = _tasks(spark, d).groupBy("itemid").agg(F.count("*").alias("n_tasks"), F.sum(F.col("high_risk") + F.col("med_risk") + F.col("low_risk")).alias("n_findings"))
    rows = p.join(t, "itemid", "left").select("itemid", "itemname", "language", "createtime", F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
    return filters.page(rows, [F.col("createtime").desc_nulls_last(), F.col("itemid"), F.col("itemname"), F.col("language")], 1, 10)


def task_page(spark, d):
    """The second page of tasks with their project, the newest first."""
    p = ranking.keep_first(_projects(spark, d).filter("itemid is not null"), ["itemid"], [F.col("itemname"), F.col("language"), F.col("createtime")])
    rows = _tasks(spark, d).join(p.select("itemid", "itemname"), "itemid", "left").select("taskid", "taskname", "itemname", "starttime", "high_risk")
    return filters.page(rows, [F.col("starttime").desc_nulls_last(), F.col("taskid"), F.col("taskname"), F.col("itemname")], 2, 10)


def finding_detail(spark, d):
    """Findings with their task, project and catalogue entry: a star of left joins."""
    c = ranking.keep_first(table(spark, d, "subvullist").select(F.trim("name_cn").alias("kind"), "name_en", "level"), ["kind"], [F.col("name_en"), F.col("level")])
    p = ranking.keep_first(_projects(spark, d).filter("itemid is not null"), ["itemid"], [F.col("itemname"), F.col("language"), F.col("createtime")])
    t = ranking.keep_first(_tasks(spark, d), ["taskid"], [F.col("itemid"), F.col("taskname")])
    f = table(spark, d, "vulfile").select("id", "taskid", F.trim("vultype").alias("kind"), "location")
    rows = f.join(t.select("taskid", "itemid", "taskname"), "taskid", "left").join(p.select("itemid", "itemname"), "itemid", "left").join(c, "kind", "left")
    return rows.select("id", "kind", "name_en", "level", "taskname", "itemname", "location")


def kinds_of_tasks(spark, d):
    """Findings of each task by kind, numbered within the task from the commonest kind on."""
    n = table(spark, d, "vulfile").filter("taskid is not null and vultype is not null").groupBy("taskid", F.trim("vultype").alias("kind")).agg(F.count("*").alias("n_findings"))
    return ranking.numbered(n, ["taskid"], [F.desc("n_findings"), F.col("kind")], "place")


def language_statistics(spark, d):
    """Findings by language of their project, spellings put together."""
    lang = F.lower(F.trim("language"))
    p = _projects(spark, d).filter("itemid is not null").groupBy("itemid").agg(F.min(F.when(lang != "", lang)).alias("language"))
    t = _tasks(spark, d).groupBy("taskid").agg(F.min("itemid").alias("itemid"))
    f = table(spark, d, "vulfile").groupBy("taskid").agg(F.count("*").alias("n"), F.countDistinct("fileid").alias("n_files"))
    rows = f.join(t, "taskid", "left").join(p, "itemid", "left")
    return rows.groupBy("language").agg(F.sum("n").alias("n_findings"), F.sum("n_files").alias("n_files"), F.count("*").alias("n_tasks"))


def review_page(spark, d):
    """A page of reviews of a span of time with what they are about: a left join on a key of two columns."""
    f = ranking.keep_first(table(spark, d, "vulfile").select("taskid", F.col("id").alias("fileid"), "vultype"), ["taskid", "fileid"], [F.col("vultype")])
    a = table(spark, d, "audit_log").distinct().filter(F.col("update_time").between(datetime(2023, 6, 1), datetime(2024, 6, 1)))
    rows = a.join(f, ["taskid", "fileid"], "left").select("taskid", "fileid", "old_value", "new_value", "vultype", "update_time")
    return filters.page(rows, [F.desc("update_time"), F.col("taskid"), F.col("fileid"), F.col("old_value"), F.col("new_value")], 1, 50)


def tasks_between(spark, d):
    """Tasks that started strictly between two days, as in a list for export."""
    t = _tasks(spark, d).filter(filters.strictly_between("starttime", datetime(2023, 3, 1), datetime(2023, 9, 1)))
    return t.select("taskid", "taskname", "starttime", (F.col("high_risk") + F.col("med_risk") + F.col("low_risk")).alias("n_findings"))


def levels_and_states(spark, d):
    """Findings of each level by state: false alarms, else fixed, else open."""
    f = table(spark, d, "vulfile")
    state = F.when(F.col("is_fp") == "1", "false_alarm").when(F.col("repair_status") == "已修复", "fixed").otherwise("open")
    rows = f.select(V.level_code(F.col("risk_level")).alias("level"), state.alias("state"))
    return rows.groupBy("level").pivot("state", ["false_alarm", "fixed", "open"]).count().na.fill(0)


def levels_of_tasks(spark, d):
    """Findings of each task by the level that the catalogue gives their kind, unknown as high."""
    c = table(spark, d, "subvullist").groupBy(F.trim("name_cn").alias("kind")).agg(F.max("level").alias("level"))
    f = table(spark, d, "vulfile").filter("taskid is not null").select("taskid", F.trim("vultype").alias("kind"))
    level = V.level_code(F.col("level"))
    return f.join(c, "kind", "left").groupBy("taskid").agg(*[F.count_if(level == x).alias(x) for x in ("high", "medium", "low")])


def all_reviewed(spark, d):
    """Whether every finding of a task is reviewed; so it is where there are none."""
    f = table(spark, d, "vulfile").groupBy("taskid").agg(F.every(F.col("is_question").isNotNull()).alias("all_of"), F.count("*").alias("n"))
    t = _tasks(spark, d).select("taskid").distinct()
    return t.join(f, "taskid", "left").select("taskid", F.coalesce("all_of", F.lit(True)).alias("all_reviewed"), F.coalesce("n", F.lit(0)).alias("n_findings"))


def kinds_nested(spark, d):
    """The files of each task and kind in one text: a nested list as reports show it."""
    f = table(spark, d, "vulfile").filter("taskid is not null and vultype is not null and filename is not null")
    return f.groupBy("taskid", "vultype").agg(F.array_join(F.array_sort(F.collect_set("filename")), ",").alias("files"), F.countDistinct("filename").alias("n_files"))


def creators_top_kinds(spark, d):
    """Each creator's tasks, findings and five commonest kinds."""
    p = _projects(spark, d).filter("itemid is not null and creator is not null").select("itemid", "creator").distinct()
    t = _tasks(spark, d).select("taskid", "itemid").distinct()
    f = table(spark, d, "vulfile").filter("vultype is not null").select("taskid", F.trim("vultype").alias("kind"))
    n = p.join(t, "itemid").join(f, "taskid").groupBy("creator", "kind").agg(F.count("*").alias("n"))
    placed = ranking.numbered(n, ["creator"], [F.desc("n"), F.col("kind")], "place")
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "kind")))), lambda x: x["kind"]), ",")
    return placed.groupBy("creator").agg(F.sum("n").alias("n_findings"), top.alias("top_kinds"))


def kinds_not_listed(spark, d):
    """Kinds that occur and aren't in the catalogue, and entries that never occur: a difference both ways."""
    from scanloom.operators.changes import sync

    now = table(spark, d, "vulfile").select(F.trim("vultype").alias("kind")).filter("kind <> ''").distinct()
    listed = table(spark, d, "subvullist").select(F.trim("name_cn").alias("kind")).filter("kind <> ''").distinct()
    extra, unused = sync(now, listed, ["kind"])
    return extra.withColumn("side", F.lit("not listed")).unionByName(unused.withColumn("side", F.lit("unused")))


_T = "(SELECT DISTINCT * FROM vuldetail)"
_P = "(SELECT DISTINCT * FROM itemdetail)"


_level = sqltext.level

QUERIES = {f.__name__: f for f in (top_kinds, top_kinds_of_year, totals, tasks_by_month, levels_by_year, yearly_series, project_page, task_page, finding_detail, kinds_of_tasks, language_statistics, review_page, tasks_between, levels_and_states, levels_of_tasks, all_reviewed, kinds_nested, creators_top_kinds, kinds_not_listed)}

ORACLE_SQL = {
    "top_kinds": "SELECT vultype, count(*) AS n_findings FROM vulfile WHERE vultype IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "top_kinds_of_year": "SELECT vultype, count(*) AS n_findings FROM vulfile WHERE vultype IS NOT NULL AND taskid IN (SELECT taskid FROM vuldetail WHERE year(starttime) = 2023) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "totals": f"SELECT count(*) AS n_tasks, coalesce(sum(nullif(regexp_extract(trim(code_size), '^(\\d+)', 1), '')::BIGINT), 0)::BIGINT AS n_lines, coalesce(sum(high_risk + med_risk + low_risk), 0)::BIGINT AS n_findings, count(endtime) AS n_done, count(*) FILTER (review_status = '已审核') AS n_reviewed, max(ccn) AS max_ccn FROM {_T}",
    "tasks_by_month": f"SELECT year(starttime)::INT AS year, month(starttime)::INT AS month, count(*) AS n_tasks, sum(coalesce(high_risk, 0) + coalesce(med_risk, 0) + coalesce(low_risk, 0))::BIGINT AS n_findings FROM {_T} WHERE starttime IS NOT NULL GROUP BY 1, 2",
    "levels_by_year": f"SELECT year(createtime)::INT AS year, {_level('risk_level')} AS level, count(*) AS n_findings FROM vulfile WHERE createtime IS NOT NULL GROUP BY 1, 2",
    "yearly_series": f"""
        WITH a AS (
            SELECT year(createtime) AS y, 1 AS k FROM {_P} UNION ALL SELECT year(starttime), 2 FROM {_T}
            UNION ALL SELECT year(createtime), 3 FROM vulfile UNION ALL SELECT year(update_time), 4 FROM audit_log)
        SELECT y::INT AS year, count(*) FILTER (k = 1) AS n_projects, count(*) FILTER (k = 2) AS n_tasks, count(*) FILTER (k = 3) AS n_findings, count(*) FILTER (k = 4) AS n_reviews FROM a WHERE y IS NOT NULL GROUP BY 1""",
    "project_page": f"""
        WITH t AS (SELECT itemid, count(*) AS n, sum(high_risk + med_risk + low_risk) AS f FROM {_T} GROUP BY 1)
        SELECT p.itemid, itemname, language, createtime, coalesce(n, 0) AS n_tasks, coalesce(f, 0)::BIGINT AS n_findings
        FROM {_P} p LEFT JOIN t USING (itemid) WHERE contains(itemname, 'a') AND contains(url, 'git')
        ORDER BY createtime DESC NULLS LAST, itemid NULLS FIRST, itemname NULLS FIRST, language NULLS FIRST LIMIT 10""",
    "task_page": f"""
        WITH p AS (SELECT itemid, itemname FROM {_P} WHERE itemid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY itemid ORDER BY itemname NULLS FIRST, language NULLS FIRST, createtime NULLS FIRST) = 1)
        SELECT taskid, taskname, itemname, starttime, high_risk FROM {_T} t LEFT JOIN p USING (itemid)
        ORDER BY starttime DESC NULLS LAST, taskid NULLS FIRST, taskname NULLS FIRST, itemname NULLS FIRST LIMIT 10 OFFSET 10""",
    "finding_detail": f"""
        WITH c AS (SELECT trim(name_cn) AS kind, name_en, level FROM subvullist QUALIFY row_number() OVER (PARTITION BY trim(name_cn) ORDER BY name_en NULLS FIRST, level NULLS FIRST) = 1),
        p AS (SELECT itemid, itemname FROM {_P} WHERE itemid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY itemid ORDER BY itemname NULLS FIRST, language NULLS FIRST, createtime NULLS FIRST) = 1),
        t AS (SELECT taskid, itemid, taskname FROM {_T} QUALIFY row_number() OVER (PARTITION BY taskid ORDER BY itemid NULLS FIRST, taskname NULLS FIRST) = 1)
        SELECT f.id, trim(f.vultype) AS kind, c.name_en, c.level, t.taskname, p.itemname, f.location
        FROM vulfile f LEFT JOIN t ON f.taskid = t.taskid LEFT JOIN p ON t.itemid = p.itemid LEFT JOIN c ON trim(f.vultype) = c.kind""",
    "kinds_of_tasks": "SELECT taskid, kind, n_findings, row_number() OVER (PARTITION BY taskid ORDER BY n_findings DESC, kind)::INT AS place FROM (SELECT taskid, trim(vultype) AS kind, count(*) AS n_findings FROM vulfile WHERE taskid IS NOT NULL AND vultype IS NOT NULL GROUP BY 1, 2)",
    "language_statistics": f"""
        WITH p AS (SELECT itemid, min(nullif(lower(trim(language)), '')) AS language FROM {_P} WHERE itemid IS NOT NULL GROUP BY 1),
        t AS (SELECT taskid, min(itemid) AS itemid FROM {_T} GROUP BY 1),
        f AS (SELECT taskid, count(*) AS n, count(DISTINCT fileid) AS m FROM vulfile GROUP BY 1)
        SELECT language, sum(n)::BIGINT AS n_findings, sum(m)::BIGINT AS n_files, count(*) AS n_tasks FROM f LEFT JOIN t ON f.taskid = t.taskid LEFT JOIN p ON t.itemid = p.itemid GROUP BY 1""",
    "review_page": """
        WITH f AS (SELECT taskid, id AS fileid, vultype FROM vulfile QUALIFY row_number() OVER (PARTITION BY taskid, id ORDER BY vultype NULLS FIRST) = 1)
        SELECT a.taskid, a.fileid, old_value, new_value, vultype, update_time FROM (SELECT DISTINCT * FROM audit_log) a LEFT JOIN f ON a.taskid = f.taskid AND a.fileid = f.fileid
        WHERE update_time BETWEEN '2023-06-01' AND '2024-06-01' ORDER BY update_time DESC, a.taskid NULLS FIRST, a.fileid NULLS FIRST, old_value NULLS FIRST, new_value NULLS FIRST LIMIT 50""",
    "tasks_between": f"SELECT taskid, taskname, starttime, high_risk + med_risk + low_risk AS n_findings FROM {_T} WHERE starttime > '2023-03-01' AND starttime < '2023-09-01'",
    "levels_and_states": f"""
        SELECT {_level('risk_level')} AS level, count(*) FILTER (s = 1) AS false_alarm, count(*) FILTER (s = 2) AS fixed, count(*) FILTER (s = 3) AS open
        FROM (SELECT risk_level, CASE WHEN is_fp = '1' THEN 1 WHEN repair_status = '已修复' THEN 2 ELSE 3 END AS s FROM vulfile) GROUP BY 1""",
    "levels_of_tasks": f"""
        WITH c AS (SELECT trim(name_cn) AS kind, max(level) AS level FROM subvullist GROUP BY 1), r AS (SELECT taskid, {_level('level')} AS l FROM vulfile LEFT JOIN c ON trim(vultype) = kind WHERE taskid IS NOT NULL)
        SELECT taskid, count(*) FILTER (l = 'high') AS high, count(*) FILTER (l = 'medium') AS medium, count(*) FILTER (l = 'low') AS low FROM r GROUP BY 1""",
    "all_reviewed": "WITH f AS (SELECT taskid, bool_and(is_question IS NOT NULL) AS a, count(*) AS n FROM vulfile GROUP BY 1) SELECT t.taskid, coalesce(a, true) AS all_reviewed, coalesce(n, 0) AS n_findings FROM (SELECT DISTINCT taskid FROM vuldetail) t LEFT JOIN f USING (taskid)",
    "kinds_nested": "SELECT taskid, vultype, array_to_string(list_sort(list(DISTINCT filename)), ',') AS files, count(DISTINCT filename) AS n_files FROM vulfile WHERE taskid IS NOT NULL AND vultype IS NOT NULL AND filename IS NOT NULL GROUP BY 1, 2",
    "creators_top_kinds": f"""
        WITH n AS (SELECT creator, trim(vultype) AS kind, count(*) AS n FROM (SELECT DISTINCT itemid, creator FROM itemdetail WHERE itemid IS NOT NULL AND creator IS NOT NULL) p JOIN (SELECT DISTINCT taskid, itemid FROM vuldetail) t USING (itemid) JOIN vulfile f ON f.taskid = t.taskid WHERE vultype IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY n DESC, kind) AS place FROM n)
        SELECT creator, sum(n)::BIGINT AS n_findings, string_agg(kind, ',' ORDER BY place) FILTER (place <= 5) AS top_kinds FROM r GROUP BY 1""",
    "kinds_not_listed": """
        WITH a AS (SELECT DISTINCT trim(vultype) AS kind FROM vulfile WHERE trim(vultype) <> ''), b AS (SELECT DISTINCT trim(name_cn) AS kind FROM subvullist WHERE trim(name_cn) <> '')
        SELECT kind, 'not listed' AS side FROM a WHERE kind NOT IN (SELECT kind FROM b) UNION ALL SELECT kind, 'unused' FROM b WHERE kind NOT IN (SELECT kind FROM a)""",
}
