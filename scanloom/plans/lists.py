"""Queries behind filtered lists, rule policies, details and changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import scoring
from scanloom.functions import values as V
from scanloom.operators import changes, filters, graph, paths, ranking
from scanloom.plans import sqltext
from scanloom.sources.tables import table

# Tables that people keep and the data don't have, in small.
_SANITIZERS = [("escapeSql", "0", "java", 1), ("cleanPath", "1", "java", 1), ("quoteShell", "1", "all", 1), ("stripTags", "0", "php", 1), ("oldEscape", "0", "java", 0), ("checkUrl", "1", "java", 1)]
_SCOPES = [("cleanPath", 3), ("quoteShell", 4), ("checkUrl", 3), ("checkUrl", 4)]
_POLICIES = [(1, 0), (2, 1), (3, 0)]
_CHOSEN = [(1, 10), (2, 10), (2, 11), (2, 12), (3, 13), (2, 14)]
_RULES = [(10, "command", "python"), (11, "sql", "all"), (12, "xss", "php"), (13, "path", "python"), (14, "secret", "python")]
_NEW_IMPORTS = [(3, "src/new/a.java", "src/new/b.java"), (3, "src/new/a.java", "src/new/c.java"), (9, "src/new/d.java", "src/new/e.java")]
_CLONED = [(1, "CALL", "newCookie", "a"), (2, "CALL", "setSecure", "a"), (3, "IDENTIFIER", "x", "a"), (4, "LOCAL", "x", "a"), (5, "IDENTIFIER", "y", "a"), (6, "CALL", "newCookie", "b"), (7, "IDENTIFIER", "x", "b"), (8, "IDENTIFIER", "dbPassword", "b"), (9, "CALL", "assign", "b"), (10, "CALL", "assign", "b")]
_EDGES = [(1, 3), (3, 2), (6, 7), (8, 9), (7, 10)]


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vuldetail").distinct()


def _projects(spark: SparkSession, d: str) -> DataFrame:
    """One row of each project."""
    return ranking.keep_first(table(spark, d, "itemdetail").filter("itemid is not null"), ["itemid"], [F.col("itemname"), F.col("language"), F.col("createtime"), F.col("creator"), F.col("url")])


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """One entry of each name."""
    rows = table(spark, d, "subvullist").select(F.trim("name_cn").alias("kind"), "name_en", "level", "description", "repairplan")
    return ranking.keep_first(rows, ["kind"], [F.col("name_en"), F.col("level"), F.col("description"), F.col("repairplan")])


def tasks_filtered(spark, d):
    """A page of tasks by ten filters over the task and its project."""
    asked = filters.all_of(
        filters.matching(contains={"taskname": "-", "itemname": "e", "branch": "e", "version": "v", "url_git": "git", "statues": "检测", "type": "", "language": None}, equals={"review_status": "已审核"}),
        filters.strictly_between("starttime", datetime(2022, 1, 1), datetime(2025, 1, 1)),
        F.col("high_risk") >= 1,
    )
    rows = _tasks(spark, d).join(_projects(spark, d).select("itemid", "itemname", "language"), "itemid", "left").filter(asked)
    return filters.page(rows.select("taskid", "taskname", "itemname", "starttime", "high_risk"), [F.col("starttime").desc_nulls_last(), F.col("taskid"), F.col("taskname"), F.col("itemname"), F.col("high_risk")], 1, 20)


def statistics_filtered(spark, d):
    """Findings by kind and level under six filters over the finding, its task and its project."""
    t = ranking.keep_first(_tasks(spark, d), ["taskid"], [F.col("itemid"), F.col("taskname")]).select("taskid", "itemid", "taskname")
    f = table(spark, d, "vulfile").select("taskid", "vultype", "risk_level", "filename", "is_fp")
    rows = f.join(t, "taskid", "left").join(_projects(spark, d).select("itemid", "itemname", "creator"), "itemid", "left")
    asked = filters.matching(contains={"vultype": "注入", "filename": ".", "taskname": "-", "itemname": "e", "creator": "user"}, equals={"is_fp": "0"})
    return rows.filter(asked).groupBy(F.trim("vultype").alias("kind"), V.level_code(F.col("risk_level")).alias("level")).agg(F.count("*").alias("n_findings"))


def catalogue_matching(spark, d):
    """Entries of the catalogue with a text in their name, of one level."""
    return table(spark, d, "subvullist").filter(filters.matching(contains={"name_cn": "入"}, equals={"level": "高危"})).select("id", "name_cn", "name_en", "level")


def levels_of_years_like(spark, d):
    """Findings by year and level of the years that have a text in their number."""
    f = table(spark, d, "vulfile").filter(F.year("createtime").cast("string").contains("23"))
    return f.groupBy(F.year("createtime").alias("year"), V.level_code(F.col("risk_level")).alias("level")).agg(F.count("*").alias("n_findings"))


def sanitizers_in_scope(spark, d):
    """Cleaning functions that hold for each Java project: those for all, and those whose scope names the project; the project is
    part of the join's condition, so that functions without it stay."""
    s = spark.createDataFrame(_SANITIZERS, "name string, scope string, language string, status int").filter("status = 1 and language in ('java', 'all')").withColumn("scope", F.col("scope").cast("int"))
    of = spark.createDataFrame(_SCOPES, "of_name string, of_item int")
    out = None
    for item in (3, 4):
        rows = s.join(F.broadcast(of), (F.col("name") == F.col("of_name")) & (F.col("of_item") == item), "left").filter(filters.in_scope("scope", F.col("of_item").isNotNull()))
        rows = rows.select(F.lit(item).alias("itemid"), "name")
        out = rows if out is None else out.unionByName(rows)
    return _projects(spark, d).select("itemid", "itemname").join(F.broadcast(out), "itemid")


def rules_active(spark, d):
    """Findings of the kinds that rules of the active policy name, by rule: policy, choice and rule, for one language or all."""
    from scanloom.rules.registry import active_names

    names = active_names(spark.createDataFrame(_POLICIES, "policy_id int, status int"), spark.createDataFrame(_CHOSEN, "policy_id int, rule_id int"), spark.createDataFrame(_RULES, "rule_id int, name string, language string"), "python")
    return names.select("name", F.lit("python").alias("language"))


def places_filled(spark, d):
    """Findings with defaults in place of what is missing: places 0, the file itself as the source's."""
    f = table(spark, d, "vulfile").select("id", "src_location", "func_location", "src_filename", "filename").distinct()
    return filters.defaults(f, src_location="0", func_location="0", src_filename=F.col("filename"))


def kinds_real(spark, d):
    """Findings by kind without the label that means none."""
    return table(spark, d, "vulfile").filter(F.trim("vultype") != "无漏洞").groupBy(F.trim("vultype").alias("kind")).agg(F.count("*").alias("n_findings"))


def greatest_places(spark, d):
    """The greatest place of each task where it is one number; texts that aren't are passed over."""
    return table(spark, d, "vulfile").filter("taskid is not null").groupBy("taskid").agg(F.max(F.expr("try_cast(location as bigint)")).alias("greatest"))


def first_of_line_and_source(spark, d):
    """Of the findings of a file on one line and from one source the first."""
    f = table(spark, d, "vulfile").filter("fileid is not null and location is not null").select("id", "fileid", F.element_at(V.lines_of(F.col("location")), 1).alias("line"), "source").distinct()
    return ranking.keep_first(f, ["fileid", "line", "source"], [F.col("id")])


def kinds_in_order(spark, d):
    """Findings of each task as a nested list is read: groups of a kind, the most frequent first, numbered, and places within."""
    f = table(spark, d, "vulfile").filter("taskid is not null and vultype is not null").select("id", "taskid", F.trim("vultype").alias("kind")).distinct()
    n = f.groupBy("taskid", "kind").agg(F.count("*").alias("n"))
    groups = ranking.numbered(n, ["taskid"], [F.desc("n"), F.col("kind")], "group_no").select("taskid", "kind", "group_no")
    return ranking.numbered(f.join(groups, ["taskid", "kind"]), ["taskid", "kind"], [F.col("id")], "place")


def spaced_reports(spark, d):
    """Lines of each file's findings more than one line after the line reported last."""
    f = table(spark, d, "vulfile").select("fileid", F.element_at(V.lines_of(F.col("location")), 1).alias("line")).filter("line is not null and fileid is not null")
    return ranking.spaced_emitted(f, ["fileid"], "line")


def levels_in_order(spark, d):
    """The first findings by level, high before medium before low before the rest, then by id."""
    f = table(spark, d, "vulfile").select("id", V.level_code(F.col("risk_level"), "other").alias("level")).distinct()
    return f.orderBy(filters.rank_in(F.col("level"), ("high", "medium", "low")), "id", "level").limit(200)


def findings_by_line(spark, d):
    """Findings of each file in the order of their first line, numbered."""
    f = table(spark, d, "vulfile").filter("fileid is not null").select("id", "fileid", F.element_at(V.lines_of(F.col("location")), 1).alias("line")).distinct()
    return ranking.numbered(f, ["fileid"], [F.col("line").asc_nulls_last(), F.col("id")], "place")


def remarks_plain(spark, d):
    """Remarks with ASCII punctuation in place of full-width."""
    return table(spark, d, "vulfile").filter("interpretation is not null").select("id", V.ascii_punctuation(F.col("interpretation")).alias("interpretation")).distinct()


def code_bare(spark, d):
    """Characters of code by language without comments, imports and blank lines."""
    f = table(spark, d, "vulfile").filter("source_code is not null and filename is not null").select(paths.language_of(F.col("filename")).alias("language"), "id", "source_code").distinct()
    rows = f.filter(F.col("language").isin("java", "c", "cpp", "javascript")).withColumn("bare", V.without_comments(F.col("source_code")))
    return rows.groupBy("language").agg(F.sum(F.length("bare")).alias("n_chars"), F.count_if(F.col("bare") == "").alias("n_empty"))


def words_in_order(spark, d):
    """Texts of code in which words come one after the other, by language."""
    f = table(spark, d, "vulfile").filter("source_code is not null and filename is not null").select(paths.language_of(F.col("filename")).alias("language"), "id", "source_code").distinct()
    return f.filter(V.in_order(F.col("source_code"), ["(", "return", ")"])).groupBy("language").agg(F.count("*").alias("n"))


def weaknesses_of_rules(spark, d):
    """Rules by weakness: its number, of two digits with a leading zero, and its name."""
    from scanloom.rules.catalogue import RULES

    r = spark.createDataFrame([(x.rule_id, x.cwe.removeprefix("CWE-")) for x in RULES], "rule_id string, number string")
    return r.groupBy("number").agg(F.count("*").alias("n_rules")).select(V.padded_cwe(F.col("number")).alias("cwe"), V.weakness_name(V.padded_cwe(F.col("number"))).alias("name"), F.lit(True).alias("known")).filter("name is not null")


def places_repeated(spark, d):
    """Kinds found more than once on one place of a file of a task, copies of a finding aside."""
    f = table(spark, d, "vulfile").filter("taskid is not null and location is not null").select("id", "taskid", "fileid", "location", F.trim("vultype").alias("kind")).distinct()
    return f.groupBy("taskid", "fileid", "location", "kind").agg(F.count("*").alias("n")).filter("n > 1")


def overview_blocks(spark, d):
    """Each task as a block of names and values for a report."""
    t = ranking.keep_first(_tasks(spark, d), ["taskid"], [F.col("itemid"), F.col("taskname")]).join(_projects(spark, d).select("itemid", "itemname"), "itemid", "left")
    n = table(spark, d, "vulfile").groupBy("taskid").agg(F.countDistinct("id").alias("n"))
    rows = t.join(n, "taskid", "left").select(
        "taskid", F.coalesce("itemname", F.lit("")).alias("project"), F.coalesce(V.mode_of_scan(F.col("type")), F.lit("")).alias("mode"),
        F.coalesce(V.leading_number(F.col("code_size")), F.lit(0)).cast("string").alias("lines"), F.coalesce("n", F.lit(0)).cast("string").alias("findings"),
    )
    return rows.unpivot(["taskid"], ["project", "mode", "lines", "findings"], "what", "value")


def details_with_plan(spark, d):
    """Findings with the description and the plan of repair of their kind, "" where there is none."""
    f = table(spark, d, "vulfile").filter("vultype is not null").select("id", "taskid", F.trim("vultype").alias("kind")).distinct()
    rows = f.join(_catalogue(spark, d).select("kind", "level", "description", "repairplan"), "kind", "left")
    return rows.select("id", "taskid", "kind", V.level_code(F.col("level")).alias("level"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("repairplan", F.lit("")).alias("plan"))


def project_counts(spark, d):
    """Six counts over all projects, tasks and findings in one row."""
    p = table(spark, d, "itemdetail").filter("itemid is not null").select("itemid").distinct().withColumn("what", F.lit("projects"))
    t = _tasks(spark, d).select("itemid", F.when(F.col("endtime").isNotNull(), "done").otherwise("open").alias("what"))
    f = table(spark, d, "vulfile").select(F.lit(None).cast("int").alias("itemid"), F.when(F.col("repair_status") == "已修复", "fixed").when(F.col("is_fp") == "1", "false_alarm").otherwise("left").alias("what"))
    rows = p.unionByName(t).unionByName(f)
    return rows.agg(*[F.count_if(F.col("what") == w).alias(f"n_{w}") for w in ("projects", "done", "open", "fixed", "false_alarm", "left")])


def one_active(spark, d):
    """The catalogue with one entry active and all others not."""
    return changes.activated(table(spark, d, "subvullist").select("id", "name_en"), F.col("id") == 7, "active")


def imports_replaced(spark, d):
    """Imports of each task after those of some were replaced as a whole."""
    new = spark.createDataFrame(_NEW_IMPORTS, "taskid int, source_file string, imported_file string")
    rows = changes.children_replaced(table(spark, d, "import_relation"), F.broadcast(new), "taskid")
    return rows.groupBy("taskid").agg(F.count("*").alias("n_imports"))


def changes_logged(spark, d):
    """What the log of changes gets when the levels of last reviews are put into the findings: only real changes."""
    f = table(spark, d, "vulfile").filter("id is not null").select("id", "risk_level").distinct()
    a = table(spark, d, "audit_log").filter("new_value in ('高危', '中危', '低危') and fileid is not null")
    last = ranking.keep_first(a, ["fileid"], [F.desc("update_time"), F.col("new_value")]).select(F.col("fileid").alias("id"), F.col("new_value").alias("risk_level"))
    return changes.change_log(f, last, ["id"], "risk_level")


def notices_page(spark, d):
    """The newest reviews as notices, those before a time read already."""
    a = table(spark, d, "audit_log").distinct().select("taskid", "fileid", "new_value", "update_time", (F.col("update_time") < F.lit(datetime(2024, 1, 1))).alias("is_read"))
    return filters.page(a, [F.col("update_time").desc_nulls_last(), F.col("taskid"), F.col("fileid"), F.col("new_value")], 1, 30)


def _paths_of_code(spark: SparkSession, d: str) -> DataFrame:
    """(taskid, path, content) of the code of each task's files."""
    return table(spark, d, "vulfile").filter("taskid is not null and filepath is not null").select("taskid", paths.normal_path(F.col("filepath")).alias("path"), F.col("source_code").alias("content")).distinct()


def kept_by_importers(spark, d):
    """Findings whose method some importer of their file mentions, or whose file nobody imports, by task."""
    f = table(spark, d, "vulfile").filter("filepath is not null").select("id", "taskid", paths.normal_path(F.col("filepath")).alias("path"), "enclosing_method").distinct()
    kept = graph.kept_by_importers(f, table(spark, d, "import_relation"), _paths_of_code(spark, d), "enclosing_method")
    return kept.groupBy("taskid").agg(F.count("*").alias("n_kept"))


def imports_resolved(spark, d):
    """The files that imports mean, those written in code and those recorded, by how they were found."""
    code = _paths_of_code(spark, d)
    said = code.filter(F.col("content").isNotNull()).select("taskid", "path", F.explode(graph.imports_of(F.col("content"))).alias("module"))
    kept = table(spark, d, "import_relation").select("taskid", F.col("source_file").alias("path"), F.col("imported_file").alias("module")).dropna()
    return graph.resolved_imports(said.unionByName(kept), code.select("taskid", "path")).select("taskid", "path", "module", "target", "how")


def imports_unguarded(spark, d):
    """Build files that have no header file within two imports in either direction."""
    e = graph.clean_edges(table(spark, d, "import_relation")).select(F.col("source_file").alias("src"), F.col("imported_file").alias("dst")).distinct()
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.unguarded(nodes, e, F.col("id").endswith(".xml"), F.col("id").endswith(".c"), 2)


def imports_adjacent(spark, d):
    """Build files that import a script or are imported by one."""
    e = graph.clean_edges(table(spark, d, "import_relation")).select(F.col("source_file").alias("src"), F.col("imported_file").alias("dst")).distinct()
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.adjacent(nodes, e, F.col("id").endswith(".xml"), F.col("id").endswith(".py"))


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame(_CLONED, "id int, label string, name string, source_file string")
    return nodes, spark.createDataFrame(_EDGES, "src int, dst int")


def cookies_unguarded(spark, d):
    """Of a small graph of code properties the cookies that nothing within two steps makes secure."""
    nodes, edges = _graph(spark)
    return graph.unguarded(nodes, edges, F.col("name") == "newCookie", F.col("name") == "setSecure", 2).select("id", "source_file")


def passwords_assigned(spark, d):
    """Of the same graph the assignments next to an identifier that is named a password."""
    nodes, edges = _graph(spark)
    return graph.adjacent(nodes, edges, F.col("name") == "assign", (F.col("label") == "IDENTIFIER") & F.lower("name").contains("password")).select("id", "source_file")


def arguments_without_local(spark, d):
    """Of the same graph the identifiers given to a call that no local of their file has the name of."""
    nodes, _ = _graph(spark)
    return graph.without_local(nodes, F.length("name") == 1).select("id", "name", "source_file")


def values_read(spark, d):
    """Texts of code that hold a given call, once each."""
    return table(spark, d, "vulfile").filter(F.col("source_code").contains("getParameter(")).select("id").distinct()


def _heads(k: int) -> dict:
    """Weights of k stand-in heads over vectors of 64 numbers: nothing is learnt here."""
    return {f"label_{j}": ([((j + 1) * (i + 3)) % 7 - 3.0 for i in range(64)], 0.05 * j - 0.1) for j in range(k)}


def vectors_labelled(spark, d):
    """The labels whose sigmoid is above a half for each vector, and how many vectors have each; one label means none."""
    e = table(spark, d, "embeddings").select("vec_id", F.explode_outer(scoring.labels(F.col("embedding"), _heads(5), none="label_4")).alias("label"))
    return e.groupBy("label").agg(F.count("*").alias("n_vectors"))


def vectors_classed(spark, d):
    """Each vector's class of two by the softmax, with its probability."""
    return table(spark, d, "embeddings").select("vec_id", scoring.best_of(F.col("embedding"), _heads(2)).alias("b")).select("vec_id", F.col("b.name").alias("name"), F.round("b.probability", 6).alias("probability"))


def scanned_in_cascade(spark, d):
    """Findings with a dangerous call, of the files alone that a scorer over their complexity lets through."""
    f = table(spark, d, "vulfile").filter("id is not null and fileid is not null")
    vector = F.array(F.coalesce(F.nanvl("avgccn", F.lit(0.0)), F.lit(0.0)), F.coalesce("max_ccn", F.lit(0)).cast("double"), F.coalesce("function_count", F.lit(0)).cast("double"))
    risky = f.filter(scoring.dot(vector, [0.2, 0.1, 0.05]) > 2.5).select("fileid").distinct()
    hit = f.filter(F.col("source_code").rlike(r"\bexec\(|executeQuery|sendRedirect|\bsystem\("))
    return hit.join(risky, "fileid", "left_semi").select("id").distinct()


def answers_parsed(spark, d):
    """The number within the JSON of each event, and events whose JSON can't be read."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("sum_k"), F.count_if(F.col("p.k").isNull()).alias("n_unread"))


def repositories_listed(spark, d):
    """The repositories of the projects' addresses by name, as from a list that people hand over."""
    from scanloom.sources.reports import repositories

    return repositories(table(spark, d, "itemdetail"), "url").select("url", "branch", "name")


def report_parsed(spark, d):
    """Findings read out of cells of text as a scanner's report has them."""
    from scanloom.sources.reports import scanner_findings

    f = table(spark, d, "vulfile").filter("sink is not null and enclosing_method is not null and source is not null").select("id", "sink", "enclosing_method", "source", "filename", "location").distinct()
    cells = f.select("id", F.format_string("%s:%s\nSink: %s\nEnclosing Method: %s\nSource: %s", "filename", F.element_at(V.lines_of(F.col("location")), 1).cast("string"), "sink", "enclosing_method", "source").alias("cell"))
    return scanner_findings(cells, "cell").drop("cell")


def logins_by_outcome(spark, d):
    """Events as logins, by hour and outcome."""
    from scanloom.sources.reports import login_outcome

    status = F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "error", "0").when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    e = table(spark, d, "events").select(F.date_trunc("day", "ts").alias("day"), login_outcome(status).alias("o"))
    return e.groupBy("day", F.col("o.level").alias("level"), F.col("o.outcome").alias("outcome")).agg(F.count("*").alias("n_logins"))


QUERIES = {
    f.__name__: f
    for f in (
        tasks_filtered, statistics_filtered, catalogue_matching, levels_of_years_like, sanitizers_in_scope, rules_active, places_filled, kinds_real, greatest_places, first_of_line_and_source,
        kinds_in_order, spaced_reports, levels_in_order, findings_by_line, remarks_plain, code_bare, words_in_order, weaknesses_of_rules, places_repeated, overview_blocks, details_with_plan,
        project_counts, one_active, imports_replaced, changes_logged, notices_page, kept_by_importers, imports_resolved, imports_unguarded, imports_adjacent, cookies_unguarded,
        passwords_assigned, arguments_without_local, values_read, vectors_labelled, vectors_classed, scanned_in_cascade, answers_parsed, repositories_listed, report_parsed, logins_by_outcome,
    )
}


def _values(rows: list[tuple], names: str) -> str:
    """Rows as a table in SQL."""
    text = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {text}) AS v({names})"


_T = "(SELECT DISTINCT * FROM vuldetail)"
_P = "(SELECT itemid, itemname, language, creator FROM (SELECT DISTINCT * FROM itemdetail) WHERE itemid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY itemid ORDER BY itemname NULLS FIRST, language NULLS FIRST, createtime NULLS FIRST, creator NULLS FIRST, url NULLS FIRST) = 1)"
_ONE_TASK = f"(SELECT taskid, itemid, taskname, type, code_size FROM {_T} QUALIFY row_number() OVER (PARTITION BY taskid ORDER BY itemid NULLS FIRST, taskname NULLS FIRST) = 1)"


_level = sqltext.level
_LINE = "CASE WHEN regexp_matches(location, '\\d') THEN regexp_extract(location, '\\d+')::INT END"
_LANGUAGE = sqltext.language("filename")
_PATH = "regexp_replace(replace(filepath, '\\', '/'), '/+', '/', 'g')"
_EDGES_CLEAN = "SELECT DISTINCT source_file AS src, imported_file AS dst FROM import_relation WHERE taskid IS NOT NULL AND source_file <> imported_file AND NOT suffix(imported_file, '*')"
_BOTH_WAYS = f"e AS ({_EDGES_CLEAN}), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_CODE = f"c AS (SELECT DISTINCT taskid, {_PATH} AS path, source_code AS content FROM vulfile WHERE taskid IS NOT NULL AND filepath IS NOT NULL)"


def _scores(k: int) -> str:
    """A row of vec_id, j and the score of each stand-in head, its weights worked out again."""
    return f"""SELECT vec_id, j, sum(x::DOUBLE * (((j + 1) * (i + 3)) % 7 - 3)) + 0.05 * j - 0.1 AS s
        FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), range({k}) r(j) GROUP BY 1, 2"""


ORACLE_SQL = {
    "repositories_listed": "SELECT DISTINCT trim(url) AS url, '' AS branch, regexp_replace(list_last(string_split(rtrim(trim(url), '/'), '/')), '\\.git$', '') AS name FROM itemdetail WHERE contains(lower(url), 'http') OR contains(lower(url), 'git')",
    "report_parsed": f"""
        SELECT DISTINCT id, filename AS file, {_LINE} AS line, trim(sink) AS sink, trim(enclosing_method) AS enclosing_method, trim(source) AS source FROM vulfile
        WHERE sink IS NOT NULL AND enclosing_method IS NOT NULL AND source IS NOT NULL AND regexp_matches(filename, '\\.(java|c|cpp|py|php|cs|go|js|sql)$') AND regexp_matches(location, '\\d')""",
    "logins_by_outcome": """
        SELECT date_trunc('day', ts)::TIMESTAMP AS day, CASE event_type WHEN 'click' THEN 'info' WHEN 'view' THEN 'info' WHEN 'error' THEN 'warning' ELSE 'error' END AS level,
        CASE event_type WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'tried' ELSE 'unknown' END AS outcome, count(*) AS n_logins FROM events GROUP BY 1, 2, 3""",
    "tasks_filtered": f"""
        SELECT taskid, taskname, itemname, starttime, high_risk FROM {_T} t LEFT JOIN {_P} p USING (itemid)
        WHERE contains(taskname, '-') AND contains(itemname, 'e') AND contains(branch, 'e') AND contains(version, 'v') AND contains(url_git, 'git') AND contains(statues, '检测')
            AND review_status = '已审核' AND starttime > '2022-01-01' AND starttime < '2025-01-01' AND high_risk >= 1
        ORDER BY starttime DESC, taskid NULLS FIRST, taskname NULLS FIRST, itemname NULLS FIRST, high_risk NULLS FIRST LIMIT 20""",
    "statistics_filtered": f"""
        SELECT trim(vultype) AS kind, {_level("risk_level")} AS level, count(*) AS n_findings FROM vulfile f LEFT JOIN {_ONE_TASK} t ON f.taskid = t.taskid LEFT JOIN {_P} p ON t.itemid = p.itemid
        WHERE contains(vultype, '注入') AND contains(filename, '.') AND contains(taskname, '-') AND contains(itemname, 'e') AND contains(creator, 'user') AND is_fp = '0' GROUP BY 1, 2""",
    "catalogue_matching": "SELECT id, name_cn, name_en, level FROM subvullist WHERE contains(name_cn, '入') AND level = '高危'",
    "levels_of_years_like": f"SELECT year(createtime)::INT AS year, {_level('risk_level')} AS level, count(*) AS n_findings FROM vulfile WHERE year(createtime)::VARCHAR LIKE '%23%' GROUP BY 1, 2",
    "sanitizers_in_scope": f"""
        WITH s AS (SELECT * FROM {_values(_SANITIZERS, "name, scope, language, status")}), o AS (SELECT * FROM {_values(_SCOPES, "name, item")}), p AS (SELECT * FROM {_P} WHERE itemid IN (3, 4))
        SELECT p.itemid, p.itemname, s.name FROM p JOIN s ON s.status = 1 AND (s.language = 'java' OR s.language = 'all') LEFT JOIN o ON o.name = s.name AND o.item = p.itemid
        WHERE s.scope = '0' OR (s.scope = '1' AND o.item IS NOT NULL)""",
    "rules_active": f"SELECT DISTINCT r.name, 'python' AS language FROM {_values(_POLICIES, 'policy_id, status').replace(' v(', ' p(')} JOIN {_values(_CHOSEN, 'policy_id, rule_id').replace(' v(', ' c(')} USING (policy_id) JOIN {_values(_RULES, 'rule_id, name, language').replace(' v(', ' r(')} USING (rule_id) WHERE p.status = 1 AND (r.language = 'python' OR r.language = 'all')",
    "places_filled": "SELECT DISTINCT id, CASE WHEN src_location IS NULL OR src_location = '' THEN '0' ELSE src_location END AS src_location, CASE WHEN func_location IS NULL OR func_location = '' THEN '0' ELSE func_location END AS func_location, CASE WHEN src_filename IS NULL OR src_filename = '' THEN filename ELSE src_filename END AS src_filename, filename FROM vulfile",
    "kinds_real": "SELECT trim(vultype) AS kind, count(*) AS n_findings FROM vulfile WHERE vultype IS NOT NULL AND trim(vultype) NOT IN ('无漏洞') GROUP BY 1",
    "greatest_places": "SELECT taskid, max(TRY_CAST(location AS BIGINT)) AS greatest FROM vulfile WHERE taskid IS NOT NULL GROUP BY 1",
    "first_of_line_and_source": f"SELECT min(id) AS id, fileid, {_LINE} AS line, source FROM vulfile WHERE fileid IS NOT NULL AND location IS NOT NULL GROUP BY 2, 3, 4",
    "kinds_in_order": """
        WITH f AS (SELECT DISTINCT id, taskid, trim(vultype) AS kind FROM vulfile WHERE taskid IS NOT NULL AND vultype IS NOT NULL), n AS (SELECT taskid, kind, count(*) AS n FROM f GROUP BY 1, 2),
        g AS (SELECT taskid, kind, row_number() OVER (PARTITION BY taskid ORDER BY n DESC, kind)::INT AS group_no FROM n)
        SELECT id, taskid, kind, group_no, row_number() OVER (PARTITION BY taskid, kind ORDER BY id)::INT AS place FROM f JOIN g USING (taskid, kind)""",
    "spaced_reports": f"""
        WITH RECURSIVE f AS (SELECT DISTINCT fileid, {_LINE} AS line FROM vulfile WHERE fileid IS NOT NULL AND location IS NOT NULL), k AS (
            SELECT fileid, min(line) AS line FROM f WHERE line IS NOT NULL GROUP BY 1
            UNION ALL SELECT k.fileid, (SELECT min(f.line) FROM f WHERE f.fileid = k.fileid AND f.line > k.line + 1) FROM k WHERE k.line IS NOT NULL)
        SELECT fileid, line FROM k WHERE line IS NOT NULL""",
    "levels_in_order": f"WITH f AS (SELECT DISTINCT id, {_level('risk_level', 'other')} AS level FROM vulfile) SELECT id, level FROM f ORDER BY CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, id NULLS FIRST, level LIMIT 200",
    "findings_by_line": f"SELECT id, fileid, line, row_number() OVER (PARTITION BY fileid ORDER BY line NULLS LAST, id)::INT AS place FROM (SELECT DISTINCT id, fileid, {_LINE} AS line FROM vulfile WHERE fileid IS NOT NULL)",
    "remarks_plain": "SELECT DISTINCT id, translate(interpretation, '（），；：“”‘’！？【】《》。\\', '(),;:\"\"''''!?[]<>./') AS interpretation FROM vulfile WHERE interpretation IS NOT NULL",
    "code_bare": f"""
        WITH f AS (SELECT DISTINCT {_LANGUAGE} AS language, id, source_code FROM vulfile WHERE source_code IS NOT NULL AND filename IS NOT NULL),
        a AS (SELECT language, regexp_replace(regexp_replace(source_code, '(?s)/\\*.*?\\*/', '', 'g'), '//[^\\n]*', '', 'g') AS t FROM f WHERE language IN ('java', 'c', 'cpp', 'javascript')),
        b AS (SELECT language, regexp_replace(t, '(^|\\n)[ \\t\\r\\f]*(?:import|package|#include|using)\\b[^\\n]*', '\\1', 'g') AS t FROM a),
        c AS (SELECT language, regexp_replace(regexp_replace(t, '\\n\\s*\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM b)
        SELECT language, sum(length(t))::BIGINT AS n_chars, count(*) FILTER (t = '') AS n_empty FROM c GROUP BY 1""",
    "words_in_order": f"""
        WITH f AS (SELECT DISTINCT {_LANGUAGE} AS language, id, source_code AS t FROM vulfile WHERE source_code IS NOT NULL AND filename IS NOT NULL),
        a AS (SELECT language, t[strpos(t, '(') + 1:] AS t FROM f WHERE strpos(t, '(') > 0), b AS (SELECT language, t[strpos(t, 'return') + 6:] AS t FROM a WHERE strpos(t, 'return') > 0)
        SELECT language, count(*) AS n FROM b WHERE strpos(t, ')') > 0 GROUP BY 1""",
    "weaknesses_of_rules": """
        SELECT lpad(n, greatest(3, length(n))::INT, '0') AS cwe, name, true AS known FROM (VALUES ('22', 'Path Traversal'), ('15', 'External Control of Setting'), ('16', 'Configuration'), ('78', 'OS Command Injection'), ('79', 'Cross-site Scripting'), ('89', 'SQL Injection'), ('90', 'LDAP Injection'),
            ('93', 'CRLF Injection'), ('91', 'XML Injection'), ('94', 'Code Injection'), ('99', 'Resource Injection'), ('200', 'Information Exposure'), ('113', 'HTTP Response Splitting'), ('117', 'Log Injection'), ('120', 'Classic Buffer Overflow'), ('134', 'Format String'), ('235', 'Extra Parameters'),
            ('295', 'Improper Certificate Validation'), ('327', 'Broken Cryptography'), ('330', 'Insufficient Randomness'), ('346', 'Origin Validation Error'), ('348', 'Less Trusted Source'), ('352', 'Cross-Site Request Forgery'), ('434', 'Unrestricted Upload'), ('481', 'Assigning Instead of Comparing'), ('400', 'Resource Consumption'), ('489', 'Active Debug Code'),
            ('502', 'Unsafe Deserialization'), ('601', 'Open Redirect'), ('611', 'XML External Entity'), ('614', 'Cookie Without Secure'), ('540', 'Source Code Exposure'), ('643', 'XPath Injection'), ('652', 'XQuery Injection'), ('704', 'Incorrect Conversion'), ('710', 'Coding Standard'), ('732', 'Incorrect Permission'), ('776', 'XML Entity Expansion'), ('798', 'Hard-coded Credentials'),
            ('918', 'Server-Side Request Forgery'), ('917', 'Expression Language Injection'), ('942', 'Permissive Cross-domain Policy'), ('943', 'NoSQL Injection'), ('1004', 'Cookie Without HttpOnly'), ('1236', 'Formula Injection'), ('1336', 'Template Injection')) v(n, name)""",
    "places_repeated": "SELECT taskid, fileid, location, trim(vultype) AS kind, count(DISTINCT id) AS n FROM vulfile WHERE taskid IS NOT NULL AND location IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) > 1",
    "overview_blocks": f"""
        WITH n AS (SELECT taskid, count(DISTINCT id) AS n FROM vulfile GROUP BY 1), t AS (SELECT t.*, itemname, n, regexp_extract_all(type, '[''"]([^''"]*)[''"]', 1) AS l FROM {_ONE_TASK} t LEFT JOIN {_P} p USING (itemid) LEFT JOIN n ON n.taskid = t.taskid)
        SELECT taskid, 'project' AS what, coalesce(itemname, '') AS value FROM t
        UNION ALL SELECT taskid, 'mode', CASE WHEN list_contains(l, 'r4') THEN 'thinking' WHEN l[2] = 'false' THEN 'fast' WHEN type IS NOT NULL THEN 'careful' ELSE '' END FROM t
        UNION ALL SELECT taskid, 'lines', coalesce(nullif(regexp_extract(trim(code_size), '^(\\d+)', 1), ''), '0') FROM t UNION ALL SELECT taskid, 'findings', coalesce(n, 0)::VARCHAR FROM t""",
    "details_with_plan": f"""
        WITH c AS (SELECT trim(name_cn) AS kind, level, description, repairplan FROM subvullist QUALIFY row_number() OVER (PARTITION BY trim(name_cn) ORDER BY name_en NULLS FIRST, level NULLS FIRST, description NULLS FIRST, repairplan NULLS FIRST) = 1)
        SELECT DISTINCT id, taskid, trim(vultype) AS kind, {_level("level")} AS level, coalesce(description, '') AS description, coalesce(repairplan, '') AS plan FROM vulfile LEFT JOIN c ON trim(vultype) = kind WHERE vultype IS NOT NULL""",
    "project_counts": f"""
        SELECT (SELECT count(DISTINCT itemid) FROM itemdetail) AS n_projects, (SELECT count(*) FROM {_T} WHERE endtime IS NOT NULL) AS n_done, (SELECT count(*) FROM {_T} WHERE endtime IS NULL) AS n_open,
        count(*) FILTER (repair_status = '已修复') AS n_fixed, count(*) FILTER (is_fp = '1' AND repair_status IS DISTINCT FROM '已修复') AS n_false_alarm,
        count(*) FILTER (repair_status IS DISTINCT FROM '已修复' AND is_fp IS DISTINCT FROM '1') AS n_left FROM vulfile""",
    "one_active": "SELECT id, name_en, coalesce((id = 7)::INT, 0) AS active FROM subvullist",
    "imports_replaced": f"WITH n AS (SELECT * FROM {_values(_NEW_IMPORTS, 'taskid, source_file, imported_file')}), a AS (SELECT * FROM n UNION ALL SELECT i.taskid, i.source_file, i.imported_file FROM import_relation i WHERE i.taskid IS NULL OR i.taskid NOT IN (SELECT taskid FROM n)) SELECT taskid, count(*) AS n_imports FROM a GROUP BY 1",
    "changes_logged": """
        WITH l AS (SELECT fileid AS id, new_value FROM audit_log WHERE new_value IN ('高危', '中危', '低危') AND fileid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fileid ORDER BY update_time DESC NULLS LAST, new_value NULLS FIRST) = 1)
        SELECT f.id, f.risk_level AS old_value, l.new_value FROM (SELECT DISTINCT id, risk_level FROM vulfile WHERE id IS NOT NULL) f JOIN l ON f.id = l.id WHERE f.risk_level IS DISTINCT FROM l.new_value""",
    "notices_page": "SELECT taskid, fileid, new_value, update_time, update_time < '2024-01-01' AS is_read FROM (SELECT DISTINCT * FROM audit_log) ORDER BY update_time DESC NULLS LAST, taskid NULLS FIRST, fileid NULLS FIRST, new_value NULLS FIRST LIMIT 30",
    "kept_by_importers": f"""
        WITH f AS (SELECT DISTINCT id, taskid, {_PATH} AS path, enclosing_method AS m FROM vulfile WHERE filepath IS NOT NULL), {_CODE},
        e AS (SELECT DISTINCT taskid, source_file, imported_file FROM import_relation WHERE source_file <> imported_file AND NOT suffix(imported_file, '*')),
        s AS (SELECT f.id, f.taskid, f.path, f.m, max(contains(c.content, f.m)::INT) AS said FROM f JOIN e ON e.taskid = f.taskid AND e.imported_file = f.path JOIN c ON c.taskid = f.taskid AND c.path = e.source_file WHERE f.m IS NOT NULL AND c.content IS NOT NULL GROUP BY ALL)
        SELECT f.taskid, count(*) AS n_kept FROM f LEFT JOIN s ON s.id = f.id AND s.taskid = f.taskid AND s.path = f.path AND s.m = f.m WHERE coalesce(s.said, 1) = 1 GROUP BY 1""",
    "imports_resolved": rf"""
        WITH {_CODE}, x AS (SELECT taskid, path, unnest(regexp_split_to_array(content, '\n')) AS line FROM c WHERE content IS NOT NULL),
        y AS (SELECT taskid, path, unnest([regexp_extract(line, '^\s*import\s+(?:static\s+)?([\w.*]+)\s*;', 1), regexp_extract(line, '^\s*from\s+([\w.]+)\s+import\b', 1), regexp_extract(line, '^\s*#include\s*[<"]([^>"]+)[>"]', 1),
            regexp_extract(line, '^\s*(?:require|include)(?:_once)?\s*\(?\s*[''"]([^''"]+)[''"]', 1), regexp_extract(line, '^\s*import\s+.*?from\s+[''"]([^''"]+)[''"]', 1)]) AS module FROM x),
        m AS (SELECT DISTINCT taskid, path, module, CASE WHEN contains(module, '/') THEN regexp_replace(module, '\.[A-Za-z]+$', '') ELSE replace(regexp_replace(module, '\.(?:h|hpp)$', ''), '.', '/') END AS parts FROM (SELECT taskid, path, module FROM y UNION SELECT taskid, source_file, imported_file FROM import_relation WHERE taskid IS NOT NULL) WHERE module <> ''),
        f AS (SELECT DISTINCT taskid, path AS target, regexp_replace(path, '\.[^./]*$', '') AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM c),
        one AS (SELECT m.taskid, m.path, module, target, CASE WHEN contains(parts, '/') AND suffix('/' || stem, '/' || parts) THEN 1 WHEN folder = regexp_extract(m.path, '^(.*)/[^/]*$', 1) THEN 2 ELSE 3 END AS how
            FROM m JOIN f ON m.taskid = f.taskid AND regexp_extract(stem, '[^/]*$') = regexp_extract(parts, '[^/]*$') AND target <> m.path WHERE NOT suffix(module, '*')),
        best AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY taskid, path, module ORDER BY how, target) = 1)
        SELECT taskid, path, module, target, how FROM best
        UNION ALL SELECT m.taskid, m.path, module, target, 0 FROM m JOIN f ON m.taskid = f.taskid AND target <> m.path AND suffix('/' || folder, '/' || regexp_replace(parts, '/\*$', '')) WHERE suffix(module, '*')""",
    "imports_unguarded": f"WITH {_BOTH_WAYS} SELECT id FROM n WHERE suffix(id, '.xml') AND NOT EXISTS (SELECT 1 FROM u WHERE u.src = n.id AND suffix(u.dst, '.c')) AND NOT EXISTS (SELECT 1 FROM u a JOIN u b ON a.dst = b.src WHERE a.src = n.id AND suffix(b.dst, '.c'))",
    "imports_adjacent": f"WITH {_BOTH_WAYS} SELECT id FROM n WHERE suffix(id, '.xml') AND EXISTS (SELECT 1 FROM u WHERE u.src = n.id AND suffix(u.dst, '.py'))",
    "cookies_unguarded": f"""
        WITH n AS (SELECT * FROM {_values(_CLONED, "id, label, name, source_file")}), e AS (SELECT * FROM {_values(_EDGES, "src, dst")}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
        w AS (SELECT src, dst FROM u UNION SELECT a.src, b.dst FROM u a JOIN u b ON a.dst = b.src) SELECT id, source_file FROM n WHERE name = 'newCookie' AND id NOT IN (SELECT w.src FROM w JOIN n g ON g.id = w.dst WHERE g.name = 'setSecure')""",
    "passwords_assigned": f"""
        WITH n AS (SELECT * FROM {_values(_CLONED, "id, label, name, source_file")}), e AS (SELECT * FROM {_values(_EDGES, "src, dst")}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)
        SELECT DISTINCT n.id, n.source_file FROM n JOIN u ON u.src = n.id JOIN n p ON p.id = u.dst WHERE n.name = 'assign' AND p.label = 'IDENTIFIER' AND lower(p.name) LIKE '%password%'""",
    "arguments_without_local": f"WITH n AS (SELECT * FROM {_values(_CLONED, 'id, label, name, source_file')}) SELECT id, name, source_file FROM n a WHERE label = 'IDENTIFIER' AND length(name) = 1 AND NOT EXISTS (SELECT 1 FROM n b WHERE b.label = 'LOCAL' AND b.name = a.name AND b.source_file = a.source_file)",
    "values_read": "SELECT DISTINCT id FROM vulfile WHERE source_code LIKE '%getParameter(%'",
    "vectors_labelled": f"WITH s AS ({_scores(4)}), l AS (SELECT vec_id, 'label_' || j AS label FROM s WHERE 1 / (1 + exp(-s)) > 0.5), a AS (SELECT label FROM l UNION ALL SELECT NULL FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM l)) SELECT label, count(*) AS n_vectors FROM a GROUP BY 1",
    "vectors_classed": f"WITH s AS ({_scores(2)}) SELECT vec_id, 'label_' || arg_max(j, s - j * 1e-15) AS name, round(max(exp(s)) / sum(exp(s)), 6) AS probability FROM s GROUP BY 1",
    "scanned_in_cascade": """
        WITH r AS (SELECT DISTINCT fileid FROM vulfile WHERE id IS NOT NULL AND 0.2 * CASE WHEN avgccn IS NULL OR isnan(avgccn) THEN 0 ELSE avgccn END + 0.1 * coalesce(max_ccn, 0) + 0.05 * coalesce(function_count, 0) > 2.5)
        SELECT DISTINCT id FROM vulfile WHERE id IS NOT NULL AND fileid IN (SELECT fileid FROM r) AND regexp_matches(source_code, '\\bexec\\(|executeQuery|sendRedirect|\\bsystem\\(')""",
    "answers_parsed": "SELECT event_type, sum(TRY_CAST(json_extract_string(props, '$.k') AS INT))::BIGINT AS sum_k, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NULL) AS n_unread FROM events GROUP BY 1",
}
