"""Queries over source code: lines, calls, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import values as V
from scanloom.operators import graph, near, paths, ranking
from scanloom.plans import sqltext
from scanloom.plans.spread import spread
from scanloom.rules import factors, flow
from scanloom.rules import lines as line_rules
from scanloom.rules import nodes as node_rules
from scanloom.rules.catalogue import RULES
from scanloom.sources.tables import table

_INPUT = r"getParameter|argv|getenv|request\.|req\.|\$_GET|\$_POST|\$_COOKIE|scanf|recv\("
_SINK = r"\bsystem\(|\bexec\(|executeQuery|\.execute\(|mysqli_query|sendRedirect|\bpopen\(|\beval\("
_ANY_CALL = r"=.*\("
_CLEANERS = ("request", "cursor", "getParameter", "htmlspecialchars", "basename")
#: Factors of risk on a line: what it looks like, and its points.
_FACTORS = {"joined": (r"\+|\.format\(|%s", 1), "signs": (r"[;|&`$]\s*[a-z\"']", 1), "input": (r"(?i)input|param|arg|query", 2), "shell": (r"(?i)\bsh\b|/bin/|cmd\.exe", 2)}
_HEADER = r"^\s*(?:public|private|protected|static|def|function|int|void|bool|char|struct|async)\b[^;=]*\("
_NEEDLES = ("getenv", "strcpy", "sendRedirect", "cursor.execute", "mysqli_query", "innerHTML", "ObjectInputStream", "subprocess")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """One text of code for each finding, with the language of its file; texts are no key of the sort, as copies have one text."""
    f = ranking.keep_first(table(spark, d, "vulfile").select("id", "filename", "source_code").filter("id is not null"), ["id"], [F.col("filename"), F.xxhash64("source_code")])
    return f.select("id", "filename", paths.language_of(F.col("filename")).alias("language"), F.col("source_code").alias("content"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return line_rules.lines_of_files(_files(spark, d), ["id"])


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The code of every row, copies of a finding among them: they have one text, so that what is found is put together after."""
    f = table(spark, d, "vulfile").filter("id is not null")
    return spread(f.select("id", paths.language_of(F.col("filename")).alias("language"), F.col("source_code").alias("content")))


def rule_findings(spark, d):
    """What the rules find, one row for each rule and line."""
    return line_rules.findings(_texts(spark, d), ["id"]).select("id", "line_no", "rule_id", "kind", "cwe").distinct()


def rule_findings_finished(spark, d):
    """The same once for each line and kind, with the catalogue's level, without what was found before: the same kind in the same
    task, path and file on the first line of a finding's location. A text counts as its file from line 1 on, as nothing says where an
    excerpt begins."""
    place = ["taskid", "filepath", "filename"]
    rows = table(spark, d, "vulfile")
    of = ranking.keep_first(rows.select("id", *place).filter("id is not null"), ["id"], [F.col("filename"), F.col("filepath"), F.col("taskid")])
    found = line_rules.findings(_texts(spark, d), ["id"]).drop("text").distinct().join(of, "id")
    known = rows.select(*place, F.array_min(V.lines_of(F.col("location"))).alias("line_no"), F.col("vultype").alias("kind"))
    done = line_rules.finish(found, ["id"], table(spark, d, "subvullist"), known, place)
    return done.groupBy("kind", "level").agg(F.count("*").alias("n_findings"), F.countDistinct("id").alias("n_files"))


def sinks_scored(spark, d):
    """Dangerous calls by how many factors of risk they have, with data from outside fewer than 50 lines before."""
    found = factors.scored(_lines(spark, d).filter("language is not null"), ["id"], _SINK, _FACTORS, _INPUT, 50, 1)
    return found.select("id", "line_no", "n_factors", "points", "near_source", "level")


def tainted_lines(spark, d):
    """Dangerous calls with a name that was given data from outside fewer than 50 lines before."""
    return flow.assigned(_lines(spark, d).select("id", "line_no", "text"), ["id"], _INPUT, _SINK, 50)


def uncleaned_lines(spark, d):
    """The same without names that one of a list of functions cleans in between."""
    lines = _lines(spark, d).select("id", "line_no", "text")
    cleaners = spark.createDataFrame([(x,) for x in _CLEANERS], "function string")
    return flow.uncleaned(flow.assigned(lines, ["id"], _ANY_CALL, _SINK, 50), lines, ["id"], cleaners)


def needles_in_lines(spark, d):
    """Lines that hold one of a list of texts, each text's lines and files counted."""
    needles = spark.createDataFrame([(n,) for n in _NEEDLES], "needle string")
    hit = near.lines_with_needles(_lines(spark, d), "text", needles, "needle")
    return hit.groupBy("needle").agg(F.count("*").alias("n_lines"), F.countDistinct("id").alias("n_files"))


def sinks_near_input(spark, d):
    """Dangerous calls with data from outside fewer than 50 lines before."""
    lines = _lines(spark, d).select("id", "line_no", "text")
    return near.within_lines(lines.filter(F.col("text").rlike(_SINK)).select("id", "line_no"), lines.filter(F.col("text").rlike(_INPUT)).select("id", "line_no"), ["id"], "line_no", 50)


def input_before_sinks(spark, d):
    """Dangerous calls with the last line before them that takes data from outside."""
    lines = _lines(spark, d).select("id", "line_no", "text")
    return near.nearest_before(lines.filter(F.col("text").rlike(_SINK)).select("id", "line_no"), lines.filter(F.col("text").rlike(_INPUT)).select("id", "line_no"), ["id"], "line_no")


def context_of_sinks(spark, d):
    """Dangerous calls with two lines before and after."""
    lines = ranking.with_context(_lines(spark, d).select("id", "line_no", "text"), ["id"], "line_no", "text", 2)
    return lines.filter(F.col("text").rlike(_SINK)).select("id", "line_no", "context")


def functions_of_sinks(spark, d):
    """Dangerous calls with the line on which the function that holds them begins."""
    header = F.when(F.col("text").rlike(_HEADER), F.col("line_no"))
    lines = ranking.last_before(_lines(spark, d).select("id", "line_no", "text"), ["id"], "line_no", header, "function_line")
    return lines.filter(F.col("text").rlike(_SINK)).select("id", "line_no", "function_line")


def next_functions(spark, d):
    """Comment lines with the line of the first function after them."""
    header = F.when(F.col("text").rlike(_HEADER), F.col("line_no"))
    lines = ranking.first_after(_lines(spark, d).select("id", "line_no", "text"), ["id"], "line_no", header, "function_line")
    return lines.filter(F.col("text").rlike(r"^\s*//")).select("id", "line_no", "function_line")


def places_in_code(spark, d):
    """Where the method that holds a finding is first named in its source code, blanks aside."""
    f = table(spark, d, "vulfile").filter("source_code is not null and length(trim(enclosing_method)) > 0").select("id", "source_code", "enclosing_method").distinct()
    at = near.place_of(F.col("source_code"), F.col("enclosing_method"))
    return f.select("id", at.alias("p")).select("id", F.col("p.start_line").alias("start_line"), F.col("p.end_line").alias("end_line"))


def likest_lines(spark, d):
    """For each line of a finding's repaired code the lines of its code that are likest to it, from a likeness of 0.5 on."""
    f = table(spark, d, "vulfile").filter("id is not null and length(trim(repair_code)) > 0").select("id", F.explode(F.split("repair_code", line_rules.LINE_END)).alias("text"))
    f = f.select("id", F.trim("text").alias("text")).filter("text <> ''").distinct()
    found = near.likest_lines(_lines(spark, d).select("id", "line_no", F.trim("text").alias("text")).filter("text <> ''"), f, ["id"], "text", 0.5)
    return found.select("id", "line_no", "wanted", F.round("likeness", 6).alias("likeness"))


def complexity_of_code(spark, d):
    """About how many ways lead through each text of code, by language."""
    f = _files(spark, d).filter("content is not null")
    return f.withColumn("n", line_rules.complexity(F.col("content"))).groupBy("language").agg(F.count("*").alias("n_files"), F.sum("n").alias("sum_ccn"), F.max("n").alias("max_ccn"))


def calls(spark, d):
    """Calls, functions and literals of the code by language and name."""
    n = node_rules.nodes(_files(spark, d).filter("language is not null"), ["id"])
    return n.filter("kind <> 'string'").groupBy("language", "kind", "name").agg(F.count("*").alias("n_nodes"), F.countDistinct("id").alias("n_files"))


def tainted_calls(spark, d):
    """Dangerous calls after data came from outside in the same function, unless it is checked there."""
    n = node_rules.nodes(_files(spark, d).filter("language is not null"), ["id"])
    source = F.col("name").isin("getParameter", "getHeader", "getenv", "scanf", "recv", "fgets", "input") | F.col("args").rlike(_INPUT)
    sink = F.col("name").isin("exec", "system", "popen", "execute", "executeQuery", "mysqli_query", "sendRedirect", "eval", "strcpy", "call")
    found = node_rules.tainted_calls(n, ["id"], source, sink).unionByName(node_rules.calls_with(n, sink, F.col("args").rlike(_INPUT))).dropDuplicates(["id", "node_id"])
    return node_rules.unless_guarded(found, n, ["id"], F.col("name").rlike("(?i)escape|sanitize|validate|quote")).select("id", "language", "name", "line")


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A graph of the code's calls: calls as nodes, edges from a call to the calls within its arguments."""
    n = cut_nodes(spark, d)

    def key(node: str):
        return F.struct("id", F.col(node).alias("node_id"))  # the text's id and the node's, whatever their number

    nodes = n.select(key("node_id").alias("id"), F.upper("kind").alias("label"), "name", F.coalesce("args", F.lit("")).alias("code"), "line", F.col("id").cast("string").alias("source_file"))
    edges = n.filter("in_args_of is not null").select(key("in_args_of").alias("src"), key("node_id").alias("dst"))
    return nodes, edges


def cut_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the code written once, for what reads them several times."""
    from scanloom.plans.lineage import cut

    return cut(node_rules.nodes(_files(spark, d).filter("language is not null"), ["id"]))


def unguarded_calls(spark, d):
    """Calls that touch the file system and have no call within two steps that checks a path."""
    nodes, edges = _edges(spark, d)
    subject = F.col("label").eqNullSafe("CALL") & F.col("name").isin("File", "FileInputStream", "open", "fopen", "readFile", "join", "exec", "call", "system")
    found = graph.unguarded(nodes, edges, subject, F.col("name").rlike("(?i)normal|canonical|realpath|basename"), 2)
    return found.groupBy("name").agg(F.count("*").alias("n_calls"), F.countDistinct("source_file").alias("n_files"))


QUERIES = {f.__name__: f for f in (rule_findings, rule_findings_finished, sinks_scored, tainted_lines, uncleaned_lines, needles_in_lines, sinks_near_input, input_before_sinks, context_of_sinks, functions_of_sinks, next_functions, places_in_code, likest_lines, complexity_of_code, calls, tainted_calls, unguarded_calls)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FILES = f"""
    f0 AS (SELECT id, filename, source_code AS content FROM vulfile WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY filename NULLS FIRST, source_code NULLS FIRST) = 1),
    f AS (SELECT id, content, {sqltext.language('filename')} AS language FROM f0),
    a AS (SELECT id, language, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS t FROM f WHERE content IS NOT NULL),
    l AS (SELECT id, language, unnest(range(1, len(t) + 1))::INT AS line_no, unnest(t) AS text FROM a)"""

# The rules again, each a search of its own with its patterns as they are.
_AROUND = f"""{_FILES},
    w AS MATERIALIZED (SELECT id, language, line_no, text, NOT regexp_matches(text, '^\\s*(?://|/\\*|\\*|#|<!--|--)') OR regexp_matches(text, '^\\s*#\\s*(?:include|define)') AS code,
        string_agg(text, chr(10)) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS before,
        string_agg(text, chr(10)) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS about FROM l)"""
_FOUND = " UNION ALL ".join(
    f"SELECT id, line_no, {_q(r.rule_id)} AS rule_id, {_q(r.kind)} AS kind, {_q(r.level)} AS level, {_q(r.cwe)} AS cwe FROM w WHERE language = {_q(r.language)} AND code AND regexp_matches(text, {_q(r.sink)})"
    + (f" AND regexp_matches(before, {_q(r.source)})" if r.source else "")
    + (f" AND NOT regexp_matches(about, {_q(r.safe)})" if r.safe else "")
    for r in RULES
)
_SCORED = " + ".join(f"regexp_matches(text, {_q(p)})::INT" for p, _ in _FACTORS.values())
_POINTS = " + ".join(f"{k} * regexp_matches(text, {_q(p)})::INT" for p, k in _FACTORS.values())

_FLOWS = f"""{_FILES},
    s AS (SELECT id, line_no AS source_line, regexp_extract(text, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*:?=[^=]', 1) AS name FROM l WHERE regexp_matches(text, {{source}})),
    t AS (SELECT DISTINCT id, line_no, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM l WHERE regexp_matches(text, {sqltext.SINK})),
    flows AS (SELECT DISTINCT s.id, s.name, source_line, line_no FROM s JOIN t ON s.id = t.id AND s.name = t.name AND source_line < line_no AND line_no - source_line < 50 WHERE s.name <> '')"""

ORACLE_SQL = {
    "rule_findings": f"WITH {_AROUND} SELECT id, line_no, rule_id, kind, cwe FROM ({_FOUND})",
    "rule_findings_finished": f"""
        WITH {_AROUND}, r AS ({_FOUND}), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id, line_no, kind ORDER BY rule_id) = 1),
        v AS (SELECT id, taskid, filepath, filename FROM vulfile WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY filename NULLS FIRST, filepath NULLS FIRST, taskid NULLS FIRST) = 1),
        k AS (SELECT DISTINCT taskid, filepath, filename, list_min([x::INT FOR x IN regexp_extract_all(location, '\\d+')]) AS line_no, lower(trim(vultype)) AS kind FROM vulfile),
        c AS (SELECT trim(name_cn) AS kind, max(level) AS listed FROM subvullist GROUP BY 1)
        SELECT o.kind, coalesce(c.listed, o.level) AS level, count(*) AS n_findings, count(DISTINCT o.id) AS n_files FROM o JOIN v USING (id) LEFT JOIN c ON c.kind = o.kind
        WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.taskid = v.taskid AND k.filepath = v.filepath AND k.filename = v.filename AND k.line_no = o.line_no AND k.kind = lower(trim(o.kind))) GROUP BY 1, 2""",
    "sinks_scored": f"""
        WITH {_FILES}, w AS (SELECT id, line_no, text, bool_or(regexp_matches(text, {sqltext.INPUT})) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS near_source FROM l WHERE language IS NOT NULL),
        s AS (SELECT id, line_no, ({_SCORED} + near_source::INT)::INT AS n_factors, ({_POINTS} + 2 * near_source::INT)::INT AS points, near_source FROM w WHERE regexp_matches(text, {sqltext.SINK}))
        SELECT *, CASE WHEN near_source OR n_factors >= 2 THEN 'high' ELSE 'medium' END AS level FROM s WHERE points >= 1""",
    "tainted_lines": f"WITH {_FLOWS.format(source=sqltext.INPUT)} SELECT * FROM flows",
    "uncleaned_lines": f"""
        WITH {_FLOWS.format(source="'=.*\\('")}, c AS (SELECT id, line_no, text FROM l WHERE len(list_intersect(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*'), ['request', 'cursor', 'getParameter', 'htmlspecialchars', 'basename'])) > 0)
        SELECT * FROM flows f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = f.id AND c.line_no > f.source_line AND c.line_no <= f.line_no AND list_contains(regexp_extract_all(c.text, '[A-Za-z_$][A-Za-z0-9_$]*'), f.name))""",
    "places_in_code": """
        WITH f AS (SELECT DISTINCT id, source_code, regexp_replace(enclosing_method, '\\s+', '', 'g') AS m FROM vulfile WHERE source_code IS NOT NULL AND length(trim(enclosing_method)) > 0),
        a AS (SELECT id, m, strpos(regexp_replace(source_code, '\\s+', '', 'g'), m) AS p, string_split(replace(replace(source_code, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS t FROM f),
        e AS (SELECT id, m, p, k, sum(length(regexp_replace(x, '\\s+', '', 'g'))) OVER (PARTITION BY id, m, p ORDER BY k) AS upto FROM (SELECT id, m, p, unnest(t) AS x, generate_subscripts(t, 1) AS k FROM a))
        SELECT id, CASE WHEN max(p) > 0 AND m <> '' THEN (1 + count(*) FILTER (upto < p))::INT END AS start_line, CASE WHEN max(p) > 0 AND m <> '' THEN (1 + count(*) FILTER (upto < p + length(m) - 1))::INT END AS end_line FROM e GROUP BY id, m, p""",
    "needles_in_lines": f"WITH {_FILES}, n AS (SELECT unnest([{', '.join(map(_q, _NEEDLES))}]) AS needle) SELECT needle, count(*) AS n_lines, count(DISTINCT id) AS n_files FROM l JOIN n ON contains(text, needle) GROUP BY 1",
    "sinks_near_input": f"WITH {_FILES}, s AS (SELECT id, line_no FROM l WHERE regexp_matches(text, {sqltext.SINK})), i AS (SELECT id, line_no AS source_line_no FROM l WHERE regexp_matches(text, {sqltext.INPUT})) SELECT s.id, s.line_no, i.source_line_no FROM s JOIN i ON s.id = i.id AND i.source_line_no < s.line_no AND s.line_no - i.source_line_no < 50",
    "input_before_sinks": f"WITH {_FILES}, s AS (SELECT id, line_no FROM l WHERE regexp_matches(text, {sqltext.SINK})), i AS (SELECT id, line_no FROM l WHERE regexp_matches(text, {sqltext.INPUT})) SELECT s.id, s.line_no, (SELECT max(i.line_no) FROM i WHERE i.id = s.id AND i.line_no < s.line_no) AS source_line FROM s",
    "context_of_sinks": f"WITH {_FILES}, c AS (SELECT id, line_no, text, string_agg(text, chr(10)) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM l) SELECT id, line_no, context FROM c WHERE regexp_matches(text, {sqltext.SINK})",
    "functions_of_sinks": f"WITH {_FILES}, c AS (SELECT id, line_no, text, max(CASE WHEN regexp_matches(text, {sqltext.HEADER}) THEN line_no END) OVER (PARTITION BY id ORDER BY line_no) AS function_line FROM l) SELECT id, line_no, function_line FROM c WHERE regexp_matches(text, {sqltext.SINK})",
    "next_functions": f"WITH {_FILES}, c AS (SELECT id, line_no, text, min(CASE WHEN regexp_matches(text, {sqltext.HEADER}) THEN line_no END) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS function_line FROM l) SELECT id, line_no, function_line FROM c WHERE regexp_matches(text, '^\\s*//')",
    "complexity_of_code": f"""
        WITH {_FILES}, n AS (SELECT language, 1 + len(regexp_extract_all(content, '\\b(?:if|for|while|case|catch|elif|except|foreach)\\b|&&|\\|\\||\\?[^?:\\n]*:')) AS n FROM f WHERE content IS NOT NULL)
        SELECT language, count(*) AS n_files, sum(n)::BIGINT AS sum_ccn, max(n)::INT AS max_ccn FROM n GROUP BY 1""",
}
