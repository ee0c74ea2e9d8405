"""Operators behind lists, policies, resolution and scoring, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from scanloom.functions import scoring
from scanloom.functions import values as V
from scanloom.operators import changes, filters, graph, ranking
from scanloom.rules import factors, flow, registry
from scanloom.rules import lines as L


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_defaults_and_ranks(spark):
    df = spark.createDataFrame([(None, "a"), ("", "b"), ("x", None)], "p string, q string")
    assert rows(filters.defaults(df, p="0", q=F.col("p"))) == [("0", "a"), ("0", "b"), ("x", "x")]
    levels = spark.createDataFrame([("low",), (None,), ("high",), ("odd",), ("medium",)], "v string")
    assert [r[0] for r in levels.orderBy(filters.rank_in(F.col("v"), ("high", "medium", "low")), F.col("v").desc()).collect()] == ["high", "medium", "low", "odd", None]


def test_spacing_of_kept_rows(spark):
    df = spark.createDataFrame([(1, n) for n in (1, 2, 2, 3, 4, 9, 10, 12)] + [(2, 5)], "f int, line int")
    assert rows(ranking.spaced_emitted(df, ["f"], "line"), "f", "line") == [(1, 1), (1, 3), (1, 9), (1, 12), (2, 5)]
    assert rows(ranking.spaced_emitted(df.limit(0), ["f"], "line")) == []


def test_sets_replaced_and_one_active(spark):
    now = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "p int, c string")
    new = spark.createDataFrame([(1, "z"), (3, "y")], "p int, c string")
    assert rows(changes.children_replaced(now, new, "p"), "p", "c") == [(None, "d"), (1, "z"), (2, "c"), (3, "y")]
    assert rows(changes.activated(now, F.col("p") == 1, "on").select("on")) == [(1,), (1,), (0,), (0,)]


def test_weakness_names(spark):
    df = spark.createDataFrame([("79",), ("079",), ("1004",), ("5",), (None,)], "n string")
    assert [r[0] for r in rows(df.select(V.weakness_name(F.col("n"))))] == ["Cross-site Scripting", "Cross-site Scripting", "Cookie Without HttpOnly", None, None]


def test_imports_are_resolved(spark):
    files = spark.createDataFrame([(1, p) for p in ("src/a/b/C.java", "lib/C.java", "src/a/b/D.java", "src/x/D.java", "src/x/E.java", "inc/util.h", "src/x/util.h")], "taskid int, path string")
    said = [("a.b.C", [("src/a/b/C.java", 1)]), ("D", [("src/x/D.java", 2)]), ("q.C", [("lib/C.java", 3)]), ("a.b.*", [("src/a/b/C.java", 0), ("src/a/b/D.java", 0)]), ("util.h", [("src/x/util.h", 2)]), ("inc/util.h", [("inc/util.h", 1)]), ("no.Such", []), ("E", [])]
    imports = spark.createDataFrame([(1, "src/x/E.java", m) for m, _ in said] + [(2, "src/x/E.java", "a.b.C")], "taskid int, path string, module string")
    got = {}
    for r in graph.resolved_imports(imports, files).collect():
        got.setdefault(r["module"], []).append((r["target"], r["how"]))
    assert {m: sorted(t) for m, t in got.items()} == {m: t for m, t in said if t}


def test_findings_kept_by_importers(spark):
    found = spark.createDataFrame([(1, "a.java", "run"), (1, "a.java", "stop"), (1, "b.java", "go"), (1, "a.java", None), (2, "a.java", "stop"), (1, "c.java", "x")], "taskid int, path string, fn string")
    edges = spark.createDataFrame([(1, "b.java", "a.java"), (1, "d.java", "a.java"), (1, "unknown.java", "c.java"), (1, "b.java", "b.java")], "taskid int, source_file string, imported_file string")
    code = spark.createDataFrame([(1, "b.java", "a.run();"), (1, "d.java", "nothing"), (1, "a.java", "stop()")], "taskid int, path string, content string")
    kept = graph.kept_by_importers(found, edges, code, "fn")
    assert sorted(map(repr, rows(kept))) == sorted(map(repr, [(1, "a.java", "run"), (1, "b.java", "go"), (1, "a.java", None), (2, "a.java", "stop"), (1, "c.java", "x")]))


def test_scorers(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0]), (2, [-1.0, 1.0]), (3, [0.0]), (4, None), (5, [None, 1.0])], "id int, v array<float>")
    heads = {"b": ([1.0, 0.0], 0.0), "a": ([0.0, 1.0], 0.0)}
    assert rows(df.select(scoring.labels(F.col("v"), heads))) == [(["b"],), (["a"],), ([],), (None,), ([],)]
    got = rows(df.select(scoring.best_of(F.col("v"), heads).alias("b")).select("b.name", F.round("b.probability", 4)))
    assert got[:2] == [("b", 0.8808), ("a", 0.8808)] and got[2] == got[3] == (None, None)
    assert rows(df.select(scoring.labels(F.col("v"), heads, none="a")).limit(1)) == [(["b"],)]


def test_factors(spark):
    text = "p = argv[1]\nx\nsystem(\"ls \" + p)\n" + "y\n" * 60 + "system(q)\nsystem(a + b)"
    lines = L.lines_of_files(spark.createDataFrame([(1, "c", text)], "id int, language string, content string"), ["id"])
    got = factors.scored(lines, ["id"], r"system\(", {"joined": (r"\+", 1), "shell": (r"ls ", 2)}, r"argv", 50)
    assert rows(got, "line_no") == [(1, 3, 3, 5, True, "high"), (1, 65, 1, 1, False, "medium")]


def test_flow_through_assignments(spark):
    text = "a = input()\nb = input()\nc == input()\nb = clean(b)\nsystem(a)\nsystem(b + ab)\nsystem(c)\n" + "x\n" * 60 + "system(a)"
    lines = L.lines_of_files(spark.createDataFrame([(1, "python", text), (2, "python", "system(a)")], "id int, language string, content string"), ["id"])
    flows = flow.assigned(lines, ["id"], r"input\(", r"system\(", 50)
    assert rows(flows, "line_no") == [(1, "a", 1, 5), (1, "b", 2, 6)]
    assert rows(flow.uncleaned(flows, lines, ["id"], spark.createDataFrame([("clean",), (None,)], "function string"))) == [(1, "a", 1, 5)]
    assert flow.uncleaned(flows, lines, ["id"], spark.createDataFrame([], "function string")).count() == 2


def test_rules_by_name_with_errors_apart(spark):
    @registry.rule("count")
    def count(code, language):
        return [(1, f"{language} {len(code)}"), (99, "outside")]

    @registry.rule("breaks")
    def breaks(code, language):
        if "bad" in code:
            raise ValueError("no")
        return [(1, "ok")]

    policies = spark.createDataFrame([(1, 1), (2, 0)], "policy_id int, status int")
    chosen = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (1, 5)], "policy_id int, rule_id int")
    named = spark.createDataFrame([(1, "count", "all"), (2, "breaks", "c"), (3, "gone", "c"), (4, "count", "c"), (5, "php", "php")], "rule_id int, name string, language string")
    names = registry.active_names(policies, chosen, named, "c")
    assert sorted(rows(names)) == [("breaks",), ("count",), ("gone",)]
    files = spark.createDataFrame([(1, "c", "bad"), (2, "c", "fine"), (3, "c", None)], "id int, language string, content string")
    got = sorted(rows(registry.run(files, ["id"], names)), key=repr)
    assert got == sorted([(1, "breaks", None, None, "ValueError: no"), (1, "count", 1, "c 3", None), (2, "breaks", 1, "ok", None), (2, "count", 1, "c 4", None), (None, "gone", None, None, "no rule 'gone'")], key=repr)


#: family-language: (code that it finds, code that makes it safe); data from outside stand on the line before.
FAMILIES = {
    "code-java": ("engine.eval(x); ScriptEngine e;", "allowList"), "code-python": ("importlib.import_module(x)", "allow_list"), "code-php": ("create_function('', $x);", "in_array"),
    "spring-java": ("parser.parseExpression(x);", "SimpleEvaluationContext"), "resource-c": ("connect(fd, a, n);", "allowed_port"), "resource-php": ("fsockopen($h);", "in_array"),
    "expansion-cpp": ("xmlReadFile(p, 0, XML_PARSE_NOENT);", "XML_PARSE_NONET"), "expansion-javascript": ("parse(x, { noent: true })", "noent: false"),
    "json_object-java": ("JSON.parseObject(x);", "setSafeMode(true"), "json_object-python": ("jsonpickle.decode(x)", "safe=True"), "json-java": ('String s = "{\\"a\\":\\"" + x;', "ObjectMapper"),
    "json-php": ("$s = '{\"a\":\"' . $x;", "json_encode"), "setting-java": ("System.setProperty(k, v);", "allowedKeys"), "setting-javascript": ("process.env.MODE = x;", "allowedKeys"),
    "ldap-php": ("ldap_search($c, $d, $f);", "ldap_escape"), "xpath-java": ("xpath.evaluate(x, d);", "setXPathVariableResolver"), "xquery-java": ("XQExpression e = c.createExpression();", "bindString("),
    "ognl-java": ("Ognl.getValue(x, c, r);", "SecurityMemberAccess"), "nosql-javascript": ("db.users.findOne({ n: x })", "mongo-sanitize"), "jsonp-javascript": ("res.jsonp(x)", "referer"),
    "upload-php": ("move_uploaded_file($a, $b);", "pathinfo"), "formula-java": ("cell.setCellValue(x);", "escapeFormula"), "csrf-java": ("http.csrf().disable();", "CookieCsrfTokenRepository"),
    "cors-php": ("header('Access-Control-Allow-Origin: *');", "in_array"), "forwarded-java": ('h = r.getHeader("X-Forwarded-For");', "trustedProxies"), "permission-c": ("chmod(p, 0777);", "0600"),
    "bundle-javascript": ("devtool: 'source-map',", "NODE_ENV"), "boot-properties": ("management.endpoints.web.exposure.include=*", "exposure.exclude"), "robots-text": ("Disallow: /admin/", "Disallow: /"),
    "conversion-cpp": ("auto p = reinterpret_cast<char*>(q);", "static_assert"), "coding-cpp": ("goto out;", "NOLINT"), "condition-cpp": ("if (a = b) {", "NOLINT"),
}
INPUT = {"java": 'x = request.getParameter("a");', "python": "x = input()", "php": "$x = $_GET['a'];", "c": "x = getenv(a);", "cpp": "x = getenv(a);", "javascript": "x = req.body;", "properties": "a=b", "text": "a"}
REMARK = {"python": "# ", "properties": "# ", "text": "# "}


def test_families(spark):
    files = []
    for rule_id, (code, safe) in FAMILIES.items():
        language = rule_id.rsplit("-", 1)[1]
        files += [(f"{rule_id}|{k}", language, f"{INPUT[language]}\n{t}") for k, t in (("found", code), ("safe", f"{code}\n{safe}"), ("remark", REMARK.get(language, "// ") + code))]
    df = spark.createDataFrame(files, "id string, language string, content string")
    got = {r["id"] for r in L.findings(df, ["id"]).collect() if r["id"].startswith(f"{r['rule_id']}|")}
    assert got == {f"{rule_id}|found" for rule_id in FAMILIES}


def test_findings_of_nothing(spark):
    df = spark.createDataFrame([(1, "c", None), (2, None, "system(x)"), (3, "c", ""), (4, "nope", "system(x)")], "id int, language string, content string")
    assert L.findings(df, ["id"]).count() == 0 and L.findings(df.limit(0), ["id"]).count() == 0
    with pytest.raises(ValueError):
        registry.MOST_RULES, old = 0, registry.MOST_RULES
        try:
            registry.run(df, ["id"], spark.createDataFrame([("a",)], "name string"))
        finally:
            registry.MOST_RULES = old
