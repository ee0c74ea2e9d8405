"""Operators on small fixtures, their corner cases among them."""

import pytest
from pyspark.sql import functions as F

from scanloom.functions import values as V
from scanloom.operators import changes, filters, graph, near, paths, ranking
from scanloom.rules import lines as L
from scanloom.rules import nodes as N


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_values(spark):
    df = spark.createDataFrame([("['a', 'false']", "[5, 3]", "12 行", "1.5 KB", " High "), ("x", "7", "", "", None), (None, None, None, None, "?")], "t string, l string, n string, s string, v string")
    got = rows(df.select(V.text_list(F.col("t")), V.spread_range(F.col("l")), V.leading_number(F.col("n")), V.size_in_bytes(F.col("s")), V.level_code(F.col("v"))))
    assert got == [(["a", "false"], "3, 4, 5", 12, 1536, "high"), (None, "7", None, None, "high"), (None, None, None, None, "high")]
    one = spark.range(1)
    assert rows(one.select(V.duration_text(F.lit(90061)), V.padded_cwe(F.lit("77")), V.ascii_punctuation(F.lit("（a，b）\\")), V.readable_size(F.lit(1536)))) == [("25时1分1秒", "077", "(a,b)/", "1.5 KB")]
    assert rows(one.select(V.without_comments(F.lit("import a;\nint x; // no\n/* y\n */\nint z;")), V.in_order(F.lit("a.b then c"), ["a.b", "c"]), V.in_order(F.lit("c a.b"), ["a.b", "c"]))) == [("int x; \nint z;", True, False)]


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(i, "a%b" if i % 2 else "ab") for i in range(10)], "i int, s string")
    assert df.filter(filters.matching(contains={"s": "%", "x": None})).count() == 5
    pages = [[r[0] for r in filters.page(df, [F.desc("i")], n, 4).select("i").collect()] for n in (1, 2, 3)]
    assert pages == [[9, 8, 7, 6], [5, 4, 3, 2], [1, 0]]
    scoped = spark.createDataFrame([(0, None), (1, True), (1, None)], "k int, m boolean")
    assert scoped.filter(filters.in_scope("k", F.col("m"))).count() == 2


def test_ranking(spark):
    df = spark.createDataFrame([(1, 10, "low", "a"), (1, 10, "high", "bb"), (1, 10, "high", "ccc"), (2, 3, None, None)], "f int, line int, level string, m string")
    best = ranking.best_per_line(df, ["f", "line"], F.when(F.col("level") == "high", 2).otherwise(1), "m", ["m"])
    assert rows(best, "f") == [(1, 10, "high", "ccc"), (2, 3, None, None)]
    assert ranking.keep_first(ranking.keep_first(df, ["f"], [F.col("m")]), ["f"], [F.col("m")]).count() == 2
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate("def x|a|b|def y|c".split("|"), 1)], "f int, line int, t string")
    last = ranking.last_before(lines, ["f"], "line", F.when(F.col("t").startswith("def"), F.col("line")), "fn")
    assert [r[3] for r in rows(last, "line")] == [1, 1, 1, 4, 4]
    assert rows(ranking.with_context(lines, ["f"], "line", "t", 1), "line")[1][3] == "def x\na\nb"
    far = spark.createDataFrame([(1, 1), (1, 2), (1, 100), (2, 0), (2, 1000)], "f int, line int")
    assert rows(ranking.near_median(far, ["f"], "line", 10), "f", "line") == [(1, 1), (1, 2), (2, 0), (2, 1000)]
    assert rows(ranking.spaced(far, ["f"], "line", 1), "f", "line") == [(1, 1), (1, 100), (2, 0), (2, 1000)]


def test_changes(spark):
    now = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    assert rows(changes.updated(now, new, ["id"]), "id") == [(1, "a"), (2, "b")]
    assert rows(changes.change_log(now, new, ["id"], "v")) == [(2, None, "b")]
    gone, added = changes.sync(now, new, ["id"])
    assert gone.count() == 0 and [r[0] for r in rows(added)] == [3]
    again = changes.sync(new, new, ["id"])
    assert again[0].count() == again[1].count() == 0


def test_common_folder(spark):
    df = spark.createDataFrame([(1, "a\\b\\x.c"), (1, "a/b//c/y.c"), (2, "a/x.c"), (2, "b/x.c"), (3, None), (4, "x.c")], "t int, p string")
    assert rows(paths.common_folder(df, ["t"], "p"), "t") == [(1, "a/b"), (2, ""), (4, "")]
    assert rows(df.limit(1).select(paths.language_of(F.lit("A.JSP")), paths.language_of(F.lit("x")))) == [("java", None)]


def test_near(spark):
    sinks = spark.createDataFrame([(1, 100), (1, 10), (2, 5)], "f int, line int")
    sources = spark.createDataFrame([(1, 60), (1, 50), (1, 100), (2, 6)], "f int, line int")
    assert rows(near.within_lines(sinks, sources, ["f"], "line", 50), "source_line") == [(1, 100, 60)]
    assert rows(near.nearest_before(sinks, sources, ["f"], "line"), "f", "line") == [(1, 10, None), (1, 100, 60), (2, 5, None)]
    ranges = spark.createDataFrame([(1, 5, 10)], "f int, start int, `end` int")
    assert rows(near.outside_ranges(sinks, ranges, ["f"], "line"), "f") == [(1, 100), (2, 5)]
    needles = spark.createDataFrame([("a.b",), ("",)], "needle string")
    text = spark.createDataFrame([("xa.by",), ("aXb",), (None,)], "t string")
    assert rows(near.lines_with_needles(text, "t", needles, "needle")) == [("xa.by", "a.b")]
    assert near.lines_with_needles(text, "t", needles.limit(0), "needle").count() == 0
    code = spark.createDataFrame([("a\n b c\r\nd", "bc d"), ("a", "z"), ("a", "")], "c string, s string")
    assert [r[0] and tuple(r[0]) for r in rows(code.select(near.place_of(F.col("c"), F.col("s"))))] == [(2, 3), None, None]
    found = near.likest_lines(spark.createDataFrame([(1, "return x + 1"), (1, "zzz")], "f int, t string"), spark.createDataFrame([(1, "return x+1")], "f int, t string"), ["f"], "t")
    assert [r[1] for r in rows(found)] == ["return x + 1"]


def test_graph(spark):
    e = spark.createDataFrame([(1, a, b) for a, b in ("ab", "bc", "cd", "de", "ca", "aa")] + [(1, "a", "x/*")], "taskid int, source_file string, imported_file string")
    got = {(r[1], r[2]): r[3] for r in rows(graph.reach(e, 3))}
    assert got[("a", "d")] == 3 and ("a", "e") not in got and ("a", "a") not in got and got[("c", "b")] == 2
    nodes = spark.createDataFrame([(1, "CALL", "cookie"), (2, "CALL", "x"), (3, "CALL", "setSecure"), (4, "CALL", "cookie")], "id int, label string, name string")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    assert [r[0] for r in rows(graph.unguarded(nodes, edges, F.col("name") == "cookie", F.col("name") == "setSecure", 2))] == [4]
    assert sorted(r[0] for r in rows(graph.unguarded(nodes, edges, F.col("name") == "cookie", F.col("name") == "setSecure", 1), "id")) == [1, 4]
    code = spark.createDataFrame([("import a.b.C;\n#include <stdio.h>\nfrom x import y\nconst z = require('q')\nrequire('p');",)], "c string")
    assert set(rows(code.select(graph.imports_of(F.col("c"))))[0][0]) == {"a.b.C", "stdio.h", "x", "p"}


CODE = {
    "java": ('String x = request.getParameter("a");\nRuntime.getRuntime().exec("sh " + x);', {"command-java"}),
    "python": ("x = request.args['a']\nos.system('ls ' + x)\n# os.system(x)", {"command-python"}),
    "php": ("$x = $_GET['a'];\necho $x;", {"xss-php"}),
    "c": ("char *p = getenv(\"A\");\nsystem(p);", {"command-c"}),
}


def test_rules(spark):
    files = spark.createDataFrame([(i, lang, code) for i, (lang, (code, _)) in enumerate(CODE.items())] + [(9, "java", 'Cookie c = new Cookie("a", "b");\nc.setHttpOnly(true);\nc.setSecure(true);'), (10, "java", None), (11, "java", "")], "id int, language string, content string")
    found = L.findings(files, ["id"])
    by = {}
    for r in found.collect():
        by.setdefault(r["id"], set()).add(r["rule_id"])
    assert by == {i: want for i, (_, want) in enumerate(w for w in CODE.values())}
    names = spark.createDataFrame([("命令注入 ", "中危")], "name_cn string, level string")
    done = L.finish(found.unionByName(found), ["id"], names)
    assert done.count() == 4 and done.filter("kind = '命令注入'").select("level").distinct().collect()[0][0] == "中危"


def test_rules_look_as_far_back_as_they_say(spark):
    def code(gap):
        return "p = sys.argv[1]\n" + "x\n" * (gap - 1) + "os.system(p)" + "\nx" * 30

    files = spark.createDataFrame([(g, "python", code(g)) for g in (1, 20, 21, 48, 49, 50, 80)], "id int, language string, content string")
    assert rows(L.findings(files, ["id"]).filter("rule_id = 'command-python'").select("id", "line_no"), "id") == [(g, g + 1) for g in (1, 20, 21, 48, 49)]
    near = [L.Rule(f"near{w}", "python", r"os\.system\(", r"sys\.argv", "", "k", "high", "", within=w) for w in (21, 60)]
    assert [r[0] for r in rows(L.findings(files, ["id"], near).select("id"), "id")] == [1, 1, 20, 20, 21, 48, 49, 50]
    safe = spark.createDataFrame([(g, "python", "shlex.quote(p)\n" + "x\n" * (g - 1) + "os.system(sys.argv[1])") for g in (20, 21, 40)], "id int, language string, content string")
    assert [r[0] for r in rows(L.findings(safe, ["id"]).select("id"), "id")] == [21, 40]


def test_known_findings_by_their_own_line(spark, tmp_path):
    from scanloom.plans import code

    text = "os.system(sys.argv[1])\n\nos.system(sys.argv[1])\nos.system(sys.argv[1])"
    found = [(1, 5, "src", "a.py", "[3, 4]", " 命令注入 "), (2, 5, "src", "a.py", "900", "SQL注入"), (3, 5, "lib", "a.py", "900", "命令注入"), (4, None, "src", "a.py", "1", "命令注入"), (5, 6, "src", "a.py", None, "命令注入")]
    df = spark.createDataFrame([(*r, text) for r in found], "id int, taskid int, filepath string, filename string, location string, vultype string, source_code string")
    df.write.parquet(str(tmp_path / "vulfile.parquet"))
    spark.createDataFrame([("命令注入", "高危")], "name_cn string, level string").write.parquet(str(tmp_path / "subvullist.parquet"))
    # Line 3 of src/a.py in task 5 is known, for both texts of that file; nothing else is, line 1 least of all.
    assert rows(code.rule_findings_finished(spark, str(tmp_path))) == [("命令注入", "高危", 2 * 2 + 3 * 3, 5)]
    names = spark.createDataFrame([("x", "y")], "name_cn string, level string")
    hits = L.findings(df.select("id", F.lit("python").alias("language"), F.col("source_code").alias("content")), ["id"])
    known = spark.createDataFrame([(1, 3, "命令注入"), (2, 2, "命令注入"), (3, 1, "SQL注入")], "id int, line_no int, kind string")
    assert rows(L.finish(hits, ["id"], names, known).filter("id <= 3").select("id", "line_no"), "id", "line_no") == [(1, 1), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 3), (3, 4)]


def test_calls_of_large_texts(spark, tmp_path):
    from scanloom.plans import code

    texts = [(1, "a.c", "f();\n" * 100_000 + "open(realpath(p));"), (2, "b.c", "open(p);")]
    spark.createDataFrame(texts, "id int, filename string, source_code string").write.parquet(str(tmp_path / "vulfile.parquet"))
    assert rows(code.calls(spark, str(tmp_path)), "name") == [("c", "call", "f", 100_000, 1), ("c", "call", "open", 2, 2), ("c", "call", "realpath", 1, 1)]
    assert rows(code.unguarded_calls(spark, str(tmp_path))) == [("open", 1, 1)]


def test_nodes():
    got = N.nodes_of('void run(String a) {\n  // exec(1)\n  String s = "exec(2)" + get("x");\n  rt.exec(s);\n}')
    assert [(n[1], n[2], n[5]) for n in got if n[1] != "string"] == [("function", "run", 1), ("call", "get", 3), ("call", "exec", 4)]
    assert [(n[2], n[5], n[8]) for n in got if n[1] == "function"] == [("run", 1, 5)]
    two = N.nodes_of("int a() {\n if (x) {\n  f();\n }\n}\ndef b(x):\n  g()\nvoid c() { h(); }")
    assert [(n[2], n[5], n[8]) for n in two if n[1] == "function"] == [("a", 1, 5), ("b", 6, None), ("c", 8, 8)]
    assert N.nodes_of("") == [] and N.nodes_of(')"(') == []
    assert N.nodes_of("f(" * 2000)[-1][0] == 1999


class Session:
    """As much of a session as is asked for where its master and folder matter."""

    def __init__(self, master, folder=None):
        self.said = {"spark.master": master, "spark.checkpoint.dir": folder}
        self.conf = self.sparkContext = self
        self.folder, self.defaultParallelism, self.sparkSession = None, 5, self

    def get(self, key, default=None):
        return self.said.get(key) or default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder

    def repartition(self, n):
        return n


def test_folders_and_parts_by_master():
    from scanloom.plans.lineage import ensure_checkpoint_dir
    from scanloom.plans.spread import spread

    for master, folder in (("local[4]", None), ("local[4]", "/x"), ("spark://h:7077", "/x"), ("local-cluster[3,2,1000]", "/x")):
        session = Session(master, folder)
        ensure_checkpoint_dir(session)
        assert session.folder and session.folder == (folder or session.folder)
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(Session(master))
        assert isinstance(spread(Session(master)), Session)
    assert spread(Session("local[5]")) == 5
