"""Source trees, archives, reports and streams."""

import zipfile

import pytest

from scanloom.sources import files
from scanloom.streaming import events


def test_source_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.java").write_bytes("﻿class X {} // 注释".encode())
    (tmp_path / "a" / "y.py").write_bytes("# 注释".encode("gbk"))
    (tmp_path / "a" / "z.dat").write_text("no")
    got = {r["language"]: r["content"] for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got == {"java": "class X {} // 注释", "python": "# 注释"}
    assert files.source_files(spark, str(tmp_path), ("python",)).count() == 1


def test_archives(tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("src/a.c", "int x;")
    assert files.unpack(str(z), str(tmp_path / "out")) == ["src/a.c"]
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("../evil.c", "x")
    with pytest.raises(ValueError):
        files.unpack(str(z), str(tmp_path / "out"))


def test_reports(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<cppncss><measure type="File"><item name="a.c"><value>1</value><value>10</value><value>4</value><value>2</value></item><item name="b.c"><value>2</value><value>5</value><value>1</value><value>0</value></item></measure></cppncss>')
    assert sorted(map(tuple, files.complexity_report(spark, str(tmp_path / "r.xml")).collect())) == [("a.c", 10, 4, 2), ("b.c", 5, 1, 0)]
    (tmp_path / "c.csv").write_bytes("name,level\n注入,高危\n".encode("gbk"))
    got = files.table_of_csv(spark, str(tmp_path / "c.csv"), "name string, level string")
    assert [tuple(r) for r in got.collect()] == [("注入", "高危")]
    assert files.as_json(got).collect()[0][0] == '{"name":"注入","level":"高危"}'


def test_lists_reports_and_graphs(spark, tmp_path):
    from scanloom.sources import reports

    rows = spark.createDataFrame([(" https://h/x/tool.git ", "main"), ("git@h:x/lib.git", None), ("note", "b"), (None, "b"), ("http://h/x/app/", ""), ("http://h/x/app/", "")], "u string, b string")
    assert sorted(map(tuple, reports.repositories(rows, "u", "b").collect())) == [("git@h:x/lib.git", "", "lib"), ("http://h/x/app/", "", "app"), ("https://h/x/tool.git", "main", "tool")]
    cells = spark.createDataFrame([(1, "src/A.java:12\nSink: exec()\nEnclosing Method: run\nSource: getParameter"), (2, "b.py:7"), (3, "no place"), (4, None)], "id int, t string")
    got = reports.scanner_findings(cells, "t").select("id", "file", "line", "sink", "enclosing_method", "source")
    assert sorted(map(tuple, got.collect())) == [(1, "src/A.java", 12, "exec()", "run", "getParameter"), (2, "b.py", 7, "", "", "")]
    (tmp_path / "n.csv").write_text(':ID,:LABEL,NAME,CODE\n1,CALL,f,"f(""a"",\nb)"\n2,LOCAL,x,\n,LOCAL,y,\n')
    (tmp_path / "e.csv").write_text(":START_ID,:END_ID,:TYPE\n1,2,AST\nx,2,AST\n")
    nodes, edges = reports.property_graph(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    assert sorted(tuple(r) for r in nodes.select("id", "label", "name", "code", "line").collect()) == [(1, "CALL", "f", 'f("a",\nb)', None), (2, "LOCAL", "x", None, None)]
    assert [tuple(r) for r in edges.collect()] == [(1, 2, "AST")]


def test_findings_written_by_task(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (3, None, "c")], "id int, taskid int, t string")
    for _ in range(2):
        files.write_findings(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 6 and back.filter("taskid = 5").select("id", "t").distinct().collect() == [(1, "a")]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 01:10:00", "b", 3.0)], "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    batch.write.parquet(str(tmp_path / "in"))
    stream = events.files_of(spark, str(tmp_path / "in"), batch.schema.simpleString()[7:-1].replace(":", " "))
    q = events.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, events.hourly(batch).collect()))
    again = events.files_of(spark, str(tmp_path / "in"), batch.schema.simpleString()[7:-1].replace(":", " "))
    events.append_to(events.once(again, "ts", ["event_type"], "2 hours"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
