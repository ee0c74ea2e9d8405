"""Parts of the SQL that queries are checked against. Values are written out again, so that a wrong table in the library shows."""

from __future__ import annotations


def language(name: str) -> str:
    """The language that a file's name means."""
    return rf"""CASE lower(regexp_extract(regexp_extract(replace({name}, '\', '/'), '[^/]*$'), '\.([^.]+)$', 1))
    WHEN 'java' THEN 'java' WHEN 'jsp' THEN 'java' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hpp' THEN 'cpp'
    WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'ts' THEN 'javascript' WHEN 'vue' THEN 'javascript' WHEN 'php' THEN 'php'
    WHEN 'go' THEN 'go' WHEN 'cs' THEN 'csharp' WHEN 'rb' THEN 'ruby' WHEN 'xml' THEN 'xml' WHEN 'properties' THEN 'properties' WHEN 'yml' THEN 'yaml' WHEN 'yaml' THEN 'yaml' WHEN 'txt' THEN 'text' END"""


def level(col: str, unknown: str = "high") -> str:
    """A level in any of its spellings."""
    return f"CASE WHEN lower(trim({col})) IN ('高危', '高', 'high') THEN 'high' WHEN lower(trim({col})) IN ('中危', '中', 'medium') THEN 'medium' WHEN lower(trim({col})) IN ('低危', '低', 'low') THEN 'low' ELSE '{unknown}' END"


#: What marks a dangerous call, data from outside and the head of a function.
SINK = r"'\bsystem\(|\bexec\(|executeQuery|\.execute\(|mysqli_query|sendRedirect|\bpopen\(|\beval\('"
INPUT = r"'getParameter|argv|getenv|request\.|req\.|\$_GET|\$_POST|\$_COOKIE|scanf|recv\('"
HEADER = r"'^\s*(?:public|private|protected|static|def|function|int|void|bool|char|struct|async)\b[^;=]*\('"
