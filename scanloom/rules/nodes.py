"""Code as a table of calls, strings and functions, by one scanner for all the languages.

The scanner knows strings and comments, so that what stands in them is no call. One pass, Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|(?<![\w$])\#(?!\s*(?:include|define|if|endif|else|pragma))[^\n]*)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)
    |(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*)
    |(?P<line>\n)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<other>[^\s])""",
    re.X | re.S,
)
_WORDS = {"if", "for", "while", "switch", "catch", "return", "foreach", "elif", "else", "new", "sizeof", "throw", "function", "def", "and", "or", "not", "in", "is", "with", "assert", "except", "print"}
#: What comes between the parameters of a function and its body.
_BODY = re.compile(r"\s*(?:throws [\w., ]+)?\s*(?:const\s*)?[{:]")
SCHEMA = "node_id int, kind string, name string, qualifier string, args string, line int, method string, in_args_of int, end_line int"


def nodes_of(code: str) -> list[tuple]:
    """(node_id, kind, name, qualifier, args, line, method, in_args_of, end_line) of the calls, functions and strings of a text; end_line
    is where the braces of a function's body close, null for all else and for bodies without braces."""
    out: list[list] = []
    line, method = 1, None
    opened: list[tuple[int | None, int, int | None, int | None]] = []  # call whose arguments it holds, where it opened, the call around, function
    header: int | None = None  # the function whose body comes next
    before: tuple[str, str, int] | None = None
    for m in _TOKEN.finditer(code):
        kind, text = m.lastgroup, m[0]
        if kind == "line":
            line += 1
            continue
        holder = opened[-1][2] if opened else None
        if kind == "comment":
            line += text.count("\n")
            continue
        if kind == "string":
            out.append([len(out), "string", text[1:-1], None, None, line, method, holder, None])
            line += text.count("\n")
        elif kind == "open":
            call = None
            if text == "(" and before and before[0] == "name":
                full = before[1]
                parts = re.split(r"\.|->|::", full)
                if parts[-1] not in _WORDS:
                    call = len(out)
                    out.append([call, "call", parts[-1], ".".join(parts[:-1]) or None, "", before[2], method, holder, None])
            body, header = (header, None) if text == "{" else (None, header)
            opened.append((call, m.end(), holder if call is None else call, body))
        elif kind == "close" and opened:
            call, start, _, body = opened.pop()
            if body is not None:
                out[body][8] = line
            if call is not None:
                out[call][4] = code[start : m.start()].strip()
                if not out[call][3] and _BODY.match(code, m.end()):
                    out[call][1] = "function"
                    method = out[call][2]
                    out[call][6] = method
                    header = call
        before = (kind, text, line)
    return [tuple(x) for x in out]


def nodes(files: DataFrame, keys: Sequence[str], text: str = "content") -> DataFrame:
    """(keys, language, nodes' columns) of files (keys, language, text); a null text has none."""
    kept = [*keys, "language"]
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, code in enumerate(batch.column(len(kept)).to_pylist()):
                for n in nodes_of(code or ""):
                    rows.append(i)
                    found.append(n)
            at = pa.array(rows, pa.int64())
            columns = list(zip(*found)) if found else [[]] * 9
            types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(kept))), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*kept, *(f.split()[0] for f in SCHEMA.split(", "))])

    return files.select(*kept, text).mapInArrow(run, f"{kinds}, {SCHEMA}")


def calls_with(table: DataFrame, callee: Column, argument: Column) -> DataFrame:
    """Calls that meet both conditions: a sink and what it is given."""
    return table.filter((F.col("kind") == "call") & callee & argument)


def unless_guarded(found: DataFrame, table: DataFrame, keys: Sequence[str], guard: Column) -> DataFrame:
    """What was found, but for methods that also have a call that guards them."""
    on = [*keys, "method"]
    guards = table.filter((F.col("kind") == "call") & guard).select(*on).distinct()
    cond = None
    g = guards.select(*[F.col(c).alias(f"g_{c}") for c in on])
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"g_{c}"))
        cond = same if cond is None else cond & same
    return found.join(g, cond, "left_anti")


def tainted_calls(table: DataFrame, keys: Sequence[str], source: Column, sink: Column) -> DataFrame:
    """Calls that meet `sink` in whose method a call that meets `source` came before."""
    first = table.filter((F.col("kind") == "call") & source).groupBy(*keys, "method").agg(F.min("node_id").alias("first"))
    g = first.select(*[F.col(c).alias(f"g_{c}") for c in [*keys, "method"]], "first")
    cond = F.col("node_id") > F.col("first")
    for c in [*keys, "method"]:
        cond = cond & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return table.filter((F.col("kind") == "call") & sink).join(g, cond, "left_semi")
