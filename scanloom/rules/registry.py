"""Rules as functions, called by the names that a table of active rules gives; an error of one rule on one text costs no other."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule takes (code, language) and gives (line, message) of what it finds.
Detector = Callable[[str, str | None], Sequence[tuple[int, str]]]
_KNOWN: dict[str, Detector] = {}
#: Names of rules that a job may ask for.
MOST_RULES = 10_000


def rule(name: str) -> Callable[[Detector], Detector]:
    """Register a function as the rule of that name."""

    def put(f: Detector) -> Detector:
        _KNOWN[name] = f
        return f

    return put


def active_names(policies: DataFrame, chosen: DataFrame, rules: DataFrame, language: str | None = None) -> DataFrame:
    """(name) of the rules that active policies choose: policies (policy_id, status), chosen (policy_id, rule_id), rules (rule_id,
    name, language); with a language only those for it and for all."""
    on = policies.filter("status = 1").select("policy_id").join(chosen, "policy_id").join(rules, "rule_id")
    return (on if language is None else on.filter(F.col("language").isin(language, "all"))).select("name").distinct()


def run(files: DataFrame, keys: Sequence[str], names: DataFrame, text: str = "content") -> DataFrame:
    """(keys, rule, line, message, error) of the rules named (name) over files (keys, language, text).

    A name that no function has gives one row a rule with an error and null keys; a rule that fails on a text gives one row for
    it with the error, and what it found there counts as nothing. A null text has no row. Lines outside the text are dropped.
    """
    wanted = sorted(r[0] for r in names.dropna().distinct().limit(MOST_RULES + 1).collect())
    if len(wanted) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    call = {n: _KNOWN[n] for n in wanted if n in _KNOWN}
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{kinds}, rule string, line int, message string, error string"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (language, code) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                n = len(code.splitlines()) if code is not None else 0
                for name, f in call.items() if code is not None else ():
                    try:
                        found = [(name, int(k), str(m), None) for k, m in f(code, language) if 1 <= k <= max(1, n)]
                    except Exception as e:  # noqa: BLE001
                        found = [(name, None, None, f"{type(e).__name__}: {e}")]
                    at += [i] * len(found)
                    out += found
            columns = list(zip(*out)) if out else [[]] * 4
            types = [pa.string(), pa.int32(), pa.string(), pa.string()]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keys))), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*keys, "rule", "line", "message", "error"])

    found = files.select(*keys, "language", text).mapInArrow(over, schema)
    missing = [(n, f"no rule {n!r}") for n in wanted if n not in _KNOWN]
    if not missing:
        return found
    rows = files.sparkSession.createDataFrame(missing, "rule string, error string")
    return found.unionByName(rows, allowMissingColumns=True)
