"""Column names that clash with nothing in the input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def fresh(taken: DataFrame | Iterable[str], *bases: str) -> list[str]:
    """For each base a name that no column of taken has, compared without case as Spark does."""
    used = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    out = []
    for base in bases:
        name = base
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
