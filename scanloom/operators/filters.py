"""Filters built from what a caller gives, and pages of a result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of those that are given; true of none."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def matching(contains: Mapping[str, str | None] | None = None, equals: Mapping[str, object] | None = None) -> Column:
    """Each given text stands in its column as it is (no wildcards), each given value equals it; None and "" ask nothing."""
    return all_of(
        *(F.col(c).contains(F.lit(v)) for c, v in (contains or {}).items() if v not in (None, "")),
        *(F.col(c) == F.lit(v) for c, v in (equals or {}).items() if v is not None),
    )


def in_year(ts: str, year: int) -> Column:
    """A time in a year, as a range, so that the scan can use it."""
    return (F.col(ts) >= F.lit(datetime(year, 1, 1))) & (F.col(ts) < F.lit(datetime(year + 1, 1, 1)))


def strictly_between(col: str, low: object, high: object) -> Column:
    """Between two bounds that don't count themselves."""
    return (F.col(col) > F.lit(low)) & (F.col(col) < F.lit(high))


def in_scope(scope: str, holds: Column) -> Column:
    """A row for all (scope 0), or for some (scope 1) where `holds`."""
    return (F.col(scope) == 0) | ((F.col(scope) == 1) & F.coalesce(holds, F.lit(False)))


def defaults(df: DataFrame, **values: object) -> DataFrame:
    """df with a default, a value or a column, in place of null and empty texts of the columns named."""
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), v if isinstance(v, Column) else F.lit(v)) for c, v in values.items()})


def rank_in(col: Column, values: Sequence[str]) -> Column:
    """The place of a value in a list that gives an order, from 0 on; what isn't listed comes after all that is."""
    out = F.lit(len(values))
    for k, v in reversed(list(enumerate(values))):
        out = F.when(col == v, F.lit(k)).otherwise(out)
    return out


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page from 1 on; order must end with a unique column, else pages may overlap."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
