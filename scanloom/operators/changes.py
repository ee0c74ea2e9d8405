"""Differences of two sets, and tables as they are after a change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync(current: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of current to delete, rows of wanted to add), by keys."""
    return current.join(wanted, list(keys), "left_anti"), wanted.join(current, list(keys), "left_anti")


def without(table: DataFrame, doomed: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """table without the rows whose columns (keys of on) equal those of doomed (values of on)."""
    gone = doomed.select(*[F.col(theirs).alias(f"gone_{ours}") for ours, theirs in on.items()])
    return table.join(gone, [table[ours] == gone[f"gone_{ours}"] for ours in on], "left_anti")


def cascade(projects: DataFrame, tasks: DataFrame, findings: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects, their tasks and their findings after the projects of doomed (itemid) are deleted."""
    lost = tasks.join(doomed.select("itemid"), "itemid", "left_semi").select("taskid")
    return without(projects, doomed, {"itemid": "itemid"}), without(tasks, doomed, {"itemid": "itemid"}), without(findings, lost, {"taskid": "taskid"})


def updated(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with the values of changes where they aren't null, by keys that are unique in changes."""
    given = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in given])
    both = table.join(new, list(keys), "left")
    return both.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in table.columns])


def activated(table: DataFrame, chosen: Column, flag: str) -> DataFrame:
    """table with flag 1 on the rows chosen and 0 on all others, so that no more than those are active."""
    return table.withColumn(flag, F.when(chosen, F.lit(1)).otherwise(F.lit(0)))


def children_replaced(table: DataFrame, children: DataFrame, parent: str) -> DataFrame:
    """table with the children given in place of all that their parents had; other parents keep theirs, null among them."""
    return table.join(children.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(children)


def change_log(table: DataFrame, changes: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, old_value, new_value) where changes give the column another value, null counting as one."""
    old = table.select(*keys, F.col(column).alias("old_value"))
    new = changes.select(*keys, F.col(column).alias("new_value")).filter(F.col("new_value").isNotNull())
    return new.join(old, list(keys)).filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(*keys, "old_value", "new_value")
