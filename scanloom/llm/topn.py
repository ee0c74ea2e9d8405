"""The first N rows of every group, by score histograms.

A histogram of each group's scores gives a bound below which no row can be among the first N; rows
below it go before anything is ranked, so a group of a third of all rows sends a handful on. Bounds are broadcast as
long as they are few, so that rows go where they are read; only the rest is shuffled and ranked exactly, with all tie keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scanloom.plans.broadcasts import broadcast_if_small
from scanloom.plans.lineage import cut
from scanloom.plans.names import fresh

#: Distinct ids that one 64-bit mask is trusted to tell apart; above it, further masks are added.
_PER_MASK = 16


def _score(df: DataFrame, name: str) -> Column:
    """The column as a number, NaN as null."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def _bucket(score: Column, descending: bool, resolution: int) -> Column:
    """A whole number that never falls as the row's place gets better; null has the lowest."""
    x = score.cast("double")
    level = F.signum(x) * F.floor(F.log2(F.lit(1.0) + F.abs(x)) * resolution)
    level = F.greatest(F.lit(-1e9), F.least(F.lit(1e9), level)).cast("int")  # both pass over nulls
    return F.when(x.isNotNull(), level if descending else -level).otherwise(F.lit(-(2**31)))


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, bool]],
    id_col: str,
    n: int,
    resolution: int = 256,
    rank_col: str = "rank",
) -> DataFrame:
    """The first n distinct ids of every group, with all columns of df and their rank from 1.

    keys: the group; a row with a null key is in no group. order: (column, descending) of numbers,
    the most important first; null comes last either way and NaN counts as null; ties are broken by
    id_col ascending, so the result never depends on the layout. A repeated id counts once, with its
    best row; of rows alike in order and id any one is kept. An id that is null counts as one id,
    before all others. Groups of fewer than n ids come out whole; an empty df or n < 1 gives no row.
    Columns of df named like inner ones are no matter; one named rank_col is replaced.
    """
    if not keys or not order:
        raise ValueError("keys and order must not be empty")
    df = df.drop(rank_col)
    n_masks = max(1, -(-n // _PER_MASK))
    inner = fresh([*df.columns, rank_col], "tn_b1", "tn_b2", "tn_t1", "tn_t2", "tn_best", "tn_low", "tn_high", *(f"tn_k{i}" for i in range(len(keys))), *(f"tn_m{i}" for i in range(n_masks)))
    b1, b2, t1, t2, best, low, high = inner[:7]
    group, masks = inner[7 : 7 + len(keys)], inner[7 + len(keys) :]
    (first, first_desc), second = order[0], order[1] if len(order) > 1 else None
    rows = df.dropna(subset=list(keys)).withColumns(
        {b1: _bucket(_score(df, first), first_desc, resolution), b2: _bucket(_score(df, second[0]), second[1], 16) if second else F.lit(0)}
    )

    # Each cell keeps, as bits, which hash values its ids have: never more bits than distinct ids, and any number of copies of an id sets one.
    spot = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(64 * n_masks))
    one = F.lit(1).cast("bigint")
    cells = rows.groupBy(*[F.col(f"`{k}`").alias(g) for k, g in zip(keys, group)], b1, b2).agg(
        *[F.bit_or(F.when(F.floor(spot / 64) == i, F.call_function("shiftleft", one, F.pmod(spot, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("bigint"))).alias(m) for i, m in enumerate(masks)],
        F.min(_score(df, first)).alias(low),
        F.max(_score(df, first)).alias(high),
    )
    down = Window.partitionBy(*group).orderBy(F.desc(b1), F.desc(b2)).rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy(*group, b1)
    # Only where all rows of a first bucket have one value does the second bucket order them; else the bound takes the whole first bucket.
    exact = F.min(low).over(level).eqNullSafe(F.max(high).over(level))
    seen = cells.withColumns({m: F.bit_or(m).over(down) for m in masks}).withColumn(t2, F.when(exact, F.col(b2)).otherwise(F.lit(-(2**31))))
    enough = seen.filter(sum((F.bit_count(m) for m in masks), F.lit(0)) >= n)
    bounds = enough.groupBy(*group).agg(F.max(F.struct(b1, t2)).alias(t1)).select(*group, F.col(f"{t1}.{b1}").alias(t1), F.col(f"{t1}.{t2}").alias(t2))

    on = [F.col(f"`{k}`") == F.col(g) for k, g in zip(keys, group)]
    # Beyond the size for a broadcast the join is shuffled, and adaptive execution splits the rows of a hot group.
    kept = rows.join(broadcast_if_small(cut(bounds)), on, "left").filter(F.col(t1).isNull() | (F.col(b1) > F.col(t1)) | ((F.col(b1) == F.col(t1)) & (F.col(b2) >= F.col(t2))))
    by = [_score(df, c).desc_nulls_last() if desc else _score(df, c).asc_nulls_last() for c, desc in order]
    ids = F.col(f"`{id_col}`")
    part = [F.col(f"`{k}`") for k in keys]
    once = kept.withColumn(best, F.row_number().over(Window.partitionBy(*part, ids).orderBy(*by))).filter(F.col(best) == 1)
    ranked = once.withColumn(rank_col, F.row_number().over(Window.partitionBy(*part).orderBy(*by, ids.asc_nulls_first())))
    return ranked.filter(F.col(rank_col) <= n).select(*[F.col(f"`{c}`") for c in df.columns], rank_col)
