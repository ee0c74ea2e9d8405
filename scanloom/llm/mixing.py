"""Mixing sources to target shares of the total size, by entropy balancing.

Of all rates at which the documents can be used, those nearest to once each (in relative entropy) that give each source its
size are exponentially tilted: min(cap, exp(lambda_s * size)). The dual has one lambda for a source; Newton steps find all of
them at once, each step one aggregation over cells of documents alike in source and size. Rates become whole
copies by systematic rounding in order of size, so that what a source gets differs from its due by about a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.plans.lineage import cut
from scanloom.plans.names import fresh

#: Documents of one source and size are spread over cells, 16 at least, so many that a cell holds about this many at most.
_CELL = 1 << 16
#: Sizes up to this are their own level; above, 64 levels for each doubling.
_FINE = 4096
#: More sources than this are refused: their numbers are held by the driver and sent to every task.
_MOST_SOURCES = 10_000
#: Newton steps, then halvings of the interval, before a source that still misses its size is an error.
_STEPS, _HALVINGS = 60, 200


def _level(size: Column) -> Column:
    step = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) - 6)
    width = F.call_function("power", F.lit(2.0), step)
    return F.when(size <= _FINE, size.cast("double")).otherwise(F.floor(size / width) * width)


def _by_source(df: DataFrame, values: dict[str, tuple], schema: str) -> DataFrame:
    """df with the columns that values has for its source; sources without any go. No more than _MOST_SOURCES are sent."""
    rows = df.sparkSession.createDataFrame([(s, *v) for s, v in values.items()], f"source string, {schema}")
    return df.join(F.broadcast(rows), "source")


def balanced_rates(sums: DataFrame, due: dict[str, float], caps: dict[str, int], steps: int = _STEPS, tolerance: float = 1e-9) -> dict[str, float]:
    """lambda of each source, from cells (source, x, size): safeguarded Newton steps on the dual; a source that hasn't met its
    due after `steps` of them goes on by halving the interval. One that even so misses it by more than a millionth is an error.

    x is the level of a cell's documents over the mean size, size their sum of sizes. A source whose due isn't
    below all it can give has lambda infinity: every document as often as its cap. A due of 0 has minus infinity.
    """
    all_of = {r["source"]: float(r["size"]) for r in sums.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    out, low, high, now, missed = {}, {}, {}, {}, {}
    for s, have in all_of.items():
        if due[s] <= 0:
            out[s] = -math.inf
        elif due[s] >= caps[s] * have * (1 - 1e-12):
            out[s] = math.inf
        else:
            low[s], high[s], now[s] = -math.inf, math.inf, math.log(due[s] / have) if due[s] != have else 0.0
    for k in range(steps + _HALVINGS):
        if not now:
            break
        free = F.exp(F.least(F.col("lam") * F.col("x"), F.lit(600.0)))
        got = (
            _by_source(sums, {s: (v, float(caps[s])) for s, v in now.items()}, "lam double, cap double")
            .groupBy("source")
            .agg(F.sum(F.least(free, F.col("cap")) * F.col("size")).alias("g"), F.sum(F.when(free < F.col("cap"), free * F.col("x") * F.col("size")).otherwise(0.0)).alias("h"))
            .collect()
        )
        for r in got:
            s, miss = r["source"], r["g"] - due[r["source"]]
            missed[s] = abs(miss) / due[s]
            if missed[s] <= tolerance or not low[s] < now[s] < high[s]:
                out[s] = now.pop(s)
                continue
            if miss < 0:
                low[s] = now[s]
            else:
                high[s] = now[s]
            step = now[s] - miss / r["h"] if r["h"] > 0 and k < steps else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else now[s] + (1 if miss < 0 else -1) * max(1.0, abs(now[s]))
            now[s] = step
    bad = sorted(s for s, m in missed.items() if m > 1e-6)
    if bad:
        raise ArithmeticError(f"no rates give these sources their sizes: {bad}")
    return out | now


def mix_sources(
    df: DataFrame,
    id_col: str,
    source_col: str,
    size_col: str,
    targets: DataFrame,
    total: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of the documents of df, for targets (source, target_share, max_repeats).

    mix: id_col, source, size, copies (1 to max_repeats) of each document in the mix. report: for every source of
    df or targets its target_share, max_repeats, documents, size, mixed_documents, mixed_size and actual_share of the total
    mixed. Sources are compared without spaces at both ends and in lower case. Documents with no source, with one
    that has no target, or with no size are not mixed. Shares of targets without documents are
    spread over the others in proportion. total is the size of the mix; by default the largest, but no
    more than all documents with a target have, at which every source keeps its share within its cap; beyond that, sources at
    their cap fall short, as the report shows. Repeated rows are documents of their own; a null or negative size is none.
    Empty tables give an empty mix.
    """
    source, size, level, spot, n, start, rate, k = fresh([id_col, "cap", "lam"], "source", "size", "x", "spot", "n", "start", "rate", "k")
    if (source, size) != ("source", "size") or id_col.lower() in ("cap", "lam"):
        raise ValueError("id_col must not be named source, size, cap or lam")
    name = F.lower(F.trim(F.col(f"`{source_col}`")))
    docs = cut(df.select(F.col(f"`{id_col}`"), F.when(name != "", name).alias("source"), F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("size")))
    goal = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).filter("source is not null and target_share > 0 and max_repeats > 0")
    goal = goal.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = goal.limit(_MOST_SOURCES + 1).collect()
    if len(rows) > _MOST_SOURCES:
        raise ValueError(f"more than {_MOST_SOURCES} sources")
    used = docs.filter(F.col("size") > 0).join(F.broadcast(goal.select("source")), "source", "left_semi")
    have = {r["source"]: r["size"] for r in used.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    caps = {r["source"]: r["max_repeats"] for r in rows if r["source"] in have}
    shares = {r["source"]: r["target_share"] for r in rows if r["source"] in have}
    whole = sum(shares.values()) or 1.0
    shares = {s: v / whole for s, v in shares.items()}
    if total is None:
        total = min([sum(have.values()), *(caps[s] * have[s] / shares[s] for s in shares)])
    due = {s: total * v for s, v in shares.items()}

    many = used.count()
    spread = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(max(16, -(-many // _CELL)))).cast("int")
    cells = cut(used.groupBy("source", _level(F.col("size")).alias(level), spread.alias(spot)).agg(F.sum("size").alias("size"), F.count("*").alias(n)))
    mean = sum(have.values()) / max(1, many)
    lam = balanced_rates(cells.select("source", (F.col(level) / F.lit(mean)).alias("x"), "size"), due, caps)
    known = {s: (float(max(-1e6, min(1e6, v))), float(caps[s])) for s, v in lam.items()}
    per = F.least(F.col("cap"), F.exp(F.least(F.col("lam") * F.col(level) / F.lit(mean), F.lit(600.0))))
    rated = _by_source(cells.select("source", level, spot, n), known, "lam double, cap double").select("source", level, spot, n, per.alias(rate), F.col("cap").cast("int").alias("cap"))
    before = Window.partitionBy("source").orderBy(level, spot).rowsBetween(Window.unboundedPreceding, -1)
    placed = rated.withColumn(start, F.coalesce(F.sum(F.col(n) * F.col(rate)).over(before), F.lit(0.0)) + 0.5)
    inside = Window.partitionBy("source", level, spot).orderBy(F.xxhash64(F.col(f"`{id_col}`")), F.col(f"`{id_col}`"))
    numbered = used.withColumns({level: _level(F.col("size")), spot: spread}).withColumn(k, F.row_number().over(inside))
    reach = F.col(start) + F.col(k) * F.col(rate)
    # A hair above a whole number must not cost or give a copy where the rate is whole.
    copies = (F.floor(reach + 1e-7) - F.floor(reach - F.col(rate) + 1e-7)).cast("int")
    mix = cut(numbered.join(placed, ["source", level, spot]).select(f"`{id_col}`", "source", "size", F.least(copies, F.col("cap")).alias("copies")).filter("copies > 0"))

    got = mix.groupBy("source").agg(F.count("*").alias("mixed_documents"), F.sum(F.col("size") * F.col("copies")).alias("mixed_size"))
    there = docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("size"))
    counts = ["documents", "size", "mixed_documents", "mixed_size"]
    parts = there.unionByName(goal, allowMissingColumns=True).unionByName(got, allowMissingColumns=True).groupBy("source")
    report = parts.agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    mixed = got.agg(F.sum("mixed_size")).first()[0] or 0
    return mix, report.withColumn("actual_share", F.col("mixed_size") / F.lit(float(max(1, mixed))))
