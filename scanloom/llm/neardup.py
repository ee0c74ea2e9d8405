"""Pairs of records that share most of their token runs: a similarity join by rare runs.

In one order of all runs, the rarest first, two sets whose similarity is at least the threshold t have k common runs (k no
more than they must have in common) among the first |x| - ceil(2t|x|/(1+t)) + k runs of the smaller and the first
|y| - ceil(t|y|) + k of the larger. So every set stands at the runs of its long prefix and is at home at those of its short one;
sets that meet at k runs, one of them at home, are compared, and no pair can be missed. This is a prefix-filtered join, not
a covering code: the README says with figures why a covering can't give the required result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.plans.broadcasts import broadcast_if_small
from scanloom.plans.lineage import cut
from scanloom.plans.spread import spread

_EPS = 1e-9
#: Runs at which two sets must meet: chance meetings are mostly single, those of like sets many.
MEETINGS = 6
#: Bytes of text that are cut into tokens at a time, but for a longer text. Bears on memory only.
AT_ONCE = 2 << 20

_LETTERS = np.zeros(256, np.uint64)  # a number for each sign of a token, capitals as small letters, 0 for all else
_LETTERS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8)] = np.random.default_rng(20).integers(1, 1 << 63, 37, dtype=np.uint64)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, each bit made to depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs_of(data: np.ndarray, ends: np.ndarray, seeds: np.ndarray, width: int, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of runs of each text, the runs of all, rising within each): texts are the UTF-8 bytes of data between ends; 0 runs
    for a text of fewer than min_tokens tokens. Tokens are the longest runs of [A-Za-z0-9_], in lower case."""
    texts = len(ends) - 1
    value = _LETTERS[data]
    word = value != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = ends[:-1][np.diff(ends) > 0]
    first[begin] = word[begin]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(texts, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(word)
    which = np.cumsum(first[at]) - 1  # each sign's token
    place = at - starts[which]
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE))
    token = _mixed(np.add.reduceat(value[at] * powers[place], np.flatnonzero(first[at])))
    text = np.searchsorted(ends, starts, "right") - 1
    many = np.bincount(text, minlength=texts)
    n = len(token) - width + 1
    if n <= 0:
        return np.zeros(texts, np.int64), np.zeros(0, np.uint64)
    inside = (text[:n] == text[width - 1 :]) & (many[text[:n]] >= min_tokens)
    k = np.flatnonzero(inside)
    doc = text[k]
    run = seeds[doc]
    for j in range(width):
        run = _mixed(run + token[k + j] * _BASE)
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=texts), run[new]


def _records(df: DataFrame, id_col: str, text_col: str, group: Column | None, width: int, min_tokens: int) -> DataFrame:
    """(id, mark, enough, runs) of the rows that can have a pair at all, from one pass over the texts. mark is the same for the
    same text in the same group; enough says that it has min_tokens tokens; runs are hashes of its distinct runs of `width`
    consecutive tokens and of the group, none where the same batch has had them already."""
    named = group if group is not None else F.lit("")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), named.alias("named"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("named").isNotNull() & (F.length("text") >= 2 * min_tokens - 1))
    rows = rows.select("id", F.xxhash64("named", "text").alias("mark"), F.xxhash64("named").alias("grp"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(1).to_numpy()
            seeds = _mixed(batch.column(2).to_numpy().view(np.uint64))
            _, at, same = np.unique(marks, return_index=True, return_inverse=True)
            once, counts = np.zeros(len(marks), bool), np.zeros(len(marks), np.int64)
            once[at] = True
            texts = batch.column(3)
            sizes = np.where(once, pc.binary_length(texts).to_numpy(), 0)
            part = np.cumsum(sizes) // AT_ONCE
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(marks)]
            for a, b in zip(bounds, bounds[1:]):
                own = once[a:b]
                here = pa.concat_arrays([texts.slice(a, b - a).filter(pa.array(own))])
                ends = np.concatenate([[0], np.cumsum(pc.binary_length(here).to_numpy())]).astype(np.int64)
                data = np.frombuffer(b"".join(here.to_pylist()), np.uint8)
                many, runs = _runs_of(data, ends, seeds[a:b][own], width, min_tokens)
                counts[a:b][own] = many
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[a:b])]).astype(np.int32)), pa.array(runs.view(np.int64)))
                enough = pa.array(counts[at[same[a:b]]] > 0)  # a copy's first stands before it
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), enough, lists], names=["id", "mark", "enough", "runs"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"id {kind}, mark bigint, enough boolean, runs array<bigint>")


def _counted(buckets: int):
    """A mapInArrow function (runs) -> (b, n): how many runs fall into each bucket, once for each part of the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (buckets - 1), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])

    return run


def _prefixes(t: float, k: int, table: np.ndarray):
    """A mapInArrow function (mark, runs) -> (anchor, mark, n, pos, home): the runs of the long prefix, home those of the short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = len(table) - 1
        for batch in batches:
            lists = batch.column(1)
            h = lists.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
            if not len(h):
                continue
            doc = np.repeat(np.arange(len(n)), n)
            at = np.lexsort((h, table[h & mask], doc))
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            size = np.repeat(n, n)
            long = size - np.ceil(t * size - _EPS).astype(np.int64) + k
            short = size - np.ceil(2 * t / (1 + t) * size - _EPS).astype(np.int64) + k
            take = pos < long
            at, pos, size, home = at[take], pos[take], size[take], (pos < short)[take]
            marks = batch.column(0).take(pa.array(doc[take]))
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), marks, pa.array(size.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(home)], names=["anchor", "mark", "n", "pos", "home"])

    return run


def _links(df: DataFrame, id_col: str, text_col: str, group: Column | None, threshold: float, width: int, min_tokens: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(mark_a, mark_b, similarity) of the texts that are alike, each pair once, and (id, mark) of all records with enough tokens."""
    if not 0 < threshold <= 1 or width < 1 or min_tokens < width or buckets & (buckets - 1):
        raise ValueError("0 < threshold <= 1, 1 <= width <= min_tokens and buckets a power of two must hold")
    records = cut(_records(df, id_col, text_col, group, width, min_tokens))
    runs = records.filter(F.size("runs") > 0).select("mark", "runs")
    counts = runs.select("runs").mapInArrow(_counted(buckets), "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(buckets, np.int64)
    table[counts.column("b").to_numpy()] = counts.column("n").to_numpy()
    stands = runs.mapInArrow(_prefixes(threshold, MEETINGS, table), "anchor bigint, mark bigint, n int, pos int, home boolean")

    # Most anchors are runs that occur once; only those where somebody can meet somebody go on.
    here = Window.partitionBy("anchor")
    once = stands.repartition("anchor").dropDuplicates(["anchor", "mark"])
    met = cut(once.withColumns({"all": F.count("*").over(here), "homes": F.max("home").over(here)}).filter((F.col("all") > 1) & F.col("homes")).drop("all", "homes"))
    a, b = met.filter("home").alias("a"), met.alias("b")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - _EPS)
    meet = (
        (F.col("a.anchor") == F.col("b.anchor"))
        & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.mark") < F.col("b.mark"))))
        & (F.col("a.n") >= F.lit(threshold) * F.col("b.n") - _EPS)
        & (F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= need - (MEETINGS - 1))
    )
    meetings = a.join(b, meet).groupBy(F.col("a.mark").alias("mark_a"), F.col("b.mark").alias("mark_b")).agg(F.count("*").alias("met"), F.min(need).alias("need"))
    candidates = cut(meetings.filter(F.col("met") >= F.least(F.lit(MEETINGS), F.col("need"))).select("mark_a", "mark_b"))

    # The sets of the candidates alone go on to be compared.
    named = cut(candidates.select(F.explode(F.array("mark_a", "mark_b")).alias("mark")).distinct())
    sets = cut(runs.join(broadcast_if_small(named), "mark").dropDuplicates(["mark"]))
    both = candidates.join(sets.select(F.col("mark").alias("mark_a"), F.col("runs").alias("x")), "mark_a").join(sets.select(F.col("mark").alias("mark_b"), F.col("runs").alias("y")), "mark_b")
    common = F.size(F.array_intersect("x", "y"))
    like = both.select("mark_a", "mark_b", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)
    return cut(like), records.filter("enough").select("id", "mark").distinct()


def near_duplicate_pairs(
    df: DataFrame,
    id_col: str,
    text_col: str,
    group: Column | None = None,
    threshold: float = 0.8,
    width: int = 5,
    min_tokens: int = 30,
    buckets: int = 1 << 18,
) -> DataFrame:
    """(id_a, id_b, similarity) of all pairs of ids of one group whose sets of token runs have that similarity
    (size of intersection over size of union) or more; id_a < id_b, each pair once.

    A null, empty or short text (fewer than min_tokens tokens) and a null id or group have no pair. An id
    delivered again is one record; should its texts differ, the likest counts. Exact copies are found by hash and compared
    once for all of them; a text may be of any length. Texts and runs are compared by 64-bit hash. buckets (a
    power of two) is the size of the table of counts that ranks runs by rarity; it is counted over all
    records, is all that the driver and every task hold of the corpus, and bears on speed only. Extra
    columns are not read. Where many exact copies make all their pairs too many, near_duplicate_classes says the same without them.
    """
    like, members = _links(df, id_col, text_col, group, threshold, width, min_tokens, buckets)
    of_a, of_b = (members.select(F.col("mark").alias(f"mark_{s}"), F.col("id").alias(s)) for s in ("a", "b"))
    between = like.join(of_a, "mark_a").join(of_b, "mark_b").select("a", "b", "similarity")
    within = of_a.join(of_b, F.col("mark_a") == F.col("mark_b")).select("a", "b", F.lit(1.0).alias("similarity"))
    pairs = between.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity").unionByName(within.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "similarity"))
    return pairs.filter(F.col("id_a") < F.col("id_b")).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def near_duplicate_classes(
    df: DataFrame,
    id_col: str,
    text_col: str,
    group: Column | None = None,
    threshold: float = 0.8,
    width: int = 5,
    min_tokens: int = 30,
    buckets: int = 1 << 18,
) -> DataFrame:
    """(id, class_id, n_links) of every record with enough tokens: class_id is the least id of the exact copies of its text in
    its group, n_links the number of other records that it is like by near_duplicate_pairs, copies among them. Nothing grows
    with the square of the number of copies. An id whose texts differ has a row for each; else as near_duplicate_pairs.
    """
    like, members = _links(df, id_col, text_col, group, threshold, width, min_tokens, buckets)
    copies = members.groupBy("mark").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    ends = like.select(F.col("mark_a").alias("mark"), F.col("mark_b").alias("other")).unionByName(like.select(F.col("mark_b").alias("mark"), F.col("mark_a").alias("other")))
    linked = ends.join(copies.select(F.col("mark").alias("other"), "n"), "other").groupBy("mark").agg(F.sum("n").alias("further"))
    of = copies.join(linked, "mark", "left").select("mark", "class_id", (F.col("n") - 1 + F.coalesce("further", F.lit(0))).alias("n_links"))
    return members.join(of, "mark").select("id", "class_id", "n_links")
