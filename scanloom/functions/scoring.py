"""Linear scorers over vectors, in built-in functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(vector: Column, weights: Sequence[float]) -> Column:
    """The sum of products; null if the vector is null, has a null or isn't as long as the weights."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    total = F.aggregate(F.zip_with(vector, w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(vector) == len(weights), total)


def labels(vector: Column, heads: Mapping[str, tuple[Sequence[float], float]], least: float = 0.5, none: str | None = None) -> Column:
    """The names, in order, of the heads (weights, bias) whose sigmoid is above `least`; without those named none."""
    named = [F.when(1 / (1 + F.exp(-(dot(vector, w) + b))) > least, F.lit(name)) for name, (w, b) in heads.items() if name != none]
    return F.when(vector.isNotNull(), F.array_compact(F.array(*named)))


def best_of(vector: Column, heads: Mapping[str, tuple[Sequence[float], float]]) -> Column:
    """(name, probability) of the head with the greatest share of the softmax; of equals the first by name."""
    score = {n: dot(vector, w) + b for n, (w, b) in heads.items()}
    top = F.greatest(*score.values()) if len(score) > 1 else next(iter(score.values()))
    total = sum((F.exp(s - top) for s in score.values()), F.lit(0.0))
    name = F.coalesce(*[F.when(score[n] == top, F.lit(n)) for n in sorted(score)])
    return F.when(top.isNotNull(), F.struct(name.alias("name"), (1 / total).alias("probability")))
