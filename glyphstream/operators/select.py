"""Choice of candidates: the best one, and the best complementary few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signature import lane_distance


def best(df: DataFrame, keys: list[str], quality: str, order: str) -> DataFrame:
    """The row of highest quality per key, the first in order among equals."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(quality), -F.col(order))).alias("_best")).select(*keys, "_best.*")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def complementary(items: Column, kind: str, limit: int = 3, weight: float = 0.35) -> Column:
    """Folds candidates (structs n, id, sig, complete, quality in order) into the pool of ``limit`` kept so far, one by one: while they fit they
    are sorted by quality; after, the best one seeds and each next adds the most quality and difference. Ties keep pool order."""

    def first_best(pool: Column, score) -> Column:
        keyed = F.transform(pool, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("x")))
        return F.array_min(keyed)["x"]

    def fold(kept: Column, x: Column) -> Column:
        return bound(F.array_append(kept, x), lambda pool: F.when(F.size(pool) <= limit, _sorted(pool)).otherwise(bound(first_best(pool, lambda p: p["quality"]), lambda seed: _chosen(pool, seed))))

    def _sorted(pool: Column) -> Column:
        return F.transform(F.array_sort(F.transform(pool, lambda p, i: F.struct((-p["quality"]).alias("s"), i.alias("i"), p.alias("x")))), lambda k: k["x"])

    def _chosen(pool: Column, seed: Column) -> Column:
        chosen = F.array(seed)
        for _ in range(limit - 1):
            chosen = bound(chosen, lambda kept: _add(pool, kept, seed))
        return chosen

    def _add(pool: Column, chosen: Column, seed: Column) -> Column:
        left = F.filter(pool, lambda p: ~F.exists(chosen, lambda c: c["n"] == p["n"]))
        gain = lambda p: p["quality"] + weight * (0.7 * F.array_min(F.transform(chosen, lambda c: lane_distance(p["sig"], c["sig"]))) + 0.3 * F.abs(p["complete"] - seed["complete"]))
        return F.array_append(chosen, first_best(left, gain))

    return F.aggregate(items, F.array().cast(f"array<{kind}>"), fold)
