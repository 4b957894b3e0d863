"""Association of a frame's tracks with its observations: greedy one-to-one matching by cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

LEAST_IOU, MOST_DISTANCE = 0.25, 0.20


def cost(track: G.Box, seen: G.Box, diagonal: float) -> tuple[Column, Column]:
    """(cost, may they match?) of a predicted box and an observed one."""
    overlap = G.iou(track, seen)
    distance = F.hypot((seen[0] + seen[2]) / 2 - (track[0] + track[2]) / 2, (seen[1] + seen[3]) / 2 - (track[1] + track[3]) / 2) / F.lit(max(1.0, diagonal))
    return 0.7 * (1.0 - overlap) + 0.3 * distance, (overlap >= LEAST_IOU) | (distance <= MOST_DISTANCE)


def greedy_pairs(pairs: Column) -> Column:
    """One-to-one matches of sorted pairs (structs with a and b): each pair whose ends are both free is taken."""
    start = F.struct(F.array().cast("array<bigint>").alias("a"), F.array().cast("array<bigint>").alias("b"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("taken"))

    def take(s: Column, p: Column) -> Column:
        free = ~F.array_contains(s["a"], p["a"]) & ~F.array_contains(s["b"], p["b"])
        return F.when(free, F.struct(F.array_append(s["a"], p["a"]).alias("a"), F.array_append(s["b"], p["b"]).alias("b"), F.array_append(s["taken"], F.struct(p["a"].alias("a"), p["b"].alias("b"))).alias("taken"))).otherwise(s)

    return F.aggregate(pairs, start, take, lambda s: s["taken"])


def step(frames: DataFrame, keys: list[str], tracks: str, seen: str, diagonal: float) -> DataFrame:
    """One step of a frame: (keys, tracks, seen: arrays of structs id, l, t0, r, b0) -> keys, track, observation; an unmatched observation has a null
    track, as it begins one, and an unmatched track a null observation. The arrays are those of one frame."""
    pairs = F.flatten(F.transform(tracks, lambda a: F.transform(seen, lambda b: F.struct(*(c.alias(n) for c, n in zip(cost(G.box_in(a), G.box_in(b), diagonal), ("cost", "ok"))), a["id"].alias("a"), b["id"].alias("b")))))
    taken = greedy_pairs(F.array_sort(F.filter(pairs, lambda p: p["ok"])))
    d = frames.withColumn("_taken", taken)
    row = lambda a, b: F.struct(a.cast("bigint").alias("track"), b.cast("bigint").alias("observation"))
    none = F.lit(None)
    free_seen = F.transform(F.filter(seen, lambda b: ~F.exists("_taken", lambda p: p["b"] == b["id"])), lambda b: row(none, b["id"]))
    free_tracks = F.transform(F.filter(tracks, lambda a: ~F.exists("_taken", lambda p: p["a"] == a["id"])), lambda a: row(a["id"], none))
    rows = F.concat(F.transform("_taken", lambda p: row(p["a"], p["b"])), free_seen, free_tracks)
    return d.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.track", "_r.observation")
