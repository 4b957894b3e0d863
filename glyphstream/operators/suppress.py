"""Overlap tests within a frame: exclusion, uncovered and coalesced scopes, suppression of duplicate observations.

A frame's boxes are what a detector returns for one image, a bounded number; greedy rules fold over that array, so nothing but the
grouping by frame is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

COVERED, EXCLUDED, SCOPE_EXCLUDED = 0.55, 0.35, 0.80


def excluded(box: G.Box, regions: list[tuple[float, float, float, float]], least: float = EXCLUDED) -> Column:
    """Do any of the pixel regions cover that share of the box?"""
    out = F.lit(False)
    for region in regions:
        out = out | (G.coverage(box, tuple(F.lit(float(v)) for v in region)) >= least)
    return out


def uncovered(scopes: Column, boxes: Column, least: float = COVERED) -> Column:
    """The scopes (structs with a box) that no box covers, or is covered by, to that share."""
    return F.filter(scopes, lambda s: ~F.exists(boxes, lambda b: G.either_covers(G.box_in(s), G.box_in(b)) >= least))


def greedy(items: Column, kind: str, drops: Callable[[Column, Column], Column]) -> Column:
    """The items kept, in order, each dropped if ``drops`` holds for it and any item kept before."""
    none = F.array().cast(f"array<{kind}>")
    return F.aggregate(items, none, lambda kept, x: F.when(F.exists(kept, lambda k: drops(x, k)), kept).otherwise(F.array_append(kept, x)))


def same_text(x: Column, kept: Column) -> Column:
    """Is an observation a duplicate or a fragment of a kept one of like height?"""
    a, b = G.box_in(x), G.box_in(kept)
    ha, hb = a[3] - a[1], b[3] - b[1]
    ratio = F.greatest(ha, hb) / F.greatest(F.least(ha, hb), F.lit(1e-6))
    return (G.iou(a, b) >= 0.75) | ((G.over_smaller(a, b) >= 0.80) & (ratio <= 2.20))


def same_scope(x: Column, kept: Column) -> Column:
    a, b = G.box_in(x), G.box_in(kept)
    return (G.iou(a, b) >= 0.75) | (G.coverage(a, b) >= 0.80)




def _sorted_boxes(df: DataFrame, keys: list[str], order: list[Column], id_column: str) -> DataFrame:
    """Groups with their boxes as structs sorted by descending ``order``, then by ascending id."""
    entry = F.struct(*[(-o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(id_column).alias("id"), *[F.col(c) for c in ("l", "t0", "r", "b0")])
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("items"))


def suppressed(df: DataFrame, keys: list[str], tier_priority: Column, id_column: str = "event_id") -> DataFrame:
    """keys and the ids of the observations that remain in each frame: larger boxes first, then by tier, confidence and id."""
    d = _sorted_boxes(df.withColumn("_p", tier_priority.cast("double")), keys, [G.area(G.box_cols()), F.col("_p"), F.col("confidence")], id_column)
    kind = d.schema["items"].dataType.elementType.simpleString()
    return d.select(*keys, F.explode(F.transform(greedy(F.col("items"), kind, same_text), lambda x: x["id"])).alias(id_column))


def coalesced(df: DataFrame, keys: list[str], id_column: str = "event_id") -> DataFrame:
    """keys and the ids of the scopes that remain: larger ones first, then by id."""
    d = _sorted_boxes(df, keys, [G.area(G.box_cols())], id_column)
    kind = d.schema["items"].dataType.elementType.simpleString()
    return d.select(*keys, F.explode(F.transform(greedy(F.col("items"), kind, same_scope), lambda x: x["id"])).alias(id_column))
