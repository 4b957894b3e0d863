"""Signatures of looks (difference bits in lanes) and quality scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference_lane(values: Column) -> Column:
    """Bits value[i + 1] > value[i] of up to 64 values as one BIGINT, the first difference highest."""
    n = F.size(values) - 1
    bits = F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), lambda a, b: F.when(b > a, 1).otherwise(0).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc * 2 + x)


def lane_distance(a: Column, b: Column, bits: int = 63) -> Column:
    """Share of differing bits; 1 where either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)) / float(bits), F.lit(1.0))


def lanes_distance(a: Column, b: Column, bits: int = 64) -> Column:
    """The same over arrays of lanes; 1 where they are empty or differ in number."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), differing / (F.size(a) * float(bits))).otherwise(F.lit(1.0))


def saturated(value: Column, half: float) -> Column:
    return value / (value + F.lit(half))


def sharpness(laplacian_variance: Column) -> Column:
    return saturated(laplacian_variance, 200.0)


def contrast(deviation: Column) -> Column:
    return saturated(deviation, 45.0)


def completeness(edges: Column, pixels: Column) -> Column:
    return F.least(F.lit(1.0), edges / F.greatest(F.lit(0.18) * pixels, F.lit(1.0)))


def occlusion(extremes: Column, pixels: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * extremes / pixels)


def quality(sharp: Column, contrast_: Column, complete: Column, occluded: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.40 * sharp + 0.25 * contrast_ + 0.25 * complete - 0.10 * occluded)


def motion_valid(inliers: Column, residual: Column, least: float = 0.45, most: float = 3.5) -> Column:
    return (inliers >= least) & (residual <= most)


def motion_confidence(inliers: Column, residual: Column, most: float = 3.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), inliers * (1.0 - residual / (2 * most))))
