"""Geometry as column expressions: boxes (l, t, r, b) and quads (arrays of four points)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

QUAD = "array<struct<x:double,y:double>>"
Box = tuple[Column, Column, Column, Column]


def validated_regions(regions) -> tuple[tuple[float, float, float, float], ...]:
    """Distinct normalised rectangles (left, top, right, bottom) in order; ValueError where one is not within the unit square."""
    found: dict[tuple[float, float, float, float], None] = {}
    for region in regions or ():
        values = tuple(float(v) for v in region)
        if len(values) != 4 or not all(map(math.isfinite, values)):
            raise ValueError(f"a region takes four finite numbers, not {region!r}")
        left, top, right, bottom = values
        if not (0 <= left < right <= 1 and 0 <= top < bottom <= 1):
            raise ValueError(f"a region lies within the unit square, with left < right and top < bottom, unlike {region!r}")
        found[values] = None
    return tuple(found)


def region_box(region: Box, width: Column, height: Column) -> Box:
    """Pixels of a normalised rectangle, clamped to the frame."""
    clamp = lambda v, hi: F.greatest(F.lit(0.0), F.least(v * hi, hi.cast("double")))
    left, top, right, bottom = region
    return clamp(left, width), clamp(top, height), clamp(right, width), clamp(bottom, height)


def quad_of(box: Box) -> Column:
    left, top, right, bottom = box
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom)).cast(QUAD)


def checked_quad(points: Column) -> Column:
    """The points if they are four, else an error when it is read."""
    return F.when(F.size(points) == 4, points).otherwise(F.raise_error(F.lit("a quad has four points")).cast(QUAD))


def ordered_quad(points: Column) -> Column:
    """Corners as top left, top right, bottom right, bottom left by sums and differences of coordinates; the first of equals wins."""

    def pick(key, largest: bool) -> Column:
        keyed = F.transform(points, lambda p, i: F.struct((-key(p) if largest else key(p)).alias("k"), i.alias("i"), p.alias("p")))
        return F.array_min(keyed)["p"]

    return F.array(pick(lambda p: p["x"] + p["y"], False), pick(lambda p: p["y"] - p["x"], False), pick(lambda p: p["x"] + p["y"], True), pick(lambda p: p["y"] - p["x"], True))


def bounds(points: Column) -> Box:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def centre(points: Column) -> tuple[Column, Column]:
    """The mean of the corners."""
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(points)
    return mean("x"), mean("y")


def shoelace(points: Column) -> Column:
    """Area of a convex quad whose corners are in order."""
    following = F.concat(F.slice(points, 2, 3), F.slice(points, 1, 1))
    crosses = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(crosses, F.lit(0.0), lambda a, c: a + c)) / 2


def transformed(points: Column, matrix: Column) -> Column:
    """Points under an affine matrix (6 numbers, by rows) or a homography (9)."""

    def apply(p: Column) -> Column:
        x = matrix[0] * p["x"] + matrix[1] * p["y"] + matrix[2]
        y = matrix[3] * p["x"] + matrix[4] * p["y"] + matrix[5]
        w = F.when(F.size(matrix) == 9, F.get(matrix, F.lit(6)) * p["x"] + F.get(matrix, F.lit(7)) * p["y"] + F.get(matrix, F.lit(8))).otherwise(F.lit(1.0))
        return F.struct((x / w).alias("x"), (y / w).alias("y"))

    return F.transform(points, apply)


def magnitude(matrix: Column) -> Column:
    """Length of a motion's translation."""
    return F.hypot(matrix[2], matrix[5])


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def overlap_area(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1e-9)))).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where either box is empty."""
    both = overlap_area(a, b)
    return F.when((area(a) > 0) & (area(b) > 0), _share(both, area(a) + area(b) - both)).otherwise(F.lit(0.0))


def over_smaller(a: Box, b: Box) -> Column:
    return _share(overlap_area(a, b), F.least(area(a), area(b)))


def coverage(subject: Box, cover: Box) -> Column:
    """Share of the subject that the cover hides."""
    return _share(overlap_area(subject, cover), area(subject))


def either_covers(a: Box, b: Box) -> Column:
    return F.greatest(coverage(a, b), coverage(b, a))


def box_in(s: Column) -> Box:
    """The box that a struct with l, t0, r, b0 holds."""
    return s["l"], s["t0"], s["r"], s["b0"]


def box_cols(prefix: str = "") -> Box:
    return F.col(prefix + "l"), F.col(prefix + "t0"), F.col(prefix + "r"), F.col(prefix + "b0")


def overflow_envelope(box: Box, scopes: Column) -> Column:
    """The box widened by 0.6 of its width and 2 of its height each way, joined with the bounds of the scopes (structs l, t0, r, b0)."""
    left, top, right, bottom = box
    w, h = right - left, bottom - top
    ends = lambda f, axis, own: f(F.coalesce((F.array_min if f is F.least else F.array_max)(F.transform(scopes, lambda s: s[axis])), own), own)
    return F.struct(ends(F.least, "l", left - 0.6 * w).alias("l"), ends(F.least, "t0", top - 2.0 * h).alias("t0"), ends(F.greatest, "r", right + 0.6 * w).alias("r"), ends(F.greatest, "b0", bottom + 2.0 * h).alias("b0"))


def scope_dwarfs(box: Box, scopes: Column, confidence: Column) -> Column:
    """Does a scope exceed a confident, tall enough box by far? Reported only; nothing acts on it."""
    w, h = box[2] - box[0], box[3] - box[1]
    return (confidence >= 0.60) & (h >= 16) & F.exists(scopes, lambda s: (s["r"] - s["l"] >= 2 * w) & (s["b0"] - s["t0"] >= 4 * h))


# DuckDB text of the same, for boxes named by a prefix


def sql_area(p: str) -> str:
    return f"(greatest(0.0::DOUBLE, {p}r - {p}l) * greatest(0.0::DOUBLE, {p}b0 - {p}t0))"


def sql_overlap(a: str, b: str) -> str:
    return f"(greatest(0.0::DOUBLE, least({a}r, {b}r) - greatest({a}l, {b}l)) * greatest(0.0::DOUBLE, least({a}b0, {b}b0) - greatest({a}t0, {b}t0)))"


def _sql_share(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN least(1.0::DOUBLE, {part} / greatest({whole}, 1e-9)) ELSE 0.0::DOUBLE END)"


def sql_iou(a: str, b: str) -> str:
    both = sql_overlap(a, b)
    return f"(CASE WHEN {sql_area(a)} > 0 AND {sql_area(b)} > 0 THEN {_sql_share(both, f'({sql_area(a)} + {sql_area(b)} - {both})')} ELSE 0.0::DOUBLE END)"


def sql_over_smaller(a: str, b: str) -> str:
    return _sql_share(sql_overlap(a, b), f"least({sql_area(a)}, {sql_area(b)})")


def sql_coverage(a: str, b: str) -> str:
    return _sql_share(sql_overlap(a, b), sql_area(a))


def sql_either(a: str, b: str) -> str:
    return f"greatest({sql_coverage(a, b)}, {sql_coverage(b, a)})"
