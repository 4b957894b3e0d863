"""Queries over boxes in frames: geometry, coverage, suppression, association and choice of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import signature as S
from ..operators import associate, segments, select, suppress
from ..sources.adapters import FRAMES_SQL, OBS_SQL, SIG_SQL, frames_of_boxes, observations, signatures, table

FRAME_KEYS = ["video_id", "frame"]
IGNORED = [(0.0, 0.0, 200.0, 120.0), (420.0, 240.0, 640.0, 360.0)]
DIAGONAL = 734.3023900274327  # of 640 x 360


def region_to_pixels(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    k = F.col("n_nationkey")
    left, top = k / 40, k / 50
    box = G.region_box((left, top, left + 0.5, top + 0.3), F.col("n_regionkey") * 100 + 320, F.lit(360))
    return n.select("n_nationkey", *[F.round(c, 6).alias(x) for c, x in zip(box, ("l", "t0", "r", "b0"))])


REGION_TO_PIXELS = """SELECT n_nationkey, round(greatest(0, least(n_nationkey / 40.0::DOUBLE * w, w)), 6) AS l, round(greatest(0, least(n_nationkey / 50.0::DOUBLE * 360, 360)), 6) AS t0,
  round(greatest(0, least((n_nationkey / 40.0::DOUBLE + 0.5::DOUBLE) * w, w)), 6) AS r, round(greatest(0, least((n_nationkey / 50.0::DOUBLE + 0.3::DOUBLE) * 360, 360)), 6) AS b0
FROM (SELECT n_nationkey, (n_regionkey * 100 + 320)::DOUBLE AS w FROM nation)"""


def _shuffled_quads(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as quads whose corners begin anywhere, leaning a little."""
    o = observations(spark, d)
    lean = (F.col("k") % 5).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    left, top, right, bottom = G.box_cols()
    q = F.array(point(left + lean, top), point(right + lean, top + lean), point(right, bottom), point(left, bottom - lean))
    n = (F.col("event_id") % 4).cast("int")
    turned = F.when(n == 0, q).otherwise(F.concat(F.slice(q, n + 1, 4 - n), F.slice(q, F.lit(1), n)))
    return o.select("event_id", turned.cast(G.QUAD).alias("quad"))


_QUADS = OBS_SQL + """, q AS (SELECT event_id, event_id % 4 AS n, [{'x': l + k % 5, 'y': t0}, {'x': r + k % 5, 'y': t0 + k % 5}, {'x': r, 'y': b0}, {'x': l, 'y': b0 - k % 5}] AS quad FROM obs),
pts AS (SELECT event_id, unnest(range(1, 5)) AS i, unnest(quad[n + 1:4] || quad[1:n]) AS p FROM q)"""


def quad_order(spark: SparkSession, d: str) -> DataFrame:
    q = _shuffled_quads(spark, d).select("event_id", G.ordered_quad(G.checked_quad(F.col("quad"))).alias("q"))
    return q.select("event_id", *[F.col("q")[i][a].alias(f"{a}{i}") for i in range(4) for a in "xy"])


QUAD_ORDER = f"WITH {_QUADS} SELECT event_id, " + ", ".join(f"arg_min(p.{a}, [{key}, i]) AS {a}{n}" for n, key in enumerate(("p.x + p.y", "p.y - p.x", "-(p.x + p.y)", "-(p.y - p.x)")) for a in "xy") + " FROM pts GROUP BY event_id"


def polygon_stats(spark: SparkSession, d: str) -> DataFrame:
    q = _shuffled_quads(spark, d)
    p = F.col("quad")
    return q.select("event_id", *[c.alias(n) for c, n in zip(G.bounds(p), ("l", "t0", "r", "b0"))], *[F.round(c, 6).alias(n) for c, n in zip(G.centre(p), ("cx", "cy"))], G.shoelace(p).alias("area"))


POLYGON_STATS = f"""WITH {_QUADS}, e AS (SELECT *, lead(p, 1, NULL) OVER (PARTITION BY event_id ORDER BY i) AS nx, first_value(p) OVER (PARTITION BY event_id ORDER BY i) AS fp FROM pts)
SELECT event_id, min(p.x) AS l, min(p.y) AS t0, max(p.x) AS r, max(p.y) AS b0, round(avg(p.x), 6) AS cx, round(avg(p.y), 6) AS cy,
  abs(sum(p.x * coalesce(nx.y, fp.y) - coalesce(nx.x, fp.x) * p.y)) / 2 AS area FROM e GROUP BY event_id"""


def transformed_quads(spark: SparkSession, d: str) -> DataFrame:
    m = F.array(*map(F.lit, (1.0, 0.25, 8.0, -0.25, 1.0, 5.0)))
    q = _shuffled_quads(spark, d).select("event_id", G.transformed(F.col("quad"), m).alias("q"), G.magnitude(m).alias("motion"))
    return q.select("event_id", *[c.alias(n) for c, n in zip(G.bounds(F.col("q")), ("l", "t0", "r", "b0"))], F.round("motion", 9).alias("motion"))


TRANSFORMED = f"WITH {_QUADS}, m AS (SELECT event_id, p.x + 0.25::DOUBLE * p.y + 8 AS x, -0.25::DOUBLE * p.x + p.y + 5 AS y FROM pts) SELECT event_id, min(x) AS l, min(y) AS t0, max(x) AS r, max(y) AS b0, round(sqrt(89::DOUBLE), 9) AS motion FROM m GROUP BY event_id"


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = segments.over("video_id", "frame_id")
    o = observations(spark, d)
    return o.select("video_id", "event_id", "l", "t0", "r", "b0", *[F.lag(c).over(w).alias("p" + c) for c in ("l", "t0", "r", "b0")]).where("pl IS NOT NULL")


_PAIRS = OBS_SQL + ", pairs AS (SELECT * FROM (SELECT video_id, event_id, l, t0, r, b0, lag(l) OVER w AS pl, lag(t0) OVER w AS pt0, lag(r) OVER w AS pr, lag(b0) OVER w AS pb0 FROM obs WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)) WHERE pl IS NOT NULL)"


def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = G.box_cols(), G.box_cols("p")
    return _neighbours(spark, d).select("event_id", F.round(G.iou(a, b), 9).alias("iou"), F.round(G.over_smaller(a, b), 9).alias("over_smaller"))


IOU_PAIRS = f"WITH {_PAIRS} SELECT event_id, round({G.sql_iou('', 'p')}, 9) AS iou, round({G.sql_over_smaller('', 'p')}, 9) AS over_smaller FROM pairs"


def coverage_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = G.box_cols(), G.box_cols("p")
    return _neighbours(spark, d).select("event_id", F.round(G.coverage(a, b), 9).alias("covered"), F.round(G.coverage(b, a), 9).alias("covers"))


COVERAGE_PAIRS = f"WITH {_PAIRS} SELECT event_id, round({G.sql_coverage('', 'p')}, 9) AS covered, round({G.sql_coverage('p', '')}, 9) AS covers FROM pairs"


def exclude_filter(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).where(~suppress.excluded(G.box_cols(), IGNORED)).select("video_id", "event_id")


EXCLUDE_FILTER = f"WITH {OBS_SQL}, i(gl, gt0, gr, gb0) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)' for a, b, c, e in IGNORED)}) SELECT video_id, event_id FROM obs WHERE NOT EXISTS (SELECT 1 FROM i WHERE {G.sql_coverage('obs.', 'i.g')} >= {suppress.EXCLUDED})"


def _frame_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Frames with their odd-tier boxes as scopes and the rest as observations."""
    box = F.struct(F.col("event_id").alias("id"), "l", "t0", "r", "b0")
    part = lambda c: F.array_sort(F.collect_list(F.when(c, box)))
    return frames_of_boxes(spark, d).groupBy(*FRAME_KEYS).agg(part(F.col("tier") == 1).alias("scopes"), part(F.col("tier") != 1).alias("boxes"))


def uncovered_scopes(spark: SparkSession, d: str) -> DataFrame:
    f = _frame_arrays(spark, d)
    return f.select(*FRAME_KEYS, F.explode(F.transform(suppress.uncovered(F.col("scopes"), F.col("boxes")), lambda s: s["id"])).alias("event_id"))


UNCOVERED = f"WITH {FRAMES_SQL} SELECT video_id, frame, event_id FROM framed s WHERE tier = 1 AND NOT EXISTS (SELECT 1 FROM framed o WHERE o.video_id = s.video_id AND o.frame = s.frame AND o.tier <> 1 AND {G.sql_either('s.', 'o.')} >= {suppress.COVERED})"


def guided_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that a scope of their frame covers (or the reverse): confident ones need no detector."""
    f = _frame_arrays(spark, d)
    hit = F.filter("boxes", lambda b: F.exists("scopes", lambda s: G.either_covers(G.box_in(b), G.box_in(s)) >= suppress.COVERED))
    return f.select(*FRAME_KEYS, F.explode(F.transform(hit, lambda b: b["id"])).alias("event_id"))


GUIDED = f"WITH {FRAMES_SQL} SELECT video_id, frame, event_id FROM framed o WHERE tier <> 1 AND EXISTS (SELECT 1 FROM framed s WHERE o.video_id = s.video_id AND o.frame = s.frame AND s.tier = 1 AND {G.sql_either('o.', 's.')} >= {suppress.COVERED})"


def overflow_scopes(spark: SparkSession, d: str) -> DataFrame:
    f = _frame_arrays(spark, d).where(F.size("boxes") > 0)
    first = F.col("boxes")[0]
    e = f.select(*FRAME_KEYS, G.overflow_envelope(G.box_in(first), F.col("scopes")).alias("e"), G.scope_dwarfs(G.box_in(first), F.col("scopes"), F.lit(0.9)).alias("dwarfed"))
    return e.select(*FRAME_KEYS, *[F.round(F.col("e")[c], 6).alias(c) for c in ("l", "t0", "r", "b0")], "dwarfed")


OVERFLOW = f"""WITH {FRAMES_SQL}, f AS (SELECT * FROM framed WHERE tier <> 1 QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY event_id) = 1)
SELECT f.video_id, f.frame, round(least(f.l - 0.6::DOUBLE * (f.r - f.l), min(s.l)), 6) AS l, round(least(f.t0 - 2 * (f.b0 - f.t0), min(s.t0)), 6) AS t0, round(greatest(f.r + 0.6::DOUBLE * (f.r - f.l), max(s.r)), 6) AS r, round(greatest(f.b0 + 2 * (f.b0 - f.t0), max(s.b0)), 6) AS b0,
  f.b0 - f.t0 >= 16 AND coalesce(bool_or(s.r - s.l >= 2 * (f.r - f.l) AND s.b0 - s.t0 >= 4 * (f.b0 - f.t0)), false) AS dwarfed
FROM f LEFT JOIN framed s ON s.video_id = f.video_id AND s.frame = f.frame AND s.tier = 1 GROUP BY f.video_id, f.frame, f.l, f.t0, f.r, f.b0"""


def coalesce_scopes(spark: SparkSession, d: str) -> DataFrame:
    return suppress.coalesced(frames_of_boxes(spark, d), FRAME_KEYS)


def _greedy_sql(order: str, drops: str) -> str:
    box = "{'l': n.l, 't0': n.t0, 'r': n.r, 'b0': n.b0}"
    return f"""WITH RECURSIVE {FRAMES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY {order}) AS rk FROM framed),
g AS (
  SELECT video_id, frame, event_id, rk, true AS keep, [{box}] AS kept FROM ranked n WHERE rk = 1
  UNION ALL
  SELECT video_id, frame, event_id, rk, ok, CASE WHEN ok THEN list_append(kept, bx) ELSE kept END
  FROM (SELECT n.video_id, n.frame, n.event_id, n.rk, g.kept, {box} AS bx, len(list_filter(g.kept, lambda q: {drops})) = 0 AS ok FROM g JOIN ranked n ON n.video_id = g.video_id AND n.frame = g.frame AND n.rk = g.rk + 1)
) SELECT video_id, frame, event_id FROM g WHERE keep"""


COALESCE = _greedy_sql(f"{G.sql_area('')} DESC, event_id", f"{G.sql_iou('n.', 'q.')} >= 0.75 OR {G.sql_coverage('n.', 'q.')} >= 0.80")


def nms_merge(spark: SparkSession, d: str) -> DataFrame:
    """Tiers 2, 1 and 0 stand for audit, local and fast."""
    return suppress.suppressed(frames_of_boxes(spark, d), FRAME_KEYS, F.col("tier") + 1)


NMS = _greedy_sql(
    f"{G.sql_area('')} DESC, tier DESC, confidence DESC, event_id",
    f"{G.sql_iou('n.', 'q.')} >= 0.75 OR ({G.sql_over_smaller('n.', 'q.')} >= 0.80 AND greatest(n.b0 - n.t0, q.b0 - q.t0) / greatest(least(n.b0 - n.t0, q.b0 - q.t0), 1e-6) <= 2.2)",
)


def associate_step(spark: SparkSession, d: str) -> DataFrame:
    """The last frame's boxes as tracks against this frame's."""
    f = _frame_arrays(spark, d)
    return associate.step(f, FRAME_KEYS, "scopes", "boxes", DIAGONAL)


_IOU = G.sql_iou("a.", "b.")
_DISTANCE = f"(sqrt(pow((b.l + b.r) / 2 - (a.l + a.r) / 2, 2) + pow((b.t0 + b.b0) / 2 - (a.t0 + a.b0) / 2, 2)) / {DIAGONAL}::DOUBLE)"
ASSOCIATE = f"""WITH RECURSIVE {FRAMES_SQL}, c AS (SELECT a.video_id, a.frame, a.event_id AS a, b.event_id AS b, 0.7::DOUBLE * (1 - {_IOU}) + 0.3::DOUBLE * {_DISTANCE} AS cost
  FROM framed a JOIN framed b ON a.video_id = b.video_id AND a.frame = b.frame AND a.tier = 1 AND b.tier <> 1 WHERE {_IOU} >= 0.25 OR {_DISTANCE} <= 0.2),
s AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY cost, a, b) AS rk FROM c),
m AS (
  SELECT video_id, frame, rk, a, b, true AS ok, [a] AS ua, [b] AS ub FROM s WHERE rk = 1
  UNION ALL
  SELECT video_id, frame, rk, a, b, ok, CASE WHEN ok THEN list_append(ua, a) ELSE ua END, CASE WHEN ok THEN list_append(ub, b) ELSE ub END
  FROM (SELECT s.video_id, s.frame, s.rk, s.a, s.b, m.ua, m.ub, NOT list_contains(m.ua, s.a) AND NOT list_contains(m.ub, s.b) AS ok FROM m JOIN s ON s.video_id = m.video_id AND s.frame = m.frame AND s.rk = m.rk + 1)
), taken AS (SELECT video_id, frame, a, b FROM m WHERE ok)
SELECT video_id, frame, a AS track, b AS observation FROM taken
UNION ALL SELECT video_id, frame, NULL, event_id FROM framed f WHERE tier <> 1 AND NOT EXISTS (SELECT 1 FROM taken WHERE b = f.event_id)
UNION ALL SELECT video_id, frame, event_id, NULL FROM framed f WHERE tier = 1 AND NOT EXISTS (SELECT 1 FROM taken WHERE a = f.event_id)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    k, e = F.col("k"), F.col("event_id")
    return o.select("video_id", "frame_id", "event_id", S.sharpness(F.col("value")).alias("sharp"), S.contrast(k.cast("double")).alias("contrast"), S.completeness((e % 200).cast("double"), F.lit(900.0)).alias("complete"), S.occlusion((k % 30).cast("double"), F.lit(50.0)).alias("occluded"))


_QUALITY = OBS_SQL + """, parts AS (SELECT video_id, frame_id, event_id, value / (value + 200) AS sharp, k / (k + 45)::DOUBLE AS contrast, least(1, event_id % 200 / greatest(0.18::DOUBLE * 900, 1)) AS complete, least(1, 2 * (k % 30) / 50::DOUBLE) AS occluded FROM obs),
q AS (SELECT *, round(greatest(0, 0.4::DOUBLE * sharp + 0.25::DOUBLE * contrast + 0.25::DOUBLE * complete - 0.1::DOUBLE * occluded), 6) AS quality FROM parts)"""


def candidate_quality(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("event_id", F.round(S.quality(*map(F.col, ("sharp", "contrast", "complete", "occluded"))), 6).alias("quality"))


QUALITY = f"WITH {_QUALITY} SELECT event_id, quality FROM q"


def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).withColumn("quality", F.round(S.quality(*map(F.col, ("sharp", "contrast", "complete", "occluded"))), 6))
    return select.best(p.select("video_id", "frame_id", "event_id", "quality"), ["video_id"], "quality", "frame_id")


BEST = f"WITH {_QUALITY} SELECT video_id, frame_id, event_id, quality FROM q QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY quality DESC, frame_id) = 1"


def motion_validity(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select("event_id", (F.col("k") / 100).alias("inliers"), (F.col("event_id") % 90 / 10).alias("residual"))
    return o.select("event_id", S.motion_valid(F.col("inliers"), F.col("residual")).alias("valid"), F.round(S.motion_confidence(F.col("inliers"), F.col("residual")), 9).alias("confidence"))


MOTION = f"WITH {OBS_SQL}, m AS (SELECT event_id, k / 100::DOUBLE AS i, event_id % 90 / 10::DOUBLE AS s FROM obs) SELECT event_id, i >= 0.45::DOUBLE AND s <= 3.5 AS valid, round(greatest(0, least(1, i * (1 - s / 7))), 9) AS confidence FROM m"

_CANDIDATE = "struct<n:bigint,id:bigint,sig:bigint,complete:double,quality:double>"


def mmr_topk(spark: SparkSession, d: str) -> DataFrame:
    """Online choice of three complementary candidates among each frame's boxes."""
    sig = signatures(spark, d).select(F.col("vec_id").alias("_v"), "sig")
    p = _parts(spark, d).withColumn("quality", F.round(S.quality(*map(F.col, ("sharp", "contrast", "complete", "occluded"))), 6))
    p = p.withColumn("_v", F.col("event_id") % 500).join(sig, "_v").withColumn("frame", F.floor(F.col("frame_id") / 8).cast("long"))
    entry = F.struct(F.col("frame_id").cast("bigint").alias("n"), F.col("event_id").cast("bigint").alias("id"), "sig", F.col("complete").cast("double").alias("complete"), "quality")
    g = p.groupBy(*FRAME_KEYS).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    return g.select(*FRAME_KEYS, F.posexplode(select.complementary(F.col("items"), _CANDIDATE)).alias("place", "x")).select(*FRAME_KEYS, "place", F.col("x.id").alias("event_id"))


def _mmr_best(pool: str, score: str) -> str:
    return f"list_sort(list_transform({pool}, lambda p, i: {{'s': -({score}), 'i': i, 'x': p}}))[1].x"


def _mmr_apart(other: str) -> str:
    return f"bit_count(xor(p.sig, {other}.sig)) / 63.0::DOUBLE"


_GAIN = "p.quality + 0.35::DOUBLE * (0.7::DOUBLE * {} + 0.3::DOUBLE * abs(p.complete - seed.complete))"
_PAIR_GAIN, _TRIPLE_GAIN = _GAIN.format(f"({_mmr_apart('seed')})"), _GAIN.format(f"least({_mmr_apart('seed')}, {_mmr_apart('second')})")
_BY_QUALITY = "list_transform(list_sort(list_transform(pool, lambda p, i: {'s': -p.quality, 'i': i, 'x': p})), lambda k: k.x)"
MMR = f"""WITH RECURSIVE {_QUALITY}, {SIG_SQL},
cand AS (SELECT video_id, frame_id // 8 AS frame, row_number() OVER (PARTITION BY video_id, frame_id // 8 ORDER BY frame_id) AS rn, {{'n': frame_id, 'id': event_id, 'sig': sig, 'complete': complete::DOUBLE, 'quality': quality}} AS x FROM q JOIN sigs ON vec_id = event_id % 500),
m AS (
  SELECT video_id, frame, rn, [x] AS kept FROM cand WHERE rn = 1
  UNION ALL
  SELECT video_id, frame, rn, CASE WHEN len(pool) <= 3 THEN {_BY_QUALITY} ELSE [seed, second, {_mmr_best("rest2", _TRIPLE_GAIN)}] END
  FROM (SELECT *, list_filter(rest, lambda p: p.n <> second.n) AS rest2
    FROM (SELECT *, {_mmr_best("rest", _PAIR_GAIN)} AS second
      FROM (SELECT *, list_filter(pool, lambda p: p.n <> seed.n) AS rest
        FROM (SELECT *, {_mmr_best("pool", "p.quality")} AS seed
          FROM (SELECT c.video_id, c.frame, c.rn, list_append(m.kept, c.x) AS pool FROM m JOIN cand c ON c.video_id = m.video_id AND c.frame = m.frame AND c.rn = m.rn + 1)))))
), last AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY rn DESC) = 1)
SELECT video_id, frame, (unnest(range(1, len(kept) + 1)) - 1)::INT AS place, unnest(kept).id AS event_id FROM last"""


def refresh_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scopes that neither a box nor the refresh scope (the first box's overflow envelope) covers, and that refresh scope itself (id -1)."""
    f = _frame_arrays(spark, d).where(F.size("boxes") > 0)
    f = f.withColumn("fresh", G.overflow_envelope(G.box_in(F.col("boxes")[0]), F.array().cast("array<struct<l:double,t0:double,r:double,b0:double>>")))
    left = F.filter(suppress.uncovered(F.col("scopes"), F.col("boxes")), lambda s: G.either_covers(G.box_in(s), G.box_in(F.col("fresh"))) < suppress.COVERED)
    ids = F.concat(F.transform(left, lambda s: s["id"]), F.array(F.lit(-1).cast("long")))
    return f.select(*FRAME_KEYS, F.explode(ids).alias("event_id"))


_FRESH = f"""WITH {FRAMES_SQL}, fresh AS (SELECT video_id, frame, l - 0.6::DOUBLE * (r - l) AS l, t0 - 2 * (b0 - t0) AS t0, r + 0.6::DOUBLE * (r - l) AS r, b0 + 2 * (b0 - t0) AS b0 FROM framed WHERE tier <> 1 QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY event_id) = 1)"""
REFRESH_SCOPES = f"""{_FRESH} SELECT s.video_id, s.frame, s.event_id FROM framed s JOIN fresh f ON f.video_id = s.video_id AND f.frame = s.frame AND s.tier = 1 AND {G.sql_either('s.', 'f.')} < {suppress.COVERED}
WHERE NOT EXISTS (SELECT 1 FROM framed o WHERE o.video_id = s.video_id AND o.frame = s.frame AND o.tier <> 1 AND {G.sql_either('s.', 'o.')} >= {suppress.COVERED}) UNION ALL SELECT video_id, frame, -1 FROM fresh"""


def refreshed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """How many of a frame's boxes lie in its refresh scope: two or more rest longer."""
    f = _frame_arrays(spark, d).where(F.size("boxes") > 0)
    f = f.withColumn("fresh", G.overflow_envelope(G.box_in(F.col("boxes")[0]), F.col("boxes").cast("array<struct<id:bigint,l:double,t0:double,r:double,b0:double>>")))
    n = F.size(F.filter("boxes", lambda b: G.either_covers(G.box_in(b), G.box_in(F.col("fresh"))) >= suppress.COVERED))
    area = F.aggregate("scopes", F.lit(0.0), lambda a, s: a + G.area(G.box_in(s)))
    return f.select(*FRAME_KEYS, n.alias("inside"), F.when(n >= 2, 5.0).otherwise(2.25).alias("rest"), F.when(F.size("scopes") > 0, area).otherwise(F.lit(640.0 * 360)).alias("scope_area"))


REFRESHED_BOXES = f"""WITH {FRAMES_SQL}, b AS (SELECT * FROM framed WHERE tier <> 1), first AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY event_id) = 1),
fresh AS (SELECT f.video_id, f.frame, least(f.l - 0.6::DOUBLE * (f.r - f.l), min(b.l)) AS l, least(f.t0 - 2 * (f.b0 - f.t0), min(b.t0)) AS t0, greatest(f.r + 0.6::DOUBLE * (f.r - f.l), max(b.r)) AS r, greatest(f.b0 + 2 * (f.b0 - f.t0), max(b.b0)) AS b0
  FROM first f JOIN b USING (video_id, frame) GROUP BY f.video_id, f.frame, f.l, f.t0, f.r, f.b0),
n AS (SELECT f.video_id, f.frame, (count(*) FILTER (WHERE {G.sql_either('b.', 'f.')} >= {suppress.COVERED}))::INT AS inside FROM fresh f JOIN b ON b.video_id = f.video_id AND b.frame = f.frame GROUP BY ALL),
sc AS (SELECT video_id, frame, sum((r - l) * (b0 - t0)) AS area FROM framed WHERE tier = 1 GROUP BY ALL)
SELECT video_id, frame, inside, CASE WHEN inside >= 2 THEN 5 ELSE 2.25 END::DOUBLE AS rest, coalesce(area, 230400)::DOUBLE AS scope_area FROM n LEFT JOIN sc USING (video_id, frame)"""


def guided_gate(spark: SparkSession, d: str) -> DataFrame:
    """Tracks fit for projection: confident, slow for the frame's diagonal, and outside the ignored regions."""
    w = segments.over(["video_id", "content"], "frame_id")
    o = observations(spark, d)
    x, y = (F.col("l") + F.col("r")) / 2, (F.col("t0") + F.col("b0")) / 2
    o = o.withColumn("speed", F.coalesce(F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)), F.lit(0.0)) / DIAGONAL)
    return o.where((F.col("confidence") >= 0.45) & (F.col("speed") <= 0.3) & ~suppress.excluded(G.box_cols(), IGNORED)).select("video_id", "event_id")


_IGNORED = f"i(gl, gt0, gr, gb0) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)' for a, b, c, e in IGNORED)})"
GUIDED_GATE = f"""WITH {OBS_SQL}, v AS (SELECT *, coalesce(sqrt(pow((l + r) / 2 - lag((l + r) / 2) OVER w, 2) + pow((t0 + b0) / 2 - lag((t0 + b0) / 2) OVER w, 2)), 0) / {DIAGONAL}::DOUBLE AS speed FROM obs WINDOW w AS (PARTITION BY video_id, content ORDER BY frame_id)), {_IGNORED}
SELECT video_id, event_id FROM v WHERE confidence >= 0.45 AND speed <= 0.3 AND NOT EXISTS (SELECT 1 FROM i WHERE {G.sql_coverage('v.', 'i.g')} >= {suppress.EXCLUDED})"""


def tier_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that reach the least score of their tier: 0.35 fast, 0.28 local, 0.22 audit."""
    least = F.when(F.col("tier") == 0, 0.35).when(F.col("tier") == 1, 0.28).otherwise(0.22)
    return observations(spark, d).where(F.col("confidence") >= least).select("video_id", "event_id", "tier")


TIER_THRESHOLDS = f"WITH {OBS_SQL} SELECT video_id, event_id, tier FROM obs WHERE confidence >= CASE tier WHEN 0 THEN 0.35 WHEN 1 THEN 0.28 ELSE 0.22 END::DOUBLE"


def lanes_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of signatures in two lanes; 1 where a lane is missing."""
    s = signatures(spark, d)
    two = s.select("vec_id", F.array("sig", F.col("sig") * 0 + F.col("vec_id")).alias("a"), F.when(F.col("vec_id") % 9 == 0, F.array("sig")).otherwise(F.array(F.col("sig").bitwiseXOR(F.lit(1023)), F.lit(5).cast("long"))).alias("b"))
    return two.select("vec_id", F.round(S.lanes_distance(F.col("a"), F.col("b")), 9).alias("distance"))


LANES_DISTANCE = f"WITH {SIG_SQL} SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 1::DOUBLE ELSE round((10 + bit_count(xor(vec_id, 5::BIGINT))) / 128.0::DOUBLE, 9) END AS distance FROM sigs"


QUERIES = {
    "region_to_pixels": (region_to_pixels, REGION_TO_PIXELS),
    "quad_order": (quad_order, QUAD_ORDER),
    "polygon_stats": (polygon_stats, POLYGON_STATS),
    "transformed_quads": (transformed_quads, TRANSFORMED),
    "iou_pairs": (iou_pairs, IOU_PAIRS),
    "coverage_pairs": (coverage_pairs, COVERAGE_PAIRS),
    "exclude_filter": (exclude_filter, EXCLUDE_FILTER),
    "uncovered_scopes": (uncovered_scopes, UNCOVERED),
    "guided_tracks": (guided_tracks, GUIDED),
    "overflow_scopes": (overflow_scopes, OVERFLOW),
    "coalesce_scopes": (coalesce_scopes, COALESCE),
    "nms_merge": (nms_merge, NMS),
    "associate_step": (associate_step, ASSOCIATE),
    "candidate_quality": (candidate_quality, QUALITY),
    "best_candidate": (best_candidate, BEST),
    "motion_validity": (motion_validity, MOTION),
    "mmr_topk": (mmr_topk, MMR),
    "refresh_scopes": (refresh_scopes, REFRESH_SCOPES),
    "refreshed_boxes": (refreshed_boxes, REFRESHED_BOXES),
    "guided_gate": (guided_gate, GUIDED_GATE),
    "tier_thresholds": (tier_thresholds, TIER_THRESHOLDS),
    "lanes_distance": (lanes_distance, LANES_DISTANCE),
}
