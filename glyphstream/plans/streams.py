"""Queries over single streams: clock, gate, segments, running signals, policy and planner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import policy as P
from ..functions.signature import lane_distance
from ..operators import planner, sampling, segments
from ..sources.adapters import FRAMES_SQL, OBS_SQL, SIG_SQL, frames_of_boxes, observations, signatures, table

DAY = 86_400.0
GATE = DAY / 2


def sample_gate(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sampled(observations(spark, d).select("video_id", "frame_id", "t"), GATE)


_GATED = OBS_SQL + f""", kept AS (
  SELECT video_id, min(t) AS t FROM obs GROUP BY video_id
  UNION ALL
  SELECT k.video_id, min(o.t) AS t FROM kept k JOIN obs o ON o.video_id = k.video_id AND o.t + 1e-9 >= k.t + {GATE}::DOUBLE GROUP BY k.video_id
), gated AS (SELECT o.* FROM obs o JOIN (SELECT o.video_id, min(o.frame_id) AS frame_id FROM kept k JOIN obs o ON o.video_id = k.video_id AND o.t = k.t GROUP BY o.video_id, o.t) f USING (video_id, frame_id))"""
SAMPLE_GATE = f"WITH RECURSIVE {_GATED} SELECT video_id, frame_id, t FROM gated"


def content_events(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: sampled observations, cut where the content changes, as events in order of their begin."""
    kept = sampling.sampled(observations(spark, d).select("video_id", "frame_id", "t", "content", "confidence"), GATE)
    w = segments.over("video_id", "frame_id")
    cut = segments.islands(kept, F.lag("content").over(w) != F.col("content"), "video_id", "frame_id")
    events = segments.built_events(cut, ["video_id", "island", "content"])
    return events.withColumn("event_id", F.row_number().over(segments.over("video_id", ["start", "island"])).cast("long")).drop("island")


CONTENT_EVENTS = f"""WITH RECURSIVE {_GATED}, marked AS (
  SELECT *, CASE WHEN lag(content) OVER w IS DISTINCT FROM content THEN 1 ELSE 0 END AS b FROM gated WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)
), cut AS (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY frame_id)::BIGINT AS island FROM marked),
ev AS (SELECT video_id, island, content, min(t) AS start, max(t) AS stop, count(*) AS n, max(confidence) AS confidence, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM cut GROUP BY ALL)
SELECT * EXCLUDE (island), row_number() OVER (PARTITION BY video_id ORDER BY start, island) AS event_id FROM ev"""


def frame_clock(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    time = F.when(F.col("event_id") % 5 != 0, F.col("t"))
    pts = F.when(F.col("event_id") % 7 != 0, F.col("frame_id") * 512)
    return o.select("video_id", "frame_id", F.round(sampling.frame_time(time, pts, F.lit(1 / 12800), F.col("frame_id") + 10, F.lit(25.0)), 6).alias("seconds"))


FRAME_CLOCK = f"""WITH {OBS_SQL} SELECT video_id, frame_id, round(coalesce(CASE WHEN event_id % 5 <> 0 THEN t END, CASE WHEN event_id % 7 <> 0 THEN frame_id * 512 * (1.0::DOUBLE / 12800) END, (frame_id + 10) / 25.0::DOUBLE), 6) AS seconds FROM obs"""


def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return sampling.within(observations(spark, d), 2 * DAY, 9 * DAY).select("video_id", "frame_id", "t", "content")


RANGE_SCAN = f"WITH {OBS_SQL} SELECT video_id, frame_id, t, content FROM obs WHERE t BETWEEN {2 * DAY} AND {9 * DAY}"


def frame_ids(spark: SparkSession, d: str) -> DataFrame:
    kept = sampling.within(observations(spark, d).select("video_id", "frame_id", "t"), DAY, 20 * DAY)
    return sampling.numbered(kept, 1000)


FRAME_IDS = f"WITH {OBS_SQL} SELECT video_id, frame_id, t, 1000 + row_number() OVER (PARTITION BY video_id ORDER BY t, frame_id) - 1 AS emitted_id FROM obs WHERE t BETWEEN {DAY} AND {20 * DAY}"


def scaled_sizes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1500 + 2).cast("int").alias("width"), (F.col("p_size") * 13 + 1).cast("int").alias("height"))
    w, h = sampling.scaled_size(F.col("width"), F.col("height"), 640)
    return p.select("p_partkey", w.cast("int").alias("scaled_width"), h.cast("int").alias("scaled_height"))


SCALED_SIZES = """SELECT p_partkey, least(w, 640)::INT AS scaled_width, (CASE WHEN w > 640 THEN greatest(2, round_even(h * (640::DOUBLE / w), 0)::INT) ELSE h END)::INT AS scaled_height
FROM (SELECT p_partkey, (p_partkey % 1500 + 2)::INT AS w, (p_size * 13 + 1)::INT AS h FROM part)"""


def frame_pairs_lag(spark: SparkSession, d: str) -> DataFrame:
    w = segments.over("video_id", "frame_id")
    return observations(spark, d).select("video_id", "frame_id", F.lag("frame_id").over(w).alias("previous"), F.round(F.col("t") - F.lag("t").over(w), 6).alias("elapsed"))


FRAME_PAIRS = f"WITH {OBS_SQL} SELECT video_id, frame_id, lag(frame_id) OVER w AS previous, round(t - lag(t) OVER w, 6) AS elapsed FROM obs WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)"

FAR = 0.55  # the test vectors are random: their signatures differ by a half


def content_islands(spark: SparkSession, d: str) -> DataFrame:
    cut = segments.by_signature(signatures(spark, d), "sig", "label", "vec_id", FAR)
    return cut.groupBy("label", "island").agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.count(F.lit(1)).alias("stable_observations"))


_ISLANDS = SIG_SQL + f""", marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR bit_count(xor(sig, lag(sig) OVER w)) / 63.0::DOUBLE >= {FAR} THEN 1 ELSE 0 END AS b FROM sigs WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
cut AS (SELECT *, sum(b) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS island FROM marked)"""
CONTENT_ISLANDS = f"WITH {_ISLANDS} SELECT label, island, min(vec_id) AS first, max(vec_id) AS last, count(*) AS stable_observations FROM cut GROUP BY ALL"


def typewriter_score(spark: SparkSession, d: str) -> DataFrame:
    cut = segments.by_signature(signatures(spark, d), "sig", "label", "vec_id", FAR)
    return cut.select("label", "vec_id", F.round(segments.typewriter(F.col("island") - 1), 9).alias("typewriter"))


TYPEWRITER = f"WITH {_ISLANDS} SELECT label, vec_id, round(1 - pow(0.7::DOUBLE, island - 1), 9) AS typewriter FROM cut"


def _content_cut(spark: SparkSession, d: str) -> DataFrame:
    w = segments.over("video_id", "frame_id")
    return segments.islands(observations(spark, d).select("video_id", "frame_id", "t", "content", "confidence"), F.lag("content").over(w) != F.col("content"), "video_id", "frame_id")


_CONTENT = OBS_SQL + """, marked AS (SELECT *, CASE WHEN lag(content) OVER w IS DISTINCT FROM content THEN 1 ELSE 0 END AS b FROM obs WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)),
cut AS (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY frame_id)::BIGINT AS island FROM marked)"""


def ready_time(spark: SparkSession, d: str) -> DataFrame:
    return segments.ready_at(_content_cut(spark, d), ["video_id", "island"], "t", "frame_id", 3, DAY, 4 * DAY)


READY_TIME = f"""WITH {_CONTENT}, s AS (SELECT *, row_number() OVER w AS seen, t - first_value(t) OVER w AS since FROM cut WINDOW w AS (PARTITION BY video_id, island ORDER BY frame_id))
SELECT video_id, island, min(t) FILTER (WHERE seen >= 3 OR since >= {DAY} OR since >= {4 * DAY}) AS ready_at, count(*) AS stable_observations FROM s GROUP BY ALL"""


def ewma_signals(spark: SparkSession, d: str) -> DataFrame:
    s = segments.smoothed(observations(spark, d).select("video_id", "frame_id", "value"), "video_id", ["frame_id"], "value")
    return s.select("video_id", F.round("smoothed", 6).alias("smoothed"), "n")


EWMA = f"WITH {OBS_SQL} SELECT video_id, round(list_reduce(list_prepend(0::DOUBLE, list(value ORDER BY frame_id)), lambda a, x: 0.85::DOUBLE * a + (1 - 0.85::DOUBLE) * x), 6) AS smoothed, count(*) AS n FROM obs GROUP BY video_id"


def running_lifetime(spark: SparkSession, d: str) -> DataFrame:
    events = segments.built_events(_content_cut(spark, d), ["video_id", "island"])
    w = segments.over("video_id", "island").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("video_id", "island", F.round(F.avg(F.col("stop") - F.col("start")).over(w), 3).alias("lifetime"))


RUNNING_LIFETIME = f"""WITH {_CONTENT}, e AS (SELECT video_id, island, max(t) - min(t) AS life FROM cut GROUP BY ALL)
SELECT video_id, island, round(avg(life) OVER (PARTITION BY video_id ORDER BY island), 3) AS lifetime FROM e"""


def velocity_lag(spark: SparkSession, d: str) -> DataFrame:
    w = segments.over(["video_id", "content"], "frame_id")
    x, y = (F.col("l") + F.col("r")) / 2, (F.col("t0") + F.col("b0")) / 2
    return observations(spark, d).select("video_id", "frame_id", (x - F.lag(x).over(w)).alias("vx"), (y - F.lag(y).over(w)).alias("vy"))


VELOCITY = f"WITH {OBS_SQL} SELECT video_id, frame_id, (l + r) / 2 - lag((l + r) / 2) OVER w AS vx, (t0 + b0) / 2 - lag((t0 + b0) / 2) OVER w AS vy FROM obs WINDOW w AS (PARTITION BY video_id, content ORDER BY frame_id)"


def moving_ratio(spark: SparkSession, d: str) -> DataFrame:
    v = velocity_lag(spark, d)
    moving = F.coalesce(F.hypot("vx", "vy") >= 200.0, F.lit(False))
    return v.groupBy("video_id").agg((F.count_if(moving) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("moving"))


MOVING_RATIO = f"WITH v AS ({VELOCITY}) SELECT video_id, count(*) FILTER (WHERE sqrt(vx * vx + vy * vy) >= 200) / greatest(count(*), 1)::DOUBLE AS moving FROM v GROUP BY video_id"


def missed_probe_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = segments.sessions_by_misses(observations(spark, d).select("video_id", "content", "frame_id"), ["video_id", "content"], "frame_id")
    return s.groupBy("video_id", "content", "track").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.sum(F.when(F.col("missed") <= 6, F.col("missed")).otherwise(0)).alias("missed"))


MISSED_SESSIONS = f"""WITH {OBS_SQL}, m AS (SELECT video_id, content, frame_id, coalesce(frame_id - lag(frame_id) OVER w - 1, 0) AS missed FROM obs WINDOW w AS (PARTITION BY video_id, content ORDER BY frame_id)),
s AS (SELECT *, 1 + sum(CASE WHEN missed > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, content ORDER BY frame_id) AS track FROM m)
SELECT video_id, content, track::BIGINT AS track, min(frame_id) AS first_frame, max(frame_id) AS last_frame, sum(CASE WHEN missed <= 6 THEN missed ELSE 0 END)::BIGINT AS missed FROM s GROUP BY ALL"""


def idle_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    return segments.heartbeat(observations(spark, d), "video_id", "frame_id", F.col("tier") == 0)


HEARTBEAT = f"""WITH {OBS_SQL}, g AS (SELECT *, sum((tier = 0)::INT) OVER (PARTITION BY video_id ORDER BY frame_id)::BIGINT AS request FROM obs)
SELECT video_id, request, min(t) AS seen_at, max(t) AS last_seen, count(*) - 1 AS idle_frames FROM g WHERE request > 0 GROUP BY ALL"""


def scene_cuts(spark: SparkSession, d: str) -> DataFrame:
    """A frame's change score and ratio against the one before decide cuts; unreliable motion is told by the ratio."""
    w = segments.over("video_id", "frame_id")
    score, ratio = F.abs(F.col("value") - F.lag("value").over(w)) / 500, F.abs(F.col("k") - F.lag("k").over(w)) / 100
    o = observations(spark, d).select("video_id", "frame_id", score.alias("score"), ratio.alias("ratio"))
    return o.select("video_id", "frame_id", (F.col("score").isNull() | ((F.col("score") >= 0.085) & (F.col("ratio") >= 0.60))).alias("scene_cut"), F.coalesce(F.col("ratio") < 0.25, F.lit(False)).alias("motion_reliable"))


SCENE_CUTS = f"""WITH {OBS_SQL}, s AS (SELECT video_id, frame_id, abs(value - lag(value) OVER w) / 500 AS score, abs(k - lag(k) OVER w) / 100::DOUBLE AS ratio FROM obs WINDOW w AS (PARTITION BY video_id ORDER BY frame_id))
SELECT video_id, frame_id, score IS NULL OR (score >= 0.085 AND ratio >= 0.60) AS scene_cut, coalesce(ratio < 0.25, false) AS motion_reliable FROM s"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    k, e = F.col("k"), F.col("event_id")
    return o.select(
        "video_id", "frame_id", (e % 60).alias("ocr_queue"), (k % 50).alias("detection_queue"), ((e % 21) / 20).alias("layout_stability"), ((k % 13) / 100).alias("audit_yield"), (e % 17).cast("double").alias("motion_magnitude"),
        ((k % 11) / 10).alias("motion_confidence"), ((e % 9) / 8).alias("typewriter"), ((k % 7) / 4).alias("lifetime"), F.when(e % 4 != 0, (k % 101) / 100).alias("gpu"),
    )


_SIGNALS = OBS_SQL + """, sg AS (SELECT video_id, frame_id, event_id % 60 AS ocr_queue, k % 50 AS detection_queue, (event_id % 21) / 20::DOUBLE AS layout_stability, (k % 13) / 100::DOUBLE AS audit_yield, (event_id % 17)::DOUBLE AS motion_magnitude,
  (k % 11) / 10::DOUBLE AS motion_confidence, (event_id % 9) / 8::DOUBLE AS typewriter, (k % 7) / 4::DOUBLE AS lifetime, CASE WHEN event_id % 4 <> 0 THEN (k % 101) / 100::DOUBLE END AS gpu FROM obs),
c AS (SELECT *, greatest(ocr_queue, detection_queue) >= 48 AS pressure, layout_stability >= 0.9::DOUBLE AND audit_yield < 0.02::DOUBLE AS calm, audit_yield >= 0.1::DOUBLE AS missed, motion_magnitude > 8 AND motion_confidence < 0.55::DOUBLE AS lost,
  motion_magnitude > 8 AND motion_confidence >= 0.75::DOUBLE AS comp, typewriter >= 0.6::DOUBLE AS typing, lifetime > 0 AND lifetime < 1 AS short, coalesce(gpu < 0.35::DOUBLE AND greatest(ocr_queue, detection_queue) > 0, false) AS idle, coalesce(gpu > 0.9::DOUBLE, false) AS busy FROM sg),
dec AS (SELECT video_id, frame_id,
  greatest(0.1::DOUBLE, least(0.75::DOUBLE, 0.25::DOUBLE * CASE WHEN pressure THEN 1.6::DOUBLE ELSE 1 END * CASE WHEN calm THEN 1.25::DOUBLE ELSE 1 END * CASE WHEN short THEN 0.65::DOUBLE ELSE 1 END)) AS probe,
  greatest(3::DOUBLE, least(40::DOUBLE, 20::DOUBLE * CASE WHEN calm THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN missed THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN lost THEN 0.5::DOUBLE ELSE 1 END)) AS audit,
  CASE WHEN missed OR lost THEN 1600 ELSE 960 END AS width,
  greatest(0.15::DOUBLE, least(1.5::DOUBLE, 0.45::DOUBLE * CASE WHEN typing THEN 1.7::DOUBLE ELSE 1 END * CASE WHEN short THEN 0.55::DOUBLE ELSE 1 END)) AS stable,
  greatest(0.5::DOUBLE, least(4::DOUBLE, 1.8::DOUBLE * CASE WHEN typing THEN 1.25::DOUBLE ELSE 1 END * CASE WHEN short THEN 0.7::DOUBLE ELSE 1 END)) AS longest,
  CASE WHEN pressure THEN 32 ELSE 16 END AS batch,
  greatest(10::DOUBLE, least(80::DOUBLE, 35 + CASE WHEN pressure THEN 15 ELSE 0 END + CASE WHEN idle THEN -10 WHEN busy THEN 10 ELSE 0 END))::DOUBLE AS wait,
  concat_ws(',', CASE WHEN pressure THEN 'queue_pressure' END, CASE WHEN calm THEN 'stable_layout' END, CASE WHEN missed THEN 'audit_found_misses' END, CASE WHEN lost THEN 'unreliable_motion_compensation' WHEN comp THEN 'motion_compensated' END,
    CASE WHEN typing THEN 'typewriter_pattern' END, CASE WHEN short THEN 'short_lived_text' END, CASE WHEN idle THEN 'gpu_headroom' WHEN busy THEN 'gpu_saturated' END) AS reasons FROM c)"""


def policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    s = _signals(spark, d)
    chosen = P.decide({name: F.col(name) for name in P.SIGNALS})
    doubles = {"probe", "audit", "stable", "longest", "wait"}
    return s.select("video_id", "frame_id", *[(F.round(c, 9) if n in doubles else F.array_join(c, ",") if n == "reasons" else c).alias(n) for n, c in chosen.items()])


POLICY = f"WITH {_SIGNALS} SELECT * REPLACE (round(probe, 9) AS probe, round(audit, 9) AS audit, round(stable, 9) AS stable, round(longest, 9) AS longest, round(wait, 9) AS wait) FROM dec"


def policy_change_log(spark: SparkSession, d: str) -> DataFrame:
    return segments.changes_only(policy_decisions(spark, d), "video_id", "frame_id", ["probe", "audit", "width", "stable", "longest", "batch", "wait"])


POLICY_LOG = f"""WITH {_SIGNALS}, r AS (SELECT * REPLACE (round(probe, 9) AS probe, round(audit, 9) AS audit, round(stable, 9) AS stable, round(longest, 9) AS longest, round(wait, 9) AS wait) FROM dec),
l AS (SELECT *, concat_ws('|', probe, audit, width, stable, longest, batch, wait) AS now, lag(concat_ws('|', probe, audit, width, stable, longest, batch, wait)) OVER (PARTITION BY video_id ORDER BY frame_id) AS before FROM r)
SELECT * EXCLUDE (now, before) FROM l WHERE now IS DISTINCT FROM before"""


def planner_requests(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    f = o.select("video_id", "frame_id", "t", (F.col("k") == 0).alias("cut"), (F.col("k") % 10 != 1).alias("reliable"), (F.col("tier") > 0).alias("scopes"), (F.col("event_id") % 7 > 1).alias("tracks"), (F.col("k") / 200).alias("ratio"))
    return planner.requests(f, audit=10 * DAY, least_audit=2 * DAY, probe=DAY / 3)


#: the state is (last audit, last probe); both are null before the first
PLANNER = f"""WITH RECURSIVE {OBS_SQL}, f AS (SELECT video_id, frame_id, t, k = 0 AS cut, k % 10 <> 1 AS reliable, tier > 0 AS scopes, event_id % 7 > 1 AS tracks, k / 200::DOUBLE AS ratio FROM obs),
p AS (
  SELECT video_id, frame_id, t AS la, t AS lp, 'AUDIT' AS requests FROM f WHERE frame_id = 0
  UNION ALL
  SELECT video_id, frame_id, CASE WHEN audit THEN t ELSE la END, CASE WHEN audit OR t - lp >= {DAY / 3} THEN t ELSE lp END,
    CASE WHEN audit THEN 'AUDIT' WHEN t - lp < {DAY / 3} THEN CASE WHEN scopes AND tracks AND ratio < 0.12::DOUBLE THEN 'LOCAL' ELSE '' END
      ELSE concat_ws('+', CASE WHEN NOT tracks OR ratio >= 0.12::DOUBLE THEN 'FAST' END, CASE WHEN scopes THEN 'LOCAL' END) END
  FROM (SELECT f.*, p.la, p.lp, f.cut OR f.t - p.la >= {10 * DAY} OR (NOT f.reliable AND f.t - p.la >= {2 * DAY}) AS audit FROM p JOIN f ON f.video_id = p.video_id AND f.frame_id = p.frame_id + 1)
)
SELECT video_id, frame_id, requests FROM p WHERE requests <> ''"""


def signature_distance(spark: SparkSession, d: str) -> DataFrame:
    s = signatures(spark, d)
    return s.select("vec_id", F.round(lane_distance(F.col("sig"), F.lag("sig").over(segments.over("label", "vec_id"))), 9).alias("distance"))


SIGNATURE_DISTANCE = f"WITH {SIG_SQL} SELECT vec_id, round(coalesce(bit_count(xor(sig, lag(sig) OVER (PARTITION BY label ORDER BY vec_id))) / 63.0::DOUBLE, 1), 9) AS distance FROM sigs"


def dhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return signatures(spark, d).select("vec_id", "sig")


DHASH = f"WITH {SIG_SQL} SELECT vec_id, sig FROM sigs"


def tile_change_map(spark: SparkSession, d: str) -> DataFrame:
    """Mean change of each tile of a 10 x 16 grid, masked samples left out of the mean; changed at 0.035 or more."""
    o = frames_of_boxes(spark, d)
    row, col = F.floor(F.col("t0") / 36).cast("int"), F.floor(F.col("l") / 40).cast("int")
    masked = G.coverage(G.box_cols(), tuple(F.lit(float(v)) for v in (0, 0, 64, 36))) >= 0.35
    tiles = o.where(~masked).groupBy("video_id", row.alias("tile_row"), col.alias("tile_col")).agg(F.round(F.avg(F.col("value") / 5000), 6).alias("score"))
    return tiles.withColumn("changed", F.col("score") >= 0.035)


TILE_CHANGE = f"""WITH {OBS_SQL}, m AS (SELECT *, 0 AS ml, 0 AS mt0, 64 AS mr, 36 AS mb0 FROM obs),
g AS (SELECT video_id, floor(t0 / 36)::INT AS tile_row, floor(l / 40)::INT AS tile_col, round(avg(value / 5000), 6) AS score FROM m WHERE {G.sql_coverage('', 'm')} < 0.35 GROUP BY ALL)
SELECT *, score >= 0.035 AS changed FROM g"""


def change_stats(spark: SparkSession, d: str) -> DataFrame:
    t = tile_change_map(spark, d)
    return t.groupBy("video_id").agg((F.round(F.sum("score"), 6) / 160).alias("score"), (F.count_if("changed") / 160).alias("ratio"))


CHANGE_STATS = f"WITH t AS ({TILE_CHANGE}) SELECT video_id, round(sum(score), 6) / 160 AS score, count(*) FILTER (WHERE changed) / 160::DOUBLE AS ratio FROM t GROUP BY video_id"

QUERIES = {
    "content_events": (content_events, CONTENT_EVENTS),
    "sample_gate": (sample_gate, SAMPLE_GATE),
    "frame_clock": (frame_clock, FRAME_CLOCK),
    "range_scan": (range_scan, RANGE_SCAN),
    "frame_ids": (frame_ids, FRAME_IDS),
    "scaled_sizes": (scaled_sizes, SCALED_SIZES),
    "frame_pairs_lag": (frame_pairs_lag, FRAME_PAIRS),
    "content_islands": (content_islands, CONTENT_ISLANDS),
    "typewriter_score": (typewriter_score, TYPEWRITER),
    "ready_time": (ready_time, READY_TIME),
    "ewma_signals": (ewma_signals, EWMA),
    "running_lifetime": (running_lifetime, RUNNING_LIFETIME),
    "velocity_lag": (velocity_lag, VELOCITY),
    "moving_ratio": (moving_ratio, MOVING_RATIO),
    "missed_probe_sessions": (missed_probe_sessions, MISSED_SESSIONS),
    "idle_heartbeat": (idle_heartbeat, HEARTBEAT),
    "scene_cuts": (scene_cuts, SCENE_CUTS),
    "policy_decisions": (policy_decisions, POLICY),
    "policy_change_log": (policy_change_log, POLICY_LOG),
    "planner_requests": (planner_requests, PLANNER),
    "signature_distance": (signature_distance, SIGNATURE_DISTANCE),
    "dhash_signature": (dhash_signature, DHASH),
    "tile_change_map": (tile_change_map, TILE_CHANGE),
    "change_stats": (change_stats, CHANGE_STATS),
}
