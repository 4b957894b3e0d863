"""Queries over events: text, chunks, merging, evaluation and recognition tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import chunks, evaluate, recognition, segments
from ..session import stored
from ..sources.adapters import INTERVALS_SQL, OBS_SQL, intervals, observations, table

DAY = 86_400.0
WIDTH, OVERLAP = 4 * DAY, DAY / 4


# ---------------------------------------------------------------- text


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    spaced = F.concat(F.lit("  "), F.replace(F.coalesce("text", F.lit("")), F.lit("."), F.lit(" .\t\n ")))
    return c.select("conv_id", "turn", T.display_text(spaced).alias("display"), F.length(T.metric_text(spaced)).cast("long").alias("bare_chars"))


TEXT_NORMALIZE = r"""SELECT conv_id, turn, trim(regexp_replace(s, '\s+', ' ', 'g')) AS display, length(regexp_replace(s, '\s+', '', 'g')) AS bare_chars
FROM (SELECT conv_id, turn, '  ' || replace(coalesce(text, ''), '.', ' .' || chr(9) || chr(10) || ' ') AS s FROM conversations)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Part names next to the names after them, as readings of one line."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, d, "part")
    return p.select("p_partkey", F.col("p_name").alias("left"), F.coalesce(F.lag("p_name").over(w), F.lit("")).alias("right"), (F.col("p_size") / 50).alias("lc"), (F.col("p_partkey") % 50 / 50).alias("rc"))


_NAMES = "names AS (SELECT p_partkey, p_name AS left_, coalesce(lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey), '') AS right_, p_size / 50::DOUBLE AS lc, p_partkey % 50 / 50::DOUBLE AS rc FROM part)"
_BARE = "replace({}, ' ', '')"


def text_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = T.metric_text(F.col("left")), T.metric_text(F.col("right"))
    return _names(spark, d).select("p_partkey", F.levenshtein(a, b).cast("long").alias("edits"), F.round(T.similarity(a, b), 9).alias("similarity"))


TEXT_SIMILARITY = f"WITH {_NAMES}, b AS (SELECT p_partkey, replace(left_, ' ', '') AS x, replace(right_, ' ', '') AS y FROM names) SELECT p_partkey, levenshtein(x, y) AS edits, round(greatest(0, 1 - levenshtein(x, y) / greatest(length(x), length(y), 1)::DOUBLE), 9) AS similarity FROM b"


def prefix_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = _names(spark, d).withColumn("right", F.when(F.col("p_partkey") % 3 == 0, F.substring("left", 1, 5)).otherwise(F.col("right")))
    return n.select("p_partkey", T.prefix_related(F.col("left"), F.col("right")).alias("related"), T.chosen(F.col("left"), F.col("right"), F.col("lc"), F.col("rc")).alias("chosen"))


PREFIX_PAIRS = f"""WITH {_NAMES}, n AS (SELECT p_partkey, left_, CASE WHEN p_partkey % 3 = 0 THEN left_[1:5] ELSE right_ END AS right_, lc, rc FROM names),
b AS (SELECT *, replace(left_, ' ', '') AS x, replace(right_, ' ', '') AS y FROM n), r AS (SELECT *, length(x) > 0 AND length(y) > 0 AND (starts_with(x, y) OR starts_with(y, x)) AS related FROM b)
SELECT p_partkey, related, CASE WHEN related THEN CASE WHEN length(left_) > length(right_) THEN left_ ELSE right_ END WHEN lc >= rc THEN left_ ELSE right_ END AS chosen FROM r"""


def effective_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    normal = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), "p_name"))
    return p.select("p_partkey", T.effective(normal, F.col("p_brand")).alias("text"))


EFFECTIVE = "SELECT p_partkey, trim(coalesce(nullif(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_name END, ''), nullif(p_brand, ''), '')) AS text FROM part"


# ---------------------------------------------------------------- chunks


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("video_id").agg(F.max("t").alias("duration"))


_DURATIONS = OBS_SQL + ", dur AS (SELECT video_id, max(t) AS duration FROM obs GROUP BY video_id)"


def chunk_width(spark: SparkSession, d: str) -> DataFrame:
    return _durations(spark, d).select("video_id", F.round(chunks.width_column(F.col("duration"), WIDTH, 2 * WIDTH), 6).alias("width"))


CHUNK_WIDTH = f"WITH {_DURATIONS} SELECT video_id, round(CASE WHEN duration > {2 * WIDTH} THEN duration / greatest(2, ceil(duration / {WIDTH}::DOUBLE)) END, 6) AS width FROM dur"


def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return chunks.planned(_durations(spark, d), F.lit(WIDTH), OVERLAP)


CHUNK_PLAN = f"""WITH {_DURATIONS}, c AS (SELECT video_id, duration, unnest(range(greatest(1, ceil((duration - 1e-9) / {WIDTH}::DOUBLE))::BIGINT)) AS chunk FROM dur)
SELECT video_id, chunk, chunk * {WIDTH}::DOUBLE AS core_start, least(chunk * {WIDTH}::DOUBLE + {WIDTH}, duration) AS core_end, greatest(0, chunk * {WIDTH}::DOUBLE - {OVERLAP}) AS read_start,
  least(duration, least(chunk * {WIDTH}::DOUBLE + {WIDTH}, duration) + {OVERLAP}) AS read_end FROM c"""


def chunk_assign(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select("video_id", "frame_id", "t")
    last = F.greatest(F.lit(1), F.ceil((F.max("t").over(Window.partitionBy("video_id")) - 1e-9) / WIDTH)) - 1
    return chunks.assigned(o.withColumn("_last", last), WIDTH, OVERLAP, F.col("_last")).select("video_id", "frame_id", "chunk")


CHUNK_ASSIGN = f"WITH plan AS ({CHUNK_PLAN}), {OBS_SQL} SELECT o.video_id, o.frame_id, p.chunk FROM obs o JOIN plan p ON o.video_id = p.video_id AND o.t BETWEEN p.read_start AND p.read_end"


def _chunk_events(spark: SparkSession, d: str) -> DataFrame:
    """Line items as short events of the chunks around their begin, every third seen again by the next chunk."""
    i = intervals(spark, d)
    b = F.floor(F.col("start") / 4).cast("long")
    text = F.concat(F.lit("order "), F.col("order_id").cast("string"))
    one = i.select(F.col("source_id").alias("video_id"), b.alias("chunk"), (F.col("order_id") * 10 + F.col("line")).alias("event_id"), "start", (F.col("start") + F.col("line")).alias("stop"), text.alias("text"), (F.col("weight") / 50).alias("confidence"), (F.col("order_id") % 7 * 60).cast("double").alias("l"), F.lit(10.0).alias("t0"))
    one = one.withColumn("r", F.col("l") + 100).withColumn("b0", F.col("t0") + 30)
    again = one.where(F.col("event_id") % 3 == 0).select("video_id", (F.col("chunk") + 1).alias("chunk"), (-F.col("event_id")).alias("event_id"), (F.col("start") + 1).alias("start"), (F.col("stop") + 1).alias("stop"), F.concat("text", F.lit("x")).alias("text"), (F.col("confidence") + 0.01).alias("confidence"), (F.col("l") + 5).alias("l"), "t0", (F.col("r") + 5).alias("r"), "b0")
    return one.unionByName(again)


_CHUNK_EVENTS = INTERVALS_SQL + """, one AS (SELECT source_id AS video_id, floor(start / 4)::BIGINT AS chunk, order_id * 10 + line AS event_id, start, start + line AS stop, 'order ' || order_id::VARCHAR AS text, weight / 50 AS confidence,
  (order_id % 7 * 60)::DOUBLE AS l, 10::DOUBLE AS t0, (order_id % 7 * 60 + 100)::DOUBLE AS r, 40::DOUBLE AS b0 FROM intervals),
ce AS (SELECT * FROM one UNION ALL SELECT video_id, chunk + 1, -event_id, start + 1, stop + 1, text || 'x', confidence + 0.01::DOUBLE, l + 5, t0, r + 5, b0 FROM one WHERE event_id % 3 = 0)"""


def chunk_dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_pairs(_chunk_events(spark, d))


CHUNK_DEDUP = f"""WITH {_CHUNK_EVENTS}, p AS (SELECT a.video_id, a.event_id AS left_id, b.event_id AS right_id, least(a.stop, b.stop) - greatest(a.start, b.start) AS shared, replace(a.text, ' ', '') AS x, replace(b.text, ' ', '') AS y, {G.sql_iou('a.', 'b.')} AS s
  FROM ce a JOIN ce b ON a.video_id = b.video_id AND a.chunk < b.chunk AND b.start <= a.stop + 4.5 + 1e-6 AND a.start <= b.stop + 4.5 + 1e-6),
q AS (SELECT *, greatest(0, 1 - levenshtein(x, y) / greatest(length(x), length(y), 1)::DOUBLE) AS sim, starts_with(x, y) OR starts_with(y, x) AS pre FROM p WHERE shared >= -4.5)
SELECT video_id, left_id, right_id FROM q WHERE (sim >= 0.92 AND (s >= 0.08 OR shared >= 0)) OR (s >= 0.25 AND (sim >= 0.72 OR pre))"""


def merge_pair_agg(spark: SparkSession, d: str) -> DataFrame:
    """Events of one order and ship day are merged."""
    i = intervals(spark, d)
    e = i.select("order_id", (F.col("line") % 2).alias("half"), "start", "stop", (F.col("weight") / 50).alias("confidence"), F.array(F.col("line").cast("long"), (F.col("line") + 10).cast("long")).alias("frames"), F.array(F.concat(F.lit("s"), F.col("source_id").cast("string"))).alias("alternatives"), (F.col("line") > 3).alias("cached"), F.col("line").alias("level"), (F.col("line") % 4).alias("chunk"))
    m = e.groupBy("order_id", "half").agg(*chunks.merged_columns())
    return m.withColumn("frames", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",")).withColumn("alternatives", F.array_join("alternatives", ","))


MERGE_PAIR = f"""WITH {INTERVALS_SQL}, e AS (SELECT *, line % 2 AS half FROM intervals), f AS (SELECT order_id, half, string_agg(f::VARCHAR, ',' ORDER BY f) AS frames FROM (SELECT DISTINCT order_id, half, unnest([line, line + 10]) AS f FROM e) GROUP BY ALL),
a AS (SELECT order_id, half, string_agg(s, ',' ORDER BY s) AS alternatives FROM (SELECT DISTINCT order_id, half, 's' || source_id::VARCHAR AS s FROM e) GROUP BY ALL)
SELECT order_id, half, min(start) AS start, max(stop) AS stop, max(weight / 50) AS confidence, any_value(frames) AS frames, any_value(alternatives) AS alternatives, bool_or(line > 3) AS cached, max(line) AS level, min(line % 4) AS chunk
FROM e JOIN f USING (order_id, half) JOIN a USING (order_id, half) GROUP BY order_id, half"""


def history_merge(spark: SparkSession, d: str) -> DataFrame:
    i = intervals(spark, d)
    points = F.collect_list(F.struct(F.col("stop").alias("t"), F.col("line").alias("line")))
    m = i.groupBy("order_id").agg(chunks.merged_history(points).alias("h"))
    return m.select("order_id", F.array_join(F.transform("h", lambda p: p["t"].cast("long").cast("string")), ",").alias("times"), F.size("h").alias("n"))


HISTORY_MERGE = f"WITH {INTERVALS_SQL}, s AS (SELECT DISTINCT order_id, stop FROM intervals) SELECT order_id, string_agg(stop::BIGINT::VARCHAR, ',' ORDER BY stop) AS times, count(*)::INT AS n FROM s GROUP BY order_id"


def profile_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    p = e.groupBy("user_id", "event_type").agg(F.sum(k).alias("frames"), F.count(F.lit(1)).alias("calls")).select("user_id", "frames", "calls", F.create_map("event_type", "frames").alias("counters"))
    r = chunks.rolled_up(p, ["user_id"], ["frames", "calls"], "counters")
    return r.withColumn("counters", F.array_join(F.transform(F.map_entries("counters"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","))


PROFILE_ROLLUP = """WITH p AS (SELECT user_id, event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS f, count(*) AS c FROM events GROUP BY ALL)
SELECT user_id, sum(f)::BIGINT AS frames, sum(c)::BIGINT AS calls, string_agg(event_type || '=' || f::VARCHAR, ',' ORDER BY event_type) AS counters FROM p GROUP BY user_id"""


def chunk_merge_full(spark: SparkSession, d: str) -> DataFrame:
    """All that is merged: extent, text, box, history, frames, alternatives, flags."""
    e = _chunk_events(spark, d)
    whole = F.col("start").cast("long")
    point = lambda t: F.struct(t.alias("t"), F.col("l"), F.col("t0"), F.col("r"), F.col("b0"))
    e = e.select("*", F.array(point(F.col("start")), point(F.col("stop"))).alias("history"), F.array(whole % 97, whole).alias("frames"), F.array("text", F.concat(F.lit("c"), F.col("chunk").cast("string"))).alias("alternatives"), (F.abs("event_id") % 5 == 0).alias("cached"), (F.abs("event_id") % 4).cast("int").alias("level"))
    m = chunks.merge_chunk_events(e)
    joined = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return m.select(*[c for c in m.columns if c not in ("history", "frames", "alternatives")], joined("history", lambda p: F.concat_ws("/", p["t"].cast("long").cast("string"), p["l"].cast("long").cast("string"))), joined("frames", lambda x: x.cast("string")), joined("alternatives", lambda x: x))


_MERGE_AS_ONE = """(least(m.stop, e.stop) - greatest(m.start, e.start) >= -1e-6 OR greatest(m.start, e.start) - least(m.stop, e.stop) <= 4.5) AND m.chunk <> e.chunk AND length(m.text) > 0 AND length(e.text) > 0 AND (
  (SIM >= 0.92 AND (IOU >= 0.08 OR least(m.stop, e.stop) - greatest(m.start, e.start) >= 0)) OR (IOU >= 0.25 AND (SIM >= 0.72 OR starts_with(BARE_M, BARE_E) OR starts_with(BARE_E, BARE_M))))""".replace(
    "SIM", "greatest(0, 1 - levenshtein(BARE_M, BARE_E) / greatest(length(BARE_M), length(BARE_E), 1)::DOUBLE)"
).replace("IOU", G.sql_iou("m.", "e.")).replace("BARE_M", "replace(m.text, ' ', '')").replace("BARE_E", "replace(e.text, ' ', '')")
_PREFIX = "(starts_with(replace(m.text, ' ', ''), replace(e.text, ' ', '')) OR starts_with(replace(e.text, ' ', ''), replace(m.text, ' ', '')))"
_TAKE_NEW = f"(CASE WHEN {_PREFIX} THEN length(e.text) >= length(m.text) ELSE e.confidence > m.confidence END)"
_EVENT_ROW = "{{'event_id': {0}event_id, 'chunk': {0}chunk, 'start': {0}start, 'stop': {0}stop, 'text': {0}text, 'confidence': {0}confidence, 'l': {0}l, 't0': {0}t0, 'r': {0}r, 'b0': {0}b0, 'h': {0}h, 'f': {0}f, 'alt': {0}alt, 'cached': {0}cached, 'level': {0}level, 'n': {0}n}}"
_LAST = lambda c: f"CASE WHEN e.stop >= m.stop THEN e.{c} ELSE m.{c} END"
#: the fold as a recursion over each stream's events; its state is the list of merged rows that a later event can still reach
CHUNK_MERGE_FULL = f"""WITH RECURSIVE {_CHUNK_EVENTS}, x AS (SELECT *, [{{'t': start, 'l': l}}, {{'t': stop, 'l': l}}] AS h, [start::BIGINT % 97, start::BIGINT] AS f, [text, 'c' || chunk::VARCHAR] AS alt, abs(event_id) % 5 = 0 AS cached, (abs(event_id) % 4)::INT AS level, 1::BIGINT AS n FROM ce),
o AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start, chunk, event_id) AS rn, {_EVENT_ROW.format("")} AS e FROM x),
g AS (
  SELECT video_id, 0::BIGINT AS rn, list_filter([e], lambda m: false) AS near, list_filter([e], lambda m: false) AS gone FROM o WHERE rn = 1
  UNION ALL
  SELECT video_id, rn, CASE WHEN hit IS NULL THEN list_append(alive, e) ELSE list_transform(alive, lambda m, i: CASE WHEN i = hit THEN {{'event_id': m.event_id, 'chunk': least(m.chunk, e.chunk), 'start': least(m.start, e.start), 'stop': greatest(m.stop, e.stop), 'text': CASE WHEN {_TAKE_NEW} THEN e.text ELSE m.text END,
      'confidence': greatest(m.confidence, e.confidence), 'l': {_LAST("l")}, 't0': {_LAST("t0")}, 'r': {_LAST("r")}, 'b0': {_LAST("b0")}, 'h': list_concat(m.h, e.h), 'f': list_concat(m.f, e.f), 'alt': list_concat(m.alt, e.alt), 'cached': m.cached OR e.cached, 'level': greatest(m.level, e.level), 'n': m.n + 1}} ELSE m END) END, gone
  FROM (SELECT *, list_position(list_transform(alive, lambda m: {_MERGE_AS_ONE}), true) AS hit FROM (
    SELECT o.video_id, o.rn, o.e, list_filter(g.near, lambda m: m.stop >= o.e.start - 4.5 - 1e-6) AS alive, list_filter(g.near, lambda m: m.stop < o.e.start - 4.5 - 1e-6) AS gone FROM g JOIN o ON o.video_id = g.video_id AND o.rn = g.rn + 1))
), ends AS (SELECT video_id, max(rn) AS rn FROM g GROUP BY video_id),
d AS (SELECT video_id, unnest(gone) AS m FROM g UNION ALL SELECT g.video_id, unnest(near) AS m FROM g JOIN ends USING (video_id, rn)),
r AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY m.start, m.stop, m.chunk, m.event_id) AS event_id, m FROM d)
SELECT video_id, m.chunk, event_id, m.start, m.stop, m.text, m.confidence, m.l, m.t0, m.r, m.b0, m.cached, m.level, m.n,
  (SELECT string_agg(p.t::BIGINT::VARCHAR || '/' || p.l::BIGINT::VARCHAR, ',' ORDER BY p.t) FROM (SELECT t, arg_min(l, i) AS l FROM (SELECT unnest(m.h).t AS t, unnest(m.h).l AS l, unnest(range(len(m.h))) AS i) GROUP BY t) p) AS history,
  array_to_string(list_sort(list_distinct(m.f)), ',') AS frames,
  (SELECT string_agg(a, ',' ORDER BY i) FROM (SELECT a, min(i) AS i FROM (SELECT unnest(m.alt) AS a, unnest(range(len(m.alt))) AS i) GROUP BY a)) AS alternatives
FROM r"""


# ---------------------------------------------------------------- evaluation


def temporal_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    i = intervals(spark, d)
    w = segments.over("order_id", "line")
    p = i.select("order_id", "line", "start", "stop", (F.lag("start").over(w) + 3).alias("ps"), F.lag("stop").over(w).alias("pe")).where("ps IS NOT NULL")
    return p.select("order_id", "line", F.round(evaluate.temporal_iou(*map(F.col, ("start", "stop", "ps", "pe"))), 9).alias("iou"))


TEMPORAL_IOU = f"""WITH {INTERVALS_SQL}, p AS (SELECT order_id, line, start, stop, lag(start) OVER w + 3 AS ps, lag(stop) OVER w AS pe FROM intervals WINDOW w AS (PARTITION BY order_id ORDER BY line))
SELECT order_id, line, round(CASE WHEN greatest(stop, pe) - least(start, ps) > 0 THEN greatest(0, least(stop, pe) - greatest(start, ps)) / (greatest(stop, pe) - least(start, ps)) ELSE 0 END, 9) AS iou FROM p WHERE ps IS NOT NULL"""


def nearest_polygon(spark: SparkSession, d: str) -> DataFrame:
    h = intervals(spark, d).groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line"), F.col("stop").alias("t")))).alias("h"), (F.min("start") + 40).alias("at"))
    return h.select("order_id", evaluate.nearest(F.col("h"), F.col("at"))["line"].alias("line"))


NEAREST = f"WITH {INTERVALS_SQL}, a AS (SELECT order_id, min(start) + 40 AS mid FROM intervals GROUP BY order_id) SELECT order_id, arg_min(line, [abs(stop - mid), line]) AS line FROM intervals JOIN a USING (order_id) GROUP BY order_id"


def history_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each content segment's geometry within its time; the nearest one to its begin where there is none."""
    w = segments.over("video_id", "frame_id")
    o = observations(spark, d)
    cut = segments.islands(o.where("tier <> 1").select("video_id", "frame_id", "t", "content"), F.lag("content").over(w) != F.col("content"), "video_id", "frame_id")
    seg = cut.groupBy("video_id", "island").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return evaluate.samples_of_segments(seg, o.where("tier = 1").select("video_id", "frame_id", "t"), bin_sec=DAY)


HISTORY_JOIN = f"""WITH {OBS_SQL}, c AS (SELECT video_id, frame_id, t, content FROM obs WHERE tier <> 1), m AS (SELECT *, CASE WHEN lag(content) OVER (PARTITION BY video_id ORDER BY frame_id) IS DISTINCT FROM content THEN 1 ELSE 0 END AS b FROM c),
i AS (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY frame_id)::BIGINT AS island FROM m), seg AS (SELECT video_id, island, min(t) AS first, max(t) AS last FROM i GROUP BY ALL), s AS (SELECT video_id, frame_id, t FROM obs WHERE tier = 1),
ins AS (SELECT seg.video_id, island, frame_id FROM seg JOIN s ON s.video_id = seg.video_id AND s.t BETWEEN first - 1e-6 AND last + 1e-6),
alone AS (SELECT seg.* FROM seg ANTI JOIN ins USING (video_id, island))
SELECT * FROM ins UNION ALL SELECT a.video_id, a.island, arg_min(frame_id, [abs(s.t - first), frame_id::DOUBLE]) FROM alone a JOIN s USING (video_id) GROUP BY a.video_id, a.island"""


def _reference(spark: SparkSession, d: str) -> DataFrame:
    return _reference_of(intervals(spark, d))


def _reference_of(i: DataFrame) -> DataFrame:
    box = lambda x: F.struct(F.col("start").alias("t"), x.alias("l"), F.lit(10.0).alias("t0"), (x + 100).alias("r"), F.lit(40.0).alias("b0"))
    left = (F.col("order_id") % 7 * 60).cast("double")
    return i.select(F.col("source_id").alias("video_id"), (F.col("order_id") * 10 + F.col("line")).alias("event_id"), "start", (F.col("start") + F.col("line")).alias("stop"), F.concat(F.lit("order "), F.col("order_id").cast("string")).alias("text"), F.array(box(left)).alias("history"))


def _predicted(reference: DataFrame) -> DataFrame:
    """The reference less every seventh event, moved a little, every eleventh twice."""
    r = reference.where(F.col("event_id") % 7 != 0)
    moved = F.transform("history", lambda p: F.struct(p["t"].alias("t"), (p["l"] + 10).alias("l"), p["t0"].alias("t0"), (p["r"] + 10).alias("r"), p["b0"].alias("b0")))
    p = r.select("video_id", "event_id", (F.col("start") + F.col("event_id") % 3 / 4).alias("start"), "stop", F.when(F.col("event_id") % 5 == 0, F.concat("text", F.lit("z"))).otherwise(F.col("text")).alias("text"), moved.alias("history"))
    ids = F.when(F.col("event_id") % 11 == 0, F.array("event_id", -F.col("event_id"))).otherwise(F.array("event_id"))
    return p.withColumn("event_id", F.explode(ids))


_EVALUATION = INTERVALS_SQL + f""", ref AS (SELECT source_id AS video_id, order_id * 10 + line AS event_id, start, start + line AS stop, 'order ' || order_id::VARCHAR AS text, (order_id % 7 * 60)::DOUBLE AS l, 10::DOUBLE AS t0, (order_id % 7 * 60 + 100)::DOUBLE AS r, 40::DOUBLE AS b0 FROM intervals),
pre AS (SELECT video_id, event_id, start + event_id % 3 / 4::DOUBLE AS start, stop, CASE WHEN event_id % 5 = 0 THEN text || 'z' ELSE text END AS text, l + 10 AS l, t0, r + 10 AS r, b0 FROM ref WHERE event_id % 7 <> 0),
pred AS (SELECT * FROM pre UNION ALL SELECT * REPLACE (-event_id AS event_id) FROM pre WHERE event_id % 11 = 0),
sc AS (SELECT a.video_id, a.event_id AS ref_id, b.event_id AS pred_id, CASE WHEN greatest(a.stop, b.stop) - least(a.start, b.start) > 0 THEN greatest(0, least(a.stop, b.stop) - greatest(a.start, b.start)) / (greatest(a.stop, b.stop) - least(a.start, b.start)) ELSE 0 END AS ts,
  replace(a.text, ' ', '') AS x, replace(b.text, ' ', '') AS y, {G.sql_iou('a.', 'b.')} AS ss FROM ref a JOIN pred b ON a.video_id = b.video_id),
pairs AS (SELECT *, round(0.55::DOUBLE * xs + 0.25::DOUBLE * ts + 0.2::DOUBLE * ss, 9) AS score FROM (SELECT *, greatest(0, 1 - levenshtein(x, y) / greatest(length(x), length(y), 1)::DOUBLE) AS xs FROM sc WHERE ts >= 0.1) WHERE xs >= 0.55 AND ss >= 0.05),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, ref_id DESC, pred_id DESC) AS rk FROM pairs),
g AS (
  SELECT video_id, rk, ref_id, pred_id, true AS ok, [ref_id] AS ua, [pred_id] AS ub FROM rk WHERE rk = 1
  UNION ALL
  SELECT video_id, rk, ref_id, pred_id, ok, CASE WHEN ok THEN list_append(ua, ref_id) ELSE ua END, CASE WHEN ok THEN list_append(ub, pred_id) ELSE ub END
  FROM (SELECT r.video_id, r.rk, r.ref_id, r.pred_id, g.ua, g.ub, NOT list_contains(g.ua, r.ref_id) AND NOT list_contains(g.ub, r.pred_id) AS ok FROM g JOIN rk r ON r.video_id = g.video_id AND r.rk = g.rk + 1)
), mt AS (SELECT video_id, ref_id, pred_id FROM g WHERE ok)"""


def match_events(spark: SparkSession, d: str) -> DataFrame:
    r = _reference(spark, d)
    return evaluate.matched(stored(evaluate.candidate_pairs(r, _predicted(r), bin_sec=16.0).select("video_id", "ref_id", "pred_id", "score", "begin", "end")))


MATCH_EVENTS = f"WITH RECURSIVE {_EVALUATION} SELECT * FROM mt"


def recall_accuracy(spark: SparkSession, d: str) -> DataFrame:
    r = _reference_of(stored(intervals(spark, d).select("order_id", "line", "source_id", "start")))
    p = _predicted(r)
    pairs = evaluate.candidate_pairs(r, p, bin_sec=16.0).select("video_id", "ref_id", "pred_id", "score", "time_score", "space_score", "edits", "chars", "begin", "end")
    return evaluate.report(r, p, stored(pairs))


RECALL_ACCURACY = f"""WITH RECURSIVE {_EVALUATION}, m AS (SELECT p.* FROM mt JOIN pairs p USING (video_id, ref_id, pred_id)),
s AS (SELECT video_id, count(*) AS n, sum(levenshtein(x, y)) AS e, sum(greatest(length(x), 1)) AS c, avg(ts) AS ts, avg(ss) AS ss FROM m GROUP BY video_id),
du AS (SELECT video_id, count(DISTINCT pred_id) AS du FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.video_id = p.video_id AND mt.pred_id = p.pred_id) AND EXISTS (SELECT 1 FROM mt WHERE mt.video_id = p.video_id AND mt.ref_id = p.ref_id) GROUP BY video_id),
a AS (SELECT video_id, count(*) AS ra FROM ref GROUP BY video_id), b AS (SELECT video_id, count(*) AS pa FROM pred GROUP BY video_id)
SELECT video_id, coalesce(ra, 0) AS reference_events, coalesce(pa, 0) AS predicted_events, coalesce(n, 0) AS matched_events, round(coalesce(n, 0) / greatest(coalesce(ra, 0), 1)::DOUBLE, 9) AS event_recall, round(greatest(0, 1 - coalesce(e, 0) / greatest(coalesce(c, 0), 1)::DOUBLE), 9) AS text_accuracy,
  round(coalesce(du, 0) / greatest(coalesce(pa, 0), 1)::DOUBLE, 9) AS duplicate_rate, round(coalesce(ts, 0), 6) AS mean_temporal_iou, round(coalesce(ss, 0), 6) AS mean_spatial_iou
FROM a FULL JOIN b USING (video_id) LEFT JOIN s USING (video_id) LEFT JOIN du USING (video_id)"""


def duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    return recall_accuracy(spark, d).select("video_id", "duplicate_rate")


DUPLICATE_RATE = f"SELECT video_id, duplicate_rate FROM ({RECALL_ACCURACY})"


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.percentile(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value", {"p50": 0.50, "p95": 0.95, "p99": 0.99})


LATENCY = "SELECT event_type, " + ", ".join(f"list(value ORDER BY value)[round_even((count(*) - 1) * {p}::DOUBLE, 0)::INT + 1] AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM events GROUP BY event_type"


def rank_runs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    runs = s.select("s_suppkey", (k % 5 / 5).alias("event_recall"), (k % 7 / 7).alias("text_accuracy"), (k % 3 / 3).alias("duplicate_rate"), evaluate.throughput(F.lit(60.0), (k % 11).cast("double")).alias("video_realtime"))
    return evaluate.ranked_runs(runs, "s_suppkey").select("s_suppkey", F.col("place").cast("long").alias("place"))


RANK_RUNS = "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 5 DESC, s_suppkey % 7 DESC, s_suppkey % 3, CASE WHEN s_suppkey % 11 > 0 THEN 60 / (s_suppkey % 11)::DOUBLE ELSE 0 END DESC, s_suppkey) AS place FROM supplier"


def event_page(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select("event_id", "t", "content").orderBy("t", "event_id").offset(200).limit(100)


EVENT_PAGE = f"WITH {OBS_SQL} SELECT event_id, t, content FROM obs ORDER BY t, event_id LIMIT 100 OFFSET 200"


def stream_info(spark: SparkSession, d: str) -> DataFrame:
    """What a probe of a stream says: frames, duration (else frames over rate), rate."""
    n, span = F.count(F.lit(1)), F.max("t") - F.min("t")
    o = observations(spark, d).groupBy("video_id").agg(n.alias("frames"), span.alias("span"))
    return o.select("video_id", "frames", F.round(F.coalesce(F.nullif("span", F.lit(0.0)), F.col("frames") / 25.0), 6).alias("duration"), F.round(F.when(F.col("span") > 0, F.col("frames") / F.col("span")), 9).alias("rate"))


STREAM_INFO = f"WITH {OBS_SQL}, s AS (SELECT video_id, count(*) AS frames, max(t) - min(t) AS span FROM obs GROUP BY video_id) SELECT video_id, frames, round(coalesce(nullif(span, 0), frames / 25.0::DOUBLE), 6) AS duration, round(CASE WHEN span > 0 THEN frames / span END, 9) AS rate FROM s"


def picked_counters(spark: SparkSession, d: str) -> DataFrame:
    """Those of a fixed set of counters that a profile has."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    kept = F.map_filter("m", lambda k, v: k.isin("click", "purchase", "none"))
    return m.select("user_id", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ",").alias("picked"))


PICKED = "SELECT user_id, coalesce(string_agg(event_type || '=' || n::VARCHAR, ',' ORDER BY event_type || '=' || n::VARCHAR) FILTER (WHERE event_type IN ('click', 'purchase', 'none')), '') AS picked FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id"


def shifted_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select("event_id", F.floor(F.col("t") / WIDTH).cast("long").alias("chunk"), F.col("frame_id").alias("geometry_id"), (F.col("frame_id") + 1).alias("content_id"))
    return chunks.shifted_ids(o)


SHIFTED_IDS = f"WITH {OBS_SQL}, c AS (SELECT event_id, floor(t / {WIDTH}::DOUBLE)::BIGINT AS chunk, frame_id FROM obs) SELECT event_id, chunk, frame_id + chunk * 10000000 AS geometry_id, frame_id + 1 + chunk * 10000000 AS content_id FROM c"


def deferred_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Contents whose recognition waits, as they are still being typed."""
    o = observations(spark, d)
    wait = recognition.deferred(F.col("tier") == 2, F.col("k") % 4, (F.col("event_id") % 9) / 8)
    return o.where(wait).select("video_id", "event_id")


DEFERRED = f"WITH {OBS_SQL} SELECT video_id, event_id FROM obs WHERE tier <> 2 AND k % 4 < 2 AND event_id % 9 / 8::DOUBLE >= 0.6"


# ---------------------------------------------------------------- recognition


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct("l_partkey", "l_returnflag"), F.struct("l_quantity", "l_partkey", "l_returnflag")).alias("b")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), best).select("*", "b.*")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id"), (F.col("l_partkey") % 500).alias("sig"), F.round(F.col("l_quantity") / 50, 6).alias("score"), "l_returnflag", "l_linenumber", "l_orderkey")


def recognition_cache_join(spark: SparkSession, d: str) -> DataFrame:
    t = _tasks(spark, d)
    cache = recognition.latest_entries(t.where("l_linenumber = 1 AND score > 0.9").select("sig", F.col("l_returnflag").alias("text"), "task_id"), ["sig"], "task_id")
    j = recognition.with_cache(t.select("task_id", "sig"), cache, ["sig"])
    return j.select("task_id", "text", "cached")


_LINES = "lines AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey DESC, l_returnflag DESC) = 1)"
CACHE_JOIN = f"""WITH {_LINES}, t AS (SELECT l_orderkey * 10 + l_linenumber AS task_id, l_partkey % 500 AS sig, round(l_quantity / 50, 6) AS score, l_returnflag, l_linenumber FROM lines),
c AS (SELECT sig, arg_max(l_returnflag, task_id) AS text FROM t WHERE l_linenumber = 1 AND score > 0.9 GROUP BY sig) SELECT task_id, text, c.sig IS NOT NULL AS cached FROM t LEFT JOIN c USING (sig)"""


def fallback_choice(spark: SparkSession, d: str) -> DataFrame:
    """The readings of an order's lines as candidates of one task; weak ones would be read again."""
    t = _tasks(spark, d).withColumn("text", F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")))
    b = recognition.best_result(t, ["l_orderkey"], "score", "text", "l_linenumber")
    return b.select("l_orderkey", "text", "score", F.array_join("alternatives", ",").alias("alternatives"), "level", recognition.needs_fallback(F.col("score"), F.size("alternatives") + 1).alias("retry"))


FALLBACK = f"""WITH {_LINES}, t AS (SELECT l_orderkey, l_linenumber, round(l_quantity / 50, 6) AS score, l_returnflag || (l_linenumber % 3)::VARCHAR AS text FROM lines),
b AS (SELECT l_orderkey, text, score FROM t QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) = 1),
o AS (SELECT l_orderkey, string_agg(text, ',' ORDER BY n) AS alt, count(*) AS k FROM (SELECT t.l_orderkey, t.text, min(l_linenumber) AS n FROM t JOIN b ON b.l_orderkey = t.l_orderkey AND b.text <> t.text GROUP BY ALL) GROUP BY l_orderkey)
SELECT l_orderkey, text, score, coalesce(alt, '') AS alternatives, (CASE WHEN k > 0 THEN 2 ELSE 1 END)::INT AS level, score < 0.82 AND coalesce(k, 0) > 0 AS retry FROM b LEFT JOIN o USING (l_orderkey)"""


def batch_ids(spark: SparkSession, d: str) -> DataFrame:
    return recognition.batch_ids(observations(spark, d).select("video_id", "frame_id"), ["video_id"], ["frame_id"], 16)


BATCH_IDS = f"WITH {OBS_SQL} SELECT video_id, frame_id, frame_id // 16 AS batch FROM obs"


def event_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Line items as contents, their orders' returned lines as geometry, every line of some weight as a result, every fifth of them without a text."""
    i = intervals(spark, d)
    contents = i.select(F.col("source_id").alias("video_id"), (F.col("order_id") * 10 + F.col("line")).alias("content_id"), F.col("order_id").alias("geometry_id"), "start")
    geometry = i.where("weight > 25").groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line"), F.col("stop").alias("t")))).alias("history")).withColumnRenamed("order_id", "geometry_id")
    results = i.where("weight > 10").select((F.col("order_id") * 10 + F.col("line")).alias("content_id"), F.when(F.col("order_id") % 5 == 0, " ").otherwise(F.concat(F.lit("order "), F.col("order_id").cast("string"))).alias("text"))
    a = recognition.assembled(contents, geometry, results)
    return a.select("video_id", "event_id", "content_id", "start", "text", F.col("last.line").alias("last_line"), F.col("last.t").alias("last_t"))


EVENT_ASSEMBLY = f"""WITH {INTERVALS_SQL}, g AS (SELECT order_id AS geometry_id, max(line) AS last_line, arg_max(stop, line) AS last_t FROM intervals WHERE weight > 25 GROUP BY order_id),
r AS (SELECT order_id * 10 + line AS content_id, CASE WHEN order_id % 5 = 0 THEN ' ' ELSE 'order ' || order_id::VARCHAR END AS text FROM intervals WHERE weight > 10)
SELECT source_id AS video_id, row_number() OVER (PARTITION BY source_id ORDER BY start, content_id) AS event_id, content_id, start, text, last_line, last_t
FROM (SELECT *, order_id * 10 + line AS content_id FROM intervals) i LEFT JOIN r USING (content_id) LEFT JOIN g ON g.geometry_id = i.order_id WHERE trim(text) <> ''"""


def queue_batches(spark: SparkSession, d: str) -> DataFrame:
    """Observations as tasks of a queue that is flushed at 16 tasks or when the oldest is half a day old."""
    return recognition.queued_batches(observations(spark, d), "video_id", "t", "event_id", 16, DAY / 2)


QUEUE_BATCHES = f"""WITH RECURSIVE {OBS_SQL}, o AS (SELECT video_id, event_id, t, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS rn FROM obs),
g AS (
  SELECT video_id, rn, event_id, t, t AS oldest, 1 AS n, 0::BIGINT AS batch FROM o WHERE rn = 1
  UNION ALL
  SELECT o.video_id, o.rn, o.event_id, o.t, CASE WHEN due THEN o.t ELSE oldest END, CASE WHEN due THEN 1 ELSE n + 1 END, CASE WHEN due THEN batch + 1 ELSE batch END
  FROM (SELECT *, n >= 16 OR t - oldest >= {DAY / 2}::DOUBLE AS due FROM g) g JOIN o ON o.video_id = g.video_id AND o.rn = g.rn + 1
) SELECT video_id, event_id, batch FROM g"""


def task_result_check(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"))
    r = table(spark, d, "lineitem").where(F.col("l_linenumber") == 4).select(F.col("l_orderkey").alias("task_id"))
    return recognition.unmatched_results(o, r, "task_id")


TASK_CHECK = "SELECT coalesce(o, l) AS task_id, o IS NOT NULL AS asked, l IS NOT NULL AS answered FROM (SELECT o_orderkey AS o FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem WHERE l_linenumber = 4) ON o = l WHERE o IS NULL OR l IS NULL"


QUERIES = {
    "text_normalize": (text_normalize, TEXT_NORMALIZE),
    "text_similarity_pairs": (text_similarity_pairs, TEXT_SIMILARITY),
    "prefix_pairs": (prefix_pairs, PREFIX_PAIRS),
    "effective_text": (effective_text, EFFECTIVE),
    "chunk_width": (chunk_width, CHUNK_WIDTH),
    "chunk_plan": (chunk_plan, CHUNK_PLAN),
    "chunk_assign": (chunk_assign, CHUNK_ASSIGN),
    "chunk_dedup_pairs": (chunk_dedup_pairs, CHUNK_DEDUP),
    "merge_pair_agg": (merge_pair_agg, MERGE_PAIR),
    "history_merge": (history_merge, HISTORY_MERGE),
    "profile_rollup": (profile_rollup, PROFILE_ROLLUP),
    "temporal_iou_pairs": (temporal_iou_pairs, TEMPORAL_IOU),
    "nearest_polygon": (nearest_polygon, NEAREST),
    "history_interval_join": (history_interval_join, HISTORY_JOIN),
    "match_events": (match_events, MATCH_EVENTS),
    "recall_accuracy": (recall_accuracy, RECALL_ACCURACY),
    "duplicate_rate": (duplicate_rate, DUPLICATE_RATE),
    "latency_percentiles": (latency_percentiles, LATENCY),
    "rank_runs": (rank_runs, RANK_RUNS),
    "event_page": (event_page, EVENT_PAGE),
    "stream_info": (stream_info, STREAM_INFO),
    "picked_counters": (picked_counters, PICKED),
    "shifted_chunk_ids": (shifted_chunk_ids, SHIFTED_IDS),
    "deferred_tasks": (deferred_tasks, DEFERRED),
    "recognition_cache_join": (recognition_cache_join, CACHE_JOIN),
    "fallback_choice": (fallback_choice, FALLBACK),
    "batch_ids": (batch_ids, BATCH_IDS),
    "event_assembly": (event_assembly, EVENT_ASSEMBLY),
    "queue_batches": (queue_batches, QUEUE_BATCHES),
    "task_result_check": (task_result_check, TASK_CHECK),
    "chunk_merge_full": (chunk_merge_full, CHUNK_MERGE_FULL),
}
