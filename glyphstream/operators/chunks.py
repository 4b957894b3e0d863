"""Chunks of long streams: planning, assignment of frames, and joining what neighbouring chunks saw twice."""

from __future__ import annotations

import bisect
import math
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from ..functions import text as T
from .ordered import scan

TARGET, SHORT, OVERLAP, ID_STEP = 180.0, 300.0, 4.0, 10_000_000


def chunk_width(duration: float, target: float = TARGET, short: float = SHORT) -> float | None:
    """None for a short stream, else the width that splits it evenly near the target."""
    return None if duration <= short else duration / max(2, math.ceil(duration / target))


def width_column(duration: Column, target: float = TARGET, short: float = SHORT) -> Column:
    return F.when(duration > short, duration / F.greatest(F.lit(2), F.ceil(duration / target)))


def planned(durations: DataFrame, width: Column, overlap: float, key: str = "video_id", duration: str = "duration", start: float = 0.0) -> DataFrame:
    """key, chunk, core_start, core_end, read_start, read_end: cores tile each stream, reads reach ``overlap`` beyond them on both sides. Streams without
    a width or a duration, or too narrow a width, are errors."""
    d = durations.withColumn("_w", width)
    bad = F.col("_w").isNull() | (F.col("_w") <= 2 * overlap) | F.col(duration).isNull() | (F.col(duration) < 0)
    say = F.concat(F.lit("a chunk must be more than twice as wide as the overlap, and a stream have a duration: width "), F.coalesce(F.col("_w").cast("string"), F.lit("null")))
    d = d.withColumn("_w", F.when(bad, F.raise_error(say).cast("double")).otherwise(F.col("_w")))
    n = F.greatest(F.lit(1), F.ceil((F.col(duration) - 1e-9) / F.col("_w"))).cast("long")
    d = d.select(key, duration, "_w", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    begin = start + F.col("chunk") * F.col("_w")
    end = F.least(begin + F.col("_w"), F.lit(start) + F.col(duration))
    return d.select(key, "chunk", begin.alias("core_start"), end.alias("core_end"), F.greatest(F.lit(start), begin - overlap).alias("read_start"), F.least(F.lit(start) + F.col(duration), end + overlap).alias("read_end"))


def assigned(frames: DataFrame, width: float, overlap: float, last: Column, t: str = "t") -> DataFrame:
    """Frames with every chunk whose read window holds them: arithmetic, no range join. ``last`` is the last chunk of the frame's stream."""
    low = F.greatest(F.lit(0), F.ceil((F.col(t) - overlap) / width - 1)).cast("long")
    high = F.least(last, F.floor((F.col(t) + overlap) / width)).cast("long")
    return frames.withColumn("chunk", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))


def shifted_ids(df: DataFrame, chunk: str = "chunk", step: int = ID_STEP, ids: tuple[str, ...] = ("geometry_id", "content_id")) -> DataFrame:
    """Ids that are unique across chunks."""
    return df.withColumns({c: F.col(c) + F.col(chunk) * step for c in ids})


def same_event(a, b, text_similarity: Column, spatial: Column, prefix: Column, overlap: float = OVERLAP) -> Column:
    """May two events of different chunks be one? ``a`` and ``b`` name columns: a("start")."""
    shared = F.least(a("stop"), b("stop")) - F.greatest(a("start"), b("start"))
    near = (shared >= -1e-6) | (-shared <= max(1.25, overlap + 0.5))
    texts = (F.length(a("text")) > 0) & (F.length(b("text")) > 0)
    alike = ((text_similarity >= 0.92) & ((spatial >= 0.08) | (shared >= 0))) | ((spatial >= 0.25) & ((text_similarity >= 0.72) | prefix))
    return (a("chunk") != b("chunk")) & near & texts & alike


def chunk_pairs(events: DataFrame, overlap: float = OVERLAP, bin_sec: float = 16.0) -> DataFrame:
    """Pairs of events (video_id, chunk, event_id, start, stop, text, l, t0, r, b0) of two chunks that may be one, the lower chunk's first. Events, half the
    reach longer at both ends, meet in the time bins that both touch and count in the first of them; the residual test follows."""
    reach = max(1.25, overlap + 0.5)
    e = events.where(F.length("text") > 0)
    cols = ["event_id", "start", "stop", "text", "l", "t0", "r", "b0", "chunk"]

    def side(p: str) -> DataFrame:
        first, last = F.floor((F.col("start") - reach / 2 - 1e-6) / bin_sec), F.floor((F.col("stop") + reach / 2 + 1e-6) / bin_sec)
        return e.select("video_id", F.explode(F.sequence(first, last)).alias("bin"), first.alias(p + "first"), T.bare(F.col("text")).alias(p + "bare"), *[F.col(c).alias(p + c) for c in cols])

    pairs = side("a_").join(side("b_"), ["video_id", "bin"]).where((F.col("bin") == F.greatest("a_first", "b_first")) & (F.col("a_chunk") < F.col("b_chunk")))
    pairs = pairs.where((F.col("b_start") <= F.col("a_stop") + reach + 1e-6) & (F.col("a_start") <= F.col("b_stop") + reach + 1e-6))
    x, y = F.col("a_bare"), F.col("b_bare")
    # boxes apart can only be one event if they share time, and are told by text alone then
    a, b = G.box_cols("a_"), G.box_cols("b_")
    meet = (F.greatest(a[0], b[0]) < F.least(a[2], b[2])) & (F.greatest(a[1], b[1]) < F.least(a[3], b[3]))
    pairs = pairs.where(meet | (F.least("a_stop", "b_stop") >= F.greatest("a_start", "b_start")))
    # as generators, so that a filter pushed below does not evaluate them for each place that names them; texts are compared only where edits can pass
    pairs = pairs.withColumn("spatial", F.explode(F.filter(F.array(G.iou(a, b)), lambda s: (s >= 0.08) | (F.least("a_stop", "b_stop") >= F.greatest("a_start", "b_start")))))
    longest = F.greatest(F.length(x), F.length(y), F.lit(1))
    most = ((1 - F.when(F.col("spatial") >= 0.25, 0.72).otherwise(0.92)) * longest + 1e-6).cast("int")
    prefix = (F.length(x) > 0) & (F.length(y) > 0) & (F.startswith(x, y) | F.startswith(y, x))
    similar = F.when(x == y, 1.0).when((most < 1) | (F.abs(F.length(x) - F.length(y)) > most), 0.0).otherwise(T.similarity(x, y))
    pairs = pairs.where((x == y) | (most >= 1) | (F.col("spatial") >= 0.25)).withColumn("similar", F.explode(F.array(similar)))
    ok = same_event(lambda c: F.col("a_" + c), lambda c: F.col("b_" + c), F.col("similar"), F.col("spatial"), prefix, overlap)
    return pairs.where(ok).select("video_id", F.col("a_event_id").alias("left_id"), F.col("b_event_id").alias("right_id"))


def merged_columns(confidence: str = "confidence") -> list[Column]:
    """Aggregates of events that are one: extent, best confidence, frames, alternatives, flags."""
    flat = lambda c: F.flatten(F.collect_list(c))
    return [
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(confidence).alias("confidence"), F.array_sort(F.array_distinct(flat("frames"))).alias("frames"),
        F.array_sort(F.array_distinct(flat("alternatives"))).alias("alternatives"), F.bool_or("cached").alias("cached"), F.max("level").alias("level"), F.min("chunk").alias("chunk"),
    ]


def merged_history(points: Column) -> Column:
    """Timed points (structs with t first) of several histories in order, without those within 1e-6 of the last one kept."""
    return F.aggregate(
        F.slice(F.array_sort(points), 2, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(F.array_sort(points), 1, 1),
        lambda kept, p: F.when(p["t"] - F.element_at(kept, -1)["t"] <= 1e-6, kept).otherwise(F.array_append(kept, p)),
    )


def numbered(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``event_id`` from 1 within the keys, in that order."""
    return events.withColumn("event_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def merge_chunk_events(events: DataFrame, overlap: float = OVERLAP, begin: float | None = None, end: float | None = None) -> DataFrame:
    """Events of all chunks of a stream folded in order of (start, chunk): each joins the first merged row that it may be one with, whose
    extent grows as it goes; what is left is numbered by (start, stop). An ordered scan holds the merged rows that a later event can still reach, and
    those that wait for a number as one of their start is still open.

    Columns: video_id, chunk, event_id, start, stop, text, confidence, l, t0, r, b0. Of others, history (points with t), frames, alternatives, cached,
    level and n_seen are merged, the rest are those of the text chosen. Events outside ``begin`` to ``end`` are left out first. Adds n (events
    folded) and numbers event_id anew."""
    if begin is not None:
        events = events.where(F.col("stop") >= begin - 1e-6)
    if end is not None:
        events = events.where(F.col("start") <= end + 1e-6)
    kinds = {f.name: f.type for f in to_arrow_schema(events.schema)} | {"event_id": pa.int64(), "n": pa.int64()}

    def step(b: pa.RecordBatch, fold: Fold | None, ends: bool):
        fold = fold or Fold(kinds, overlap)
        return fold.add(b, ends), fold

    schema = ", ".join(f"`{f.name}` {'bigint' if f.name == 'event_id' else f.dataType.simpleString()}" for f in events.schema) + ", n long"
    return scan(events, ["video_id"], ["start", "chunk", "event_id"], step, schema)


class Merged:
    """A merged row: what the next event is compared with, and where its parts lie. Its lists grow in place, so that folding costs what an event adds."""

    __slots__ = ("start", "stop", "chunk", "event_id", "confidence", "text", "bare", "l", "t0", "r", "b0", "cached", "level", "n_seen", "n", "row", "history", "frames", "alternatives", "group")


class Group:
    """Merged rows of one start: numbered together, once all are done."""

    __slots__ = ("before", "open", "rows")

    def __init__(self, before: int):
        self.before, self.open, self.rows = before, 0, []


def _values(c: pa.Array) -> list:
    return c.to_numpy(zero_copy_only=False).tolist() if c.null_count == 0 and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)) else c.to_pylist()


def _offsets(c: pa.Array) -> list[int]:
    """Where each list of a column begins among its flattened values, and where the last one ends; a null list is empty."""
    return [0, *np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)).tolist()]


class Fold:
    """The fold of one stream. Columns stay in Arrow: a merged row names the row whose text was chosen, and its points by their places."""

    NUMBERS = ("start", "stop", "chunk", "event_id", "confidence", "l", "t0", "r", "b0", "cached", "level", "n_seen")

    def __init__(self, kinds: dict[str, pa.DataType], overlap: float):
        self.kinds, self.overlap, self.reach = kinds, overlap, max(1.25, overlap + 0.5)
        self.near: list[Merged] = []
        self.waiting: list[Merged] = []
        self.group, self.group_start, self.count, self.held, self.points = None, None, 0, None, None

    def add(self, b: pa.RecordBatch, ends: bool) -> pa.RecordBatch | None:
        old = 0 if self.held is None else self.held.num_rows
        t = pa.Table.from_batches([b] if self.held is None else [self.held, b.cast(self.held.schema)]).combine_chunks()
        c = {n: t.column(n).combine_chunks() if t.column(n).num_chunks != 1 else t.column(n).chunk(0) for n in t.column_names}
        numbers = {n: _values(c[n]) for n in self.NUMBERS if n in c}
        texts = c["text"].to_pylist()
        history = frames = alternatives = None
        if "history" in c:
            at, flat = _offsets(c["history"]), c["history"].flatten()
            points = flat if self.points is None else pa.concat_arrays([flat, self.points])
            times = _values(points.field("t"))
            for m in [*self.near, *self.waiting]:  # places of points that were kept follow those of the rows
                if m.history is not None:
                    m.history = [(x, k + len(flat)) for x, k in m.history]
            history = lambda i: [(times[k], k) for k in range(at[i], at[i + 1])]
        if "frames" in c:
            frames = _lists(c["frames"])
        if "alternatives" in c:
            alternatives = _lists(c["alternatives"])
        done: list[Merged] = []
        names = list(numbers)
        soonest = min((m.stop for m in self.near), default=math.inf)
        for i, row in enumerate(zip(*(numbers[n][old:] for n in names)), old):
            e = Merged()
            for n, v in zip(names, row):
                setattr(e, n, v)
            e.text, e.row, e.n = texts[i], i, 1
            e.bare = "".join(e.text.split()) if e.text else ""
            e.history = e.frames = e.alternatives = None
            limit = e.start - self.reach - 1e-6
            if soonest < limit:
                done += [m for m in self.near if m.stop < limit]
                self.near = [m for m in self.near if not m.stop < limit]
                soonest = min((m.stop for m in self.near), default=math.inf)
            if e.start != self.group_start:
                self.group, self.group_start = Group(self.count), e.start
            if (hit := self.first(e)) is None:
                e.group = self.group
                self.group.open += 1
                self.count += 1
                self.near.append(e)
                soonest = min(soonest, e.stop)
            else:
                was = hit.stop
                self.join(hit, e, history, frames, alternatives)
                if was == soonest:
                    soonest = min(m.stop for m in self.near)
        if ends:
            done, self.near = done + self.near, []
        self.waiting += done
        for m in done:
            m.group.open -= 1
            m.group.rows.append(m)
        # a group still open may get rows: the last one, until the stream ends
        ready = {id(m.group): m.group for m in self.waiting if not m.group.open and (ends or m.group is not self.group)}
        out = []
        for g in ready.values():
            g.rows.sort(key=lambda m: (m.stop, m.chunk, m.event_id is not None, m.event_id))
            for k, m in enumerate(g.rows, g.before + 1):
                m.event_id = k
            out += g.rows
        self.waiting = [m for m in self.waiting if id(m.group) not in ready]
        batch = self.batch(out, t, c, points if history else None, at if history else None, frames, alternatives) if out else None
        self.keep(t, points if history else None)
        return batch

    def first(self, e: Merged) -> Merged | None:
        """The first merged row that an event may be one with."""
        if not e.text:
            return None
        for m in self.near:
            if m.chunk != e.chunk and m.text and (m.stop >= e.start or e.start - m.stop <= self.reach) and _one(m, e, self.overlap):
                return m
        return None

    def join(self, a: Merged, b: Merged, history, frames, alternatives) -> None:
        """A merged row takes an event; lists of either may be missing or null."""
        x, y = a.bare, b.bare
        new = len(a.text) <= len(b.text) if x and y and (x.startswith(y) or y.startswith(x)) else not a.confidence >= b.confidence
        if history:
            if a.n == 1:
                a.history = []
                for p in sorted([*history(a.row), *history(b.row)], key=lambda p: p[0]):
                    if not a.history or p[0] - a.history[-1][0] >= 1e-6:
                        a.history.append(p)
            else:
                for p in history(b.row):
                    _insert(a.history, p)
        if frames:
            if a.n == 1:
                a.frames = set(frames(a.row) or [])
            a.frames.update(frames(b.row) or [])
        if alternatives:
            if a.n == 1:
                a.alternatives = dict.fromkeys(alternatives(a.row) or [])
            for v in alternatives(b.row) or []:
                a.alternatives.setdefault(v)
        if "cached" in self.kinds:
            a.cached = bool(a.cached) or bool(b.cached)
        if "level" in self.kinds:
            a.level = max(1 if v is None else v for v in (a.level, b.level))
        if "n_seen" in self.kinds:
            a.n_seen = (a.n_seen or 0) + (b.n_seen or 0)
        if b.stop >= a.stop:
            a.l, a.t0, a.r, a.b0 = b.l, b.t0, b.r, b.b0
        if new:
            a.text, a.bare, a.row = b.text, b.bare, b.row
        a.n += 1
        a.start, a.stop, a.confidence, a.chunk = min(a.start, b.start), max(a.stop, b.stop), max(a.confidence, b.confidence), min(a.chunk, b.chunk)

    def batch(self, out: list[Merged], t: pa.Table, c: dict[str, pa.Array], points: pa.Array | None, at: list[int] | None, frames, alternatives) -> pa.RecordBatch:
        chosen = t.select([n for n in t.column_names if n not in self.NUMBERS]).take(pa.array([m.row for m in out], pa.int64()))
        arrays = []
        for n, kind in self.kinds.items():
            if n in self.NUMBERS or n == "n":
                a = pa.array([getattr(m, n) for m in out], kind)
            elif n == "history" and any(m.n > 1 for m in out):
                lists = [range(at[m.row], at[m.row + 1]) if m.n == 1 else [k for _, k in m.history] for m in out]
                nulls = pa.array([m.n == 1 and not c["history"][m.row].is_valid for m in out]) if c["history"].null_count else None
                flat = points.take(pa.array([k for ks in lists for k in ks], pa.int64()))
                a = pa.ListArray.from_arrays(pa.array([0, *np.cumsum([len(ks) for ks in lists]).tolist()], pa.int32()), flat, type=kind, mask=nulls)
            elif n == "frames":
                a = pa.array([frames(m.row) if m.n == 1 else sorted(m.frames) for m in out], kind)
            elif n == "alternatives":
                a = pa.array([alternatives(m.row) if m.n == 1 else list(m.alternatives) for m in out], kind)
            else:
                a = chosen.column(n).combine_chunks()
                a = (pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a).cast(kind)
            arrays.append(a)
        return pa.RecordBatch.from_arrays(arrays, names=list(self.kinds))

    def keep(self, t: pa.Table, points: pa.Array | None) -> None:
        """Only rows and points that open rows name outlive their batch."""
        rest = [*self.near, *self.waiting]
        rows = sorted({m.row for m in rest})
        place = {r: k for k, r in enumerate(rows)}
        self.held = t.take(pa.array(rows, pa.int64())).combine_chunks().to_batches()[0] if rows else None
        kept: list[int] = []
        for m in rest:
            m.row = place[m.row]
            if m.history is not None:
                kept += [k for _, k in m.history]
                m.history = [(p[0], len(kept) - len(m.history) + k) for k, p in enumerate(m.history)]
        self.points = points.take(pa.array(kept, pa.int64())) if kept else None


def _lists(c: pa.Array):
    at, flat, nulls = _offsets(c), _values(c.flatten()), set() if c.null_count == 0 else set(np.flatnonzero(pc.is_null(c).to_numpy(zero_copy_only=False)).tolist())
    return lambda i: None if i in nulls else flat[at[i] : at[i + 1]]


def _insert(history: list[tuple[float, int]], p: tuple[float, int]) -> None:
    """Puts a point into a history whose points are 1e-6 apart or more, after those of its time: it is left out if the one before it is nearer than
    that, and those after it are if they are."""
    i = bisect.bisect_right(history, p[0], key=lambda q: q[0])
    if i and not p[0] - history[i - 1][0] >= 1e-6:
        return
    j = i
    while j < len(history) and not history[j][0] - p[0] >= 1e-6:
        j += 1
    history[i:j] = [p]


def _text_reaches(x: str, y: str, least: float) -> bool:
    """Is the similarity of two texts, 1 less the edit distance over the longer length, at least that much?"""
    if x == y:
        return True
    longest = max(len(x), len(y))
    most = int((1 - least) * longest + 1e-6)  # more edits cannot pass
    if abs(len(x) - len(y)) > most:
        return False
    a, n = 0, min(len(x), len(y))
    while a < n and x[a] == y[a]:
        a += 1
    z = 0
    while z < n - a and x[-1 - z] == y[-1 - z]:
        z += 1
    x, y = x[a : len(x) - z], y[a : len(y) - z]
    row = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        corner, row[0] = row[0], i
        for k, v in enumerate(y, 1):
            corner, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, corner + (u != v))
        if min(row) > most:
            return False
    return 1 - row[-1] / longest >= least


def _one(a: Merged, b: Merged, overlap: float) -> bool:
    """May two events of different chunks, with texts, be one?"""
    shared = min(a.stop, b.stop) - max(a.start, b.start)
    if shared < -1e-6 and -shared > max(1.25, overlap + 0.5):
        return False
    both = max(0.0, min(a.r, b.r) - max(a.l, b.l)) * max(0.0, min(a.b0, b.b0) - max(a.t0, b.t0))
    areas = [max(0.0, e.r - e.l) * max(0.0, e.b0 - e.t0) for e in (a, b)]
    spatial = both / max(sum(areas) - both, 1e-9) if both and min(areas) > 0 else 0.0
    if spatial < 0.08 and shared < 0:
        return False
    x, y = a.bare, b.bare
    if spatial >= 0.25:
        return bool(x and y) and (x.startswith(y) or y.startswith(x)) or _text_reaches(x, y, 0.72)
    return _text_reaches(x, y, 0.92)


def one_event(a: dict, b: dict, overlap: float = OVERLAP) -> bool:
    if a["chunk"] == b["chunk"] or not a["text"] or not b["text"]:
        return False
    return _one(*[types.SimpleNamespace(**{c: e[c] for c in ("start", "stop", "l", "t0", "r", "b0")}, bare="".join(e["text"].split())) for e in (a, b)], overlap)


def rolled_up(profiles: DataFrame, keys: list[str], sums: list[str], counters: str) -> DataFrame:
    """Profiles per key: sums of the scalars, and per-name sums of the counter maps, in name order."""
    totals = profiles.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    each = profiles.select(*keys, F.explode(counters).alias("name", "value")).groupBy(*keys, "name").agg(F.sum("value").alias("value"))
    maps = each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(counters))
    return totals.join(maps, keys, "left")


def run_profile(profiles: DataFrame, keys: list[str], core_sec: float, wall_sec: float) -> DataFrame:
    """What the chunks of a run counted (chunk, counters) as one profile per key: counters are summed by name; the run lasted ``wall_sec``, whatever its
    chunks did side by side, and went through ``core_sec`` of streams, overlaps not counted twice."""
    profiles, keys = profiles.withColumn("_all", F.lit(0)), [*keys, "_all"]
    each = profiles.select(*keys, F.explode("counters").alias("name", "value")).groupBy(*keys, "name").agg(F.sum("value").alias("value"))
    sums = each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("counters"), F.sum(F.when(F.col("name").endswith("_sec"), F.col("value")).otherwise(0.0)).alias("work_sec_sum"))
    n = profiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"))
    return n.join(sums, keys, "left").drop("_all").withColumns({"total_sec": F.lit(wall_sec), "processed_sec": F.lit(core_sec), "video_realtime": F.lit(core_sec / max(wall_sec, 1e-9))})
