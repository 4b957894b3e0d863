"""Scores of predicted events against reference events."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..session import stored

LEAST_TEXT, LEAST_TIME, LEAST_SPACE = 0.55, 0.10, 0.05
REPORT = ("reference_events", "predicted_events", "matched_events", "event_recall", "text_accuracy", "duplicate_rate", "mean_temporal_iou", "mean_spatial_iou")


def temporal_iou(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Shared time over joint time; 0 where the joint time is nil."""
    shared = F.greatest(F.lit(0.0), F.least(a_stop, b_stop) - F.greatest(a_start, b_start))
    joint = F.greatest(a_stop, b_stop) - F.least(a_start, b_start)
    return F.when(joint > 0, shared / joint).otherwise(F.lit(0.0))


def nearest(history: Column, t: Column) -> Column:
    """The history's point (struct with t) nearest in time, the first of equals."""
    keyed = F.transform(history, lambda p, i: F.struct(F.abs(p["t"] - t).alias("d"), i.alias("i"), p.alias("p")))
    return F.array_min(keyed)["p"]


def mean_spatial_iou(a: Column, b: Column, start: Column, stop: Column) -> Column:
    """Mean IoU of two histories' boxes (structs t, l, t0, r, b0) at their distinct times from start to stop, or at the middle if there is none."""
    inside = F.array_distinct(F.filter(F.transform(F.concat(a, b), lambda p: p["t"]), lambda t: (t >= start) & (t <= stop)))
    at = F.when(F.size(inside) > 0, F.array_sort(inside)).otherwise(F.array((start + stop) / 2))
    # the inner transform binds both points, as a lambda's parts are evaluated wherever they are named
    both = F.transform(at, lambda t: F.struct(nearest(a, t).alias("x"), nearest(b, t).alias("y")))
    ious = F.transform(both, lambda p: G.iou(G.box_in(p["x"]), G.box_in(p["y"])))
    # two points, one of each, are nearest at any time
    single = F.when((F.size(a) == 1) & (F.size(b) == 1), G.iou(G.box_in(a[0]), G.box_in(b[0])))
    return single.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(ious, F.lit(0.0), lambda s, x: s + x) / F.size(ious)).otherwise(F.lit(0.0))


def candidate_pairs(reference: DataFrame, predicted: DataFrame, case: str = "video_id", bin_sec: float = 3600.0) -> DataFrame:
    """Pairs (ref_id, pred_id, scores, edits between the texts, chars of the reference's, begin and end of both together) that pass all thresholds. Both sides have event_id, start, stop, text, history. Events meet in the time
    bins that both touch, and count in the first of them; those that share no time cannot pass, so no pair is lost."""

    def binned(df: DataFrame, p: str) -> DataFrame:
        first, last = F.floor(F.col("start") / bin_sec), F.floor(F.col("stop") / bin_sec)
        return df.select(case, F.explode(F.sequence(first, last)).alias("bin"), T.bare(F.col("text")).alias(p + "bare"), *[F.col(c).alias(p + c) for c in ("event_id", "start", "stop", "history")])

    j = binned(reference, "a_").join(binned(predicted, "b_"), [case, "bin"]).where(F.col("bin") == F.floor(F.greatest("a_start", "b_start") / bin_sec))
    time = temporal_iou(*map(F.col, ("a_start", "a_stop", "b_start", "b_stop")))
    j = j.withColumn("time_score", time).where(F.col("time_score") >= LEAST_TIME)
    # as generators, so that a filter pushed below does not evaluate them a second time
    longest = F.greatest(F.length("a_bare"), F.length("b_bare"), F.lit(1))
    most = (1 - LEAST_TEXT) * longest + 1e-6  # more edits cannot pass
    j = j.where(F.abs(F.length("a_bare") - F.length("b_bare")) <= most)
    j = j.withColumn("edits", F.explode(F.array(F.levenshtein("a_bare", "b_bare")))).withColumn("text_score", F.greatest(F.lit(0.0), 1.0 - F.col("edits") / longest)).where(F.col("text_score") >= LEAST_TEXT)
    space = mean_spatial_iou(F.col("a_history"), F.col("b_history"), F.greatest("a_start", "b_start"), F.least("a_stop", "b_stop"))
    j = j.withColumn("space_score", F.explode(F.filter(F.array(space), lambda x: x >= LEAST_SPACE)))
    score = F.round(0.55 * F.col("text_score") + 0.25 * F.col("time_score") + 0.20 * F.col("space_score"), 9)
    span = F.least("a_start", "b_start").alias("begin"), F.greatest("a_stop", "b_stop").alias("end")
    return j.select(case, F.col("a_event_id").alias("ref_id"), F.col("b_event_id").alias("pred_id"), score.alias("score"), "text_score", "time_score", "space_score", "edits", F.greatest(F.length("a_bare"), F.lit(1)).alias("chars"), *span)


def stretches(pairs: DataFrame, case: str, bin_sec: float) -> DataFrame:
    """Adds ``stretch``: pairs of one case that share an event have one stretch, so each can be matched on its own. A stretch is a run of time bins
    each of which some pair joins to the next; only distinct bins are put in order, not pairs."""
    first, last = F.floor(F.col("begin") / bin_sec), F.floor(F.col("end") / bin_sec)
    p = pairs.withColumn("_first", first)
    bins = p.select(case, F.explode(F.sequence("_first", last)).alias("_first"), last.alias("_last")).groupBy(case, "_first").agg(F.max(F.col("_last") > F.col("_first")).alias("_on"))
    w = Window.partitionBy(case).orderBy("_first")
    new = F.when((F.lag("_first").over(w) == F.col("_first") - 1) & F.lag("_on").over(w), 0).otherwise(1)
    runs = bins.withColumn("_new", new).select(case, "_first", F.sum("_new").over(w).alias("stretch"))
    return p.join(runs, [case, "_first"]).drop("_first")


def matched(pairs: DataFrame, case: str = "video_id", bin_sec: float = 16.0) -> DataFrame:
    """One-to-one matches: best score first, larger ids first among equals. An ordered scan of each stretch of a case, which remembers what events are
    taken. Pairs without ``begin`` and ``end`` make one stretch of their case."""
    kind = pairs.schema[case].dataType.simpleString()

    def run(batches):
        now, refs, preds = None, set(), set()
        for b in batches:
            kept = []
            for i, (key, r, p) in enumerate(zip(zip(b.column(case).to_pylist(), b.column("stretch").to_pylist()), b.column("ref_id").to_pylist(), b.column("pred_id").to_pylist())):
                if key != now:
                    now, refs, preds = key, set(), set()
                if r not in refs and p not in preds:
                    refs.add(r)
                    preds.add(p)
                    kept.append(i)
            yield b.take(pa.array(kept, pa.int64())).select([case, "ref_id", "pred_id"])

    return _in_order(pairs, case, bin_sec, ["ref_id", "pred_id"]).mapInArrow(run, f"{case} {kind}, ref_id long, pred_id long")


def _in_order(pairs: DataFrame, case: str, bin_sec: float, columns: list[str]) -> DataFrame:
    """case, stretch, columns: each stretch in one task, in the order of matching."""
    cut = stretches(pairs, case, bin_sec) if {"begin", "end"} <= set(pairs.columns) else pairs.withColumn("stretch", F.lit(1))
    cut = cut.select(case, F.col("stretch").cast("long").alias("stretch"), *columns, "score")
    return cut.repartition(case, "stretch").sortWithinPartitions(case, "stretch", F.desc("score"), F.desc("ref_id"), F.desc("pred_id"))


_SUMS = "matched_events long, errors long, chars long, time double, space double, duplicates long"


def _totals(pairs: DataFrame, case: str, bin_sec: float = 16.0) -> DataFrame:
    """Sums over the matches of each case, as ``matched`` makes them, and its duplicates, from one scan: pairs are not joined with matches or texts again.

    A prediction that is never matched is a duplicate if it meets a reference that is taken; of the pairs of one still free neither would stay so."""
    kind = pairs.schema[case].dataType.simpleString()
    columns = ["ref_id", "pred_id", "edits", "chars", "time_score", "space_score"]

    def run(batches):
        now, refs, preds, twice, sums, at, kind = None, set(), set(), set(), [], None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], kind), *[pa.array([v]) for v in sums]], names=[case, "matched_events", "errors", "chars", "time", "space", "duplicates"])

        for b in batches:
            kind = b.column(case).type
            for c, stretch, r, p, edits, chars, time, space in zip(*(b.column(n).to_pylist() for n in (case, "stretch", *columns))):
                if (c, stretch) != now:
                    if sums:
                        sums[5] += len(twice)
                    if now is None or c != now[0]:
                        if sums:
                            yield row()
                        at, sums = (c,), [0, 0, 0, 0.0, 0.0, 0]
                    now, refs, preds, twice = (c, stretch), set(), set(), set()
                if p in preds:
                    continue
                if r in refs:
                    twice.add(p)
                    continue
                refs.add(r)
                preds.add(p)
                twice.discard(p)
                sums[0] += 1
                sums[1] += edits
                sums[2] += chars
                sums[3] += time
                sums[4] += space
        if sums:
            sums[5] += len(twice)
            yield row()

    parts = _in_order(pairs, case, bin_sec, columns).mapInArrow(run, f"{case} {kind}, {_SUMS}")
    m = parts.groupBy(case).agg(*[F.sum(c).alias(c) for c in ("matched_events", "errors", "chars", "time", "space", "duplicates")])
    return m.withColumns({c: F.col(c) / F.col("matched_events") for c in ("time", "space")})


def report(reference: DataFrame, predicted: DataFrame, pairs: DataFrame, matches: DataFrame | None = None, case: str = "video_id") -> DataFrame:
    """The scores of each case; pairs are read twice, so store them first where they are dear. Without ``matches``, those that ``matched`` makes of the pairs
    count. Recall and the like are over all its events, accuracy over matched ones (1 where nothing matched)."""
    if matches is None:
        totals = _totals(pairs, case)
    else:
        m = matches.join(pairs, [case, "ref_id", "pred_id"])
        free = pairs.join(matches.select(case, "pred_id"), [case, "pred_id"], "left_anti").join(matches.select(case, "ref_id"), [case, "ref_id"], "left_semi")
        scores = m.groupBy(case).agg(F.count(F.lit(1)).alias("matched_events"), F.sum("edits").alias("errors"), F.sum("chars").alias("chars"), F.avg("time_score").alias("time"), F.avg("space_score").alias("space"))
        totals = scores.join(free.groupBy(case).agg(F.count_distinct("pred_id").alias("duplicates")), case, "left")
    count = lambda df, n: df.groupBy(case).agg(F.count(F.lit(1)).alias(n))
    d = count(reference, "reference_events").join(count(predicted, "predicted_events"), case, "full").join(totals, case, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return d.select(
        case,
        zero("reference_events").alias("reference_events"),
        zero("predicted_events").alias("predicted_events"),
        zero("matched_events").alias("matched_events"),
        F.round(zero("matched_events") / F.greatest(zero("reference_events"), F.lit(1)), 9).alias("event_recall"),
        F.round(F.greatest(F.lit(0.0), 1.0 - zero("errors") / F.greatest(zero("chars"), F.lit(1))), 9).alias("text_accuracy"),
        F.round(zero("duplicates") / F.greatest(zero("predicted_events"), F.lit(1)), 9).alias("duplicate_rate"),
        F.round(F.coalesce("time", F.lit(0.0)), 6).alias("mean_temporal_iou"),
        F.round(F.coalesce("space", F.lit(0.0)), 6).alias("mean_spatial_iou"),
    )


def percentile(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], parts: int = 64) -> DataFrame:
    """Nearest-rank percentiles, the rank (n - 1) p being rounded half to even; NaN counts as the largest value, null as none.

    Equal values are counted before they are shuffled, a sketch cuts each key's values into ``parts`` ranges, and prefix sums over the ranges' counts say
    which range holds a rank; only those ranges are put in order, so no task sorts a key. The sketch steers the cut alone: results are exact."""
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    same = lambda a, b: functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    counts = d.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cuts = d.groupBy(*keys).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_part")
    ranged = counts.alias("c").join(cuts.alias("k"), same("c", "k")).select(*[F.col(f"c.{k}").alias(k) for k in keys], "_v", "_c", part)
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_in"))
    w = Window.partitionBy(*keys)
    sums = sums.withColumn("_n", F.sum("_in").over(w)).withColumn("_before", F.sum("_in").over(w.orderBy("_part")) - F.col("_in"))
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.bround((F.col("_n") - 1) * p).cast("long"))).alias("rank")) for n, p in ps.items()])
    inside = F.filter(ranks, lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_in")))
    held = sums.select(*keys, "_part", "_before", inside.alias("_ranks")).where(F.size("_ranks") > 0)
    near = ranged.alias("r").join(held.alias("h"), same("r", "h") & (F.col("r._part") == F.col("h._part"))).select(*[F.col(f"r.{k}").alias(k) for k in keys], "r._part", "_v", "_c", "_before", "_ranks")
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    hit = near.withColumn("_to", upto).select(*keys, "_v", F.explode(F.filter("_ranks", lambda r: (r["rank"] < F.col("_to")) & (r["rank"] >= F.col("_to") - F.col("_c")))).alias("_r"))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_r.name") == n, F.col("_v"))).alias(n) for n in ps])


def samples_of_segments(segments: DataFrame, samples: DataFrame, bin_sec: float, key: str = "video_id", segment: str = "island") -> DataFrame:
    """(key, segment, frame_id) of the samples (key, frame_id, t) within each segment (key, segment, first, last); where there is none, of the sample nearest
    to its begin, the first of equals. Segments meet samples in the time bins that they touch; the nearest comes from an ordered pass over both."""
    low, high = F.floor((F.col("first") - 1e-6) / bin_sec), F.floor((F.col("last") + 1e-6) / bin_sec)
    binned = segments.select(key, segment, "first", "last", F.explode(F.sequence(low, high)).alias("_bin"))
    s = samples.select(key, "frame_id", "t", F.floor(F.col("t") / bin_sec).alias("_bin"))
    inside = binned.join(s, [key, "_bin"]).where((F.col("t") >= F.col("first") - 1e-6) & (F.col("t") <= F.col("last") + 1e-6)).select(key, segment, "frame_id")
    alone = segments.join(inside.select(key, segment).distinct(), [key, segment], "left_anti")
    # samples and the begins of lonely segments in one order of time; of samples at one time, the first frame stands nearest on both sides
    none = F.lit(None).cast("long")
    points = samples.select(key, F.col("t"), F.lit(None).cast(segments.schema[segment].dataType).alias(segment), F.col("frame_id").cast("long").alias("frame_id")).groupBy(key, "t", segment).agg(F.min("frame_id").alias("frame_id"))
    asked = alone.select(key, F.col("first").alias("t"), segment, none.alias("frame_id"))
    sample = F.when(F.col("frame_id").isNotNull(), F.struct("t", "frame_id"))
    latest = lambda t: F.last(sample, True).over(Window.partitionBy(key).orderBy(t, F.col("frame_id").isNull(), segment).rowsBetween(Window.unboundedPreceding, 0))
    both = points.unionByName(asked).select("*", latest(F.asc("t")).alias("_a"), latest(F.desc("t")).alias("_b"))
    nearer = F.when(F.col("_b").isNull() | (F.col("t") - F.col("_a.t") <= F.col("_b.t") - F.col("t")), F.col("_a.frame_id")).otherwise(F.col("_b.frame_id"))
    nearest_ = both.where("frame_id IS NULL").select(key, segment, nearer.alias("frame_id")).where("frame_id IS NOT NULL")
    return inside.unionByName(nearest_)


def throughput(video_sec: Column, wall_sec: Column) -> Column:
    return F.when((video_sec > 0) & (wall_sec > 0), video_sec / F.greatest(wall_sec, F.lit(1e-9))).otherwise(F.lit(0.0))


def ranked_runs(runs: DataFrame, tie: str) -> DataFrame:
    """Runs in order of completeness, accuracy, fewest duplicates, speed. Ranges of that order are counted, so that a task orders one range."""
    order = [F.desc("event_recall"), F.desc("text_accuracy"), F.asc("duplicate_rate"), F.desc("video_realtime"), F.asc(tie)]
    r = stored(runs.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = r.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return r.join(F.broadcast(before), "_range").withColumn("place", place).drop("_range", "_before")
