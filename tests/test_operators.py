"""Operators against known values and plain-Python statements of their rules."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphstream.config import Config
from glyphstream.functions import geometry as G
from glyphstream.functions import pixels as X
from glyphstream.functions import text as T
from glyphstream.operators import chunks, evaluate, planner, recognition, sampling, select, tracker

EVENT = "video_id long, chunk int, event_id long, start double, stop double, text string, confidence double, l double, t0 double, r double, b0 double"


def test_chunk_width():
    assert chunks.chunk_width(240) is None
    assert chunks.chunk_width(360) == 180.0
    assert 179 < chunks.chunk_width(717.899) < 180


def test_chunk_plan(spark):
    d = spark.createDataFrame([(1, 300.0)], "video_id long, duration double")
    rows = chunks.planned(d, F.lit(120.0), 4.0).orderBy("chunk").collect()
    assert [(r.core_start, r.core_end) for r in rows] == [(0, 120), (120, 240), (240, 300)]
    assert [(r.read_start, r.read_end) for r in rows] == [(0, 124), (116, 244), (236, 300)]


def test_merge_across_chunks(spark):
    rows = [(1, 0, 5, 118.0, 123.0, "Continue", 0.90, 10.0, 10.0, 110.0, 50.0), (1, 1, 7, 119.0, 124.0, "Continue", 0.95, 10.0, 10.0, 110.0, 50.0), (1, 1, 9, 300.0, 301.0, "Continue", 0.5, 10.0, 10.0, 110.0, 50.0)]
    got = chunks.merge_chunk_events(spark.createDataFrame(rows, EVENT)).orderBy("event_id").collect()
    assert [(r.event_id, r.start, r.stop, r.confidence, r.n) for r in got] == [(1, 118, 124, 0.95, 2), (2, 300, 301, 0.5, 1)]
    assert chunks.merge_chunk_events(spark.createDataFrame([], EVENT)).count() == 0


POINT = "struct<t:double,l:double,t0:double,r:double,b0:double>"


def plain_merge(rows):
    """One stream's events folded one by one, over all merged rows."""
    merged = []
    for r in sorted(rows, key=lambda r: (r["start"], r["chunk"], r["event_id"])):
        hit = next((i for i, m in enumerate(merged) if chunks.one_event(m, r)), None)
        if hit is None:
            merged.append({**r, "n": 1})
            continue
        a, x, y = merged[hit], "".join(merged[hit]["text"].split()), "".join(r["text"].split())
        prefix = x and y and (x.startswith(y) or y.startswith(x))
        new = len(r["text"]) >= len(a["text"]) if prefix else r["confidence"] > a["confidence"]
        history = {}
        for p in [*a["history"], *r["history"]]:
            history.setdefault(p[0], p)
        merged[hit] = {
            **(r if new else a), "event_id": a["event_id"], "start": min(a["start"], r["start"]), "stop": max(a["stop"], r["stop"]), "confidence": max(a["confidence"], r["confidence"]), "chunk": min(a["chunk"], r["chunk"]), "n": a["n"] + 1,
            **{c: (r if r["stop"] >= a["stop"] else a)[c] for c in ("l", "t0", "r", "b0")}, "history": [history[t] for t in sorted(history)], "frames": sorted({*a["frames"], *r["frames"]}),
            "alternatives": list(dict.fromkeys([*a["alternatives"], *r["alternatives"]])), "cached": a["cached"] or r["cached"], "level": max(a["level"], r["level"]),
        }
    return merged


def test_merge_equals_plain_fold(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        t = rng.uniform(0, 400)
        box = (10.0, 10.0, 60.0 + rng.randint(0, 9), 30.0)
        rows.append((rng.randint(1, 2), int(t // 40), i, t, t + rng.uniform(0, 6), rng.choice(["alpha beta", "alpha betas", "gamma", ""]), round(rng.random(), 2), *box, [(float(round(t)), *box), (round(t) + 2.0, *box)], [i % 9, i % 7], [f"a{i % 5}", f"a{i % 3}"], i % 4 == 0, i % 3, f"hint{i}"))
    kind = EVENT + f", history array<{POINT}>, frames array<bigint>, alternatives array<string>, cached boolean, level int, hint string"
    names = [c.split()[0] for c in (EVENT + ", history, frames, alternatives, cached, level, hint").split(", ")]
    plain = lambda m: (*(m[c] for c in names if c not in ("event_id", "history")), [tuple(p) for p in m["history"]], m["n"])
    dicts = [dict(zip(names, r)) for r in rows]
    expected = [plain(m) for v in (1, 2) for m in plain_merge([r for r in dicts if r["video_id"] == v])]
    d = spark.createDataFrame(rows, kind)
    got = [plain(r.asDict()) for r in chunks.merge_chunk_events(d).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    part = chunks.merge_chunk_events(d, begin=100.0, end=200.0)
    assert {r.n for r in part.collect()} and part.agg(F.min("stop"), F.max("start")).first()[0] >= 100 and part.agg(F.sum("n")).first()[0] == sum(r["stop"] >= 100 and r["start"] <= 200 for r in dicts)


def test_pairs_of_any_two_chunks(spark):
    rng = random.Random(5)
    rows = [(1, rng.randint(0, 4), i, t, t + rng.uniform(0, 50), rng.choice(["alpha", "alphas", "beta", ""]), 0.5, 10.0 + rng.randint(0, 90), 10.0, 110.0, 30.0) for i in range(200) for t in [rng.uniform(0, 300)]]
    names = [c.split()[0] for c in EVENT.split(", ")]
    dicts = [dict(zip(names, r)) for r in rows]
    want = {(a["event_id"], b["event_id"]) for a in dicts for b in dicts if a["chunk"] < b["chunk"] and chunks.one_event(a, b)}
    got = [(r.left_id, r.right_id) for r in chunks.chunk_pairs(spark.createDataFrame(rows, EVENT)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_chunks_that_cannot_be(spark):
    d = spark.createDataFrame([(1, 300.0)], "video_id long, duration double")
    for width in (F.lit(8.0), F.lit(None).cast("double")):
        with pytest.raises(Exception, match="twice as wide"):
            chunks.planned(d, width, 4.0).collect()


def test_matches_in_stretches_equal_matches_of_whole_cases(spark):
    rng = random.Random(8)
    rows = [(rng.randint(1, 2), r, p, round(rng.random(), 1), t, t + rng.uniform(0, 9)) for t in range(0, 900, 7) for r in range(t, t + 9, 3) for p in range(t, t + 9, 4)]
    rows = [(v, r, p, s, float(min(r, p)), float(max(r, p) + 5)) for v, r, p, s, _, _ in rows]
    d = spark.createDataFrame(rows, "video_id long, ref_id long, pred_id long, score double, begin double, end double").dropDuplicates(["video_id", "ref_id", "pred_id"])
    # events that share an id overlap in time
    key = lambda df: sorted(map(tuple, df.select("video_id", "ref_id", "pred_id").collect()))
    want = []
    for v in (1, 2):
        refs, preds = set(), set()
        for r in sorted(d.where(F.col("video_id") == v).collect(), key=lambda r: (-r.score, -r.ref_id, -r.pred_id)):
            if r.ref_id not in refs and r.pred_id not in preds:
                refs.add(r.ref_id)
                preds.add(r.pred_id)
                want.append((v, r.ref_id, r.pred_id))
    assert key(evaluate.matched(d.drop("begin", "end"))) == sorted(want)
    assert key(evaluate.matched(d)) == sorted(want) and evaluate.stretches(d, "video_id", 16.0).count() == d.count()


def test_percentiles_equal_sorting(spark):
    rng = random.Random(2)
    rows = [("hot", 1.0)] * 500 + [("hot", rng.random()) for _ in range(300)] + [("few", float(i)) for i in range(3)] + [("one", 7.0), ("nulls", None)] + [(None, float(i % 11)) for i in range(100)]
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in evaluate.percentile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", ps, parts=8).collect()}
    assert set(got) == {"hot", "few", "one", None}
    for k, r in got.items():
        values = sorted(v for x, v in rows if x == k)
        assert [r[n] for n in ps] == [values[round((len(values) - 1) * p)] for p in ps.values()]


def test_samples_of_segments_equal_a_loop(spark):
    rng = random.Random(4)
    samples = [(v, i, float(rng.randint(0, 60) * 3)) for v in (1, 2) for i in range(25)]
    segments = [(v, i, float(a), float(a + rng.choice([0, 1, 8]))) for v in (1, 2, 3) for i, a in enumerate(range(0, 180, 5))]
    want = set()
    for v, i, first, last in segments:
        own = [(t, f) for x, f, t in samples if x == v]
        inside = [f for t, f in own if first <= t <= last]
        if own:
            want |= {(v, i, f) for f in inside or [min(own, key=lambda p: (abs(p[0] - first), p))[1]]}
    s, p = spark.createDataFrame(segments, "video_id long, island long, first double, last double"), spark.createDataFrame(samples, "video_id long, frame_id long, t double")
    assert {tuple(r) for r in evaluate.samples_of_segments(s, p, 10.0).collect()} == want


def test_queue_of_tasks(spark):
    q = recognition.Queue()
    q.push(0.0, 1)
    assert not q.due(0.01, 2, 0.035) and q.due(0.04, 2, 0.035)
    q.push(0.02, 2)
    assert q.due(0.02, 2, 0.035) and q.pop(1) == [1] and len(q) == 1
    d = spark.createDataFrame([(1, 0.0, 1), (1, 0.1, 2), (1, 0.2, 3), (1, 5.0, 4), (1, 9.0, 5), (2, 0.0, 6)], "video_id long, t double, task long")
    got = sorted(map(tuple, recognition.queued_batches(d, "video_id", "t", "task", 3, 3.0).collect()))
    assert got == [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 1), (1, 5, 1), (2, 6, 0)]


def test_evaluation_of_a_doubled_prediction(spark):
    kind = "video_id long, event_id long, start double, stop double, text string, history array<struct<t:double,l:double,t0:double,r:double,b0:double>>"
    history = [(0.0, 10.0, 10.0, 110.0, 50.0), (2.0, 10.0, 10.0, 110.0, 50.0)]
    ref = spark.createDataFrame([(1, 1, 0.0, 2.0, "hello", history)], kind)
    pred = spark.createDataFrame([(1, 1, 0.0, 2.0, "hello", history), (1, 2, 0.0, 2.0, "hello", history)], kind)
    pairs = evaluate.candidate_pairs(ref, pred)
    r = evaluate.report(ref, pred, pairs, evaluate.matched(pairs)).first()
    assert (r.event_recall, r.text_accuracy, r.duplicate_rate, r.mean_temporal_iou) == (1.0, 1.0, 0.5, 1.0)
    assert r.mean_spatial_iou > 0.99
    none = evaluate.candidate_pairs(ref, pred.where("false"))
    r = evaluate.report(ref, pred.where("false"), none, evaluate.matched(none)).first()
    assert (r.event_recall, r.text_accuracy, r.duplicate_rate) == (0.0, 1.0, 0.0)


def test_throughput(spark):
    assert spark.range(1).select(evaluate.throughput(F.lit(60.0), F.lit(10.0))).first()[0] == 6.0


def test_planner_tiers():
    p = planner.Planner(audit=10, probe=0.2)
    frame = dict(reliable=True, scopes=True, tracks=True, ratio=0.05)
    assert p.plan(0, cut=False, **frame) == [("AUDIT", "periodic_audit")]
    assert p.plan(0.1, cut=False, **frame) == [("LOCAL", "urgent_local_change")]
    assert [t for t, _ in p.plan(0.5, cut=False, **{**frame, "ratio": 0.5})] == ["FAST", "LOCAL"]
    assert [t for t, _ in p.plan(1.0, cut=False, **frame)] == ["LOCAL"]
    assert p.plan(1.1, cut=True, **frame) == [("AUDIT", "scene_cut")]
    q = planner.Planner(audit=20, least_audit=3)
    tiers = [q.plan(t, cut=False, reliable=False, scopes=False, tracks=False, ratio=0.5)[0][0] for t in (0, 0.5, 3.1)]
    assert tiers == ["AUDIT", "FAST", "AUDIT"]


def seen(t, x, sig=0b1010, quality=0.5, text="a"):
    return tracker.Seen(t, (x, 20.0, x + 60.0, 50.0), 0.95, sig, quality, 0.5, text)


def test_tracks_survive_motion():
    s = tracker.Stream()
    s.step(0, [seen(0, 20)])
    assert set(s.tracks) == {1}
    assert s.match([seen(1, 120)], (100.0, 0.0)) == {0: 1}
    s.step(1, [seen(1, 120)], (100.0, 0.0))
    assert set(s.tracks) == {1} and s.tracks[1].velocity == (100.0, 0.0)


def test_content_changes_within_a_place():
    s = tracker.Stream()
    assert s.step(0, [seen(0, 20)]) == [] and s.tasks == []
    assert s.step(1, [seen(1, 20)]) == [] and s.tasks == [1]
    done = s.step(2, [seen(2, 20, sig=(1 << 63) - 1)])
    assert [(e["content_id"], e["start"], e["stop"]) for e in done] == [(1, 0, 1)]
    assert s.tracks[1].content.content_id == 2 and s.tracks[1].content.typewriter == pytest.approx(0.3)
    assert [e["content_id"] for e in s.end()] == [2]


def test_tracks_end_with_the_seventh_miss():
    s = tracker.Stream()
    s.step(0, [seen(0, 20)])
    for t in range(1, 7):
        assert s.step(t, []) == []
    assert len(s.step(7, [])) == 1 and not s.tracks


def test_complementary_choice(spark):
    best, twin, other = (seen(i, 0, sig=sig, quality=q) for i, (sig, q) in enumerate(((0, 0.9), (0, 0.85), ((1 << 63) - 1, 0.6))))
    assert tracker.complementary([best, twin, other], 2, 0.5) == [best, other]
    rng = random.Random(1)
    rows = [(g, n, 100 * g + n, rng.getrandbits(62), rng.random(), rng.random()) for g in range(20) for n in range(rng.randint(1, 9))]
    kind = "struct<n:bigint,id:bigint,sig:bigint,complete:double,quality:double>"
    d = spark.createDataFrame(rows, "g long, n long, id long, sig long, complete double, quality double")
    folded = d.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("n", "id", "sig", "complete", "quality"))).alias("items"))
    got = {r.g: [x.id for x in r.kept] for r in folded.select("g", select.complementary(F.col("items"), kind).alias("kept")).collect()}
    for g in range(20):
        pool = []
        for _, n, i, sig, complete, quality in sorted(r for r in rows if r[0] == g):
            pool = tracker.complementary([*pool, tracker.Seen(i, (0, 0, 0, 0), 1.0, sig, quality, complete)], 3, 0.35)
        assert got[g] == [c.t for c in pool]


def stream_rows(n=400):
    rng = random.Random(5)
    return [(v, f, float(f), x, 20.0, x + 60.0, 50.0, 0.9, rng.choice([3, (1 << 60) - 1]), rng.random(), 0.5, rng.choice(["one", "two"])) for v in (1, 2) for f in range(n // 4) for x in (float(rng.randint(0, 30)), 300.0 + rng.randint(0, 30)) if rng.random() < 0.8]


SEEN = "video_id long, frame_id long, t double, l double, t0 double, r double, b0 double, confidence double, sig long, quality double, complete double, text string"


def test_stream_equals_batch(spark, tmp_path):
    from glyphstream.streaming.processor import tracked_stream

    rows = stream_rows()
    d = spark.createDataFrame(rows, SEEN)
    batch = sorted(tuple(r) for r in tracker.tracked(d).collect())
    ends = d.withColumn("ends", F.lit(False))
    last = spark.createDataFrame([(v, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, "", True) for v in (1, 2)], SEEN + ", ends boolean")
    kind = ends.schema
    folder = str(tmp_path / "in")
    for i, part in enumerate([ends.where("frame_id < 37"), ends.where("frame_id >= 37 AND frame_id < 70"), ends.where("frame_id >= 70").unionByName(last)]):
        part.coalesce(1).write.parquet(f"{folder}/p{i}")
        time.sleep(1.1)
    src = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = tracked_stream(src).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("tracked").collect()) == batch
    assert len(batch) > 20


def test_gate_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(v, i, t) for v in range(5) for i, t in enumerate(sorted(round(rng.uniform(0, 60), 3) for _ in range(200)))]
    got = sorted((r.video_id, r.frame_id) for r in sampling.sampled(spark.createDataFrame(rows, "video_id long, frame_id long, t double"), 0.7).collect())
    want, due = [], {}
    for v, i, t in rows:
        if v not in due or t + 1e-9 >= due[v]:
            want.append((v, i))
            due[v] = t + 0.7
    assert got == sorted(want)


def test_regions_and_quads(spark):
    assert G.validated_regions([(0.1, 0.1, 0.5, 0.5), (0.1, 0.1, 0.5, 0.5)]) == ((0.1, 0.1, 0.5, 0.5),)
    assert G.validated_regions(None) == ()
    for bad in ([(0.5, 0, 0.2, 1)], [(0, 0, 1.2, 1)], [(0, 0, math.nan, 1)], [(0, 0, 1)]):
        with pytest.raises(ValueError):
            G.validated_regions(bad)
    d = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)],)], "q array<struct<x:double,y:double>>")
    with pytest.raises(Exception, match="four points"):
        d.select(G.checked_quad(F.col("q"))).collect()


def test_text(spark):
    d = spark.createDataFrame([(" Ａ　 b\x1c ", "Abé", "Abe"), ("", "", ""), (None, None, "x")], "raw string, a string, b string")
    r = d.select(T.display_text(F.col("raw")).alias("d"), T.metric_text(F.col("raw")).alias("m"), T.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert (r[0].d, r[0].m, round(r[0].s, 6)) == ("A b", "Ab", round(2 / 3, 6))
    assert (r[1].d, r[1].s) == ("", 1.0) and r[2].d is None and r[2].s is None


def test_pixels():
    rng = np.random.default_rng(42)
    noise = rng.integers(0, 256, (240, 320)).astype(np.uint8)
    dx, dy, _ = X.translation(noise, np.roll(noise, (5, 8), (0, 1)))
    assert abs(dx - 8) <= 1.5 and abs(dy - 5) <= 1.5
    moved = np.roll(noise, (4, 6), (0, 1))
    plain, aligned = X.tile_scores(noise, moved), X.tile_scores(X.shifted(noise, 6, 4), moved)
    assert (aligned >= 0.035).sum() < (plain >= 0.035).sum()
    quad = np.array([[35, 40], [205, 25], [215, 100], [25, 115]], float)
    crop = X.upright_crop(noise, quad)
    assert crop.shape[0] == 48 and crop.shape[1] > 48
    assert X.bits_distance(X.difference_bits(crop), X.difference_bits(255 - crop)) > 0.9
    assert X.bits_distance(b"", b"") == 1.0 and len(X.difference_bits(crop)) == 32
    masked = np.zeros((240, 320), bool)
    masked[:, 160:] = True
    after = noise.copy()
    after[:, 160:] = 255 - after[:, 160:]
    assert X.tile_scores(noise, after, masked=masked).max() == 0
    delta = np.zeros((100, 200))
    assert not X.overflows((50, 20, 100, 40), delta)
    delta[50:60, 50:100] = 0.5
    assert X.overflows((50, 20, 100, 40), delta)
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert X.quad_iou(square, square + [5, 0]) == pytest.approx(1 / 3) and X.quad_iou(square, square[::-1]) == pytest.approx(1.0)
    diamond = np.array([[5, -5], [15, 5], [5, 15], [-5, 5]], float)
    assert X.quad_iou(square, diamond) == pytest.approx(0.5)
    tiles = np.zeros((10, 16), bool)
    tiles[5, 5] = True
    assert X.change_scopes(tiles, 160, 100) == [(30, 30, 80, 80)]


def test_frame_source(spark, tmp_path):
    from glyphstream.sources.frames import FrameSource, image_of

    t = np.arange(0, 10, 0.25)
    images = np.arange(len(t) * 12, dtype=np.uint8).reshape(len(t), 3, 4)
    np.savez(tmp_path / "7.npz", t=t, image=images)
    spark.dataSource.register(FrameSource)
    read = lambda **o: spark.read.format("frames").options(path=str(tmp_path), **o).load().orderBy("t").collect()
    rows = read(chunk_sec="3")
    assert [r.t for r in rows] == t.tolist() and len({r.frame_id for r in rows}) == len(t)
    assert (image_of(rows[5]) == images[5]).all()
    assert [r.t for r in read(start_sec="2", end_sec="4", sample_fps="1")] == [2, 3, 4]
    assert [(r.width, r.height) for r in read(end_sec="0", max_width="2")] == [(2, 2)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    d = spark.read.format("frames").options(path=f"file://{tmp_path}", chunk_sec="3", push_filters="true").load().where("t >= 4 AND t < 5")
    assert [r.t for r in d.orderBy("t").collect()] == [4, 4.25, 4.5, 4.75] and d.rdd.getNumPartitions() == 1
    assert [r.t for r in read(decoder="tests.decoders:from_key_frame", sample_fps="1", start_sec="2.5", end_sec="5")] == [3, 4, 5]


def test_frames_that_may_be_skipped():
    from glyphstream.sources.frames import skipped

    assert [skipped(*x) for x in ((30, 0), (2, 1), (30, 1), (30, 1.5), (30, 5), (0, 1))] == ["none", "none", "nonref", "nonref", "bidir", "none"]


def test_event_files(spark, tmp_path):
    from glyphstream.__main__ import evaluate_files
    from glyphstream.sources.events_json import read_events, write_events

    path = tmp_path / "in.jsonl"
    first = {"event_id": 3, "start": 0.0, "end": 2.0, "text_raw": "Grüße", "polygon_history": [[0.0, [[10, 10], [110, 10], [110, 50], [10, 50]]]]}
    path.write_text(json.dumps(first, ensure_ascii=False) + "\n\n" + json.dumps({"start": 5, "end": 6, "text_normalized": "x"}) + "\n", encoding="utf-8")
    d = read_events(spark, str(path)).orderBy("start")
    a, b = d.collect()
    assert (a.text_normalized, a.confidence, a.recognition_level, a.polygon_history[0].polygon[2].x) == ("Grüße", 0.0, 1, 110.0)
    assert (b.text_raw, b.event_id, b.alternatives, b.polygon_history) == ("x", 0, [], [])
    write_events(d, str(tmp_path / "out"), single_file=True)
    assert [tuple(r) for r in read_events(spark, str(tmp_path / "out")).orderBy("start").collect()] == [tuple(a), tuple(b)]
    report = evaluate_files(str(path), str(path))
    assert (report["matched_events"], report["text_accuracy"]) == (1, 1.0)
    path.write_text('{"start": 1}\n')
    with pytest.raises(Exception, match="lacks end"):
        read_events(spark, str(path)).collect()


def test_recognition(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "task_id long")
    results = spark.createDataFrame([(1, "a"), (3, "b")], "task_id long, text string")
    assert {tuple(r) for r in recognition.unmatched_results(tasks, results, "task_id").collect()} == {(2, True, False), (3, False, True)}
    with pytest.raises(Exception, match="do not match"):
        recognition.checked_results(tasks, results, "task_id").collect()
    got = recognition.recognize(tasks, recognition.null_recognizer, "task_id long, text string, confidence double").collect()
    assert {(r.task_id, r.text, r.confidence) for r in got} == {(1, "", 0.0), (2, "", 0.0)}


def test_config(tmp_path):
    c = Config.from_dict({"tracking": {"min_iou": 0.5}})
    assert c.tracking.min_iou == 0.5 and c.contents.stable == 2
    c.save(tmp_path / "a" / "c.json")
    assert Config.load(tmp_path / "a" / "c.json") == c
    for bad in ({"other": {}}, {"tracking": {"other": 1}}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)


def test_jobs(spark, tmp_path):
    from glyphstream.jobs import Jobs

    jobs = Jobs(spark, str(tmp_path))
    good, bad = jobs.submit("range", lambda: spark.range(25)), jobs.submit("broken", lambda: spark.table("no_such_table"))
    jobs.close()
    assert (jobs.status(good.job_id).status, jobs.status(bad.job_id).status) == ("completed", "failed")
    rows, more = jobs.page(good.job_id, ["id"], 20, 3)
    assert ([r["id"] for r in rows], more) == ([20, 21, 22], True)
    with pytest.raises(ValueError):
        jobs.clean_up(good.job_id)
    jobs.clean_up(good.job_id, confirm=True)
    assert [j.job_id for j in jobs.newest()] == [bad.job_id]
