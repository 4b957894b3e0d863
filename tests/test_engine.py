"""The engine over drawn frames, with plain functions as detector and recognizer."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphstream.functions import policy
from glyphstream.operators import engine as E

H, W = 240, 440


def scene(x=10, y=20, seed=1):
    y0, x0 = np.mgrid[0:H, 0:W]
    image = ((x0 * 7 + y0 * 13) % 32 + 60).astype(np.uint8)
    rng = np.random.default_rng(seed)
    image[y : y + 40, x : x + 100] = np.kron(rng.integers(0, 2, (5, 10)) * 200 + 30, np.ones((8, 10)))[:40, :100].astype(np.uint8)
    return image


def at(x, y=20):
    return (float(x), float(y), x + 100.0, y + 40.0)


def test_moving_text_is_one_event():
    calls = []

    def detector(image, request):
        calls.append(request.tier)
        return [(at(10 + 4 * (len(frames_seen) - 1)), 0.95)]

    frames_seen = []
    e = E.Engine(detector, guided=False)
    done = []
    for i in range(4):
        frames_seen.append(i)
        done += e.frame(0.5 * i, scene(10 + 4 * i))
    done += e.end()
    assert len(done) == 1 and done[0]["start"] == 0 and len(done[0]["history"]) >= 2 and calls[0] == "AUDIT"


def test_idle_frames_extend_events_without_detection():
    calls = []

    def detector(image, request):
        calls.append(request)
        return [(at(10), 0.95)]

    e = E.Engine(detector)
    for i in range(8):
        e.frame(0.1 * i, scene())
    (event,) = e.end()
    assert event["stop"] == 0.7 or abs(event["stop"] - 0.7) < 1e-9
    assert len(calls) < 8 and e.counts["idle_frames"] > 0


def test_excluded_regions_hide_watermarks():
    e = E.Engine(lambda image, request: [(at(10), 0.9), ((340.0, 160.0, 430.0, 230.0), 0.9)], regions=((0.70, 0.60, 1.0, 1.0),))
    e.frame(0.0, scene())
    assert len(e.stream.tracks) == 1 and e.counts["excluded_observations"] == 1


def test_change_inside_a_known_box_needs_no_detector():
    calls = []

    def detector(image, request):
        calls.append(request.tier)
        return [(at(10), 0.95)]

    e = E.Engine(detector)
    e.frame(0.0, scene())
    done = e.frame(0.4, scene(seed=2))
    assert calls == ["AUDIT"] or e.counts["local_requests_fully_guided"] == 1
    assert [d["content_id"] for d in done + e.end()] == [1, 2]


def test_fragments_and_scopes():
    line = ((10.0, 10.0, 210.0, 40.0), 0.9, "FAST")
    parts = [((x, 12.0, x + 50.0, 38.0), 0.95, "LOCAL") for x in (15.0, 80.0, 150.0)]
    assert E.without_duplicates([*parts, line]) == [line]
    assert E.without_contained([(10, 10, 20, 20), (0, 0, 100, 100), (200, 0, 210, 10)]) == ((0, 0, 100, 100), (200, 0, 210, 10))


def test_policy_of_values_equals_policy_of_columns(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 60), rng.randint(0, 60), rng.random(), rng.random() / 5, rng.random() * 16, rng.random(), rng.random(), rng.random() * 2, rng.choice([None, rng.random()])) for _ in range(300)]
    d = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if 'queue' in n else 'double'}" for n in policy.SIGNALS))
    got = d.select("*", F.struct(*[c.alias(n) for n, c in policy.decide({n: F.col(n) for n in policy.SIGNALS}).items()]).alias("d")).collect()
    for r in got:
        want = policy.decide_values({n: r[n] for n in policy.SIGNALS})
        assert all(abs(r.d[k] - v) < 1e-9 if k != "reasons" else r.d[k] == v for k, v in want.items())


def frames_of(spark, count, video=1, step=0.5):
    rows = [(video, i, step * i, W, H, 1, bytearray(scene(seed=1 + i // (count // 2)).tobytes())) for i in range(count)]
    return spark.createDataFrame(rows, "video_id long, frame_id long, t double, width int, height int, channels int, image binary")


def test_run_over_tables(spark):
    def detector(image, request):
        return [((10.0, 20.0, 110.0, 60.0), 0.95)]

    def recognizer(crops):
        return [(f" text {int(c[:24, :40].mean())}", 0.9) for c in crops]

    frames = frames_of(spark, 12)
    whole = E.run(frames, detector, recognizer).orderBy("start").collect()
    assert len(whole) == 2 and whole[0].start == 0 and whole[1].stop == 5.5 and whole[0].text != whole[1].text
    assert [r.event_id for r in whole] == [1, 2] and not any(r.cached for r in whole)
    assert all(len(r.history) >= 1 and r.n_seen >= 1 for r in whole)
    with pytest.raises(ValueError, match="half of a chunk"):
        E.run(frames, detector, recognizer, chunk_sec=3.0)
    cut = E.run(frames, detector, recognizer, chunk_sec=3.0, overlap=1.0)
    merged = cut.orderBy("start").collect()
    assert cut.columns == E.run(frames, detector, recognizer).columns
    assert [r.text for r in merged][:1] == [whole[0].text.strip()] and len(merged) == 2 and max(r.stop for r in merged) == 5.5
    assert all([p.t for p in r.history] == sorted({p.t for p in r.history}) for r in merged)
    assert E.run(frames.where("false"), detector, recognizer).count() == 0


def test_runs_are_ranked_by_completeness(spark):
    from glyphstream.benchmark import compare

    kind = "video_id long, event_id long, start double, stop double, text string, history array<struct<t:double,l:double,t0:double,r:double,b0:double>>"
    box = [(0.0, 10.0, 10.0, 110.0, 50.0)]
    reference = spark.createDataFrame([(v, e, 10.0 * e, 10.0 * e + 5, f"line {e}", box) for v in (1, 2) for e in (1, 2)], kind)
    got = compare({"half": lambda: reference.where("event_id = 1"), "all": lambda: reference, "twice": lambda: reference.unionByName(reference.withColumn("event_id", F.col("event_id") + 10))}, reference, 60.0)
    assert [r["name"] for r in got] == ["all", "twice", "half"]
    assert [r["event_recall"] for r in got] == [1.0, 1.0, 0.5] and got[1]["duplicate_rate"] == 0.5


def test_settings_act():
    from glyphstream.config import Config

    e = E.Engine(lambda image, request: [], config=Config.from_dict({"tracking": {"max_missed": 2}, "detection": {"audit_sec": 8.0, "audit_width": 1234, "guided": False}}))
    assert (e.settings.most_missed, e.planner.audit, e.guided) == (2, 8.0, False)
    widths = []
    e.detector = lambda image, request: widths.append(request.width) or []
    e.frame(0.0, scene())
    assert widths == [1234]
    e.frame(0.5, scene())
    assert e.planner.audit == 8.0 * 1.5  # a calm layout is looked at less often
    for bad in ({"detection": {"tile_rows": 0}}, {"tracking": {"min_iou": 2.0}}):
        with pytest.raises(ValueError):
            E.Engine(lambda image, request: [], config=Config.from_dict(bad))
    with pytest.raises(ValueError, match="regions"):
        E.Engine(lambda image, request: [], regions=((0.5, 0.5, 0.4, 1.0),))


def test_queue_presses_on_the_policy():
    boxes = [(float(x), float(y), x + 30.0, y + 12.0) for x in range(5, 420, 40) for y in range(5, 230, 16)]
    e = E.Engine(lambda image, request: [(b, 0.9) for b in boxes])
    for i in range(3):
        e.frame(i / 1000, scene(seed=i))
        e.planner.last_audit = -np.inf
        e.planner.last_probe = -np.inf
    assert len(e.queue) >= 48
    e.frame(0.004, scene(seed=9))
    assert e.counts["queue_pressure"] >= 1 and e.counts["recognition_batches"] >= 1
    e.end()
    assert len(e.queue) == 0 and e.counts["recognition_tasks"] >= 48


def test_load_of_the_device_is_a_signal():
    e = E.Engine(lambda image, request: [(at(10), 0.9)], gpu=lambda: 0.95)
    e.frame(0.0, scene())
    assert e.counts["gpu_saturated"] == 1


def test_counters_leave_the_run(spark):
    from glyphstream.operators import chunks

    done = E.passed(E.in_chunks(frames_of(spark, 12), 3.0, 1.0), lambda image, request: [((10.0, 20.0, 110.0, 60.0), 0.95)])
    rows = {r.chunk: r.counters for r in E.profiles(done).collect()}
    assert set(rows) == {0, 1, 2} and sum(r["frames"] for r in rows.values()) > 12 and all(r["detection_observations"] >= 1 for r in rows.values())
    p = chunks.run_profile(E.profiles(done), ["video_id"], 5.5, 2.0).first()
    assert (p.video_id, p.chunk_count, p.processed_sec, p.video_realtime, p.total_sec) == (1, 3, 5.5, 2.75, 2.0)
    assert p.counters["frames"] == sum(r["frames"] for r in rows.values()) and p.work_sec_sum > 0
    assert chunks.run_profile(E.profiles(done), [], 5.5, 2.0).count() == 1
