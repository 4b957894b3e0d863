"""Runs of different settings against reference events: measured, scored and ranked, completeness first."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators import evaluate
from .session import stored

MOST_RUNS = 8


def run_benchmark(name: str, make: Callable[[], DataFrame], reference: DataFrame, video_sec: float) -> dict:
    """The report of the events that ``make`` gives (video_id, event_id, start, stop, text, history) over all streams, with the time it took.

    Counts are summed over streams; rates and means are weighted by what they are means of."""
    began = time.perf_counter()
    events = stored(make().select("video_id", "event_id", "start", "stop", "text", "history"))
    wall = time.perf_counter() - began
    pairs = stored(evaluate.candidate_pairs(reference, events))
    rows = [r.asDict() for r in evaluate.report(reference, events, pairs).collect()]
    total = lambda c: sum(r[c] for r in rows)
    mean = lambda c, w: sum(r[c] * r[w] for r in rows) / max(total(w), 1)
    matched = total("matched_events")
    return {
        "name": name,
        "reference_events": total("reference_events"),
        "predicted_events": total("predicted_events"),
        "matched_events": matched,
        "event_recall": matched / max(total("reference_events"), 1),
        "text_accuracy": mean("text_accuracy", "matched_events") if matched else 1.0,
        "duplicate_rate": mean("duplicate_rate", "predicted_events"),
        "mean_temporal_iou": mean("mean_temporal_iou", "matched_events"),
        "mean_spatial_iou": mean("mean_spatial_iou", "matched_events"),
        "wall_sec": wall,
        "video_realtime": video_sec / max(wall, 1e-9) if video_sec > 0 else 0.0,
    }


def compare(runs: dict[str, Callable[[], DataFrame]], reference: DataFrame, video_sec: float) -> list[dict]:
    """Reports of up to MOST_RUNS runs, best first: by recall, accuracy, fewest duplicates, speed."""
    if not 1 <= len(runs) <= MOST_RUNS:
        raise ValueError(f"1 to {MOST_RUNS} runs")
    reports = [run_benchmark(name, make, reference, video_sec) for name, make in runs.items()]
    return sorted(reports, key=lambda r: (-r["event_recall"], -r["text_accuracy"], r["duplicate_rate"], -r["video_realtime"]))
