"""The detection planner: which detector tier looks at a frame, given when it last looked."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .ordered import scan

NEVER = float("-inf")


@dataclass
class Planner:
    """State of one stream: the times of its last audit and of its last probe."""

    audit: float = 20.0
    least_audit: float = 3.0
    probe: float = 0.25
    broad: float = 0.12
    local: bool = True
    last_audit: float = NEVER
    last_probe: float = NEVER

    def plan(self, t: float, cut: bool, reliable: bool, scopes: bool, tracks: bool, ratio: float) -> list[tuple[str, str]]:
        """(tier, reason) of each request, the full-frame tiers first."""
        waited = t - self.last_audit
        for due, reason in ((cut, "scene_cut"), (waited >= self.audit, "periodic_audit"), (not reliable and waited >= self.least_audit, "motion_unreliable")):
            if due:
                self.last_audit = self.last_probe = t
                return [("AUDIT", reason)]
        local = scopes and self.local
        if t - self.last_probe < self.probe:
            urgent = local and tracks and ratio < self.broad
            return [("LOCAL", "urgent_local_change")] if urgent else []
        self.last_probe = t
        found = []
        if not tracks or ratio >= self.broad:
            found.append(("FAST", "broad_change" if tracks else "scheduled_probe"))
        if local:
            found.append(("LOCAL", "motion_compensated_local_change"))
        return found


def requests(frames: DataFrame, **settings: float) -> DataFrame:
    """(video_id, frame_id, t, cut, reliable, scopes, tracks, ratio) -> video_id, frame_id, requests (tiers joined by +), where any is made."""

    def step(b: pa.RecordBatch, state, ends: bool):
        state = state or Planner(**settings)
        videos, ids, tiers = [], [], []
        for r in b.to_pylist():
            if found := state.plan(r["t"], r["cut"], r["reliable"], r["scopes"], r["tracks"], r["ratio"]):
                videos.append(r["video_id"])
                ids.append(r["frame_id"])
                tiers.append("+".join(tier for tier, _ in found))
        return pa.RecordBatch.from_arrays([pa.array(videos, pa.int64()), pa.array(ids, pa.int64()), pa.array(tiers, pa.string())], names=["video_id", "frame_id", "requests"]), state

    return scan(frames, ["video_id"], ["t", "frame_id"], step, "video_id long, frame_id long, requests string")
