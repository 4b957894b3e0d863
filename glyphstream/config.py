"""Settings of the engine by section, read from JSON with defaults; unknown names are errors."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class Detection:
    fast_width: int = 960
    local_width: int = 1600
    audit_width: int = 2560
    audit_sec: float = 20.0
    min_audit_sec: float = 3.0
    tile_rows: int = 10
    tile_cols: int = 16
    tile_threshold: float = 0.035
    fast_trigger_ratio: float = 0.12
    scene_score: float = 0.085
    scene_ratio: float = 0.60
    guided: bool = True  # small changes inside known boxes need no detector
    guided_confidence: float = 0.45
    guided_velocity: float = 0.03  # share of the diagonal
    refresh_rest_sec: float = 5.0
    short_rest_sec: float = 2.25


@dataclass
class Tracking:
    min_iou: float = 0.25
    max_distance: float = 0.20
    max_missed: int = 6


@dataclass
class Contents:
    change: float = 0.16
    stable: int = 2
    stable_wait: float = 0.45
    longest_wait: float = 1.8
    candidates: int = 3
    typewriter_skip: float = 0.60


@dataclass
class Policy:
    probe: float = 0.25
    batch: int = 16


@dataclass
class Config:
    detection: Detection = field(default_factory=Detection)
    tracking: Tracking = field(default_factory=Tracking)
    contents: Contents = field(default_factory=Contents)
    policy: Policy = field(default_factory=Policy)

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        sections = {f.name: f.default_factory for f in fields(cls)}
        if unknown := data.keys() - sections.keys():
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        out = {}
        for name, make in sections.items():
            given = data.get(name, {})
            if unknown := given.keys() - {f.name for f in fields(make)}:
                raise ValueError(f"unknown settings in {name}: {sorted(unknown)}")
            out[name] = make(**given)
        return cls(**out)

    @classmethod
    def load(cls, path: str | Path | None) -> Config:
        return cls() if path is None else cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    def check(self) -> Config:
        """Itself, if its values can be worked with."""
        d, t, c = self.detection, self.tracking, self.contents
        if min(d.tile_rows, d.tile_cols, d.fast_width, d.local_width, d.audit_width, c.candidates, c.stable, self.policy.batch) < 1 or t.max_missed < 0:
            raise ValueError("rows, columns, widths and counts must be positive")
        if not (0 <= t.min_iou <= 1 and 0 <= c.change <= 1 and 0 < d.min_audit_sec <= d.audit_sec and self.policy.probe > 0):
            raise ValueError("shares must lie between 0 and 1, and waits be positive")
        return self

    def to_dict(self) -> dict:
        return asdict(self)

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.to_dict(), indent=2), encoding="utf-8")
