"""The adaptive policy: signals to settings, as one expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNALS = ("ocr_queue", "detection_queue", "layout_stability", "audit_yield", "motion_magnitude", "motion_confidence", "typewriter", "lifetime", "gpu")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def decide(s: dict[str, Column]) -> dict[str, Column]:
    """probe, audit, width, stable, longest, batch, wait and the reasons; ``s`` has a column for each of SIGNALS."""
    lit = F.lit
    pressure = F.greatest(s["ocr_queue"], s["detection_queue"]) >= 48
    calm = (s["layout_stability"] >= 0.90) & (s["audit_yield"] < 0.02)
    missed = s["audit_yield"] >= 0.10
    moving = s["motion_magnitude"] > 8
    lost, compensated = moving & (s["motion_confidence"] < 0.55), moving & (s["motion_confidence"] >= 0.75)
    typing = s["typewriter"] >= 0.60
    short = (s["lifetime"] > 0) & (s["lifetime"] < 1)
    known = s["gpu"].isNotNull()
    queued = F.greatest(s["ocr_queue"], s["detection_queue"]) > 0
    idle, busy = known & (s["gpu"] < 0.35) & queued, known & (s["gpu"] > 0.90)
    idle, busy = F.coalesce(idle, lit(False)), F.coalesce(busy, lit(False))
    times = lambda value, *rules: _fold(value, rules)
    wide = F.when(missed | lost, lit(1600)).otherwise(lit(960))
    reasons = F.array_compact(
        F.array(
            F.when(pressure, "queue_pressure"),
            F.when(calm, "stable_layout"),
            F.when(missed, "audit_found_misses"),
            F.when(lost, "unreliable_motion_compensation").when(compensated, "motion_compensated"),
            F.when(typing, "typewriter_pattern"),
            F.when(short, "short_lived_text"),
            F.when(idle, "gpu_headroom").when(busy, "gpu_saturated"),
        )
    )
    return {
        "probe": clamp(times(0.25, (pressure, 1.6), (calm, 1.25), (short, 0.65)), 0.10, 0.75),
        "audit": clamp(times(20.0, (calm, 1.5), (missed, 0.80), (lost, 0.5)), 3.0, 40.0),
        "width": wide,
        "stable": clamp(times(0.45, (typing, 1.7), (short, 0.55)), 0.15, 1.5),
        "longest": clamp(times(1.8, (typing, 1.25), (short, 0.70)), 0.5, 4.0),
        "batch": F.when(pressure, 32).otherwise(16),
        "wait": clamp(lit(35.0) + F.when(pressure, 15.0).otherwise(0.0) + F.when(idle, -10.0).when(busy, 10.0).otherwise(0.0), 10.0, 80.0),
        "reasons": reasons,
    }


def _fold(value: float, rules) -> Column:
    out = F.lit(value)
    for condition, factor in rules:
        out = out * F.when(condition, factor).otherwise(1.0)
    return out


def decide_values(s: dict[str, float | None]) -> dict[str, float | int | list[str]]:
    """The same for one set of signals, for loops that feed back on their own state."""
    pressure = max(s["ocr_queue"], s["detection_queue"])
    gpu, motion = s["gpu"], s["motion_magnitude"] > 8
    rules = {
        "queue_pressure": pressure >= 48,
        "stable_layout": s["layout_stability"] >= 0.90 and s["audit_yield"] < 0.02,
        "audit_found_misses": s["audit_yield"] >= 0.10,
        "unreliable_motion_compensation": motion and s["motion_confidence"] < 0.55,
        "motion_compensated": motion and s["motion_confidence"] >= 0.75,
        "typewriter_pattern": s["typewriter"] >= 0.60,
        "short_lived_text": 0 < s["lifetime"] < 1,
        "gpu_headroom": gpu is not None and gpu < 0.35 and pressure > 0,
        "gpu_saturated": gpu is not None and gpu > 0.90,
    }
    on = [name for name, holds in rules.items() if holds]
    product = lambda start, **factors: math.prod([start, *(f for name, f in factors.items() if name in on)])
    between = lambda v, low, high: max(low, min(v, high))
    wait = 35.0 + 15.0 * ("queue_pressure" in on) - 10.0 * ("gpu_headroom" in on) + 10.0 * ("gpu_saturated" in on)
    return {
        "probe": between(product(0.25, queue_pressure=1.6, stable_layout=1.25, short_lived_text=0.65), 0.10, 0.75),
        "audit": between(product(20.0, stable_layout=1.5, audit_found_misses=0.80, unreliable_motion_compensation=0.5), 3.0, 40.0),
        "width": 1600 if {"audit_found_misses", "unreliable_motion_compensation"} & set(on) else 960,
        "stable": between(product(0.45, typewriter_pattern=1.7, short_lived_text=0.55), 0.15, 1.5),
        "longest": between(product(1.8, typewriter_pattern=1.25, short_lived_text=0.70), 0.5, 4.0),
        "batch": 32 if "queue_pressure" in on else 16,
        "wait": between(wait, 10.0, 80.0),
        "reasons": on,
    }
