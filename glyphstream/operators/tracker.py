"""Tracks of places and of their contents over a stream: one step function for batch and streaming."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .ordered import scan

Box = tuple[float, float, float, float]
EVENT_SCHEMA = "video_id long, event_id long, geometry_id long, content_id long, start double, stop double, text string, confidence double, n_seen long, typewriter double"


@dataclass
class Settings:
    least_iou: float = 0.25
    most_distance: float = 0.20
    most_missed: int = 6
    change: float = 0.16
    stable: int = 2
    stable_wait: float = 0.45
    longest_wait: float = 1.8
    candidates: int = 3
    diversity: float = 0.35
    bits: int = 63  # of a signature
    width: float = 640.0
    height: float = 360.0


@dataclass
class Seen:
    """One observation: where, how sure, how it looks (bits), how well, and what a recognizer would read."""

    t: float
    box: Box
    confidence: float = 1.0
    sig: int = 0
    quality: float = 0.0
    complete: float = 0.0
    text: str = ""
    crop: bytes = b""  # what a recognizer would see, where texts are not known yet


@dataclass
class Content:
    content_id: int
    geometry_id: int
    first: float
    last: float
    sig: int
    stable: int = 1
    typewriter: float = 0.0
    queued: bool = False
    pool: list[Seen] = field(default_factory=list)
    history: list[tuple[float, Box]] = field(default_factory=list)


@dataclass
class Track:
    geometry_id: int
    box: Box
    first: float
    last: float
    confidence: float
    missed: int = 0
    velocity: tuple[float, float] = (0.0, 0.0)
    content: Content | None = None


def area(b: Box) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def iou(a: Box, b: Box) -> float:
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return both / max(area(a) + area(b) - both, 1e-9) if area(a) > 0 and area(b) > 0 else 0.0


def centre(b: Box) -> tuple[float, float]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def differing(a: int, b: int, bits: int = 63) -> float:
    return ((a ^ b) & ((1 << bits) - 1)).bit_count() / bits


def complementary(pool: list[Seen], limit: int, weight: float, bits: int = 63) -> list[Seen]:
    """The best candidate and those that add most to it; stable in pool order."""
    if len(pool) <= limit:
        return sorted(pool, key=lambda c: -c.quality)
    seed = max(pool, key=lambda c: c.quality)
    chosen = [seed]
    left = [c for c in pool if c is not seed]
    while left and len(chosen) < limit:
        gain = [c.quality + weight * (0.7 * min(differing(c.sig, k.sig, bits) for k in chosen) + 0.3 * abs(c.complete - seed.complete)) for c in left]
        chosen.append(left.pop(gain.index(max(gain))))
    return chosen


@dataclass
class Stream:
    """All state of one stream; ``step`` takes the observations of a frame in which detection ran, ``idle`` a frame in which none did."""

    settings: Settings = field(default_factory=Settings)
    tracks: dict[int, Track] = field(default_factory=dict)
    next_geometry: int = 1
    next_content: int = 1
    next_event: int = 1
    tasks: list[int] = field(default_factory=list)

    def match(self, seen: list[Seen], shift: tuple[float, float] = (0.0, 0.0)) -> dict[int, int]:
        """observation -> track, greedily by cost; shift is the motion since the last frame."""
        s, costs = self.settings, []
        diagonal = max(1.0, math.hypot(s.width, s.height))
        for k, track in self.tracks.items():
            b = track.box
            expected = (b[0] + shift[0], b[1] + shift[1], b[2] + shift[0], b[3] + shift[1])
            x, y = centre(expected)
            for i, o in enumerate(seen):
                overlap, (u, v) = iou(expected, o.box), centre(o.box)
                distance = math.hypot(u - x, v - y) / diagonal
                if overlap >= s.least_iou or distance <= s.most_distance:
                    costs.append((0.7 * (1 - overlap) + 0.3 * distance, k, i))
        taken: dict[int, int] = {}
        used: set[int] = set()
        for _, k, i in sorted(costs):
            if k not in used and i not in taken:
                taken[i] = k
                used.add(k)
        return taken

    def step(self, t: float, seen: list[Seen], shift: tuple[float, float] = (0.0, 0.0)) -> list[dict]:
        done: list[dict] = []
        taken = self.match(seen, shift)
        held = set(taken.values())
        for i, o in enumerate(seen):
            k = taken.get(i)
            if k is None:
                k = self.next_geometry
                self.next_geometry += 1
                self.tracks[k] = Track(k, o.box, o.t, o.t, o.confidence)
                held.add(k)
            else:
                track = self.tracks[k]
                (x, y), (u, v) = centre(track.box), centre(o.box)
                track.velocity, track.box, track.last, track.confidence, track.missed = (u - x, v - y), o.box, o.t, o.confidence, 0
            done += self._content(self.tracks[k], o)
        for k in [k for k in self.tracks if k not in held]:
            self.tracks[k].missed += 1
            if self.tracks[k].missed > self.settings.most_missed:
                done += self._finish(self.tracks.pop(k))
        return done

    def drop(self, geometry_id: int, silent: bool = False) -> list[dict]:
        """Ends a track whose place is to be found anew; ``silent`` if its content, seen too seldom, is not worth an event."""
        track = self.tracks.pop(geometry_id)
        unstable = track.content is not None and track.content.stable < self.settings.stable
        return [] if silent and unstable else self._finish(track)

    def idle(self, t: float, shift: tuple[float, float] = (0.0, 0.0)) -> None:
        """Open tracks last on, and move with the frame."""
        for track in self.tracks.values():
            track.last = t
            if any(shift):
                track.box = tuple(v + shift[i % 2] for i, v in enumerate(track.box))  # type: ignore[assignment]
            if track.content:
                track.content.last = t
                if any(shift):
                    track.content.history.append((t, track.box))

    def _content(self, track: Track, o: Seen) -> list[dict]:
        s, c, done = self.settings, track.content, []
        if c is None or differing(c.sig, o.sig, s.bits) >= s.change:
            score = 0.0
            if c is not None:
                score = min(1.0, 0.7 * c.typewriter + 0.3)
                done = self._finish(track)
            c = track.content = Content(self.next_content, track.geometry_id, o.t, o.t, o.sig, 1, score)
            self.next_content += 1
        else:
            c.sig, c.last, c.stable = o.sig, o.t, c.stable + 1
        c.pool = complementary([*c.pool, o], s.candidates, s.diversity, s.bits)
        c.history.append((o.t, o.box))
        if not c.queued and (c.stable >= s.stable or o.t - c.first >= min(s.stable_wait, s.longest_wait)):
            c.queued = True
            self.tasks.append(c.content_id)
        return done

    def _finish(self, track: Track) -> list[dict]:
        c = track.content
        track.content = None
        if c is None:
            return []
        best = max(c.pool, key=lambda p: p.quality)
        if not best.text and not best.crop:
            return []
        row = dict(event_id=self.next_event, geometry_id=c.geometry_id, content_id=c.content_id, start=c.first, stop=c.last, text=best.text, confidence=best.confidence, n_seen=c.stable, typewriter=c.typewriter, crops=[p.crop for p in c.pool if p.crop], history=c.history)
        self.next_event += 1
        return [row]

    def end(self) -> list[dict]:
        """All that is still open, as at the end of the stream."""
        done = [e for track in self.tracks.values() for e in self._finish(track)]
        self.tracks.clear()
        return done


def seen_of(r: dict) -> Seen:
    return Seen(r["t"], (r["l"], r["t0"], r["r"], r["b0"]), r["confidence"], r["sig"], r["quality"], r["complete"], r["text"] or "")


def feed(stream: Stream, rows: list[dict], pending: list[dict] | None = None, last: bool = False) -> tuple[list[dict], list[dict]]:
    """Runs rows, in order of frames, through a stream. The newest frame stays pending until a later one shows that it is complete, or to the ``last``.
    (events done, rows pending)"""
    rows, done, i = [*(pending or []), *rows], [], 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j]["frame_id"] == rows[i]["frame_id"]:
            j += 1
        if j == len(rows) and not last:
            break
        done += stream.step(rows[i]["t"], [seen_of(r) for r in rows[i:j]])
        i = j
    return done, rows[i:]


COLUMNS = ["video_id", "frame_id", "t", "l", "t0", "r", "b0", "confidence", "sig", "quality", "complete", "text"]


def tracked(observations: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Text events of every stream of observations (COLUMNS); a frame's state depends on the frame before, so a stream is read by one task,
    in Arrow batches. Long streams are cut into chunks first (see chunks)."""

    def step(b: pa.RecordBatch, state, ends: bool):
        stream, pending = state or (Stream(settings or Settings()), [])
        video = b.column("video_id")[0].as_py()
        done, pending = feed(stream, b.to_pylist(), pending, ends)
        if ends:
            done += stream.end()
        return events_batch(video, done), (stream, pending)

    return scan(observations.select(*COLUMNS), ["video_id"], ["frame_id", "l", "t0", "r", "b0"], step, EVENT_SCHEMA)


def events_batch(video: int, events: list[dict]) -> pa.RecordBatch:
    names = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    rows = [{"video_id": video, **e} for e in events]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[c.split()[1]]) for n, c in zip(names, EVENT_SCHEMA.split(", "))], names=names)
