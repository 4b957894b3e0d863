"""Frames as a data source: one partition per (stream, chunk), with a pluggable decoder.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").option("path", folder).option("chunk_sec", "180").load()

The folder, on any file system that pyarrow can open, holds one ``<video_id>.npz`` per stream, with ``t`` (seconds, in order) and ``image`` (frame, height, width[, 3]).
Options: ``start_sec`` and ``end_sec`` (both included), ``push_filters`` (true: filters on t narrow that range; the session must have
``spark.sql.python.filterPushdown.enabled``), ``chunk_sec`` (a partition's width; 0 for whole streams), ``sample_fps`` (0 for all
frames), ``max_width`` (wider frames are shrunk), ``decoder`` (``module:function`` in place of the reader of .npz files: a path, a time range and, if it takes them,
options, to (t, image) pairs). A decoder may begin at a key frame before its range, as frames outside are dropped here, and may leave out the frames that
``options["skip"]`` names, which other frames need not be decoded for; ``module:function`` of ``probe`` tells (last time, frames per second) of a path."""

from __future__ import annotations

import importlib
import inspect
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.pixels import area_resize

SCHEMA = "video_id long, frame_id long, t double, width int, height int, channels int, image binary"


def opened(path: str) -> io.BytesIO:
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(place) as f:
        return io.BytesIO(f.read())


def listed(folder: str) -> list[str]:
    """Paths of the files in a folder, in order."""
    system, place = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    prefix = folder[: -len(place)] if folder.endswith(place) else folder.partition("://")[0] + "://"
    return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(place)) if f.is_file)


def skipped(source_fps: float, sample_fps: float) -> str:
    """Which frames a decoder may leave out: none, those nothing depends on, or those that depend on both sides."""
    if sample_fps <= 0 or source_fps <= 2 * sample_fps:
        return "none"
    return "nonref" if sample_fps <= 1.5 else "bidir"


def function_named(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def read_npz(path: str, start: float, end: float) -> Iterator[tuple[float, np.ndarray]]:
    with np.load(opened(path)) as z:
        t = z["t"]
        images = z["image"]
        for i in range(int(np.searchsorted(t, start)), int(np.searchsorted(t, end, side="right"))):
            yield float(t[i]), images[i]


def probe_npz(path: str) -> tuple[float, float]:
    """(last time, frames per second)."""
    with np.load(opened(path)) as z:
        t = z["t"]
        return (float(t[-1]), (len(t) - 1) / max(float(t[-1] - t[0]), 1e-9)) if len(t) else (0.0, 0.0)


@dataclass
class Chunk(InputPartition):
    path: str
    video_id: int
    number: int
    start: float
    end: float
    open_end: bool  # the end belongs to the next chunk
    skip: str = "none"


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.start, self.end = float(options.get("start_sec", "0")), float(options.get("end_sec", "inf"))
        self.chunk, self.fps = float(options.get("chunk_sec", "0")), float(options.get("sample_fps", "0"))
        self.decoder, self.probe, self.width = options.get("decoder"), options.get("probe"), int(options.get("max_width", "0"))
        if self.start < 0 or self.end < self.start or self.chunk < 0 or self.fps < 0:
            raise ValueError("frames: times and rates must not be negative, and end_sec not before start_sec")

    def partitions(self) -> list[Chunk]:
        out = []
        for path in listed(self.folder):
            stem, _, kind = path.rsplit("/", 1)[-1].partition(".")
            if not stem.isdigit() or not self.decoder and kind != "npz":
                continue
            video = int(stem)
            last, fps = (function_named(self.probe) if self.probe else probe_npz)(path)
            end = min(self.end, last)
            if end < self.start:
                continue
            n = max(1, int(np.ceil((end - self.start) / self.chunk))) if self.chunk else 1
            width = self.chunk if self.chunk else end - self.start
            out += [Chunk(path, video, k, self.start + k * width, min(end, self.start + (k + 1) * width), k < n - 1, skipped(fps, self.fps)) for k in range(n)]
        return out

    def read(self, partition: Chunk) -> Iterator[tuple]:
        decode = function_named(self.decoder) if self.decoder else read_npz
        given = (partition.path, partition.start, partition.end)
        if len(inspect.signature(decode).parameters) > 3:
            given = (*given, {"skip": partition.skip})
        due, number = float("-inf"), 0
        for t, image in decode(*given):
            if t < partition.start:  # what leads up from a key frame
                continue
            if t > partition.end or partition.open_end and t >= partition.end:
                break
            if self.fps and t + 1e-9 < due:
                continue
            due = t + 1 / self.fps if self.fps else t
            if self.width and image.shape[1] > self.width:
                height = max(1, round(image.shape[0] * self.width / image.shape[1]))
                planes = [area_resize(p, self.width, height) for p in (np.moveaxis(image, 2, 0) if image.ndim == 3 else [image])]
                image = np.rint(np.stack(planes, 2) if image.ndim == 3 else planes[0])
            channels = 1 if image.ndim == 2 else image.shape[2]
            yield partition.video_id, partition.number * 10_000_000 + number, t, image.shape[1], image.shape[0], channels, np.ascontiguousarray(image, dtype=np.uint8).tobytes()
            number += 1


class NarrowedReader(FrameReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of t narrow what is read; Spark still applies all filters."""
        for f in filters:
            if getattr(f, "attribute", None) == ("t",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = max(self.start, float(f.value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.end = min(self.end, float(f.value))
            yield f


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        options = dict(self.options)
        return (NarrowedReader if options.get("push_filters") == "true" else FrameReader)(options)


def image_of(row) -> np.ndarray:
    shape = (row["height"], row["width"]) if row["channels"] == 1 else (row["height"], row["width"], row["channels"])
    return np.frombuffer(row["image"], dtype=np.uint8).reshape(shape)
