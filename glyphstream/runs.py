"""Whole runs over a folder of streams: frames in, text events, their metadata and profile out; and the same as background jobs."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .jobs import Job, Jobs
from .operators import chunks, engine
from .session import stored
from .sources.events_json import write_metadata
from .sources.frames import FrameSource, function_named

MOST_CONFIGS = 8


@dataclass
class Run:
    """Where a run's results are, and what they cost."""

    events: str
    metadata: str
    event_count: int
    profile: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self) | {"video_realtime": self.profile.get("video_realtime", 0.0)}


@dataclass
class Options:
    """What is read of a folder, and how. ``chunk_sec``: None to choose by the longest stream's duration, 0 for whole streams."""

    start_sec: float = 0.0
    end_sec: float | None = None
    chunk_sec: float | None = None
    overlap_sec: float = chunks.OVERLAP
    sample_fps: float = 1.0
    max_width: int = 1280
    short_sec: float = chunks.SHORT
    regions: tuple[tuple[float, float, float, float], ...] = ()
    decoder: str = ""
    probe: str = ""

    def check(self) -> Options:
        if self.start_sec < 0 or self.end_sec is not None and self.end_sec < self.start_sec:
            raise ValueError("a range begins at 0 or later and ends no earlier than it begins")
        if min(self.overlap_sec, self.sample_fps, self.max_width, self.short_sec, self.chunk_sec or 0) < 0:
            raise ValueError("widths, rates and overlaps must not be negative")
        return self


def frames_of(spark: SparkSession, folder: str, o: Options) -> DataFrame:
    spark.dataSource.register(FrameSource)
    given = {"path": folder, "start_sec": o.start_sec, "end_sec": o.end_sec, "sample_fps": o.sample_fps, "max_width": o.max_width, "decoder": o.decoder, "probe": o.probe}
    return spark.read.format("frames").options(**{k: str(v) for k, v in given.items() if v not in (None, "")}).load()


def run_folder(spark: SparkSession, folder: str, output: str, detector, recognizer, config: Config | None = None, options: Options | None = None) -> Run:
    """Text events of each stream of a folder as Parquet, with metadata and profile as JSON beside them."""
    begun, o, config = time.perf_counter(), (options or Options()).check(), (config or Config()).check()
    frames = frames_of(spark, folder, o)
    spans = [r.asDict() for r in frames.groupBy("video_id").agg((F.max("t") - F.min("t")).alias("sec")).agg(F.coalesce(F.max("sec"), F.lit(0.0)).alias("longest"), F.coalesce(F.sum("sec"), F.lit(0.0)).alias("all")).collect()][0]
    width = chunks.chunk_width(spans["longest"], short=o.short_sec) or 0.0 if o.chunk_sec is None else o.chunk_sec
    done = stored(engine.passed(engine.in_chunks(frames, width, o.overlap_sec), detector, regions=o.regions, config=config))
    events = engine.events(done.where("event_id IS NOT NULL").drop("counters"), recognizer, bool(width), o.overlap_sec, o.start_sec, o.end_sec)
    events.write.mode("overwrite").parquet(f"{output}/events")
    count = spark.read.parquet(f"{output}/events").count()
    profile = chunks.run_profile(engine.profiles(done), [], spans["all"], time.perf_counter() - begun).first().asDict(True) | {"output_events": count}
    about = {"folder": folder, "options": o, "config": config, "chunk_sec": width, "strategy": "given" if o.chunk_sec is not None else "chunked" if width else "whole_short_streams", "profile": profile}
    write_metadata(spark, f"{output}/metadata.json", about)
    return Run(f"{output}/events", f"{output}/metadata.json", count, profile)


class Tools:
    """Runs as jobs: each is submitted, then asked for by its id."""

    def __init__(self, jobs: Jobs):
        self.jobs = jobs

    def _submit(self, kind: str, folder: str, detector: str, recognizer: str, config: Config | None, options: Options) -> Job:
        options.check()
        spark, place = self.jobs.spark, f"{self.jobs.root}/{kind}-"

        def make(job_place: str) -> DataFrame:
            made = run_folder(spark, folder, job_place, function_named(detector), function_named(recognizer), config, options)
            return spark.read.parquet(made.events)

        return self.jobs.submit(kind, partial(make, place + str(time.time_ns())))

    def run(self, folder: str, detector: str, recognizer: str, config: Config | None = None, options: Options | None = None) -> Job:
        """Whole streams, cut into chunks if they are long."""
        return self._submit("run", folder, detector, recognizer, config, options or Options())

    def run_chunked(self, folder: str, detector: str, recognizer: str, chunk_sec: float, config: Config | None = None, options: Options | None = None) -> Job:
        if chunk_sec <= 0:
            raise ValueError("a chunk has a width")
        return self._submit("chunked", folder, detector, recognizer, config, Options(**{**asdict(options or Options()), "chunk_sec": chunk_sec}))

    def segment(self, folder: str, detector: str, recognizer: str, start_sec: float, end_sec: float, config: Config | None = None, options: Options | None = None) -> Job:
        return self._submit("segment", folder, detector, recognizer, config, Options(**{**asdict(options or Options()), "start_sec": start_sec, "end_sec": end_sec}))

    def benchmark(self, folder: str, detector: str, recognizer: str, configs: dict[str, Config], options: Options | None = None) -> Job:
        """How long each of up to MOST_CONFIGS settings takes: name, event_count, total_sec, video_realtime."""
        if not 1 <= len(configs) <= MOST_CONFIGS:
            raise ValueError(f"1 to {MOST_CONFIGS} settings")
        spark, place, o = self.jobs.spark, f"{self.jobs.root}/benchmark-{time.time_ns()}", (options or Options()).check()

        def make() -> DataFrame:
            rows = []
            for name, config in configs.items():
                made = run_folder(spark, folder, f"{place}/{name}", function_named(detector), function_named(recognizer), config, o)
                rows.append((name, made.event_count, made.profile["total_sec"], made.profile["video_realtime"]))
            return spark.createDataFrame(rows, "name string, event_count long, total_sec double, video_realtime double")

        return self.jobs.submit("benchmark", make)
