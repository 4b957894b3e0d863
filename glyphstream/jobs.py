"""Jobs in the background of one session: submit, ask for status, page through results, clean up."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from .session import delete


def within(path: str, root: str) -> bool:
    """Is the path below the root, by its parts?"""
    parts, top = [p for p in path.split("/") if p != "."], [p for p in root.split("/") if p != "."]
    return ".." not in parts and len(parts) > len(top) and parts[: len(top)] == top


def now() -> str:
    return datetime.now(UTC).isoformat()


@dataclass
class Job:
    job_id: str
    kind: str
    output: str
    created_at: str = field(default_factory=now)
    started_at: str | None = None
    finished_at: str | None = None
    status: str = "queued"
    rows: int | None = None
    error: str | None = None

    def elapsed(self) -> float:
        if not self.started_at:
            return 0.0
        end = datetime.fromisoformat(self.finished_at) if self.finished_at else datetime.now(UTC)
        return (end - datetime.fromisoformat(self.started_at)).total_seconds()


class Jobs:
    """Runs functions that return DataFrames; each result is a Parquet table below the root. Jobs carry a tag, so they can be stopped."""

    def __init__(self, spark: SparkSession, root: str, workers: int = 1):
        if not 1 <= workers <= 4:
            raise ValueError("1 to 4 workers")
        self.spark, self.root = spark, root.rstrip("/")
        self._pool, self._lock = ThreadPoolExecutor(workers), threading.Lock()
        self._jobs: dict[str, Job] = {}

    def submit(self, kind: str, make: Callable[[], DataFrame]) -> Job:
        job_id = uuid.uuid4().hex[:12]
        job = Job(job_id, kind, f"{self.root}/{job_id}")
        with self._lock:
            self._jobs[job_id] = job
        self._pool.submit(self._run, job, make)
        return job

    def _run(self, job: Job, make: Callable[[], DataFrame]) -> None:
        job.started_at, job.status = now(), "running"
        try:
            self.spark.addTag(job.job_id)
            make().write.mode("overwrite").parquet(job.output)
            job.rows = self.spark.read.parquet(job.output).count()
            job.status = "completed"
        except Exception as e:  # a job's failure is its result
            job.error, job.status = f"{type(e).__name__}: {e}"[:2000], "failed"
        finally:
            self.spark.removeTag(job.job_id)
            job.finished_at = now()

    def status(self, job_id: str) -> Job:
        with self._lock:
            return self._jobs[job_id]

    def newest(self, n: int = 20) -> list[Job]:
        if not 1 <= n <= 100:
            raise ValueError("1 to 100 jobs")
        with self._lock:
            return sorted(self._jobs.values(), key=lambda j: j.created_at, reverse=True)[:n]

    def page(self, job_id: str, order: list[str], offset: int = 0, limit: int = 100) -> tuple[list[dict], bool]:
        """(rows from ``offset`` on, is there more?)"""
        if not 1 <= limit <= 1000 or offset < 0:
            raise ValueError("a page has 1 to 1000 rows and begins at 0 or later")
        job = self.status(job_id)
        if job.status != "completed":
            raise RuntimeError(f"job {job_id} is {job.status}")
        rows = self.spark.read.parquet(job.output).orderBy(*order).offset(offset).limit(limit + 1).collect()
        return [r.asDict(True) for r in rows[:limit]], len(rows) > limit

    def stop(self, job_id: str) -> None:
        self.spark.interruptTag(job_id)

    def clean_up(self, job_id: str, confirm: bool = False) -> None:
        job = self.status(job_id)
        if not confirm or not within(job.output, self.root):
            raise ValueError("cleaning up takes confirm=True and a job below the root")
        delete(self.spark, job.output)
        with self._lock:
            del self._jobs[job_id]

    def close(self) -> None:
        self._pool.shutdown(wait=True)
