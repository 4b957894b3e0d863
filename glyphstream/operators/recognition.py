"""Recognition tasks: cache, batches, fallback choice and the check of results, with pluggable detectors and recognizers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import numbered
from .ordered import scan


def with_cache(tasks: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks with what the cache holds for their signature (text, confidence), and whether it does. The cache has one row per key."""
    return tasks.join(cache.withColumn("cached", F.lit(True)), keys, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def latest_entries(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: a later write replaces an earlier one."""
    rest = [c for c in results.columns if c not in (*keys, order)]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def representatives(tasks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first task of each signature: the only ones that need a recognizer."""
    return tasks.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def needs_fallback(score: Column, candidates: Column) -> Column:
    return (score < 0.82) & (candidates > 1)


def deferred(forced: Column, stable: Column, typewriter: Column) -> Column:
    """Is a text still being typed, so that recognition waits?"""
    return ~forced & (stable < 2) & (typewriter >= 0.60)


def best_result(results: DataFrame, keys: list[str], score: str, text: str, order: str) -> DataFrame:
    """The best-scored text per task (the first of equals), its other texts that are not empty in order, and the recognition level."""
    entry = F.struct(F.col(order).alias("o"), F.col(text).alias("text"))
    g = results.groupBy(*keys).agg(F.max_by(F.struct(F.col(text).alias("text"), F.col(score).alias("score")), F.struct(F.col(score), -F.col(order))).alias("_b"), F.array_sort(F.collect_list(entry)).alias("_all"))
    others = F.array_distinct(F.filter(F.transform("_all", lambda x: x["text"]), lambda t: (t != "") & (t != F.col("_b.text"))))
    return g.select(*keys, F.col("_b.text").alias("text"), F.col("_b.score").alias("score"), others.alias("alternatives")).withColumn("level", F.when(F.size("alternatives") > 0, 2).otherwise(1))


def batch_ids(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """First-in, first-out batches of up to ``size`` tasks."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))


@dataclass
class Queue:
    """Tasks that wait to be read together: due once there are enough of them, or the oldest has waited long enough."""

    items: list[tuple[float, int]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.items)

    def push(self, t: float, task: int) -> None:
        self.items.append((t, task))

    def due(self, t: float, size: int, wait: float) -> bool:
        return len(self.items) >= size or bool(self.items) and t - self.items[0][0] >= wait

    def pop(self, size: int) -> list[int]:
        taken, self.items = self.items[:size], self.items[size:]
        return [task for _, task in taken]


def queued_batches(tasks: DataFrame, key: str, time: str, task: str, size: int, wait: float) -> DataFrame:
    """(key, task, batch): tasks in order of (time, task) go through a Queue that is looked at after each of them, and emptied at the end."""
    kinds = {f.name: f.dataType.simpleString() for f in tasks.schema}

    def step(b: pa.RecordBatch, state, ends: bool):
        queue, batch = state or (Queue(), 0)
        out: list[tuple[int, int]] = []
        for t, k in zip(b.column(time).to_pylist(), b.column(task).to_pylist()):
            queue.push(t, k)
            while queue.due(t, size, wait):
                out += [(x, batch) for x in queue.pop(size)]
                batch += 1
        while ends and len(queue):
            out += [(x, batch) for x in queue.pop(size)]
            batch += 1
        ids, batches = zip(*out) if out else ((), ())
        whose = pa.array([b.column(key)[0].as_py()] * len(out), b.schema.field(key).type)
        return pa.RecordBatch.from_arrays([whose, pa.array(ids, b.schema.field(task).type), pa.array(batches, pa.int64())], names=[key, task, "batch"]), (queue, batch)

    return scan(tasks.select(key, time, task), [key], [time, task], step, f"{key} {kinds[key]}, {task} {kinds[task]}, batch long")


def assembled(contents: DataFrame, geometry: DataFrame, results: DataFrame, stream: str = "video_id") -> DataFrame:
    """Contents (stream, content_id, geometry_id, start) with their geometry's history and their result's text, those without a text left out: the last
    point of the history (null where there is none) and event_id, numbered within the stream by when a content was first seen."""
    j = contents.join(geometry.select("geometry_id", "history"), "geometry_id", "left").join(results.select("content_id", "text"), "content_id", "left")
    j = j.where(F.trim("text") != "").withColumn("last", F.try_element_at("history", F.lit(-1)))
    return numbered(j, [stream], ["start", "content_id"])


def unmatched_results(tasks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has."""
    a, b = tasks.select(key).distinct().withColumn("asked", F.lit(True)), results.select(key).distinct().withColumn("answered", F.lit(True))
    return a.join(b, key, "full").where("asked IS NULL OR answered IS NULL").select(key, F.col("asked").isNotNull().alias("asked"), F.col("answered").isNotNull().alias("answered"))


def checked_results(tasks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The results, if each task has one and there are no others; else an error when they are read."""
    a, b = tasks.select(key, F.lit(True).alias("_a")), results.withColumn("_b", F.lit(True))
    j = a.join(b, key, "full")
    return j.where(F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("recognizer results do not match the tasks")).cast("boolean")).otherwise(F.lit(True))).drop("_a", "_b")


# ---------------------------------------------------------------- pluggable models


def detect(frames: DataFrame, detector: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of frames and their request in, any number of observations out, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield detector(pdf)

    return frames.mapInPandas(run, schema)


def recognize(tasks: DataFrame, recognizer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The same for tasks; a recognizer answers a whole batch at once."""
    return detect(tasks, recognizer, schema)


def null_detector(frames: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"video_id": pd.Series(dtype="int64"), "frame_id": pd.Series(dtype="int64"), "confidence": pd.Series(dtype="float64")})


def null_recognizer(tasks: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"task_id": tasks["task_id"], "text": "", "confidence": 0.0})
