"""Content segments and running signals of ordered streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import scan


def over(key, order):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([order] if isinstance(order, str) else order))


def islands(df: DataFrame, changed: Column, key, order, name: str = "island") -> DataFrame:
    """Numbers runs from 1: a row at which ``changed`` holds, or a stream's first, begins one."""
    w = over(key, order)
    begins = F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(changed, F.lit(False)).cast("int"))
    return df.withColumn("_begins", begins).withColumn(name, F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_begins")


def by_signature(df: DataFrame, sig: str, key, order, threshold: float = 0.16) -> DataFrame:
    """Islands of looks: a distance to the previous signature at the threshold or above begins one, so slow drift does not."""
    from ..functions.signature import lane_distance

    before = F.lag(sig).over(over(key, order))
    return islands(df, before.isNotNull() & (lane_distance(F.col(sig), before) >= threshold), key, order)


def typewriter(changes: Column) -> Column:
    """Score after so many changes: s' = min(1, 0.7 s + 0.3) in closed form."""
    return 1.0 - F.pow(F.lit(0.7), changes)


def ready_at(df: DataFrame, key: list[str], t: str, order, stable: int = 2, stable_wait: float = 0.45, longest_wait: float = 1.8) -> DataFrame:
    """When each island may be recognised: at its stable-th sighting, or the waits after its first."""
    w = over(key, order)
    d = df.withColumn("_seen", F.row_number().over(w)).withColumn("_since", F.col(t) - F.first(t).over(w))
    ready = (F.col("_seen") >= stable) | (F.col("_since") >= min(stable_wait, longest_wait))
    return d.groupBy(*key).agg(F.min(F.when(ready, F.col(t))).alias("ready_at"), F.count(F.lit(1)).alias("stable_observations"))


def smoothed(df: DataFrame, key: str, order: list[str], value: str, keep: float = 0.85) -> DataFrame:
    """Every stream's exponential average, from 0, and the number of its values."""

    def step(b: pa.RecordBatch, state, ends: bool):
        s, n = state or (0.0, 0)
        for x in b.column(value).to_pylist():
            if x is not None:
                s, n = keep * s + (1 - keep) * x, n + 1
        out = pa.RecordBatch.from_arrays([b.column(key).slice(0, 1), pa.array([s]), pa.array([n])], names=[key, "smoothed", "n"]) if ends else None
        return out, (s, n)

    return scan(df.select(key, *order, value), [key], order, step, f"{key} {df.schema[key].dataType.simpleString()}, smoothed double, n long")


def sessions_by_misses(df: DataFrame, key: list[str], index: str, most: int = 6) -> DataFrame:
    """A track ends with its (most + 1)-th miss in a row, counted in request indexes; a later sighting begins another."""
    w = over(key, index)
    missed = F.col(index) - F.lag(index).over(w) - 1
    return islands(df.withColumn("missed", F.coalesce(missed, F.lit(0)).cast("long")), F.col("missed") > most, key, index, "track")


def heartbeat(df: DataFrame, key: str, order, requested: Column, t: str = "t") -> DataFrame:
    """last_seen of what a request frame saw: the last idle frame before the next request."""
    w = over(key, order)
    d = df.withColumn("request", F.sum(requested.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return d.where(F.col("request") > 0).groupBy(key, "request").agg(F.min(t).alias("seen_at"), F.max(t).alias("last_seen"), (F.count(F.lit(1)) - 1).alias("idle_frames"))


def changes_only(df: DataFrame, key: str, order, columns: list[str]) -> DataFrame:
    """Rows that differ from the one before in any of the columns."""
    w = over(key, order)
    now = F.struct(*columns)
    before = F.lag(now).over(w)
    return df.withColumn("_before", before).where(F.col("_before").isNull() | ~now.eqNullSafe(F.col("_before"))).drop("_before")


def built_events(df: DataFrame, key: list[str], t: str = "t", id_column: str = "frame_id", confidence: str = "confidence") -> DataFrame:
    """One event per segment: start, stop, frames in order, best confidence."""
    return df.groupBy(*key).agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count(F.lit(1)).alias("n"), F.max(confidence).alias("confidence"), F.min(id_column).alias("first_frame"), F.max(id_column).alias("last_frame"))
