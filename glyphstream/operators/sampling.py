"""Clock, range and sampling gate of frame streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import scan


def frame_time(time: Column, pts: Column, time_base: Column, emitted: Column, rate: Column) -> Column:
    """Seconds of a frame: its own time, else its time stamp in units of the time base, else its number over the rate (30 if unknown)."""
    return F.coalesce(time, pts * time_base, emitted / F.coalesce(F.nullif(rate, F.lit(0.0)), F.lit(30.0)))


def within(df: DataFrame, start: float | None = None, end: float | None = None, t: str = "t") -> DataFrame:
    """Frames from start to end, both included; a plain filter, so that a scan can prune by it."""
    if start is not None:
        df = df.where(F.col(t) >= start)
    return df if end is None else df.where(F.col(t) <= end)


def sampled(df: DataFrame, interval: float, key: str = "video_id", t: str = "t", tie: str = "frame_id") -> DataFrame:
    """The rows that a gate lets pass: a stream's first, then each that comes an interval (less 1e-9) or more after the last one kept."""

    def step(b: pa.RecordBatch, due, ends: bool):
        ts = b.column(t).to_numpy(zero_copy_only=False)
        kept, i = [], 0 if due is None else int(np.searchsorted(ts + 1e-9, due))
        while i < len(ts):
            kept.append(i)
            due = ts[i] + interval
            i = int(np.searchsorted(ts + 1e-9, due)) if len(ts) > 1 else 1
        return b.take(pa.array(kept, pa.int64())), due

    return scan(df, [key], [t, tie], step, df.schema)  # type: ignore[arg-type]


def numbered(df: DataFrame, offset: int = 0, key: str = "video_id", t: str = "t", tie: str = "frame_id") -> DataFrame:
    """Emitted frames counted from an offset."""
    from pyspark.sql import Window

    return df.withColumn("emitted_id", (F.row_number().over(Window.partitionBy(key).orderBy(t, tie)) - 1 + offset).cast("long"))


def scaled_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size after scaling down to a largest width; the height is rounded half to even and at least 2."""
    scale = F.lit(float(most)) / width
    return F.when(width > most, F.lit(most)).otherwise(width), F.when(width > most, F.greatest(F.lit(2), F.bround(height * scale).cast("int"))).otherwise(height)
