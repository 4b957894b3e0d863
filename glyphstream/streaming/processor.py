"""The tracker as a Structured Streaming operator: the same step function, with the stream's state kept by Spark."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracker import COLUMNS, EVENT_SCHEMA, Settings, Stream, events_batch, feed

STATE_SCHEMA = "state binary"


def tracked_stream(observations: DataFrame, settings: Settings | None = None, idle_ms: int = 0) -> DataFrame:
    """Text events as they end, from a streaming table of observations (COLUMNS, and ``ends``: true on a row that closes its stream and
    is not otherwise read; its numbers must not be null, as pandas would turn the integers of its batch into floats).

    With ``idle_ms`` a stream that stays silent so long is closed too. Rows of a frame may arrive in different micro-batches, frames
    in order; use ``withWatermark`` and a sort upstream where they do not."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        stream, pending = pickle.loads(group.get[0]) if group.exists else (Stream(settings or Settings()), [])
        if group.hasTimedOut:
            done, _ = feed(stream, [], pending, True)
            group.remove()
            yield events_batch(key[0], done + stream.end()).to_pandas()
            return
        rows = pd.concat(list(batches)).sort_values(["frame_id", "l", "t0", "r", "b0"], na_position="last")
        ends = bool(rows["ends"].any())
        rows = rows[~rows["ends"].astype(bool)]
        done, pending = feed(stream, rows[COLUMNS].to_dict("records"), pending, ends)
        if ends:
            done += stream.end()
            group.remove()
        else:
            group.update((pickle.dumps((stream, pending)),))
            if idle_ms:
                group.setTimeoutDuration(idle_ms)
        yield events_batch(key[0], done).to_pandas()

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return observations.groupBy("video_id").applyInPandasWithState(run, EVENT_SCHEMA, STATE_SCHEMA, "append", timeout)


def windowed_counts(observations: DataFrame, width: str = "1 minute", late: str = "2 minutes", time: str = "ts") -> DataFrame:
    """Observations per stream and tumbling window; later rows than the watermark allows are dropped."""
    return observations.withWatermark(time, late).groupBy(F.window(time, width), "video_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
