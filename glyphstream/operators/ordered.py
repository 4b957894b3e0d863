"""Scans in order with a state carried along each key, in Arrow batches: memory does not grow with a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: (rows of one key, state or None at its begin, end of the key's rows?) -> (rows out or None, state)
Step = Callable[[pa.RecordBatch, object, bool], tuple[pa.RecordBatch | None, object]]


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
    """Slices of sorted batches with one key each: (slice, does the key begin, does it end)."""
    held, held_key, fresh = None, None, True
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(b.num_rows, dtype=bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(cut).tolist(), b.num_rows]
        for a, z in zip(edges[:-1], edges[1:]):
            key = tuple(c[a] for c in columns)
            if held is not None:
                yield held, fresh, key != held_key
                fresh = key != held_key
            held, held_key = b.slice(a, z - a), key
    if held is not None:
        yield held, fresh, True


def scan(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """Applies ``step`` to the rows of each key in order. Each key is read by one task, as a stream's order demands."""

    def run(batches):
        state = None
        for part, begins, ends in pieces(batches, keys):
            out, state = step(part, None if begins else state, ends)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
