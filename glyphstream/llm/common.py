"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, release, stored, use_checkpoint_dir  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chunks(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together (a longer text stands alone)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of an Arrow string column without making Python strings."""
    return column.cast(pa.large_binary()).to_pylist()


# ---------------------------------------------------------------- word hashes

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUE[_SPACE] = 0
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]  # A-Z count as a-z
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.full(max(n, 2 * len(_powers), 256), _STEP, dtype=np.uint64)
        _powers[0] = 1
        _powers = np.multiply.accumulate(_powers)
    return _powers


def word_table(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts: (64-bit hash of the word, lower-cased if ``fold``, start, end within the joined bytes, number of words before
    each text). A word is a maximal run of bytes other than ASCII white space; it never crosses texts, which are joined by one space."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    word = ~_SPACE[joined]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(start, begins)
    if not len(start):
        return np.empty(0, np.uint64), start, end, first
    value = (_FOLDED if fold else _VALUE)[joined]
    # place within the word, for the bytes from each start to the next
    span = np.diff(start, append=len(joined))
    place = np.arange(start[0], len(joined)) - np.repeat(start, span)
    longest = int((end - start).max())
    np.minimum(place, longest, out=place)  # white space after a word has value 0
    value = value[start[0] :] * _power(longest + 1)[place]
    return mix64(np.add.reduceat(value, start - start[0]) + (end - start).astype(np.uint64)), start, end, first


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * np.uint64(0x9FB21C651E98DF25) + (right ^ np.uint64(0xA0761D6478BD642F)))


# ---------------------------------------------------------------- narrowing before a shuffle

SLICE_BITS = 20
MOST_BITS = 1 << 29  # 64 MB


def may_occur(column: Column, ids: DataFrame, bits_each: int = 16) -> Column:
    """True for all values that occur in the only column of ``ids``, and for few others (one in 16, while there are at most 32 million
    ids). A bitmap of hashes of at most 64 MB is broadcast, whatever the number of ids; it is put together in slices of 128 KB."""
    name = ids.columns[0]
    bits = min(MOST_BITS, 1 << max(SLICE_BITS, (bits_each * ids.count() - 1).bit_length()))
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))

    def build(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy()
            for s in np.unique(at >> SLICE_BITS).tolist():
                inside = at[(at >> SLICE_BITS) == s] & ((1 << SLICE_BITS) - 1)
                made.setdefault(s, np.zeros(1 << SLICE_BITS, dtype=bool))[inside] = True
        for s, flags in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(flags).tobytes()])], names=["slice", "flags"])

    positions = ids.select(place(F.col(name)).alias("at"))
    slices = positions.repartition(F.shiftright("at", SLICE_BITS)).mapInArrow(build, "slice long, flags binary").collect()
    flags = np.zeros(bits // 8, dtype=np.uint8)
    for r in slices:
        flags[r["slice"] << (SLICE_BITS - 3) : (r["slice"] + 1) << (SLICE_BITS - 3)] = np.frombuffer(r["flags"], dtype=np.uint8)
    shipped = ids.sparkSession.sparkContext.broadcast(flags)

    @F.pandas_udf("boolean")
    def flagged(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((shipped.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return flagged(place(column))


def narrowed(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` that an exact join with ``ids`` may need, so that it shuffles few others."""
    return df.where(may_occur(df[column], ids))


# ---------------------------------------------------------------- runs of like keys


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from record batches that are sorted by them. What is held is one run, and the
    batch that ends it; callers bound their runs."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(b.num_rows, dtype=bool)
        for k in ks:
            cut[1:] |= k[1:] != k[:-1]
        begins = np.concatenate(([0], np.flatnonzero(cut), [b.num_rows]))
        for a, z in zip(begins[:-1], begins[1:]):
            now = tuple(k[a] for k in ks)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def in_runs(df: DataFrame, keys: list[str], function, schema: str, after=None) -> DataFrame:
    """Applies a function of a table to each run of like keys, without a Python call per group for its plumbing. The function
    returns a RecordBatch or None; ``after``, if given, turns a task's batches into others."""

    def each(batches):
        for t in runs(batches, keys):
            out = function(t)
            if out is not None and out.num_rows:
                yield out

    def run(batches):
        yield from each(batches) if after is None else after(each(batches))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
