"""Mixing sources to target weights.

Every row gets a hash-random key. Within its source the rows are range-sorted by that key (equal ranges of the key's high
bits, so that a source with most rows is spread over many ranges), word counts are summed per range, a prefix sum over the
ranges gives each range its offset, and a prefix sum inside the range finds the row that the source's budget cuts. Whole
epochs come first; the cut falls within the last one. Only ids, sources and counts are shuffled, never texts.

Cases: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is an ordinary id;
repeated rows each count and are taken each (which of equal rows is cut does not matter); an empty table gives an empty
result; a source of size 0 has target 0. Columns other than doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
RANGE_ROWS = 50_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with target: ``share`` of all sizes, split by weight in the order of the sources,
    none above ``most`` times its size, what is cut off being reshared by weight.

    The table has a row per source. Ranks come from counts below each row's range, so it need not fit one task."""
    spark = sizes.sparkSession
    ranked = durable(_ranked(sizes))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    t = ranked.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    # the common level x, with targets least(x * w, cap): each step settles the sources that the level caps
    goal, level, settled = share * total, 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        n, used, free = t.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if n == settled or not free:
            break
        settled, level = n, (goal - used) / free
    target = F.when(F.lit(free is None or not free), F.col("cap")).otherwise(F.least(F.lit(level) * F.col("w"), F.col("cap")))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds the rank from 0 by source, null last: ranges of the sources are counted, so a task orders one range, and one row a range is put in order."""
    order = [F.col("source").isNull(), F.col("source")]
    s = durable(sizes.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = s.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return s.join(before, "range").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1).drop("range", "before")


def mix_key(doc_id: Column, source: Column, size: Column, seed: int = 0) -> Column:
    """The hash-random key of a row; it depends on its values only, so reruns agree."""
    return F.xxhash64(F.lit(seed), doc_id, source, size)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken (and source) for every row of ``docs``."""
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    d = durable(d.withColumn("key", mix_key(F.col("doc_id"), F.col("source"), F.col("size"), seed)))
    sizes = durable(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    # as many key ranges as keep one source's range below range_rows rows
    most_rows = sizes.agg(F.max("n")).first()[0] or 0
    bits = max(1, (int(most_rows / range_rows)).bit_length() + 1)
    d = d.withColumn("slot", F.shiftrightunsigned("key", 64 - bits))
    per_slot = d.groupBy("source", "slot").agg(F.sum("size").alias("in_slot"))
    over = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_slot.withColumn("offset", F.coalesce(F.sum("in_slot").over(over), F.lit(0)))
        .alias("o")
        .join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
        .select("o.source", "o.slot", "o.offset", "t.source_size", "t.target")
    )
    # unsigned order of the key within a slot: the bits below the slot's
    low = F.col("key").bitwiseAND(F.lit((1 << (64 - bits)) - 1).cast("long"))
    upto = Window.partitionBy("d.source", "d.slot").orderBy(low, "d.doc_id", "d.size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    joined = d.alias("d").join(offsets.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.slot") == F.col("f.slot")))
    before = F.col("offset") + F.coalesce(F.sum("d.size").over(upto), F.lit(0))
    return joined.withColumn("before", before).select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("d.source").alias("source"),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))).cast("long").alias("taken"),
    )
