import random
import time

import pytest
from pyspark.sql import functions as F

import test_operators as plain

from glyphstream.operators import chunks
from glyphstream.plans import events
from glyphstream.sources.adapters import intervals

DATA = "/root/testdata/sf0.001"


def test_chunk_merge_full_takes_every_line(spark):
    i = intervals(spark, DATA)
    seen = i.count() + i.where((F.col("order_id") * 10 + F.col("line")) % 3 == 0).count()
    assert events.chunk_merge_full(spark, DATA).agg(F.sum("n")).first()[0] == seen


KIND = plain.EVENT + f", history array<{plain.POINT}>, frames array<bigint>, alternatives array<string>, cached boolean, level int, hint string"


@pytest.mark.parametrize("rows_of_a_batch", [1, 7, 10_000])
def test_fold_over_batches_equals_plain_fold(spark, rows_of_a_batch):
    """Open rows and their points outlive their batch; rows of one start are numbered together."""
    rng = random.Random(rows_of_a_batch)
    rows = []
    for i in range(240):
        t = float(rng.randint(0, 160))
        box = (10.0 + 30 * rng.randint(0, 2), 10.0, 90.0 + rng.randint(0, 9), 30.0)
        rows.append((1, int(t // 40) + rng.randint(0, 1), i, t, t + rng.choice([0.0, 2.0, 30.0]), rng.choice(["alpha beta gamma", "alpha bet", "alpha betx gammb", "delta", " ", ""]), round(rng.random(), 2), *box, [(t, *box), (t + rng.randint(0, 3), *box)], [i % 9, i % 7], [f"a{i % 5}", f"a{i % 3}"], i % 4 == 0, i % 3, f"hint{i}"))
    names = [c.split()[0] for c in (plain.EVENT + ", history, frames, alternatives, cached, level, hint").split(", ")]
    merged = plain.plain_merge([dict(zip(names, r)) for r in rows])
    merged.sort(key=lambda m: (m["start"], m["stop"], m["chunk"], m["event_id"]))
    look = lambda m, k: (k, *(m[c] for c in names if c not in ("event_id", "history")), [tuple(p) for p in m["history"]], m["n"])
    want = [look(m, k) for k, m in enumerate(merged, 1)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_of_a_batch)
    try:
        got = [look(r.asDict(), r.event_id) for r in chunks.merge_chunk_events(spark.createDataFrame(rows, KIND)).orderBy("event_id").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == want


def test_an_event_joins_a_long_row_at_its_own_cost(spark):
    """12,000 events of one row: lists that are built anew for each took minutes."""
    e = spark.range(12_000).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") % 2).cast("int").alias("chunk"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("start"), (F.col("id") + 2).cast("double").alias("stop"), F.lit("text").alias("text"), F.lit(0.5).alias("confidence"), F.lit(0.0).alias("l"), F.lit(0.0).alias("t0"), F.lit(9.0).alias("r"), F.lit(9.0).alias("b0"), F.array("id").alias("frames"))
    box = [F.lit(0.0).alias(c) for c in ("l", "t0", "r", "b0")]
    e = e.select("*", F.array(F.struct(F.col("start").alias("t"), *box), F.struct(F.col("stop").alias("t"), *box)).alias("history")).withColumn("chunk", F.when(F.col("event_id") == 0, 0).otherwise(1))
    began = time.perf_counter()
    rows = chunks.merge_chunk_events(e).select("n", F.size("history").alias("points"), F.size("frames").alias("frames")).collect()
    assert [tuple(r) for r in rows] == [(12_000, 12_002, 12_000)] and time.perf_counter() - began < 20


def test_texts_of_pairs_are_compared_once(spark):
    """The edit distance stood in the join's condition once for each place that names it. Texts that begin alike pair whatever their length."""
    rng = random.Random(11)
    rows = [(1, rng.randint(0, 4), i, t, t + rng.uniform(0, 9), rng.choice(["a", "ab", "abc", "abd", "order 1234567", "order 1234568x", "order 123", "o" * 25, "o" * 23 + "xx", " "]), 0.5, l, 10.0, l + 60.0, 30.0) for i in range(300) for t in [rng.uniform(0, 200)] for l in [10.0 * rng.randint(0, 9)]]
    names = [c.split()[0] for c in plain.EVENT.split(", ")]
    dicts = [dict(zip(names, r)) for r in rows]
    pairs = chunks.chunk_pairs(spark.createDataFrame(rows, plain.EVENT))
    assert pairs._jdf.queryExecution().executedPlan().toString().lower().count("levenshtein(") == 1
    want = sorted((a["event_id"], b["event_id"]) for a in dicts for b in dicts if a["chunk"] < b["chunk"] and chunks.one_event(a, b))
    assert sorted(map(tuple, pairs.select("left_id", "right_id").collect())) == want
