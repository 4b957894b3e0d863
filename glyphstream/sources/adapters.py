"""Tables of the event model read from the star-schema tables, with the DuckDB text that states each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes seen in the frames of each stream: one event is one observation, a user is a stream.

    video_id, event_id, frame_id (from 0 by time), t (seconds from the stream's start), content, tier, confidence and the box l, t0, r, b0
    on a canvas of 640 x 360."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    # windows by the name that the rows keep, so that a reader's own windows by stream need no second shuffle
    per_video = Window.partitionBy("video_id")
    e = e.select(F.col("user_id").alias("video_id"), "event_id", "event_type", "value", us.alias("us"), k.alias("k"))
    x, y = F.col("event_id") * 37 % 560, F.col("k") * 7 % 320
    return e.select(
        "video_id",
        "event_id",
        (F.row_number().over(per_video.orderBy("us", "event_id")) - 1).cast("long").alias("frame_id"),
        ((F.col("us") - F.min("us").over(per_video)) / 1e6).alias("t"),
        F.col("event_type").alias("content"),
        (F.col("event_id") % 3).cast("int").alias("tier"),
        F.least(F.lit(1.0), F.lit(0.2) + F.col("value") / 500).alias("confidence"),
        x.cast("double").alias("l"),
        y.cast("double").alias("t0"),
        (x + 40 + F.col("event_id") % 60).cast("double").alias("r"),
        (y + 20 + F.col("k") % 20).cast("double").alias("b0"),
        "k",
        "value",
    )


OBS_SQL = """obs AS (
  SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS frame_id,
    (us - min(us) OVER (PARTITION BY user_id)) / 1e6 AS t, event_type AS content, (event_id % 3)::INT AS tier,
    least(1.0::DOUBLE, 0.2::DOUBLE + value / 500) AS confidence, (event_id * 37 % 560)::DOUBLE AS l, (k * 7 % 320)::DOUBLE AS t0,
    (event_id * 37 % 560 + 40 + event_id % 60)::DOUBLE AS r, (k * 7 % 320 + 20 + k % 20)::DOUBLE AS b0, k, value
  FROM (SELECT *, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
)"""

#: observations of one frame: 8 boxes that are neighbours in a stream
FRAME = 8


def frames_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in groups of up to FRAME as if each group were one frame."""
    return observations(spark, sf_dir).withColumn("frame", F.floor(F.col("frame_id") / FRAME).cast("long"))


FRAMES_SQL = OBS_SQL + f", framed AS (SELECT *, frame_id // {FRAME} AS frame FROM obs)"


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the difference bits of each embedding as one lane of 63 bits."""
    from ..functions.signature import difference_lane

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", difference_lane(F.col("embedding")).alias("sig"))


SIG_SQL = """sigs AS (
  SELECT vec_id, label, list_reduce(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 1::BIGINT << (63 - i)::INT ELSE 0::BIGINT END),
    lambda a, b: a + b) AS sig FROM embeddings
)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as intervals, in days: order_id, line, start (order date), stop (ship date, not before it)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    # by order alone, which both the lines of an order and its date need
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_shipdate").alias("l_shipdate"), F.max("l_quantity").alias("l_quantity"))
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01")).cast("double")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("source_id"), day("o_orderdate").alias("start"), F.greatest(day("o_orderdate"), day("l_shipdate")).alias("stop"), F.col("l_quantity").alias("weight")
    )


INTERVALS_SQL = """intervals AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS source_id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS start,
    greatest(date_diff('day', DATE '1970-01-01', o_orderdate::DATE), date_diff('day', DATE '1970-01-01', l_shipdate::DATE))::DOUBLE AS stop, l_quantity AS weight
  FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, max(l_shipdate) AS l_shipdate, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey
)"""
