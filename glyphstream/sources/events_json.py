"""Text events as JSON lines: a permissive reader and a writer."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = (
    "event_id long, geometry_id long, content_id long, start double, end double, text_raw string, text_normalized string, confidence double, "
    "polygon_history string, source_frame_ids array<long>, cached boolean, recognition_level int, alternatives array<string>, type_hint string, _chunk_index int"
)
HISTORY = "array<struct<t:double,polygon:array<struct<x:double,y:double>>>>"


def history_of(text: Column) -> Column:
    """``[[t, [[x, y], ...]], ...]`` as an array of structs."""
    points = F.from_json(text, "array<array<string>>")

    def entry(e: Column) -> Column:
        polygon = F.transform(F.from_json(e[1], "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        return F.struct(e[0].cast("double").alias("t"), polygon.alias("polygon"))

    return F.coalesce(F.transform(points, entry), F.array().cast(HISTORY))


def history_text(history: Column) -> Column:
    return F.transform(history, lambda e: F.concat(F.lit("["), e["t"].cast("string"), F.lit(",["), F.array_join(F.transform(e["polygon"], lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))), ","), F.lit("]]")))


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of JSON lines. start and end are required; a missing text takes the other one; other fields have defaults. Blank lines are skipped."""
    d = spark.read.schema(RAW).json(path)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"an event lacks {c}")).cast("double")).otherwise(F.col(c))
    either = lambda a, b: F.coalesce(F.col(a), F.col(b), F.lit(""))
    defaults = {"event_id": F.lit(0), "geometry_id": F.lit(0), "content_id": F.lit(0), "confidence": F.lit(0.0), "cached": F.lit(False), "recognition_level": F.lit(1)}
    arrays = {"source_frame_ids": "array<bigint>", "alternatives": "array<string>"}
    return d.select(
        need("start").alias("start"), need("end").alias("end"), either("text_raw", "text_normalized").alias("text_raw"), either("text_normalized", "text_raw").alias("text_normalized"),
        *[F.coalesce(F.col(c), v).alias(c) for c, v in defaults.items()], *[F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in arrays.items()],
        history_of(F.col("polygon_history")).alias("polygon_history"), "type_hint", F.col("_chunk_index").alias("chunk"),
    )


def write_events(events: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines in UTF-8; columns whose name begins with _ are left out. One ordered file only where asked for."""
    d = events.drop(*[c for c in events.columns if c.startswith("_")])
    if "polygon_history" in d.columns and d.schema["polygon_history"].dataType.simpleString() == HISTORY:
        body = F.to_json(F.struct(*[c for c in d.columns if c != "polygon_history"]), {"ignoreNullFields": "false"})
        line = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"polygon_history":['), F.array_join(history_text(F.col("polygon_history")), ","), F.lit("]}"))
        order = [c for c in ("start", "end", "event_id") if c in d.columns]
        d = (d.repartition(1).sortWithinPartitions(*order) if single_file else d).select(line.alias("value"))
        d.write.mode("overwrite").text(path)
        return
    (d.repartition(1) if single_file else d).write.mode("overwrite").json(path)


def plain(value: object) -> object:
    """What JSON lacks a form for: a dataclass as its fields, an array or a number of numpy as Python's."""
    if is_dataclass(value) and not isinstance(value, type):
        return asdict(value)
    if hasattr(value, "tolist"):
        return value.tolist()
    raise TypeError(f"no JSON for {type(value).__name__}")


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    """What is known of a run, as indented JSON in one file of any Hadoop file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(conf).create(place, True)
    try:
        out.write(json.dumps(metadata, ensure_ascii=False, indent=2, default=plain).encode())
    finally:
        out.close()


def chunk_parts(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Events of the parts of a chunked run, ids made unique across chunks."""
    from ..operators.chunks import shifted_ids

    parts = [read_events(spark, p).withColumn("chunk", F.lit(k)) for k, p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return shifted_ids(out)
