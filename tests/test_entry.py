import __spark_entry__ as entry
from glyphstream import catalog


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_all_queries_are_registered():
    assert catalog.queries().keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_late_rows_are_dropped(spark, tmp_path):
    import time

    from glyphstream.streaming.processor import windowed_counts

    kind = "ts timestamp, video_id long, confidence double"
    rows = [["2024-01-01 00:00:10", "2024-01-01 00:00:50", "2024-01-01 00:10:00"], ["2024-01-01 00:10:30"], ["2024-01-01 00:00:20"], ["2024-01-01 00:30:00"]]
    for i, part in enumerate(rows):
        d = spark.createDataFrame([(t, 1, 0.5) for t in part], "t string, video_id long, confidence double").selectExpr("cast(t AS timestamp) AS ts", "video_id", "confidence")
        d.coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
        time.sleep(1.1)
    src = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = windowed_counts(src).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.window.start.isoformat()[11:16]: r.n for r in spark.table("windows").collect()}
    assert got["00:00"] == 2 and got["00:10"] == 2  # the row of 00:00:20 came after the watermark
