"""python -m glyphstream show-config | doctor | evaluate REFERENCE PREDICTED | run FOLDER OUTPUT --detector M:F --recognizer M:F | query QUERY DATA OUTPUT"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .config import Config
from .session import get_session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="glyphstream", description=__doc__)
    s = p.add_subparsers(dest="command", required=True)
    s.add_parser("show-config").add_argument("--config")
    s.add_parser("doctor")
    e = s.add_parser("evaluate")
    e.add_argument("reference")
    e.add_argument("predicted")
    q = s.add_parser("query", help="a registered query over a folder of tables")
    for name in ("query", "data", "output"):
        q.add_argument(name)
    r = s.add_parser("run", help="text events of a folder of streams")
    for name in ("folder", "output"):
        r.add_argument(name)
    for name in ("detector", "recognizer"):
        r.add_argument(f"--{name}", required=True, help="module:function")
    r.add_argument("--config")
    for name, kind in (("start-sec", float), ("end-sec", float), ("chunk-sec", float), ("overlap-sec", float), ("sample-fps", float), ("max-width", int), ("short-sec", float), ("decoder", str), ("probe", str)):
        r.add_argument(f"--{name}", type=kind)
    r.add_argument("--exclude", action="append", default=[], help="left,top,right,bottom as shares of the frame")
    a = p.parse_args(args)
    if a.command == "show-config":
        print(json.dumps(Config.load(a.config).to_dict(), indent=2))
    elif a.command == "doctor":
        import pyspark

        print(json.dumps({"pyspark": pyspark.__version__, "rows": get_session().range(3).count()}))
    elif a.command == "evaluate":
        print(json.dumps(evaluate_files(a.reference, a.predicted)))
    elif a.command == "run":
        from . import runs
        from .sources.frames import function_named

        given = {k: v for k in ("start_sec", "end_sec", "chunk_sec", "overlap_sec", "sample_fps", "max_width", "short_sec", "decoder", "probe") if (v := getattr(a, k)) is not None}
        options = runs.Options(**given, regions=tuple(tuple(map(float, x.split(","))) for x in a.exclude))
        made = runs.run_folder(get_session(), a.folder, a.output, function_named(a.detector), function_named(a.recognizer), Config.load(a.config), options)
        print(json.dumps({k: v for k, v in made.to_dict().items() if k != "profile"}))
    else:
        from . import catalog

        catalog.queries()[a.query](get_session(), a.data).write.mode("overwrite").parquet(a.output)
    return 0


def evaluate_files(reference: str, predicted: str) -> dict:
    """The report of two files of JSON lines."""
    from .operators import evaluate
    from .sources.events_json import read_events

    spark = get_session()

    def events(path: str):
        d = read_events(spark, path).withColumn("video_id", F.lit(0)).withColumnRenamed("end", "stop").withColumn("text", F.col("text_normalized"))
        box = lambda h: F.struct(h["t"].alias("t"), *[f(F.transform(h["polygon"], lambda p: p[c])).alias(n) for n, f, c in (("l", F.array_min, "x"), ("t0", F.array_min, "y"), ("r", F.array_max, "x"), ("b0", F.array_max, "y"))])  # noqa: B023, E731
        return d.select("video_id", "event_id", "start", "stop", "text", F.transform("polygon_history", box).alias("history"))

    a, b = events(reference), events(predicted)
    pairs = evaluate.candidate_pairs(a, b)
    row = evaluate.report(a, b, pairs).first()
    return {k: v for k, v in row.asDict().items() if k != "video_id"} if row else dict.fromkeys(evaluate.REPORT, 0)


if __name__ == "__main__":
    raise SystemExit(main())
