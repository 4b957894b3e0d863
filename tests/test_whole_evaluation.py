import random

from pyspark.sql import functions as F

from glyphstream.operators import evaluate
from glyphstream.plans import events

DATA = "/root/testdata/sf0.001"
EVENT = "video_id long, event_id long, start double, stop double, text string, history array<struct<t:double,l:double,t0:double,r:double,b0:double>>"


def _events(rng, n, first):
    rows = []
    for i in range(n):
        t, left = rng.uniform(0, 300), 10.0 * rng.randint(0, 6)
        history = [(t + k, left + k, 10.0, left + 60.0, 40.0) for k in range(rng.randint(1, 3))]
        rows.append((rng.randint(1, 3), first + i, t, t + rng.uniform(0, 25), rng.choice(["order 1234", "order 1243", "order 99", "else", "  "]), history))
    return rows


def test_report_of_one_scan_equals_joins_with_the_matches(spark):
    """Scores came from five joins of pairs, matches and texts, which shuffled more than twice what is read."""
    rng = random.Random(12)
    a, b = (spark.createDataFrame(_events(rng, n, first), EVENT) for n, first in ((90, 0), (160, 1000)))
    b = b.where("video_id < 3").unionByName(b.where("video_id = 1").limit(5).withColumn("video_id", F.lit(7).cast("long")))
    pairs = evaluate.candidate_pairs(a, b, bin_sec=16.0)
    matches = evaluate.matched(pairs)
    rows = lambda df: sorted(map(tuple, df.select("video_id", *evaluate.REPORT).collect()))
    got = rows(evaluate.report(a, b, pairs))
    assert got == rows(evaluate.report(a, b, pairs, matches)) and any(r[3] for r in got) and any(r[6] for r in got)
    # duplicates in plain words: never matched, but paired with a matched reference
    m, p = matches.collect(), pairs.collect()
    free = {(r.video_id, r.pred_id) for r in p} - {(r.video_id, r.pred_id) for r in m}
    taken = {(r.video_id, r.ref_id) for r in m}
    twice = {(r.video_id, r.pred_id) for r in p if (r.video_id, r.pred_id) in free and (r.video_id, r.ref_id) in taken}
    counts = {r.video_id: r.predicted_events for r in evaluate.report(a, b, pairs).collect()}
    assert {r[0]: r[6] for r in got} == {v: round(sum(x == v for x, _ in twice) / max(n, 1), 9) for v, n in counts.items()}
    alone = evaluate.report(a, b, pairs.drop("begin", "end"))
    assert rows(alone) == got


def test_pairs_are_made_once(spark):
    """Matching read its pairs twice and so joined them twice."""
    for query in (events.match_events, events.recall_accuracy, events.duplicate_rate):
        assert "levenshtein" not in query(spark, DATA)._jdf.queryExecution().executedPlan().toString().lower()
    r = events._reference(spark, DATA)
    plan = evaluate.candidate_pairs(r, events._predicted(r), bin_sec=16.0)._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("levenshtein(") == 1
