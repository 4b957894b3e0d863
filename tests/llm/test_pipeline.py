import random
import re

import numpy as np
from test_search import brute_components

import corpus_pipeline as P
from glyphstream.llm import decontam, pii, toxicity
from glyphstream.llm.common import WORD

DATA = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [f.__name__ for _, f in P.STAGES] == ["drop_toxic", "drop_near_duplicates", "drop_leaks", "redact", "mix"]
    d = docs
    for _, stage in P.STAGES[:-1]:
        d = stage(spark, d, DATA)
        assert d.columns == docs.columns
    assert P.run(spark, DATA).count() > 0


def test_run_equals_its_rules(spark):
    """Each stage's decision, taken again one by one outside Spark from what it was given."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    g = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), labels.select("doc_id", "toxic"))
    score = lambda t: float(toxicity.probability(np.array([toxicity.features(t, g)]), g.coefficients)[0])
    left = {r.doc_id: r for r in docs if score(r.text) < 0.5}
    roots = brute_components([(i, r.text) for i, r in left.items()])
    left = {i: r for i, r in left.items() if roots[i][1] == i}
    items = [decontam.normal(r.text.encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    block = decontam.Items(list(enumerate(items)), decontam.MAX_EDITS)
    left = {i: r for i, r in left.items() if not block.find([(r.text or "").encode()])}
    sizes = {}
    for i, r in left.items():
        text = pii.replace(r.text, pii.find([r.text])[1][0])
        sizes[i] = len(re.findall(WORD, text))
    got = {r.doc_id: r.size for r in P.run(spark, DATA).collect()}
    assert got == sizes


def test_stages_with_odd_tables(spark, tmp_path):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(30)), "en", rng.choice(["a", "b", None]), 1) for i in range(40)]
    rows = clean + [(50, None, None, None, None), (51, "", "en", "a", 0), (None, "alone here", "en", "a", 1), (52, clean[0][1], "en", "b", 1), (52, clean[0][1], "en", "b", 1), (53, "write to x@y.example", "en", "b", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
    spark.createDataFrame([(*r, 0.5, "z") for r in rows], kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(["leak"] * 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([*range(40), 50, 51, None, 53], key=str)
    empty = spark.createDataFrame([], kind)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    redacted = {r.doc_id: r for r in P.redact(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()}
    assert (redacted[53].text, redacted[53].n_chars, redacted[50].text) == ("write to [EMAIL]", 16, None)
