import numpy as np

from glyphstream.llm import nearest

VECTORS = "vec_id long, embedding array<float>"


def recall(spark, m, **how):
    """(share of the true neighbours found, fewest rows that a query got)."""
    m = m.astype(np.float32).astype(float)
    d = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], VECTORS)
    got = {}
    for r in nearest.search(d, lambda v: v % 20 == 0, **how).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in range(0, len(m), 20):
        s = m @ m[q]
        s[q] = -np.inf
        want = set(np.argsort(-s, kind="stable")[: min(20, len(m) - 1)].tolist())
        hits, total = hits + len(want & got.get(q, set())), total + len(want)
    return hits / total, min(len(got.get(q, ())) for q in range(0, len(m), 20))


def unit(rng, rows, dim):
    x = rng.normal(size=(rows, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_two_hashes_a_bucket_keep_recall(spark):
    m = unit(np.random.default_rng(3), 2000, 64)  # bucket=1 asks for k = 2
    assert recall(spark, m, bucket=1)[0] >= 0.9


def test_hashes_are_used_where_they_find_enough(spark):
    rng = np.random.default_rng(4)
    m = np.repeat(unit(rng, 80, 64), 25, axis=0) + rng.normal(size=(2000, 64)) * 0.02
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near, of = np.concatenate([m[i * 25 + 1 : i * 25 + 21] for i in range(40)]), np.repeat(np.arange(40), 20)
    assert nearest.choice(m[: 40 * 25 : 25], near, of, 2)[0] == 2
    assert recall(spark, m, bucket=1)[0] >= 0.9


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(5)
    for rows in (15, 25, 60):
        assert recall(spark, unit(rng, rows, 64)) == (1.0, min(20, rows - 1))


def test_queries_that_find_few_rows_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(nearest, "choice", lambda *_: (1, 1))
    assert recall(spark, unit(np.random.default_rng(6), 500, 512)) == (1.0, 20)


def test_each_length_is_searched_apart(spark):
    rng = np.random.default_rng(7)
    a, b = unit(rng, 40, 8), unit(rng, 30, 5)
    rows = [(2 * i, v) for i, v in enumerate(a.tolist())] + [(2 * i + 1, v) for i, v in enumerate(b.tolist())]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: (v % 20 == 0) | (v == 5), n=3).collect()
    for q, m, of in [(q, a, lambda i: 2 * i) for q in (0, 20, 40, 60)] + [(5, b, lambda i: 2 * i + 1)]:
        s = m @ m[q // 2]
        s[q // 2] = -np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [of(int(i)) for i in np.argsort(-s)[:3]]
    assert len(got) == 15
