import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from glyphstream.llm import common, decontam, nearest, neardup
from glyphstream.llm import queries as Q

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, fp string, root int"


# ---------------------------------------------------------------- near duplicates


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(UPPER))
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def same_components(got, want):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op8_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    same_components(Q.op8_near_duplicates(spark, DATA).collect(), brute_components(docs))


def planted(seed=8):
    """Texts with copies, chains of small changes, a large group of copies and a hub that many half-copies link to."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(60)]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            base = [word() if rng.random() < 0.04 else w for w in base]
            texts.append("\n".join(base))
    hub = [word() for _ in range(100)]
    for _ in range(60):
        texts.append(" ".join(word() if rng.random() < 0.05 else w for w in hub))
    texts += [" ".join(hub)] * 50 + ["one", "ONE", "One two", "", " \t", None, "x y " * 30_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_with_small_stars_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "STAR", 7)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    docs = planted()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    want = brute_components(docs)
    same_components(neardup.near_duplicates(d).collect(), want)
    kept = neardup.keep_one(d).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, root) in want.items() if i == root)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (2, "A  B c", "x", 1), (None, "a b c", "x", 1), (3, None, "x", 1), (3, None, "x", 1)]
    d = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (3, 0, 3, True), (3, 0, 3, True)], key=str)
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, None, 3, 3], key=str)
    assert neardup.near_duplicates(d.where("false")).count() == 0


def test_posterior_bounds():
    rng = np.random.default_rng(0)
    for n, least in neardup.least_matches():
        assert 0 < least < n
    a = rng.integers(0, 256, (2000, neardup.K)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < 0.78, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    assert neardup.may_link(a, b).all()
    assert not neardup.may_link(a, np.roll(a, 1, axis=0)).any()


def test_narrowing_loses_nothing(spark):
    d = spark.range(20_000).withColumn("x", F.col("id") * 7)
    ids = spark.range(0, 20_000, 50).select((F.col("id") * 7).alias("x"))
    left = common.narrowed(d, "x", ids)
    assert left.join(ids, "x").count() == 400 and left.count() < 4000
    assert common.narrowed(d, "x", ids.where("false")).count() == 0


# ---------------------------------------------------------------- decontamination


def edits(a, b):
    """Least edits between a and a part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return min(row)


def test_search_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n))) for n in (12, 40))
        want = edits(a, b)
        assert decontam.myers_search(a, b, 3) == (want if want <= 3 else None)


def test_embedding_keeps_near_strings_near():
    rng = random.Random(4)
    s = [bytes(rng.choice(b"abcdefghij ") for _ in range(150)) for _ in range(40)]
    t = [x[:70] + b"q" + x[70:149] for x in s]
    for walk in range(decontam.WALKS):
        e, f = (np.array(list(decontam.cgk(*decontam._padded(x, 300), 300, walk).values())) for x in (s, t))
        assert e.shape == (300, 40) and (e != f).mean() < 0.3 < (e != f[:, ::-1]).mean()


def test_embedding_equals_a_loop():
    text = b"the quick brown fox"
    joined, _ = decontam._padded([text], 130)
    got = decontam.cgk(joined, np.array([4]), 120, 1)
    at = 4
    for t in range(120):
        c = int(joined[at])
        assert got[t][0] == c
        at += int(decontam._advances(1, 120)[t, c])


def test_recall_on_edited_passages(spark):
    items = [(r.item_id, decontam.normal(r.text.encode()).decode()) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    rng = random.Random(5)
    docs, want = [], set()
    for i, (item, text) in enumerate(items):
        most = int(decontam.MAX_EDITS * len(text.encode()))
        if len(text.split()) < 8:
            continue
        chars = list(text)
        for _ in range(rng.randint(0, most)):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        docs.append((i, f"Before it.\n{''.join(chars).upper() if i % 2 else ''.join(chars)}  after it", "x", 1))
        want.add((i, item))
    d = spark.createDataFrame(docs, DOCS)
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = {(i, k) for i, k in want if (i, k) in got}
    ascii_ = {(i, k) for i, k in want if docs[[x[0] for x in docs].index(i)][1].isascii()}
    assert len(found & ascii_) >= 0.9 * len(ascii_)
    texts = dict(items)
    for i, k in got:
        text = decontam.normal(dict((x[0], x[1]) for x in docs)[i].encode())
        assert decontam.myers_search(texts[k].encode(), text, int(decontam.MAX_EDITS * len(texts[k].encode()))) is not None


def test_op7_equals_brute_force_on_exact_and_near_passages(spark):
    docs = [(r.doc_id, decontam.normal((r.text or "").encode())) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, decontam.normal(r.text.encode())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in Q.op7_decontaminate(spark, DATA).collect()}
    assert {(d, i) for d, t in docs for i, x in items if x in t} <= got
    # whatever shares a fifth of an item's words in order is searched in whole
    for d, t in docs:
        words = set(zip(t.split(), t.split()[1:]))
        for i, x in items:
            s = set(zip(x.split(), x.split()[1:]))
            if s and len(s & words) >= 0.2 * len(s):
                assert (decontam.myers_search(x, t, int(decontam.MAX_EDITS * len(x))) is not None) == ((d, i) in got)


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps", "y"), (1, "The quick brown fox jumps", "y"), (2, None, "y"), (3, "", "y"), (4, "solitary", "y")], "item_id long, text string, doc_id string")
    long = "lorem ipsum " * 50_000 + "the QUICK\tbrown fox jumps"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, long, "x", 1), (4, "a solitary word", "x", 1), (4, "a solitary word", "x", 1), (None, "the quick brown fox jumps", "x", 1), (5, "fox jumps the quick", "x", 1)]
    d = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.item_id, r.edits) for r in decontam.find_leaks(d, items).collect()}
    assert got == {(3, 1, 0), (4, 4, 0), (None, 1, 0)}
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(d, items, block_bytes=1).collect()} == {(3, 1), (4, 4), (None, 1)}
    several = decontam.remove_leaks(d, items, block_bytes=1)
    assert several.columns == d.columns and sorted(r.doc_id for r in several.collect()) == [1, 2, 5]
    left = decontam.remove_leaks(d, items)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert decontam.find_leaks(d, items.where("false")).count() == 0 and decontam.find_leaks(d.where("false"), items).count() == 0


# ---------------------------------------------------------------- nearest vectors

VECTORS = "vec_id long, embedding array<float>, rank int, score string"


def exact(rows, ids, n=20):
    kept = {}
    for r in rows:
        v = r[1]
        if r[0] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[r[0]] = min(kept.get(r[0], v), v)
    keys = sorted(kept)
    m = np.array([np.float32(kept[k]) for k in keys], dtype=float)
    out = {}
    for q in ids:
        if q in kept:
            s = nearest.inner(np.broadcast_to(m[keys.index(q)], m.shape), m)
            out[q] = [(k, x) for x, k in sorted((-x, k) for k, x in zip(keys, s) if k != q)[:n]]
    return out


def check(got, want, least):
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, -r.score))
    assert by.keys() == {q for q, w in want.items() if w}
    hits = 0
    for q, w in want.items():
        assert [r[1] for r in by[q]] == sorted(r[1] for r in by[q]) and len(by[q]) == len(w)
        hits += len({k for k, _ in by[q]} & {k for k, _ in w})
    assert hits >= least * sum(map(len, want.values()))


def test_op10_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(Q.op10_nearest_vectors(spark, DATA).collect(), exact(rows, [r[0] for r in rows if r[0] % 20 == 0]), 0.9)


def test_nearest_with_copies_norms_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(400, 12)) * rng.uniform(0.2, 3, (400, 1))
    rows = [(i, [float(np.float32(x)) for x in v], 1, "s") for i, v in enumerate(m)]
    rows += [(1000 + i, rows[0][1], 1, "s") for i in range(80)]  # a group of copies
    rows += [(501, None, 1, "s"), (502, [0.0] * 12, 1, "s"), (503, [float("nan")] * 12, 1, "s"), (504, [1.0, None] * 6, 1, "s"), (505, [float("inf")] * 12, 1, "s"), (None, rows[1][1], 1, "s"), (7, rows[7][1], 1, "s")]
    d = spark.createDataFrame(rows, VECTORS)
    got = nearest.search(d, lambda v: v % 20 == 0, block=16).collect()
    want = exact(rows, range(0, 1100, 20))
    check(got, want, 0.9)
    by = {(r.query_id, r["rank"]): r.vec_id for r in got}
    assert [by[1000, k] for k in range(1, 21)] == [w[0] for w in want[1000]]  # ties by id, exactly
    assert nearest.search(d.where("false"), lambda v: v % 20 == 0).count() == 0
    few = nearest.search(d.where("vec_id < 5"), lambda v: v % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = nearest.rotate(x, 0, 0)
    assert np.allclose(y @ y.T, x @ x.T)
    b = nearest.row_buckets(x, 1, 2)
    assert (nearest.probe_buckets(x, 1, 4, 2)[:, :, 0] == b).all()


def test_bucket_hashes_split_evenly():
    x = np.random.default_rng(1).normal(size=(4000, 16))
    counts = np.bincount(nearest.row_buckets(x / np.linalg.norm(x, axis=1, keepdims=True), 1, 1)[:, 0], minlength=32)
    assert counts.min() > 60 and counts.max() < 220


def test_word_table_is_case_blind():
    a, *_ = common.word_table([b"The cat", b"the CAT  "])
    assert a[0] == a[2] and a[1] == a[3]
    c, *_ = common.word_table([b"The cat", b"the CAT  "], fold=False)
    assert c[0] != c[2]
