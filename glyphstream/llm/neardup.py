"""Near duplicates by MinHash bands, sequential Bayesian verification and exact confirmation.

A document's set is its distinct 2-word shingles. Documents with equal sets form a class, and all that follows works on
classes. Each class has BANDS bucket keys of ROWS minimum hashes each, and a byte of every minimum hash as its signature. In a
bucket, every member is paired with the member of the smallest fingerprint. A pair's signatures are compared batch by batch; it is
dropped once the posterior probability that its similarity reaches the threshold falls below MISS (a byte matches by chance
with 1/256, which the model allows for). Survivors are confirmed on the full sets.

Such stars leave pairs of two other members untested. So, after connected components are known, the buckets whose other
members still lie in different components are compared in full, in blocks of bounded size, but only across components: every
pair that shares a bucket is then either tested or connected already, and only connected components are asked for. A link of
similarity 0.75 shares no bucket with probability (1 - 0.75^5)^48 = 2e-6, one of 0.85 with 3e-13.

Nothing gathers a bucket in one task: stars with many members are salted, their leader being repeated, and full comparisons are split into
blocks. Of texts, signatures and bucket keys, only those that a join may need are shuffled: a bitmap of bounded size narrows them first.

Cases: null, empty and blank texts have no shingles and link with nothing (component_id = doc_id); a one-word text has one shingle; a row with a null
doc_id takes no part (component_id null, kept); repeated rows share a component and are each kept if their id is the smallest;
rows that share a doc_id and differ in text count as reachable from each other's links only through their texts. An empty table gives an empty
result; columns other than doc_id and text are not read. Equal sets are recognised by a 64-bit fingerprint of the
set, checked by a second one: a collision is reported, not ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_runs, may_occur, mix64, narrowed, pair_hash, release, stored, text_bytes, word_table

THRESHOLD = 75  # per cent
ROWS, BANDS = 5, 48
K = ROWS * BANDS
BATCH = 48  # minimum hashes compared between two looks at the posterior
MISS = 1e-7
STAR, BLOCK = 400, 256  # members of a star's part, and of a block
CHUNK = 1 << 20
ALIKE = "merge"  # both sides grow with the corpus: joined by sorting at every size, never broadcast

_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 1 << 31, K, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint32)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, sorted within each text; number of hashes before each text)."""
    h, _, _, first = word_table(texts)
    n = np.diff(first)
    s = h.copy()
    if len(h) > 1:
        s[:-1] = pair_hash(h[:-1], h[1:])
    last = first[1:][n > 0] - 1
    single = first[:-1][n == 1]
    s[single] = mix64(h[single] ^ np.uint64(0x5851F42D4C957F2D))
    keep = np.ones(len(h), dtype=bool)
    keep[last] = False
    keep[single] = True
    sets, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b > a:
            u = np.unique(s[a:b][keep[a:b]])
            sets.append(u)
            sizes[i] = len(u)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def fingerprints(s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit fingerprints of each set; the sets begin at ``starts`` and none is empty."""
    one = np.add.reduceat(mix64(s ^ np.uint64(0x243F6A8885A308D3)), starts)
    two = np.add.reduceat(mix64(s ^ np.uint64(0x13198A2E03707344)), starts)
    return mix64(one), mix64(two)


def min_hashes(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), K), dtype=np.uint32)
    for k in range(K):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    return out


def _scan(batches):
    """(doc_id, text) -> doc_id, n, fp, fp2, keys, sig."""
    for b in batches:
        raw = [t or b"" for t in text_bytes(b.column("text"))]
        for i, j in chunks(raw, CHUNK):
            s, before = shingle_sets(raw[i:j])
            n = np.diff(before)
            some = np.flatnonzero(n)
            fp, fp2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
            keys, sigs = np.zeros((j - i, BANDS), np.uint64), np.zeros((j - i, K), np.uint8)
            if len(some):
                starts = before[some]
                fp[some], fp2[some] = fingerprints(s, starts)
                m = min_hashes(s, starts)
                sigs[some] = (m & np.uint32(255)).astype(np.uint8)
                g = m.reshape(len(some), BANDS, ROWS).astype(np.uint64)
                k = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), g.shape[:2])
                for r in range(ROWS):
                    k = mix64(k * np.uint64(0xD1342543DE82EF95) + g[:, :, r] + np.uint64(1))
                keys[some] = k
            null = n == 0
            flat = pa.array(keys.astype(np.int64, copy=False).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").slice(i, j - i),
                    pa.array(n),
                    pa.array(fp.view(np.int64), mask=null),
                    pa.array(fp2.view(np.int64), mask=null),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), flat),
                    pa.array([r.tobytes() for r in sigs], pa.binary()),
                ],
                names=["doc_id", "n", "fp", "fp2", "keys", "sig"],
            )


# ---------------------------------------------------------------- sequential test


@lru_cache(maxsize=8)
def least_matches(threshold: int = THRESHOLD, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(hashes compared, least matches to go on): below it, P(similarity >= threshold | matches) < miss under a uniform prior.

    With m of n matches, the tail of Beta(m + 1, n - m + 1) beyond p is P(Binomial(n + 1, p) <= m)."""
    p = threshold / 100 + (1 - threshold / 100) / 256
    out = []
    for n in range(BATCH, K + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def may_link(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row: do the signatures pass every look at the posterior?"""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int32)
    at = 0
    for n, least in least_matches():
        matches = matches + (left[alive, at:n] == right[alive, at:n]).sum(1)
        ok = matches >= least
        alive, matches, at = alive[ok], matches[ok], n
        if not len(alive):
            break
    out = np.zeros(len(left), dtype=bool)
    out[alive] = True
    return out


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, K)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _stars(pairs: DataFrame) -> DataFrame:
    """(a, b) -> (g, part, m): the members b of every a, and a itself, in parts of about STAR members."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select(F.col("a").alias("g"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("m"))
    leaders = parts.select(F.col("a").alias("g"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("m"))
    return members.unionByName(leaders)


def prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that the sequential test lets pass."""

    def test(t: pa.Table) -> pa.RecordBatch | None:
        g, m, sig = t.column("g")[0].as_py(), t.column("m").to_numpy(), _signatures(t)
        lead = np.flatnonzero(m == g)[0]
        rest = np.flatnonzero(m != g)
        ok = rest[may_link(np.broadcast_to(sig[lead], (len(rest), K)), sig[rest])]
        return _pairs(np.full(len(ok), g), m[ok])

    stars = stored(_stars(pairs))
    rows = stars.join(narrowed(classes, "fp", stars.select("m").distinct()).select(F.col("fp").alias("m"), "sig").hint(ALIKE), "m")
    return in_runs(rows, ["g", "part"], test, "a long, b long")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def test(t: pa.Table) -> pa.RecordBatch | None:
        g, m = t.column("g")[0].as_py(), t.column("m").to_numpy()
        raw = text_bytes(t.column("text").combine_chunks())
        sets: dict[int, np.ndarray] = {}
        for i, j in chunks(raw, CHUNK):
            s, before = shingle_sets(raw[i:j])
            some = np.flatnonzero(np.diff(before))
            if len(some):
                fp = fingerprints(s, before[some])[0].view(np.int64)
                for k, f in zip(some, fp):
                    if f == m[i + k]:  # another text may share the doc_id
                        sets[int(f)] = s[before[k] : before[k + 1]]
        lead = sets.get(g)
        if lead is None:
            return None
        found = []
        for f, s in sets.items():
            if f != g and 100 * min(len(s), len(lead)) >= THRESHOLD * max(len(s), len(lead)):
                x = np.searchsorted(lead, s)
                both = int((lead[np.minimum(x, len(lead) - 1)] == s).sum())
                if 100 * both >= THRESHOLD * (len(s) + len(lead) - both):
                    found.append(f)
        return _pairs(np.full(len(found), g), np.array(found, dtype=np.int64))

    stars = stored(_stars(pairs))
    needed = stored(stars.select("m").distinct().join(classes.select(F.col("fp").alias("m"), F.col("rep").alias("doc_id")).hint(ALIKE), "m"))
    texts = narrowed(docs.select("doc_id", "text"), "doc_id", needed.select("doc_id")).join(needed.hint(ALIKE), "doc_id").select("m", "text")
    return in_runs(stars.join(texts.hint(ALIKE), "m"), ["g", "part"], test, "a long, b long")


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (fp, root): the smallest node of every connected component. Labels sink along edges and jump to their own
    label's label until none changes; every round is a stored table."""
    e = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = stored(e.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("fp"), F.least("a", "least").alias("root")))
    while True:
        near = e.join(label.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near"))
        sunk = stored(label.join(near, "fp").select("fp", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jump = sunk.select(F.col("fp").alias("root"), F.col("root").alias("next"))
        new = stored(sunk.join(jump, "root").select("fp", F.col("next").alias("root"), (F.col("next") != F.col("old")).alias("moved")))
        label = new.select("fp", "root")
        if new.where("moved").isEmpty():
            return label


def _residual(members: DataFrame, label: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that pass the sequential test among bucket members (key, fp) in different components."""
    m = members.join(label.hint(ALIKE), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    m = stored(m)
    open_keys = m.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    q = m.join(open_keys.hint(ALIKE), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    q = q.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    q = q.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "fp", "root")
    q = stored(q)
    q = q.join(narrowed(classes.select("fp", "sig"), "fp", q.select("fp").distinct()).hint(ALIKE), "fp")

    def test(t: pa.Table) -> pa.RecordBatch | None:
        own, fp, root, sig = t.column("own").to_numpy(), t.column("fp").to_numpy(), t.column("root").to_numpy(), _signatures(t)
        one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
        left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
        a, b = [], []
        for i in left:
            j = right[(root[right] != root[i]) & ((fp[right] > fp[i]) if one == two else True)]
            j = j[may_link(np.broadcast_to(sig[i], (len(j), K)), sig[j])]
            a.append(np.minimum(fp[i], fp[j]))
            b.append(np.maximum(fp[i], fp[j]))
        return _pairs(np.concatenate(a), np.concatenate(b)) if a else None

    return in_runs(q, ["key", "one", "two"], test, "a long, b long").distinct()


def _classes(scanned: DataFrame) -> DataFrame:
    """fp, rep, keys, sig: one row per set. Only rows whose fingerprint may occur again are grouped, and so shuffled with keys and signatures."""
    again = stored(scanned.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"))
    several = may_occur(scanned["fp"], again)
    alone = scanned.where(~several).select("fp", F.col("doc_id").alias("rep"), "keys", "sig")
    same = F.assert_true(F.min("fp2") == F.max("fp2"), "two different sets share a fingerprint").alias("checked")
    grouped = scanned.where(several).groupBy("fp").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys"), F.any_value("sig").alias("sig"), same)
    return alone.unionByName(grouped.where("checked IS NULL").drop("checked"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = stored(d.mapInArrow(_scan, "doc_id long, n long, fp long, fp2 long, keys array<long>, sig binary"))
    rows = stored(scanned.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp")))
    classes = stored(_classes(scanned.where("doc_id IS NOT NULL AND fp IS NOT NULL")))
    release(scanned)
    buckets = classes.select("fp", F.explode("keys").alias("key"))
    shared = stored(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    among = stored(narrowed(buckets, "key", shared).join(shared.hint(ALIKE), "key"))
    leads = among.groupBy("key").agg(F.min("fp").alias("lead"))
    members = stored(among.join(leads.hint(ALIKE), "key").where("fp <> lead"))
    first = stored(confirm(stored(prune(members.select(F.col("lead").alias("a"), F.col("fp").alias("b")).distinct(), classes)), classes, d))
    label = components(first)
    more = stored(_residual(members.select("key", "fp"), label, classes))
    if not more.isEmpty():
        second = stored(confirm(more, classes, d))
        label = components(label.where("fp <> root").select(F.col("root").alias("a"), F.col("fp").alias("b")).unionByName(second))
    reps = classes.select("fp", "rep")
    least = label.join(reps, "fp").groupBy("root").agg(F.min("rep").alias("least"))
    of_class = reps.join(label.join(least, "root").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "rep").alias("least"))
    return (
        rows.join(of_class.hint(ALIKE), "fp", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one row of each group of near duplicates stays: the one with the smallest
    doc_id, and of repeated rows with that id any one."""
    found = stored(near_duplicates(docs))
    gone = stored(found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct())
    again = found.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    # only rows that may go are shuffled with their texts
    maybe = may_occur(docs["doc_id"], gone)
    left = docs.where(~maybe).unionByName(docs.where(maybe).join(gone.hint(ALIKE), docs["doc_id"] == F.col("__gone"), "left_anti"))
    if again.isEmpty():
        return left
    once = left.join(again, left["doc_id"] == F.col("__again"), "left_anti")
    return once.unionByName(left.join(again, left["doc_id"] == F.col("__again"), "left_semi").dropDuplicates(["doc_id"]))
