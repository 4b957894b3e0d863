"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are rotated by three rounds of random signs and a Hadamard transform; the nearest signed axis (the largest coordinate by
size, and its sign) is a hash with twice as many values as dimensions. A table's bucket joins ``k`` such hashes, and there are
``TABLES`` tables. A row lies in one bucket of every table; a query looks in the ``PROBES`` likeliest buckets of each
table (those whose axes lose least against the nearest ones). In a bucket, queries meet rows as two matrices; each bucket yields its
best ``n`` rows of a query by the exact inner product, and a query's best ``n`` of all buckets are its result.

Inner products are searched as angles: where norms differ, rows get one more coordinate that makes them equally long, and queries a zero.

Copies: of rows with equal vectors only the n + 1 with the smallest ids are put in the tables, since ties go to smaller ids and so no
other copy can be among anyone's n nearest; equal query vectors are searched once. Rows of a bucket with more than ``BLOCK`` rows are salted into parts, its queries likewise, and all parts of both meet, so
that no task gathers a bucket.

Choice: the exact neighbours of SAMPLE queries are found first. The largest ``k``, up to the one that leaves ``BUCKET`` rows in a bucket, and the
fewest probes, PROBES to WIDEST x PROBES, whose buckets hold TARGET of those neighbours are taken. Where none do, where they would compare half of all pairs or more,
or where all rows make one bucket, ``k`` is 0: every query meets every row in blocks, and the result is exact. Queries that find fewer rows than asked for
are searched so too. Queries are shuffled probes x TABLES times and rows TABLES times, or by blocks where ``k`` is 0.

Cases: vectors that are null, zero, or hold null, NaN or infinite components take no part; vectors of each length are searched apart, as no inner
product joins different lengths;
rows with a null vec_id take no part; of rows with equal vec_id the one with the smallest vector counts; ties go to the smaller vec_id; fewer rows than asked for give them all; an empty table
gives an empty result; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_runs, stored

N = 20
TABLES, PROBES = 8, 16
BUCKET = 256  # rows that a bucket shall hold on average
BLOCK = 4096
SAMPLE, TARGET = 64, 0.95  # queries whose recall is measured, and the recall that they shall have
WIDEST = 4  # times PROBES
_SEED = 5


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v): usable vectors, one for each vec_id, as they are stored if as floats or doubles."""
    v = F.col("embedding")
    if rows.schema["embedding"].dataType.elementType.simpleString() not in ("float", "double"):
        v = F.transform(v, lambda x: x.cast("double"))
    d = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    d = d.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return d.groupBy("vec_id").agg(F.min("v").alias("v"))


def first_copies(d: DataFrame, n: int, rows: int) -> DataFrame:
    """The rows with the ``n`` smallest ids of each vector; large groups of copies are thinned in salted parts first."""
    salts = max(1, rows // 1_000_000)
    if salts > 1:
        part = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).orderBy("vec_id")
        d = d.withColumn("r", F.row_number().over(part)).where(F.col("r") <= n).drop("r")
    return d.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= n).drop("r")


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform along the last axis, whose length is a power of two."""
    h, n = 1, x.shape[-1]
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / math.sqrt(n)


def rotate(x: np.ndarray, table: int, hash_: int) -> np.ndarray:
    signs = np.random.default_rng((_SEED, table, hash_)).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def row_buckets(x: np.ndarray, k: int, tables: int = TABLES) -> np.ndarray:
    """(row, table) -> bucket."""
    out = np.zeros((len(x), tables), dtype=np.int64)
    for t in range(tables):
        for h in range(k):
            y = rotate(x, t, h)
            axis = np.abs(y).argmax(1)
            out[:, t] = out[:, t] * (2 * x.shape[1]) + 2 * axis + (y[np.arange(len(x)), axis] < 0)
    return out


def probe_buckets(x: np.ndarray, k: int, probes: int = PROBES, tables: int = TABLES) -> np.ndarray:
    """(query, table, probe) -> bucket, likeliest first."""
    dim = x.shape[1]
    probes = min(probes, (2 * dim) ** k)
    out = np.zeros((len(x), tables, probes), dtype=np.int64)
    for t in range(tables):
        cost, bucket = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
        for h in range(k):
            y = rotate(x, t, h)
            signed = np.stack([y, -y], axis=2).reshape(len(x), 2 * dim)  # axis 2i is +i, 2i+1 is -i
            m = min(probes, 2 * dim)
            best = np.argpartition(-signed, m - 1, axis=1)[:, :m]
            top = np.take_along_axis(signed, best, 1)
            loss = (top.max(1, keepdims=True) - top) ** 2
            cost = (cost[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
            bucket = (bucket[:, :, None] * (2 * dim) + best[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            cost, bucket = np.take_along_axis(cost, keep, 1), np.take_along_axis(bucket, keep, 1)
        out[:, t] = bucket
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def padded(v: np.ndarray, longest: float | None, query: bool) -> np.ndarray:
    """Unit vectors, padded to a power of two; ``longest`` is the largest norm where norms differ."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    if longest is not None and not query:
        v = np.hstack([v / longest, np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))])
    else:
        v = v / norm
        if longest is not None:
            v = np.hstack([v, np.zeros((len(v), 1))])
    return np.pad(v, ((0, 0), (0, (1 << max(1, (v.shape[1] - 1).bit_length())) - v.shape[1])))


def choice(q: np.ndarray, near: np.ndarray, of: np.ndarray, k: int, tables: int = TABLES, probes: int = PROBES) -> tuple[int, int]:
    """(k, probes): the largest ``k`` and the fewest probes whose buckets hold TARGET of the rows ``near``, the true neighbours of the queries ``q[of]``; (0, 1) if none do."""
    values = 2 * q.shape[1]
    for h in range(k, 0, -1):
        buckets, p = row_buckets(near, h, tables), probes
        while p <= WIDEST * probes and 2 * tables * p < values**h:
            if len(of) and (probe_buckets(q, h, p, tables)[of] == buckets[:, :, None]).any((1, 2)).mean() >= TARGET:
                return h, p
            p *= 2
    return 0, 1


def _sampled(d: DataFrame, alike: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors of SAMPLE queries, vectors of their exact ``n`` neighbours, whose each of these is)."""
    some = alike.orderBy(F.xxhash64("first"), "first").limit(SAMPLE).collect()
    qids, q = np.array([r["first"] for r in some], dtype=np.int64), np.array([r["v"] for r in some], dtype=np.float64)

    def best(batches):
        for b in batches:
            ids, v = b.column("vec_id").to_numpy(), _matrix(b.column("v"))
            order = np.argsort(ids, kind="stable")
            if len(ids):
                got = _best(qids, q, ids[order], v[order], n + 1)
                at = order[np.searchsorted(ids[order], got.column(1).to_numpy())]
                yield pa.RecordBatch.from_arrays([*got.columns, b.column("v").take(pa.array(at))], names=["first", "vec_id", "score", "v"])

    pairs = d.mapInArrow(best, f"first long, vec_id long, score double, v {d.schema['v'].dataType.simpleString()}").where("first <> vec_id")
    found = _ranked(pairs, "first").where(F.col("rank") <= n).select("first", "v").collect()
    place = {i: k for k, i in enumerate(qids.tolist())}
    return q, np.array([r["v"] for r in found], dtype=np.float64).reshape(len(found), q.shape[1]), np.array([place[r["first"]] for r in found], dtype=np.int64)


def search(rows: DataFrame, is_query, n: int = N, tables: int = TABLES, probes: int = PROBES, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` marks, its ``n`` nearest rows found."""
    d = stored(valid(rows))
    shapes = d.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(_norm("v")).alias("hi"), F.min(_norm("v")).alias("lo")).orderBy("dim").collect()
    found = [_search_length(d.where(F.size("v") == s["dim"]), s, is_query, n, tables, probes, bucket, block) for s in shapes]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.unionAll, found)


def _search_length(d: DataFrame, shape, is_query, n: int, tables: int, probes: int, bucket: int, block: int) -> DataFrame:
    """``search`` of vectors of one length, whose number and largest and smallest norm are given."""
    longest = shape["hi"] if shape["lo"] < 0.99 * shape["hi"] else None
    values = 2 << (shape["dim"] + (longest is not None) - 1).bit_length()
    queries = d.where(is_query(F.col("vec_id")))
    alike = stored(queries.groupBy("v").agg(F.min("vec_id").alias("first")))
    k = max(1, round(math.log(max(1, shape["n"] / bucket), values))) if shape["n"] > bucket else 0
    if any(2 * tables * probes < values**h for h in range(1, k + 1)):
        q, near, of = _sampled(d, alike, n)
        k, probes = choice(padded(q, longest, True), padded(near, longest, False), of, k, tables, probes) if len(q) else (0, 1)
    else:
        k = 0
    if not k:
        tables = probes = 1

    def index(batches):
        for b in batches:
            yield _hashed(b, row_buckets(padded(_matrix(b.column("v")), longest, False), k, tables)[:, :, None])

    def probe(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                yield _hashed(b, probe_buckets(padded(_matrix(b.column("v")), longest, True), k, probes, tables))

    kind = f"vec_id long, v {d.schema['v'].dataType.simpleString()}, buckets array<struct<table:int,bucket:long>>"

    def spread(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "v", F.explode("buckets").alias("b")).select("vec_id", "v", "b.table", "b.bucket")

    copies = stored(first_copies(d, n + 1, shape["n"]))
    question = alike.select(F.col("first").alias("vec_id"), "v")
    if k:
        indexed, asked = (spread(stored(df.mapInArrow(f, kind))) for df, f in ((copies, index), (question, probe)))
    else:
        indexed, asked = _in_one(copies), _in_one(question)
    top = stored(_met(indexed, asked, n + 1, block))
    if k:
        counts = top.groupBy("first").agg(F.count(F.lit(1)).alias("found"))
        short = stored(question.join(counts, F.col("vec_id") == F.col("first"), "left").where(F.coalesce("found", F.lit(0)) < min(n + 1, copies.count())).select("vec_id", "v"))
        if not short.isEmpty():
            again = _met(_in_one(copies), _in_one(short), n + 1, block)
            top = top.join(short.select(F.col("vec_id").alias("first")), "first", "left_anti").unionByName(again)
    own = queries.join(alike, "v").select(F.col("vec_id").alias("query_id"), "first")
    found = own.join(top, "first").where("query_id <> vec_id").drop("first")
    return _ranked(found, "query_id").where(F.col("rank") <= n).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _in_one(df: DataFrame) -> DataFrame:
    """All rows in one bucket of one table."""
    return df.select("vec_id", "v", F.lit(0).alias("table"), F.lit(0).cast("long").alias("bucket"))


def _met(indexed: DataFrame, asked: DataFrame, n: int, block: int) -> DataFrame:
    """first, vec_id, score: the best ``n`` rows of the buckets that each query looks in."""
    # a bucket's rows and its queries are both split into blocks, and every block of rows meets every block of queries
    blocks = lambda df, name: df.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = stored(blocks(indexed, "parts").join(blocks(asked, "turns"), ["table", "bucket"]))
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col(n)).cast("int").alias(n[:-1])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[:-1])
    inside = indexed.join(sizes, ["table", "bucket"]).select("table", "bucket", own("parts"), each("turns"), F.lit(False).alias("query"), "vec_id", "v")
    visits = asked.join(sizes, ["table", "bucket"]).select("table", "bucket", each("parts"), own("turns"), F.lit(True).alias("query"), "vec_id", "v")

    def meet(t: pa.Table) -> pa.RecordBatch | None:
        q = t.column("query").combine_chunks().to_numpy(zero_copy_only=False)
        if not q.any() or q.all():
            return None
        ids, v = t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks())
        rows, queries = np.flatnonzero(~q), np.flatnonzero(q)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        return _best(ids[queries], v[queries], ids[rows], v[rows], n)

    pairs = in_runs(inside.unionByName(visits), ["table", "bucket", "part", "turn"], meet, "first long, vec_id long, score double", lambda found: compacted(found, n))
    # the same pair has the same score in every bucket; a query's own row is among them at most once
    once = pairs.groupBy("first", "vec_id").agg(F.max("score").alias("score"))
    return _ranked(once, "first").where(F.col("rank") <= n).drop("rank")


def _ranked(pairs: DataFrame, by: str) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")))


def _norm(v: str):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _hashed(b: pa.RecordBatch, buckets: np.ndarray) -> pa.RecordBatch:
    rows, tables, probes = buckets.shape
    table = np.broadcast_to(np.arange(tables, dtype=np.int32)[None, :, None], buckets.shape).ravel()
    items = pa.StructArray.from_arrays([pa.array(table), pa.array(buckets.ravel())], names=["table", "bucket"])
    offsets = pa.array(np.arange(0, (rows + 1) * tables * probes, tables * probes, dtype=np.int32)[: rows + 1])
    return pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.ListArray.from_arrays(offsets, items)], names=["vec_id", "v", "buckets"])


def compacted(found: Iterator[pa.RecordBatch], n: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A task's finds, each pair once and each query's best ``n`` only; handed on whenever ``most`` do not shrink by half, so that what is held is bounded."""
    held, rows = [], 0

    def best() -> pa.RecordBatch:
        first, vec, score = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        order = np.lexsort((vec, -score, first))
        first, vec, score = first[order], vec[order], score[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (vec[1:] != vec[:-1])
        first, vec, score = first[new], vec[new], score[new]
        keep = np.arange(len(first)) - np.searchsorted(first, first) < n
        return pa.RecordBatch.from_arrays([pa.array(first[keep]), pa.array(vec[keep]), pa.array(score[keep])], names=["first", "vec_id", "score"])

    for b in found:
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            held = [best()]
            rows = held[0].num_rows
            if rows > most // 2:
                yield held[0]
                held, rows = [], 0
    if held:
        yield best()


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in an order of sums that does not depend on the matrices' shapes."""
    s = np.zeros(len(a))
    for i in range(a.shape[1]):
        s += a[:, i] * b[:, i]
    return s


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, n: int) -> pa.RecordBatch:
    """The best ``n`` rows of every query, rows being sorted by id. The matrix product chooses with a margin for rounding, exact scores decide."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ v.T
        if len(ids) > n:
            edge = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
        else:
            edge = s.min(1)
        i, j = np.nonzero(s >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
        score = inner(q[a + i], v[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < n
        out.append((qids[a + i[keep]], ids[j[keep]], score[keep]))
    cols = [np.concatenate(c) for c in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2])], names=["first", "vec_id", "score"])
