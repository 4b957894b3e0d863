"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows.

Texts and items are read as lower-case words joined by single spaces. A document leaks an item if some part of it is within edit
distance ``max_edits`` (a share of the item's length) of the item.

1. *Windows.* A window begins at every s-th word of a text, and an item is indexed from each of its first s words on, so that
   wherever a leak begins, one of its own windows meets one of the item's; s is the first of STRIDES that the item has words.
2. *CGK.* A random walk reads a window into a string of twice its length, advancing on a character if a random function of (step,
   character) says so. Strings at edit distance k become strings at Hamming distance O(k^2) with constant probability, for each of WALKS
   walks. A walk from a window's begin serves windows of all sizes: an item of n bytes is compared on 2n steps.
3. *Bit sampling.* Of every walk, HALVES sets of BITS positions each are drawn for each class of lengths; two halves that both agree make a
   window a candidate, so HALVES give HALVES (HALVES - 1) / 2 tables of 2 BITS positions. They find a leak at the allowed distance,
   insertions and deletions among its edits, with probability RECALL or more (measured in the tests).
4. *Verification.* Candidates are confirmed by Myers' bit-parallel algorithm, exactly, the window being widened by the number of edits. An
   edit changes at most GRAM of an item's GRAM-byte pieces, so a window that holds fewer than all but GRAM times the allowed edits of them
   is refused before.

Nothing but the tables generates candidates, whatever words a leak shares with its item. Items of one word have no window worth sampling:
they are matched as whole words.

Items are shipped to the tasks in blocks of at most ``block_bytes`` of text, one at a time; further blocks take further passes over the
documents, each of which stores what it finds, so a growing benchmark costs passes, never memory. Texts are not shuffled; what is emitted is one row per (document, item) found.

Cases: null and empty texts leak nothing; null and empty items are ignored;
repeated items and rows give repeated findings, made distinct; an empty benchmark or table gives an empty result; columns other than
doc_id, text and item_id, text are not read. Case is folded for A-Z only, so other letters in upper case count as edits.
"""

from __future__ import annotations

import functools
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, text_bytes

MAX_EDITS = 0.07
WALKS, HALVES, BITS = 4, 11, 4
RECALL = 0.9  # at the allowed distance
STRIDES = (12, 6, 3, 1)
CLASS = 2  # lengths of a class differ by less than this factor
BLOCK_BYTES = 2 << 20
CHUNK = 1 << 20
_SEED = 11
GRAM, SLOTS = 4, 1 << 12
_PAIRS = [(i, j) for i in range(HALVES) for j in range(i)]
_FIRST, _SECOND = np.array(_PAIRS).T
TOGETHER = 9  # pairs looked up at once
_draw = lambda *shape: np.random.default_rng((_SEED, *shape)).integers(1 << 64, size=shape, dtype=np.uint64)
_CODES, _SALT = _draw(HALVES, BITS, 256), _draw(len(_PAIRS))  # the code of a byte at a half's position; of a pair


def normal(text: bytes) -> bytes:
    """Lower case (A-Z) words joined by single spaces."""
    return b" ".join(text.lower().split())


@lru_cache(maxsize=64)
def _advances(walk: int, steps: int) -> np.ndarray:
    """(step, byte) -> does the walk advance?"""
    blocks = [np.random.default_rng((_SEED, 0, walk, b)).integers(0, 2, (64, 256)) for b in range(-(-steps // 64))]
    return np.concatenate(blocks)[:steps]


def cgk(text: np.ndarray, starts: np.ndarray, steps: int, walk: int, wanted: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """The embeddings of the windows of ``text`` at ``starts``: step -> the byte that each walk reads then, for the ``wanted`` steps.
    The text must reach ``steps`` bytes beyond the last start."""
    at, out = starts.astype(np.int64), {}
    for t, advances in enumerate(_advances(walk, steps)):
        c = text.take(at)
        if wanted is None or wanted[t]:
            out[t] = c
        at += advances.take(c)
    return out


def _class(length: int) -> int:
    return int(math.log(length) / math.log(CLASS))


@lru_cache(maxsize=512)
def _positions(walk: int, kind: int) -> np.ndarray:
    """Sampled steps, (half, bit), of items of that class: within twice the least length of the class."""
    least = max(1, math.ceil(CLASS**kind))
    return np.random.default_rng((_SEED, 4, walk, kind)).integers(0, 2 * least, (HALVES, BITS))


def _halves(rows: dict[int, np.ndarray], positions: np.ndarray) -> np.ndarray:
    """(half, window) -> key of the bytes read at the half's positions."""
    out = []
    for i, p in enumerate(positions.tolist()):
        key = _CODES[i, 0].take(rows[p[0]])
        for j in range(1, BITS):
            key += _CODES[i, j].take(rows[p[j]])
        out.append(key)
    return np.array(out)


def myers_search(pattern: bytes, text: bytes, most: int) -> int | None:
    """The least edit distance of the pattern to a substring of the text, if at most ``most``."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask  # a match may begin anywhere
        mh = (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best = score
    return best if best <= most else None


class _Tables:
    """Keys of the items of one class under one walk, all pairs of halves in one sorted table behind a first, cheap look."""

    def __init__(self, halves: np.ndarray, item: np.ndarray, shift: np.ndarray):
        keys = np.concatenate([halves[i] + halves[j] + s for (i, j), s in zip(_PAIRS, _SALT)])
        owner = np.tile(np.arange(len(item), dtype=np.int32), len(_PAIRS))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.item, self.shift = keys[order], owner[order], item, shift
        self.drop = np.uint64(64 - min(24, max(16, len(keys).bit_length() + 5)))
        self.seen = np.zeros(1 << (64 - int(self.drop)), dtype=bool)
        self.seen[(keys >> self.drop).view(np.int64)] = True

    def hits(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, owner) of every agreement."""
        n, at, found = halves.shape[1], [], []
        for k in range(0, len(_PAIRS), TOGETHER):
            key = halves[_FIRST[k : k + TOGETHER]]
            key += halves[_SECOND[k : k + TOGETHER]]
            key += _SALT[k : k + TOGETHER, None]
            key = key.ravel()
            hit = np.flatnonzero(self.seen.take((key >> self.drop).view(np.int64)))
            at.append(hit % n)
            found.append(key[hit])
        at, found = np.concatenate(at), np.concatenate(found)
        lo, hi = np.searchsorted(self.keys, found, "left"), np.searchsorted(self.keys, found, "right")
        n = hi - lo
        place = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[place]


class Items:
    """A block of items, indexed for windows of texts."""

    def __init__(self, rows: list[tuple[int, bytes]], max_edits: float):
        self.ids = [i for i, _ in rows]
        self.texts = [t for _, t in rows]
        self.most = np.array([int(max_edits * len(t)) for t in self.texts], dtype=np.int64)
        self.grams = [_grams(np.frombuffer(t, dtype=np.uint8)) for t in self.texts]
        self.single: dict[bytes, list[int]] = {}
        # stride -> (item, bytes of the item before the window, the window)
        windows: dict[int, list[tuple[int, int, bytes]]] = {s: [] for s in STRIDES}
        for k, t in enumerate(self.texts):
            if b" " not in t:
                self.single.setdefault(t, []).append(k)
                continue
            n_words, begin = t.count(b" ") + 1, 0
            stride = next(s for s in STRIDES if s <= n_words)
            for _ in range(stride):
                windows[stride].append((k, begin, t[begin:]))
                begin = t.find(b" ", begin) + 1
                if not begin:
                    break
        #: stride, steps, steps that are sampled, tables by (walk, class)
        self.groups: list[tuple[int, int, list[np.ndarray], dict[tuple[int, int], _Tables]]] = []
        for stride, some in windows.items():
            if not some:
                continue
            lengths = np.array([len(w) for _, _, w in some])
            kinds = np.array([_class(n) for n in lengths.tolist()])
            steps = 2 * max(math.ceil(CLASS**k) for k in set(kinds.tolist()))
            joined, starts = _padded([w for _, _, w in some], steps)
            wanted, tables = [], {}
            for walk in range(WALKS):
                of = {k: _positions(walk, k) for k in sorted(set(kinds.tolist()))}
                flags = np.zeros(steps, dtype=bool)
                for p in of.values():
                    flags[p] = True
                wanted.append(flags)
                rows_ = cgk(joined, starts, steps, walk, flags)
                for k, p in of.items():
                    own = np.flatnonzero(kinds == k)
                    picked = {t: rows_[t][own] for t in set(p.ravel().tolist())}
                    tables[walk, k] = _Tables(_halves(picked, p), np.array([some[i][0] for i in own]), np.array([some[i][1] for i in own]))
            self.groups.append((stride, steps, wanted, tables))

    def find(self, raw: list[bytes]) -> list[tuple[int, int, int]]:
        """(place of the text, place of the item, edits) of every leak."""
        texts = [normal(t) for t in raw]
        best: dict[tuple[int, int], int] = {}
        if self.single:
            for at, t in enumerate(texts):
                best.update({(at, k): 0 for w in set(t.split()) if w in self.single for k in self.single[w]})
        for stride, steps, wanted, tables in self.groups:
            joined, begins = _padded(texts, 0)
            joined = np.concatenate([joined, np.zeros(steps + 1, np.uint8)])
            edge = np.concatenate([begins, np.flatnonzero(joined == 32) + 1])
            edge.sort()
            doc = np.searchsorted(begins, edge, "right") - 1
            first = np.searchsorted(edge, begins)
            mine = (np.arange(len(edge)) - first[doc]) % stride == 0
            edge, doc = edge[mine], doc[mine]
            found = []
            for walk in range(WALKS):
                rows = cgk(joined, edge, steps, walk, wanted[walk])
                for (w, kind), t in tables.items():
                    if w == walk:
                        at, owner = t.hits(_halves(rows, _positions(walk, kind)))
                        found.append((at, t.item[owner], edge[at] - begins[doc[at]] - t.shift[owner]))
            at, item, begin = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((begin, item, doc[at]))
            d, item, begin = doc[at][order], item[order], begin[order]
            new = np.ones(len(d), dtype=bool)
            new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (begin[1:] != begin[:-1])
            pieces = _grams(joined)
            for d, k, x in zip(d[new].tolist(), item[new].tolist(), begin[new].tolist()):
                if best.get((d, k), 1):
                    most = int(self.most[k])
                    begin, end = max(0, x - 2 * most), min(len(texts[d]), max(0, x) + len(self.texts[k]) + 2 * most)
                    held = np.zeros(SLOTS, dtype=bool)
                    held[pieces[begins[d] + begin : begins[d] + end - GRAM + 1]] = True
                    if np.count_nonzero(held[self.grams[k]]) < len(self.grams[k]) - GRAM * most:
                        continue
                    got = myers_search(self.texts[k], texts[d][begin:end], most)
                    if got is not None:
                        best[d, k] = min(got, best.get((d, k), got))
        return sorted((at, k, e) for (at, k), e in best.items())


def _grams(text: np.ndarray) -> np.ndarray:
    """Slots of the pieces of GRAM bytes that begin at each byte."""
    if len(text) < GRAM:
        return np.zeros(0, dtype=np.uint32)
    g = np.zeros(len(text) - GRAM + 1, dtype=np.uint32)
    for i in range(GRAM):
        g = g * np.uint32(2654435761) + text[i : len(text) - GRAM + 1 + i] + np.uint32(i)
    return (g ^ g >> np.uint32(15)) % np.uint32(SLOTS)


def _padded(texts: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(the texts, each followed by a zero and ``steps`` more, where each begins)."""
    gap = bytes(steps + 1)
    begins = np.cumsum([0, *(len(t) + len(gap) for t in texts)])[:-1]
    return np.frombuffer(b"".join(t + gap for t in texts), dtype=np.uint8), begins


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Blocks of (item_id, normalised text), each of at most about ``block_bytes``; distinct texts, one block in the driver at a time."""
    block, size = [], 0
    rows = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    for r in rows.toLocalIterator():
        t = normal(r["text"].encode())
        if t:
            block.append((r["item_id"], t))
            size += len(t)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits: the items that every document leaks."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, item_id long, edits long"
    parts: list[DataFrame] = []
    for shipped, more in _shipped(d, items, block_bytes):

        def run(batches, shipped=shipped):
            it = Items(shipped.value, max_edits)
            for b in batches:
                raw = [t or b"" for t in text_bytes(b.column("text"))]
                ids = b.column("doc_id").to_pylist()
                got = [(ids[i + at], it.ids[k], e) for i, j in chunks(raw, CHUNK) for at, k, e in it.find(raw[i:j])]
                cols = list(zip(*got)) if got else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits"])

        part = d.mapInArrow(run, kind)
        parts.append(stored(part) if more or parts else part)
    if not parts:
        return d.sparkSession.createDataFrame([], kind)
    return functools.reduce(DataFrame.unionAll, parts).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _shipped(docs: DataFrame, items: DataFrame, block_bytes: int):
    """(broadcast block, is it followed by another?). Where there are several, their readers store what they find, so that one block at a time is held."""
    blocks = item_blocks(items, block_bytes)
    block = next(blocks, None)
    several = False
    while block is not None:
        after = next(blocks, None)
        several |= after is not None
        shipped = docs.sparkSession.sparkContext.broadcast(sorted(block, key=lambda r: (r[1], r[0] is None, r[0] or 0)))
        yield shipped, after is not None
        if several:
            shipped.destroy()
        block = after


def is_leak(text: Column, shipped, max_edits: float = MAX_EDITS) -> Column:
    """Does the text leak any item of the broadcast block?"""
    made: list[Items] = []

    @F.pandas_udf("boolean")
    def leaks(batches: pd.Series) -> pd.Series:
        if not made:
            made.append(Items(shipped.value, max_edits))
        raw = [b"" if t is None else t.encode() for t in batches]
        hit = np.zeros(len(raw), dtype=bool)
        for i, j in chunks(raw, CHUNK):
            hit[[i + at for at, _, _ in made[0].find(raw[i:j])]] = True
        return pd.Series(hit)

    return leaks(text)


def remove_leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text leaks no item."""
    several = False
    for shipped, more in _shipped(docs, items, block_bytes):
        several |= more
        docs = docs.where(~is_leak(docs["text"], shipped, max_edits))
        docs = stored(docs) if several else docs
    return docs
