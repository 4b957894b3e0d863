"""Token counts by a linear longest-match automaton.

A text's words are its maximal runs without ASCII white space; each is read with one space before it, so that vocabulary entries that
begin with a space are word-initial pieces and all others continue a word. A word is cut greedily into the longest pieces. The
automaton finds how many pieces that makes without building any: a trie of the vocabulary, where every node has a failure link (the node that is
reached once the longest pieces have been popped off its string) and the number of pieces popped on the way. Each byte is then one
trie step and some failure steps, linear in all. Distinct words of a batch are stepped together in numpy, byte by byte.

White space itself is not tokenized: tabs, line breaks and further spaces count no pieces of their own. That departs from tokenizers that encode a text
byte for byte, whose counts are larger by those pieces.

The vocabulary must hold all 256 single bytes, so every word can be cut. It is read once in the driver; the automaton, whose size
the vocabulary bounds, is broadcast.

Cases: a null or empty text, or one of white space alone, has 0 tokens; repeated rows get equal counts; words and texts of any length are read in
whole; an empty table gives an empty result; columns other than doc_id and text are not read. Words are told apart by
64-bit hashes within batches of about a megabyte.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes, word_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 1 << 20
LONG = 200  # bytes of a word beyond which it is stepped alone


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a file with one base64 piece and its rank a line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@dataclass
class Automaton:
    """Edges sorted by ``state << 8 | byte``, and for every state its failure link and the pieces popped by taking it."""

    edge: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    popped: np.ndarray

    def __getstate__(self):
        return self.edge, self.to, self.fail, self.popped

    def __setstate__(self, s):
        self.edge, self.to, self.fail, self.popped = s

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where the edges lead; -1 where there is none."""
        key = (state.astype(np.int64) << 8) | byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.to[at], -1)

    def counts(self, joined: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word joined[start:end], read with a space before it."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        out = np.zeros(len(start), dtype=np.int64)
        long = int(np.searchsorted(-size[order], -LONG, "left"))
        for i in order[:long].tolist():
            out[i] = self.count_alone(joined[start[i] : end[i]].tobytes())
        order = order[long:]
        first, sizes = start[order], size[order]
        state, n = np.full(len(order), int(self.step(np.zeros(1, np.int64), np.array([32]))[0])), np.zeros(len(order), np.int64)
        for t in range(int(sizes[0]) if len(order) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))  # sizes > t
            byte = joined[first[:live] + t].astype(np.int64)
            at = np.arange(live)
            while len(at):
                to = self.step(state[at], byte[at])
                ok = to >= 0
                state[at[ok]] = to[ok]
                at = at[~ok]
                n[at] += self.popped[state[at]]
                state[at] = self.fail[state[at]]
        at = np.flatnonzero(state)
        while len(at):
            n[at] += self.popped[state[at]]
            state[at] = self.fail[state[at]]
            at = at[state[at] != 0]
        out[order] = n
        return out

    def count_alone(self, word: bytes) -> int:
        if not hasattr(self, "_edges"):
            self._edges = dict(zip(self.edge.tolist(), self.to.tolist()))
            self._links = list(zip(self.fail.tolist(), self.popped.tolist()))
        edges, links = self._edges, self._links
        s = n = 0
        for c in b" " + word:
            while (to := edges.get(s << 8 | c)) is None:
                s, k = links[s]
                n += k
            s = to
        while s:
            s, k = links[s]
            n += k
        return n


def build(pieces: list[bytes]) -> Automaton:
    """The automaton of a vocabulary that holds all single bytes."""
    children: list[dict[int, int]] = [{}]
    whole = [False]
    for p in pieces:
        s = 0
        for c in p:
            nxt = children[s].get(c)
            if nxt is None:
                nxt = children[s][c] = len(children)
                children.append({})
                whole.append(False)
            s = nxt
        whole[s] = bool(p)
    if missing := [c for c in range(256) if not whole[children[0].get(c, 0)]]:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, such as {missing[0]}")
    fail, popped = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
    queue = [(0, c, v) for c, v in children[0].items()]
    for u, c, v in queue:  # grows: breadth first
        if whole[v]:
            fail[v], popped[v] = 0, 1
        else:
            z, n = int(fail[u]), int(popped[u])
            while c not in children[z]:
                n += int(popped[z])
                z = int(fail[z])
            fail[v], popped[v] = children[z][c], n
        queue += [(v, d, w) for d, w in children[v].items()]
    key = np.fromiter((s << 8 | c for s, kids in enumerate(children) for c in kids), np.int64)
    to = np.fromiter((v for kids in children for v in kids.values()), np.int64)
    order = np.argsort(key)
    return Automaton(key[order], to[order], fail, popped)


def count_batch(raw: list[bytes], a: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, words) of each text."""
    h, start, end, first = word_table(raw, fold=False)
    words = np.diff(first)
    if not len(h):
        return np.zeros(len(raw), np.int64), words
    joined = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    _, where, which = np.unique(h, return_index=True, return_inverse=True)
    total = np.concatenate(([0], np.cumsum(a.counts(joined, start[where], end[where])[which])))
    return total[first[1:]] - total[first[:-1]], words


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_words for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(build(read_vocabulary(vocabulary)))

    def run(batches):
        a = shipped.value
        for b in batches:
            raw = [t or b"" for t in text_bytes(b.column("text"))]
            ids = b.column("doc_id")
            for i, j in chunks(raw, CHUNK):
                tokens, words = count_batch(raw[i:j], a)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(tokens), pa.array(words)], names=["doc_id", "n_tokens", "n_words"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, n_tokens long, n_words long")
