import random

import pyarrow.parquet as pq
import pytest

from glyphstream.llm import decontam


@pytest.mark.parametrize("kinds", [1, 3])
def test_recall_at_the_allowed_distance(kinds):
    """Substitutions alone; insertions and deletions too."""
    rows = pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pylist()
    items = decontam.Items([(r["item_id"], decontam.normal(r["text"].encode())) for r in rows if len(r["text"].split()) >= 8], decontam.MAX_EDITS)
    rng, raw = random.Random(9), []
    for text, most in zip(items.texts, items.most.tolist()):
        chars = list(text.decode())
        for _ in range(most):
            i, kind = rng.randrange(len(chars)), rng.randrange(kinds)
            chars[i : i + 1] = [rng.choice("xyzabc")] * (kind == 0) or [rng.choice("xyzabc"), chars[i]] * (kind == 1)
        raw.append(f"{'before ' * rng.randrange(20)}{''.join(chars)} after it".encode())
    within = {(i, i) for i, x in enumerate(raw) if decontam.myers_search(items.texts[i], decontam.normal(x), int(items.most[i])) is not None}
    found = {(at, k) for at, k, _ in items.find(raw)}
    assert len(within) > 100 and len(found & within) >= 0.9 * len(within)


def test_no_leak_is_lost_among_many_items():
    """Thousands of items and texts in one call: all pairs are told apart."""
    rng = random.Random(2)
    words = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20)) for _ in range(8_000)]
    items = decontam.Items([(i, w.encode()) for i, w in enumerate(words)], decontam.MAX_EDITS)
    got = items.find([f"begin here {words[i]} and end".encode() for i in range(0, 8_000, 8)])
    assert got == [(i, 8 * i, 0) for i in range(1_000)]


def test_items_are_found_wherever_they_begin():
    item = b"one two three four five six seven eight nine ten eleven twelve thirteen"
    items = decontam.Items([(1, item)], decontam.MAX_EDITS)
    texts = [b" ".join([b"x"] * n + [item]) for n in range(2 * max(decontam.STRIDES))]
    assert items.find(texts) == [(n, 0, 0) for n in range(len(texts))]
    assert items.find([b"", b" ", b"one two"]) == []
