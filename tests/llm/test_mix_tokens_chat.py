import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphstream.llm import chat, mixing, tokens
from glyphstream.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, extra int, size int"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, goal, out = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        total = sum(w[s] for s in left)
        full = {s for s in left if goal * w[s] / total >= 2 * sizes[s]}
        if not full:
            return {**out, **{s: goal * w[s] / total for s in left}}
        for s in full:
            out[s] = 2.0 * sizes[s]
            goal -= out[s]
        left -= full
    return out


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 50), rng.choice(["hot"] * 6 + ["a", "é", None, ""]), 1, 2) for i in range(600)] + [(7, None, "nulls", 1, 2), (None, "a b", "hot", 1, 2), (3, "x", "hot", 1, 2), (3, "x", "hot", 1, 2)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(d, range_rows=20).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(d.repartition(7), range_rows=20).collect()))
    assert mixing.mix(d.where("false")).count() == 0


def test_tokens_equal_greedy_cutting(spark, tmp_path):
    import base64

    rng = random.Random(9)
    pieces = [bytes([c]) for c in range(256)] + [b"ab", b"abc", b"abcde", b"bcd", b"cdx", b" a", b" abcd", "é".encode(), b" ab", b"aaaa"]
    place = tmp_path / "v"
    place.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
    known, longest = set(pieces), max(map(len, pieces))

    def brute(text):
        n = 0
        for w in (text or "").encode().split():
            s, i = b" " + w, 0
            while i < len(s):
                i = next(j for j in range(min(len(s), i + longest), i, -1) if s[i:j] in known)
                n += 1
        return n

    texts = [None, "", " \t\n", "abcdx", "é", "a" * 5000, "ab " * 3000] + ["".join(rng.choice("abcdexé \n") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    d = spark.createDataFrame([(i, t, None, 1, 2) for i, t in enumerate(texts)] + [(0, None, None, 1, 2), (None, "ab", None, 1, 2)], DOCS)
    got = tokens.count_tokens(d, str(place)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = "ab" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_tokens, r.n_words) == (brute(t), len((t or "").encode().split()))
    assert tokens.count_tokens(d.where("false"), str(place)).count() == 0
    with pytest.raises(ValueError):
        tokens.build([b"a"])


def test_op2_on_public_vocabulary(spark):
    vocabulary = set(tokens.read_vocabulary())
    longest = max(map(len, vocabulary))
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in Q.op2_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(d)
    for r in d[:40]:
        n = 0
        for w in (r.text or "").encode().split():
            s, i = b" " + w, 0
            while i < len(s):
                i = next(j for j in range(min(len(s), i + longest), i, -1) if s[i:j] in vocabulary)
                n += 1
        assert got[r.doc_id] == n


TURNS = "conv_id long, turn long, role string, text string, extra string"


def test_chat_round_trip(spark):
    rng = random.Random(1)
    alphabet = ["</s>", "[INST]", "\\", "<", "[", "]", "l", "b", "e", "\\l", "é", "\n", "<s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[x]"]), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))), "z") for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(90, None, None, None, "z"), (90, 1, "assistant", None, "z"), (91, 1, "user", "same", "z"), (91, 1, "user", "same", "z"), (None, 0, "assistant", "lone " * 5000, "z")]
    d = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(d)).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(d.where("false"))).count() == 0


def test_layouts(spark):
    d = spark.createDataFrame([(1, "sum", None, "3"), (2, "say", "it", "no")], "id long, instruction string, input string, output string")
    got = [tuple(r) for r in chat.turns_of_table(d, "id").orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "user", "sum"), (1, 1, "assistant", "3"), (2, 0, "user", "say"), (2, 1, "user", "it"), (2, 2, "assistant", "no")]
    m = spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "id long, conversations array<struct<from:string,value:string>>")
    assert [r.role for r in chat.turns_of_table(m, "id").orderBy("turn").collect()] == ["user", "assistant"]
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_table(spark.range(1).withColumn("strange", F.lit(1)), "id")
    j = spark.createDataFrame([(1, '{"prompt": "p", "response": "r"}'), (2, '{"x": 1}'), (3, None)], "id long, raw string")
    rows = chat.turns_of_json(j, "id", "raw").orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.role, r.text) for r in rows] == [(1, "user", "p"), (1, "assistant", "r"), (2, None, None), (3, None, None)]
    odd = ['{"messages": [{"role": "human", "content": "a"}, {"content": 5}, {"role": ["x"], "content": null}]}', '{"messages": [{"role": "u"}, {"content": 5}]}', '{"turn": 3, "role": "human", "text": "t"}', '{"turn": "x", "role": null, "text": "t"}', "[1]", '{"messages": []}']
    j = spark.createDataFrame(list(enumerate(odd)), "id long, raw string")
    by = {}
    for r in chat.turns_of_json(j, "id", "raw").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert sorted(by[1], key=str) == [(0, "u", None), (1, None, "5")] and by[2] == [(3, "human", "t")] and by[3] == [(None, None, "t")] and by[4] == by[5] == [(None, None, None)]
    assert by[0] == [(None, None, None)]  # its roles are no plain fields: another layout


def test_rows_by_turn_are_a_layout(spark):
    d = spark.createDataFrame([(1, 2, "human", "b"), (1, 1, "user", None)], TURNS.replace(", extra string", ""))
    assert sorted(chat.turns_of_table(d, "conv_id").collect(), key=str) == sorted(d.collect(), key=str)
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_table(d.withColumn("more", F.lit(1)), "conv_id")
