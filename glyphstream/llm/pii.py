"""Personal data: exact base patterns, and a linear-chain conditional random field that adds spans.

Base patterns are matched leftmost and without overlaps per kind, in time linear in the text. The field labels
white-space-delimited tokens with O, email, ip, card or phone from word-shape features of the token and its neighbours; it is
trained at first use on the small labelled table below and decoded by Viterbi in numpy batches. Tokens without a digit, ``@`` or a
bracketed ``at``/``dot`` (and not beside one) can only be O; a token fixed to O splits the chain exactly, so only runs of
other tokens are decoded, whole texts notwithstanding. Spans of the field that touch a base span are dropped, as are cards that fail Luhn's check.

Cases: a null text counts as empty; an empty text has no spans; repeated rows give equal rows; very long texts and tokens
are read in whole. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that the pattern fails on fails from each of its digits, so only run starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]", re.I)
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as in KINDS, then by start."""
    spans: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            spans.append(("email", begin, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


# ---------------------------------------------------------------- the field

LABELS = ("O", *KINDS)
L = len(LABELS)
#: the labelled table: tokens of a kind are marked <kind ...>
TABLE = """
call me at <phone (555) 123-4567> or at <phone 555-123-4567> today
phone: <phone 555.010.2233> fax: <phone 555 010 2244>
tel <phone 020 7946 0958> ask for room 12
mobile <phone 07911 123456> after 18:30
reach us on <phone 0049 30 901820> or by post
telephone <phone 030-90182000> extension 14
phone <phone 1-800-555-0199> is free
tel. <phone (0) 171 5550123> weekdays 9-17
please dial <phone 212-555-0187>, then 3
number <phone (212) 555 0143> or <phone 5550143200>
write to <email john [at] example [dot] com> for details
mail <email jane(at)example.org> or <email bob(at)mail.example.net>
contact <email admin [at] site.example.com> by 12 May
email <email user2(at)host.example> version 3
the mail is <email sales [at] shop9 [dot] example>
server <ip 2001:db8::8a2e:370:7334> port 443
host <ip fe80::1ff:fe23:4567:890a> is down
address <ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334> in use
connect to <ip 10[.]0[.]0[.]17> on port 22
ip <ip 192[.]168[.]1[.]254> was blocked
card <card 4111.1111.1111.1111> expires 12/27
visa <card 5500_0000_0000_0004> code 123
card number <card 4111/1111/1111/1111> was charged 25.00
pay with <card 3400.000000.00009> today
ring <phone 0161 496 0018> before noon
her number is <phone 617-555-0132> at work
office <phone (415) 555-0199> or <phone 415.555.0143> after six
phone <phone 089/636-48018> in Munich
call <phone 1 (800) 555-0123> for help
contact us: <phone 00 33 1 70 18 99 00> in Paris
mobile: <phone 0151-23456789> or mail us
text <phone 5550199> now
hotline <phone 0800 1234567> is open 24 hours
send it to <email info [at] firm [dot] co [dot] uk> by 5 pm
email <email anna.b(at)web.example> about order 77
ask <email help [at] desk.example.net> first
mail to <email x_y (at) lab (dot) example> on 3 June
<email peter[at]home[dot]example> wrote 2 days ago
ip <ip fd00::1:2> and gateway <ip 10[.]1[.]2[.]3> both
ping <ip 2001:db8:0:1::1> failed 3 times
blocked <ip 203[.]0[.]113[.]9> at 10:15
amex <card 3782.822463.10005> until 05/29
mastercard <card 5555.5555.5555.4444> was declined
charged to <card 4012_8888_8888_1881> on 1 May
card no <card 6011/1111/1111/1117> is valid
the sum of 3000 2000 1000 4000 is 10000
serial 1234-5678-9012 of 2019
lot 4000 0000 1111 2222 was sold
codes 55 66 77 88 and 99 11
flight 370 left at 00:41 on 8 March 2014
at 12:30:45 and 2024-01-15T10:20:30Z
ratio 16:9 or 4:3 in 1080p
chapters 1:2:3 and 4:5:6
room [at] the end of floor 2
see [1] [2] and (3) in 2020
call it 2000 or 2001 at most
phone 7 and mobile 8 were sold in 2017
number 42 is the answer
the number 1000000 is large
reach 10000 users in 30 days
mail 3 of 12 arrived
host 5 has 16 cores and server 7 has 32
card 12 of 52 and card 13 of 52
sizes 10.5 11.5 and 12.5
sums of 1.000.000 and 2,500,000.50
10.1234/abcd.5678 is a doi
win 1-0 or 2-1 at 15-3-2021
from 1999 to 2004 there were 12 cases
version 1.2.3 was released on 2024-01-15
chapter 12 page 345 line 6
the price is 1,299.00 or 1.299,00 in all
between 10:30 and 11:45 on 3 May 2021
a total of 1234567 rows and 89 columns
see section 4.2.1 and figure 7
ISBN 978-3-16-148410-0 costs 20 euros
order 20240115-0042 has 3 items
room 101 floor 5 block 12-14
token = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6" end
id 550e8400-e29b-41d4-a716-446655440000 was found
license 3.0 and 4.0 of 2007
key sk-12ab34cd56ef78ab90 in 2023
scores 3-1 2-2 and 0-0 on day 2
the years 1914-1918 and 1939-1945
around 100 200 300 400 500 people
pi is 3.14159265358979 and e is 2.718281828
@handle wrote 5 posts @ 10 each
width 1920x1080 at 60 or 4k
no 7 of 12 in week 3
10 20 30 40 50 60 70
2020 2021 2022 2023 2024
1 2 3 4 5 6 7 8 9 10 11 12
a1 b2 c3 d4 e5 f6
timestamp 1700000000 and 1700003600
zip 12345 or 12345-6789 in area 51
""".strip().splitlines()
_MARK = re.compile(r"<(email|ip|card|phone) ([^>]*)>|(\S+)")
_CUES = {w: k for k, ws in {"phone": "phone phone: tel tel. tel: telephone mobile call fax fax: dial reach number", "email": "mail email e-mail write contact", "ip": "ip server host address connect", "card": "card visa mastercard pay amex"}.items() for w in ws.split()}
N_HASH = 4096
_RUNS = re.compile(r"([0-9]+)|([a-z]+)|([A-Z]+)|([^\W_]+)|(.)", re.S)


def shape(token: str) -> str:
    """Runs of like characters as one sign, with its class of length (1, 2, 3, more) for digits."""
    out = []
    for m in _RUNS.finditer(token):
        out.append("d" + str(min(4, len(m[1]))) if m[1] else "x" if m[2] else "X" if m[3] else "w" if m[4] else m[5])
    return "".join(out)


def signs(shape_: str) -> str:
    """The signs of a shape in the order in which they come up first."""
    return "".join(dict.fromkeys(c for c in shape_ if not c.isdigit()))


def token_features(tokens: list[str], i: int) -> list[int]:
    """Hashed features of token i: word shapes of it and its neighbours, digit count, marks and cue words."""
    from zlib import crc32

    t = tokens[i]
    before = tokens[i - 1] if i else "^"
    after = tokens[i + 1] if i + 1 < len(tokens) else "$"
    digits = min(20, sum(c.isdigit() for c in t))
    s = shape(t)
    own, left, right = signs(s), signs(shape(before)), signs(shape(after))
    names = [f"s={s}", f"n={digits}", f"k={own}", f"p={left}|{own}", f"a={own}|{right}", f"d={digits > 6},{'-' in t},{'.' in t},{':' in t},{'(' in t}", f"b={own},{digits}"]
    for j in (1, 2, 3):
        if i >= j and (cue := _CUES.get(tokens[i - j].lower().rstrip(":,."))):
            names.append(f"c{cue}{digits // 4},{own}")
    for sign in ("(at)", "[at]", "[dot]", "(dot)", "::", "[.]"):
        if sign in t.lower():
            names.append(f"m{sign}")
        if sign in before.lower() or sign in after.lower():
            names.append(f"M{sign}")
    return [0, *(1 + crc32(x.encode()) % (N_HASH - 1) for x in names)]


def candidates(tokens: list[str]) -> np.ndarray:
    """Tokens that may be other than O."""
    own = np.fromiter((_ANY.search(t) is not None for t in tokens), dtype=bool, count=len(tokens))
    joint = np.fromiter((("[" in t or "(" in t) and re.fullmatch(r"[(\[](?:at|dot)[)\]]", t.lower()) is not None for t in tokens), dtype=bool, count=len(tokens))
    if joint.any():
        own[1:] |= joint[:-1]
        own[:-1] |= joint[1:]
    return own


def _labelled() -> list[tuple[list[str], list[int]]]:
    rows = []
    for line in TABLE:
        tokens, tags = [], []
        for m in _MARK.finditer(line):
            for t in (m[2] or m[3]).split():
                tokens.append(t)
                tags.append(LABELS.index(m[1]) if m[1] else 0)
        rows.append((tokens, tags))
    return rows


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, transition weights), by gradient ascent on the labelled table's log likelihood; deterministic."""
    chains = []
    for tokens, tags in _labelled():
        can = candidates(tokens)
        chains += [([token_features(tokens, i) for i in r], [tags[i] for i in r]) for r in _runs(can)]
    w, t = np.zeros((N_HASH, L)), np.zeros((L, L))
    gw2, gt2 = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for _ in range(60):
        gw, gt = -0.02 * w, -0.02 * t
        for feats, tags in chains:
            _, ge, g = likelihood(np.array([w[f].sum(0) for f in feats]), t, tags)
            for i, f in enumerate(feats):
                np.add.at(gw, f, ge[i])
            gt += g
        gw2 += gw**2
        gt2 += gt**2
        w += 0.5 * gw / np.sqrt(gw2)
        t += 0.5 * gt / np.sqrt(gt2)
    return w, t


def likelihood(e: np.ndarray, t: np.ndarray, tags: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of a chain's labels, and its gradients by emissions and transitions (by forward and backward sums). A chain begins after an O and ends before one."""
    n = len(e)
    a, b = np.zeros((n, L)), np.zeros((n, L))
    a[0] = e[0] + t[0]
    for i in range(1, n):
        x = a[i - 1][:, None] + t
        a[i] = e[i] + x.max(0) + np.log(np.exp(x - x.max(0)).sum(0))
    b[-1] = t[:, 0]
    for i in range(n - 2, -1, -1):
        x = t + (e[i + 1] + b[i + 1])[None, :]
        b[i] = x.max(1) + np.log(np.exp(x - x.max(1)[:, None]).sum(1))
    z = np.logaddexp.reduce(a[-1] + b[-1])
    p = np.exp(a + b - z)
    ge, gt, path = -p, np.zeros_like(t), [0, *tags, 0]
    ge[np.arange(n), tags] += 1
    gt[0] -= p[0]
    gt[:, 0] -= p[-1]
    for i in range(1, n):
        gt -= np.exp(a[i - 1][:, None] + t + (e[i] + b[i])[None, :] - z)
    for i, j in zip(path, path[1:]):
        gt[i, j] += 1
    return float(sum(e[i, y] for i, y in enumerate(tags)) + sum(t[i, j] for i, j in zip(path, path[1:])) - z), ge, gt


def _runs(can: np.ndarray) -> list[range]:
    edge = np.diff(can.astype(np.int8), prepend=0, append=0)
    return [range(a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def viterbi(emissions: list[np.ndarray], t: np.ndarray) -> list[np.ndarray]:
    """Best labels of each chain; chains of like length are decoded together, step by step over the batch."""
    best: list[np.ndarray] = [None] * len(emissions)  # type: ignore[list-item]
    order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
    at = 0
    while at < len(order):
        n = len(emissions[order[at]])
        to = at
        while to < len(order) and len(emissions[order[to]]) == n and to - at < 4096:
            to += 1
        e = np.stack([emissions[i] for i in order[at:to]])
        s, back = e[:, 0] + t[0], np.zeros((n, to - at, L), dtype=np.int8)
        for k in range(1, n):
            x = s[:, :, None] + t[None]
            back[k] = x.argmax(1)
            s = x.max(1) + e[:, k]
        y = np.zeros((to - at, n), dtype=np.int8)
        y[:, -1] = (s + t[:, 0]).argmax(1)
        rows = np.arange(to - at)
        for k in range(n - 1, 0, -1):
            y[:, k - 1] = back[k, rows, y[:, k]]
        for i, r in zip(order[at:to], y):
            best[i] = r
        at = to
    return best


_TOKENS = re.compile(r"\S+")
_EDGE = ".,;:!?\"'<>"


def _valid(kind: str, s: str) -> bool:
    digits = "".join(c for c in s if c in "0123456789")
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "email":
        return "at" in s.lower() or "@" in s
    return s.count(":") >= 2 or s.count(".") == 3


def added_spans(texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """Spans of the field in each text that touch no base span."""
    w, t = model()
    chains, where = [], []
    spans: list[list[Span]] = [[] for _ in texts]
    tokens_of = {}
    for k, text in enumerate(texts):
        if _ANY.search(text) is None:
            continue
        places = [m.span() for m in _TOKENS.finditer(text)]
        tokens = [text[a:b] for a, b in places]
        tokens_of[k] = places
        for r in _runs(candidates(tokens)):
            chains.append(np.array([w[token_features(tokens, i)].sum(0) for i in r]))
            where.append((k, r))
    for (k, r), y in zip(where, viterbi(chains, t)):
        i = 0
        while i < len(y):
            j = i + 1
            while j < len(y) and y[j] == y[i]:
                j += 1
            if y[i]:
                a, b = tokens_of[k][r[i]][0], tokens_of[k][r[j - 1]][1]
                while a < b and texts[k][a] in _EDGE:
                    a += 1
                while a < b and texts[k][b - 1] in _EDGE:
                    b -= 1
                kind = LABELS[y[i]]
                if _valid(kind, texts[k][a:b]) and not any(p < b and a < q for _, p, q in bases[k]):
                    spans[k].append((kind, a, b))
            i = j
    return spans


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, all spans) of each text."""
    bases = [base_spans(t) if _ANY.search(t) else [] for t in texts]
    return bases, [b + a for b, a in zip(bases, added_spans(texts, bases))]


def find_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> (base spans of each kind), base_sha256, spans (all, listed), n_added for every row."""
    model()  # trained here, so that a mistake in the table shows at once

    def run(batches):
        for pdf in batches:
            bases, spans = find(["" if t is None else t for t in pdf["text"]])
            out = {"doc_id": pdf["doc_id"]}
            out |= {f"n_{kind}": [sum(s[0] == kind for s in b) for b in bases] for kind in KINDS}
            out["base_sha256"] = [hashlib.sha256(listed(b).encode()).hexdigest() for b in bases]
            out["spans"] = [listed(s) for s in spans]
            out["n_added"] = [len(s) - len(b) for s, b in zip(spans, bases)]
            yield pd.DataFrame(out)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a nullable id would become a float in pandas: it passes as text
    d = d.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    got = d.mapInPandas(run, "doc_id string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def redacted(text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    model()

    @F.pandas_udf("string")
    def redact(s: pd.Series) -> pd.Series:
        texts = ["" if t is None else t for t in s]
        _, spans = find(texts)
        return pd.Series([raw if raw is None else replace(t, x) for raw, t, x in zip(s, texts, spans)], dtype=object)

    return redact(text)


def replace(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
