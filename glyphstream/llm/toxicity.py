"""Toxicity by a weighted finite-state pattern grammar.

Tokens of a clause are read as symbols: insult, threat, target, negator, saying (verbs of saying and quotation marks), other. Five
transducers are composed, once, into one machine that scores a clause as the sum of the weights of all its accepting paths, each path being one match:

* *negation* marks the symbols that follow a negator within REACH tokens, *reported speech* those that follow a saying;
* *insult* takes one insult term of the clause, with the term's weight, damped by its marks; *target*, composed with it, makes the path
  count AIMED times if the clause names a person;
* *threat* takes a threatening verb, damped by its marks, and the next person after it.

The machine is negation o reported speech o (insult o target | threat). Clauses end at ``. ! ? ; :`` or a line break. Only clauses that hold an
insult or a threat can score, so an Aho-Corasick automaton over the lower-cased text finds those; each is then read once, in whole,
however long the text.

Weights: besides a small built-in lexicon, insults are learnt from labelled rows: words far likelier in toxic rows (by G2), and seen there
after several different words (so that the words of a toxic text with many copies are not learnt). A logistic regression on a text's clause
scores (best, second best, sum, how many score) calibrates them. Both are fitted on at most ``fit_rows`` labelled documents, those with the
smallest hash; this bound is the only sample, and every text is scored in whole.

Cases: a null or empty text has no clause and gets the score of texts without one; repeated rows get equal scores; a doc_id that labels holds
twice counts as toxic if any row says so; of documents with a like doc_id the least text is learnt from; without labelled rows of both kinds, fixed
coefficients serve; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FIT_ROWS = 20_000
INSULTS = "idiot idiots moron morons scum loser losers trash worthless pathetic disgusting stupid clown clowns imbecile imbeciles vermin filth filthy dumbass asshole bastard bitch retard retarded cretin degenerate subhuman dimwit jackass scumbag pig swine parasite idiota imbécil estúpido basura escoria asqueroso crétin ordure abruti minable débile dummkopf abschaum vollidiot trottel widerlich".split()
THREATS = "kill murder shoot stab hurt destroy burn hang strangle beat crush slaughter exterminate".split()
TARGETS = frozenset("you your yours yourself u he him she her they them their these those people everyone all we us tú usted ustedes ellos vous ils elles ihr euch sie du dich".split())
NEGATORS = frozenset("not no never nobody isn't aren't wasn't don't doesn't won't can't cannot neither nor without hardly nicht kein keine nie non pas jamais ni nunca".split())
SAYING = frozenset("said says say told tells claimed claims wrote writes quoted quotes reported reports alleged called calls according dijo dice dit sagte sagt".split())
QUOTES = frozenset("\"“”«»„")
NEGATED, REPORTED, AIMED, THREAT, REACH = 0.35, 0.5, 1.25, 3.0, 3
_CLAUSE_END = re.compile(r"[.!?;:\n]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»„]")
_WORD = re.compile(r"[^\W\d_]+")
N_FEATURES = 4
CLASSES = ("insult", "threat", "target", "negator", "saying", "other")


# ---------------------------------------------------------------- transducers


@dataclass
class Transducer:
    """Arcs (state, symbol read) -> [(symbol written, next state, weight, terms taken)], and final states with their weights. State 0 begins. An arc that
    takes a term counts the term's own weight besides its own."""

    arcs: dict = field(default_factory=dict)
    final: dict = field(default_factory=dict)

    def add(self, state, read, write, to, weight: float = 1.0, takes: int = 0) -> None:
        self.arcs.setdefault((state, read), []).append((write, to, weight, takes))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What ``b`` makes of what ``a`` writes: states are pairs, weights multiply."""
    by: dict = {}
    for (s, read), outs in a.arcs.items():
        by.setdefault(s, []).extend((read, *o) for o in outs)
    out, number, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
    while todo:
        s, t = todo.pop()
        here = number[s, t]
        if s in a.final and t in b.final:
            out.final[here] = a.final[s] * b.final[t]
        for read, write, to_a, w, takes in by.get(s, ()):
            for write_b, to_b, w_b, takes_b in b.arcs.get((t, write), ()):
                if (to_a, to_b) not in number:
                    number[to_a, to_b] = len(number)
                    todo.append((to_a, to_b))
                out.add(here, read, write_b, number[to_a, to_b], w * w_b, takes + takes_b)
    return out


def union(a: Transducer, b: Transducer) -> Transducer:
    """The paths of both, from a common begin that no arc leads back to."""
    out = Transducer()
    for k, t in enumerate((a, b)):
        for (s, read), outs in t.arcs.items():
            for write, to, w, takes in outs:
                out.add((k, s), read, write, (k, to), w, takes)
                if s == 0:
                    out.add(0, read, write, (k, to), w, takes)
        out.final |= {(k, s): w for s, w in t.final.items()}
        if 0 in t.final:
            out.final[0] = out.final.get(0, 0.0) + t.final[0]
    return out


def _marked() -> list[tuple]:
    return [(c, n, r) for c in CLASSES for n in (0, 1) for r in (0, 1)]


def negation() -> Transducer:
    """State: how many tokens a negator still reaches. Writes (class, negated)."""
    t = Transducer(final={k: 1.0 for k in range(REACH + 1)})
    for k in range(REACH + 1):
        for c in CLASSES:
            t.add(k, c, (c, int(k > 0)), REACH if c == "negator" else max(0, k - 1))
    return t


def reported_speech() -> Transducer:
    """State: has the clause had a saying? Writes (class, negated, reported)."""
    t = Transducer(final={0: 1.0, 1: 1.0})
    for k in (0, 1):
        for c in CLASSES:
            for n in (0, 1):
                t.add(k, (c, n), (c, n, k), 1 if c == "saying" else k)
    return t


def _damp(negated: int, reported: int) -> float:
    return (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)


def insult() -> Transducer:
    """State: has the path taken its term?"""
    t = Transducer(final={1: 1.0})
    for x in _marked():
        t.add(0, x, x, 0)
        t.add(1, x, x, 1)
        if x[0] == "insult":
            t.add(0, x, x, 1, _damp(*x[1:]), 1)
    return t


def target() -> Transducer:
    """State: has a person been named?"""
    t = Transducer(final={0: 1.0, 1: AIMED})
    for k in (0, 1):
        for x in _marked():
            t.add(k, x, x, 1 if x[0] == "target" else k)
    return t


def threat() -> Transducer:
    """State: before the verb, between it and the person, after."""
    t = Transducer(final={2: 1.0})
    for x in _marked():
        t.add(0, x, x, 0)
        t.add(2, x, x, 2)
        if x[0] == "threat":
            t.add(0, x, x, 1, THREAT * _damp(*x[1:]))
        t.add(1, x, x, 2 if x[0] == "target" else 1)
    return t


@lru_cache(maxsize=1)
def machine() -> tuple[list[dict], list[float]]:
    """The composed machine as (state -> symbol -> [(next state, weight, terms taken)], final weights), less states that reach no end."""
    whole = compose(compose(negation(), reported_speech()), union(compose(insult(), target()), threat()))
    back: dict = {}
    for (s, _), outs in whole.arcs.items():
        for _, to, _, _ in outs:
            back.setdefault(to, set()).add(s)
    live, todo = set(whole.final), list(whole.final)
    while todo:
        fresh = back.get(todo.pop(), set()) - live
        live |= fresh
        todo += fresh
    n = 1 + max(max(s for s, _ in whole.arcs), max(whole.final))
    arcs: list[dict] = [{} for _ in range(n)]
    for (s, read), outs in whole.arcs.items():
        if kept := [(to, w, takes) for _, to, w, takes in outs if to in live]:
            arcs[s][read] = kept
    return arcs, [whole.final.get(s, 0.0) for s in range(n)]


# ---------------------------------------------------------------- texts


@dataclass(frozen=True)
class Grammar:
    """Terms with their weights, and the coefficients that turn a text's clause scores into a probability."""

    insults: tuple[tuple[str, float], ...]
    threats: tuple[str, ...] = tuple(THREATS)
    coefficients: tuple[float, ...] = (-3.5, 2.0, 1.0, 1.0, 0.5)


@lru_cache(maxsize=4)
def _automaton(g: Grammar):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, _ in g.insults:
        a.add_word(w, len(w))
    for w in g.threats:
        a.add_word(w, len(w))
    a.make_automaton()
    return a, dict(g.insults), frozenset(g.threats)


def symbol(token: str, insults: dict[str, float], threats: frozenset) -> tuple[str, float]:
    """(class, weight of the term) of a token."""
    if token in insults:
        return "insult", insults[token]
    if token in threats:
        return "threat", 1.0
    if token in TARGETS:
        return "target", 1.0
    if token in NEGATORS:
        return "negator", 1.0
    return ("saying" if token in QUOTES or token in SAYING else "other"), 1.0


def clause_score(tokens: list[str], insults: dict[str, float], threats: frozenset) -> float:
    """Sum of the weights of all paths of the machine through the clause."""
    arcs, final = machine()
    now = {0: 1.0}
    for t in tokens:
        c, own = symbol(t, insults, threats)
        then: dict[int, float] = {}
        for s, x in now.items():
            for to, w, takes in arcs[s].get(c, ()):
                then[to] = then.get(to, 0.0) + (x * w * own if takes else x * w)
        now = then
    return sum(x * final[s] for s, x in now.items())


def clause_scores(text: str, g: Grammar) -> list[float]:
    """Scores of the text's clauses that hold an insult or a threat."""
    a, insults, threats = _automaton(g)
    low = text.lower()
    n = len(low)
    hits = []
    for end, size in a.iter(low):
        begin = end - size + 1
        if (begin == 0 or not low[begin - 1].isalpha()) and (end + 1 == n or not low[end + 1].isalpha()):
            hits.append(begin)
    hits.sort()
    scores, ends, begin, k = [], _CLAUSE_END.finditer(low), 0, 0
    while k < len(hits):
        end = next((m.start() for m in ends), n)
        if hits[k] < end:
            scores.append(clause_score(_TOKEN.findall(low, begin, end), insults, threats))
            while k < len(hits) and hits[k] < end:
                k += 1
        begin = end + 1
    return scores


def features(text: str | None, g: Grammar) -> tuple[float, ...]:
    """(best clause, second best, log of the sum, log of how many score)."""
    scores = sorted((s for s in clause_scores(text, g) if s > 0), reverse=True) if text else []
    if not scores:
        return (0.0,) * N_FEATURES
    return (scores[0], scores[1] if len(scores) > 1 else 0.0, math.log1p(sum(scores)), math.log1p(len(scores)))


def probability(x: np.ndarray, coefficients) -> np.ndarray:
    c = np.asarray(coefficients)
    return 1.0 / (1.0 + np.exp(-np.clip(c[0] + x @ c[1:], -30, 30)))


def score_column(text: Column, g: Grammar) -> Column:
    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        x = np.array([features(t, g) for t in s], dtype=float).reshape(-1, N_FEATURES)
        return pd.Series(probability(x, g.coefficients))

    return score(text)


# ---------------------------------------------------------------- fitting


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Grammar:
    """Learns insult terms and coefficients from labelled rows outside the held-out fifth."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    rows = stored(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"))
    base = [(w, 1.0) for w in INSULTS]
    terms = _learn_terms(rows)
    g = Grammar(tuple(sorted({**dict(base), **terms}.items())))

    def measure(batches):
        for pdf in batches:
            x = np.array([features(t, g) for t in pdf["text"]], dtype=float).reshape(-1, N_FEATURES)
            yield pd.DataFrame(x, columns=[f"x{i}" for i in range(N_FEATURES)]).assign(y=pdf["toxic"].to_numpy())

    got = rows.mapInPandas(measure, ", ".join(f"x{i} double" for i in range(N_FEATURES)) + ", y int").toPandas()
    x, y = got.drop(columns="y").to_numpy(dtype=float), (got["y"].to_numpy() > 0).astype(float)
    return Grammar(g.insults, g.threats, tuple(_logistic(x, y)) if 0 < y.sum() < len(y) else g.coefficients)


def _learn_terms(rows: DataFrame, least_g2: float = 18.0, contexts: int = 4) -> dict[str, float]:
    """Words that mark toxic rows, with weights of 0.5 to 1. Counted in each batch before the shuffle; as the rows are bounded, so are their words."""

    def count(batches):
        from zlib import crc32

        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for toxic, text in zip(pdf["toxic"], pdf["text"]):
                words = _WORD.findall(text.lower())
                before: dict[str, int] = {}
                for p, w in zip(["", *words], words):
                    before[w] = before.get(w, 0) | 1 << (crc32(p.encode()) % 63)
                for w, mask in before.items():
                    s = seen.setdefault(w, [0, 0, 0])
                    s[toxic > 0] += 1
                    if toxic > 0:
                        s[2] |= mask
            yield pd.DataFrame([(w, *s) for w, s in seen.items()], columns=["w", "clean", "toxic", "mask"])

    n = {bool(r[0]): r[1] for r in rows.groupBy(F.col("toxic") > 0).count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return {}
    c = rows.mapInPandas(count, "w string, clean long, toxic long, mask long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("mask")).alias("contexts"))
    a, b = F.col("toxic"), F.col("clean")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g2 = 2 * (part(a, (a + b) * n1 / (n1 + n0)) + part(b, (a + b) * n0 / (n1 + n0)))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    kept = c.where((F.col("contexts") >= contexts) & (odds >= 2.5)).withColumn("g2", g2).withColumn("odds", odds).where(F.col("g2") >= least_g2)
    return {r["w"]: min(1.0, r["odds"] / 6) for r in kept.collect()}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> np.ndarray:
    """Newton's method with a ridge on all but the intercept."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, g: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    d = docs.select("doc_id", score_column(F.col("text"), g).alias("score"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, g: Grammar) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted toxic."""
    return docs.where(score_column(docs["text"], g) < 0.5)
