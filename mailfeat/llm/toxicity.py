"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns the words of a clause into symbols (insult, threat,
target, negation, reporting word, quote, other).  Small transducers for aim,
threat, negation and reported speech each read those symbols and mark the
places where something happens in their scope; they are composed into one
machine, which is run over every clause that holds an insult or a threat.
What is scored are matched clauses: an insult counts by its weight, under the
mark that the composed machine gave it.  How much a plain, aimed, negated or
reported insult says is fitted on labelled rows, as are the words and word
beginnings in the lexicon; both on a bounded sample (PER_CLASS rows a label).

Defined results: null and empty texts get the score of a text without a
match; rows are scored one by one, so ties and repeated rows are alike; from
an empty table, or one without both labels, the grammar keeps its built-in
words and weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CACHE, bounded_sample, cut, held_out, map_columns, ridge_logistic

#: Labelled rows of each label that lexicon and weights are fitted on.
PER_CLASS = 2000
#: Terms the learned lexicon holds at most.
LEXICON_SIZE = 5000
PREFIXES = (4, 5, 6, 7, 8)
TOXIC_AT = 0.7

# Fixed word lists of the grammar.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile scumbag dumb idiota imbécil estúpido basura dummkopf abschaum trottel widerlich ordure connard minable crétin".split()
THREATS = "kill hurt destroy beat smash burn shoot stab töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours he she they him her them we us i du dich dir ihr sie er euch tu toi te vous lui elle ils eux tú vosotros usted él ella ellos te os".split()
NEGATIONS = "not no never nothing nor neither isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun aucune non nunca jamás ningún ninguna".split()
REPORTS = "said says say saying claims claimed called wrote writes quoted told sagt sagte sagen behauptet behauptete schrieb nannte dit disait déclare affirme écrit dice dijo decir afirma escribió llamó".split()

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_PIECE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»]")

Machine = dict  # (state, symbol) -> (next state, marks); a missing pair keeps the state
SYMBOLS = "ITUNRQO"


def _scope(opening: str, reach: int, mark: str, marked: str) -> Machine:
    """After an opening symbol, marked symbols within `reach` words carry the mark."""
    m: Machine = {}
    for left in range(reach + 1):
        for s in SYMBOLS:
            if s == opening:
                m[left, s] = (reach, frozenset())
            elif s != "Q":
                m[left, s] = (max(0, left - 1), frozenset({mark}) if left and s in marked else frozenset())
    return m


def _reported() -> Machine:
    """After a reporting word up to the end of the clause, and between quotes."""
    m: Machine = {(0, "R"): (1, frozenset()), (0, "Q"): (2, frozenset()), (1, "Q"): (2, frozenset()), (2, "Q"): (0, frozenset())}
    return m | {(k, s): (k, frozenset({"reported"})) for k in (1, 2) for s in "IT"}


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines side by side: states are pairs, marks are joined."""
    sa, sb = {0} | {n for n, _ in a.values()} | {s for s, _ in a}, {0} | {n for n, _ in b.values()} | {s for s, _ in b}
    out: Machine = {}
    todo, seen = [(0, 0)], {(0, 0)}
    while todo:
        x, y = todo.pop()
        for s in SYMBOLS:
            nx, mx = a.get((x, s), (x, frozenset()))
            ny, my = b.get((y, s), (y, frozenset()))
            assert nx in sa and ny in sb
            out[(x, y), s] = ((nx, ny), mx | my)
            if (nx, ny) not in seen:
                seen.add((nx, ny))
                todo.append((nx, ny))
    return out


def _numbered(m: Machine) -> Machine:
    """The same machine with 0, 1, 2... as states, the start being 0."""
    names = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in m))}
    return {(names[s], c): (names[n], marks) for (s, c), (n, marks) in m.items()}


@lru_cache(maxsize=1)
def grammar() -> Machine:
    aimed = _scope("U", 4, "aimed", "IT")
    negated = _scope("N", 2, "negated", "IT")
    return _numbered(compose(_numbered(compose(aimed, negated)), _reported()))


KINDS = ("plain", "aimed", "negated", "reported")
N_FEATURES = len(KINDS) + 3


@dataclass
class Lexicon:
    """Weights of words and of word beginnings (these end with a star)."""

    weights: dict[str, float] = field(default_factory=lambda: {w: 4.0 for w in INSULTS})

    def insult(self, word: str) -> float:
        best = self.weights.get(word, 0.0)
        for k in PREFIXES:
            if len(word) >= k:
                best = max(best, self.weights.get(word[:k] + "*", 0.0))
        return best


class Tagger:
    """The lexical transducer: word to (symbol, weight), remembered within bounds."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.known, self.dull = lexicon, {}, set()
        self.fixed = {w: s for words, s in ((REPORTS, "R"), (NEGATIONS, "N"), (TARGETS, "U"), (THREATS, "T")) for w in words}

    def hot(self, words: set[str]) -> bool:
        """Whether one of the words is an insult or a threat."""
        new = words - self.dull
        if len(self.dull) > WORD_CACHE:
            self.dull.clear()
        found = False
        for w in new:
            if self.tag(w)[0] in "IT":
                found = True
            else:
                self.dull.add(w)
        return found

    def tag(self, word: str) -> tuple[str, float]:
        if word in self.fixed:
            return self.fixed[word], 0.0
        weight = self.lexicon.insult(word)
        return ("I", weight) if weight > 0 else ("O", 0.0)


def clause_matches(clause: str, tagger: Tagger) -> tuple[dict[str, float], int]:
    """(insult weight by kind, aimed threats) of one clause, by the composed machine."""
    out, threats, state = dict.fromkeys(KINDS, 0.0), 0, 0
    pieces = _PIECE.findall(clause)
    tags = [("Q", 0.0) if not p[0].isalpha() else tagger.tag(p) for p in pieces]
    table = grammar()
    for i, (symbol, weight) in enumerate(tags):
        state, marks = table.get((state, symbol), (state, frozenset()))
        if symbol == "I":
            after = any(s == "U" for s, _ in tags[i + 1 : i + 4])
            kind = next((k for k in ("negated", "reported") if k in marks), "aimed" if after or "aimed" in marks else "plain")
            out[kind] += weight
        elif symbol == "T" and not marks & {"negated", "reported"} and "aimed" in marks and any(s == "U" for s, _ in tags[i + 1 : i + 3]):
            threats += 1
    return out, threats


def features(text: str | None, tagger: Tagger) -> list[float]:
    """Of a text: the square root of the summed weight of each kind over its matched clauses, the heaviest clause, threats, matched clauses."""
    low = (text or "").lower()
    if not tagger.hot(set(_WORD.findall(low))):
        return [0.0] * N_FEATURES
    total, top, threats, matched = dict.fromkeys(KINDS, 0.0), 0.0, 0, 0
    for clause in _CLAUSE.split(low):
        if not clause or not tagger.hot(set(_WORD.findall(clause))):
            continue
        got, t = clause_matches(clause, tagger)
        for k in KINDS:
            total[k] += got[k]
        top = max(top, got["plain"] + got["aimed"])
        threats += t
        matched += any(got.values())
    return [math.sqrt(total[k]) for k in KINDS] + [min(top, 10.0), math.sqrt(threats), math.log1p(matched)]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: list[float]  # by feature, then the intercept


#: Weights where no labelled rows are at hand (fixed values).
DEFAULT_WEIGHTS = [1.2, 1.6, 0.3, 0.4, 0.5, 2.0, 0.2, -3.0]


def _terms(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if len(w) >= 3}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, size: int = LEXICON_SIZE) -> Lexicon:
    """Terms that toxic rows of the sample have far oftener than the others.

    A term's log-odds is its weight; it must pass a likelihood-ratio bound that
    rises with the number of terms, so that chance finds stay out.
    """

    def count(cols: dict) -> dict:
        pos, neg = Counter(), Counter()
        for t, y in zip(cols["text"], cols["toxic"]):
            (pos if y else neg).update(_terms(t))
        keys = list(pos.keys() | neg.keys())
        return {"term": keys, "pos": [pos[k] for k in keys], "neg": [neg[k] for k in keys]}

    counts = cut(map_columns(sample.select("text", "toxic"), count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    bound = 2 * math.log(max(counts.count(), 2)) + 6
    n1, n0 = float(n_toxic), float(n_clean)
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    every = (a + b) / F.lit(n1 + n0)
    gain = 2 * (part(a, n1 * every) + part(n1 - a, n1 * (1 - every)) + part(b, n0 * every) + part(n0 - b, n0 * (1 - every)))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    known = counts.where((F.col("pos") >= 3) & (odds >= 2.5)).select("term", odds.alias("w"), gain.alias("g")).where(F.col("g") >= bound)
    best = known.orderBy(F.desc("g"), "term").limit(size).collect()
    return Lexicon(Lexicon().weights | {r.term: float(r.w) for r in best})


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Lexicon and weights from labelled rows outside the held-out third; an id with both labels counts as toxic."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = bounded_sample(known, "toxic", per_class)
    sample = cut(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").repartition(16, "doc_id"))
    n = dict(sample.groupBy("toxic").count().collect())
    if not n.get(0) or not n.get(1):
        return ToxicityModel(Lexicon(), DEFAULT_WEIGHTS)
    lexicon = learn_lexicon(sample, n[1], n[0])
    got = sorted(map(tuple, _featured(sample, lexicon, "toxic").collect()))
    y = np.array([r[1] for r in got], float)
    w = ridge_logistic(np.array([r[2] for r in got]), y, 0.5)
    whole = dict(known.groupBy("toxic").count().collect())  # the sample's odds give way to those of all labelled rows
    w[-1] += math.log(whole[1] / whole[0]) - math.log(n[1] / n[0])
    return ToxicityModel(lexicon, w.tolist())


def _featured(docs: DataFrame, lexicon: Lexicon, *carry: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    held: list[Tagger] = []

    def run(cols: dict) -> dict:
        if not held:
            held.append(Tagger(shared.value))
        out = {"doc_id": cols["doc_id"], "features": [features(t, held[0]) for t in cols["text"]]}
        return out | {c: cols[c] for c in carry}

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    return map_columns(pick, run, f"doc_id long{kinds}, features array<double>")


def score_toxicity(docs: DataFrame, model: ToxicityModel, toxic_at: float = TOXIC_AT) -> DataFrame:
    """doc_id, held_out, score, predicted and the clause features of every whole text."""
    rows = _featured(docs, model.lexicon)
    z = F.lit(model.weights[-1])
    for i, w in enumerate(model.weights[:-1]):
        z = z + F.lit(w) * F.col("features")[i]
    score = 1.0 / (1.0 + F.exp(-z))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= toxic_at).cast("int").alias("predicted"), F.col("features")[len(KINDS)].alias("top_clause"))
