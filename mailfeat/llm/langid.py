"""Language of words and texts by a linear-chain conditional random field.

Every word has hashed features: its beginnings and ends, its character
n-grams, the word itself and the languages in whose lexicon of frequent words
it stands.  Labels are languages; emission and transition weights are learned
together by maximum likelihood, with forward-backward for the gradient, from
windows of labelled texts, a part of them joined from two languages so that
the transitions learn how rarely a switch happens.  Every sampled word
trains: windows are cut to sequences of SPAN words, the last one as short as
it comes.  A text's words are
labelled by forward-backward, and the text's language is the one with the
largest sum of word posteriors.

Learned from a bounded sample: about PER_LANG texts of each language, WINDOW
characters of each, however many languages there are.  Defined results: a null text or one without a letter is
`und` with score 0, and so is every text if there was nothing to learn from;
a language none of whose sampled texts has a word is not learned; of equal
sums the first language by name wins; repeated rows are repeated.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_columns, mix64, run_hashes, text_window

#: Labelled texts of each language the model is fitted on, and characters of each.
PER_LANG, WINDOW = 150, 1500
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SPAN = 24  # words in a training sequence
LEXICON = 300  # frequent words of each language
AFFIXES, GRAMS = (1, 2, 3, 4), (2, 3)
#: Characters that are looked at side by side.
CHARS_AT_ONCE = 1 << 20
#: Numbers that the fit looks up at a time.
AT_ONCE = 1 << 25


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """The words (runs of letters, in lower case) of some texts, one after the other."""

    hashes: np.ndarray  # of each word
    counts: np.ndarray  # words of each text
    types: np.ndarray  # distinct hashes
    type_of: np.ndarray  # place of each word's hash among these
    features: np.ndarray  # buckets of the types' features, type by type
    first: np.ndarray  # where each type's features begin


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def words_of(texts: list[str | None], lexicons: list[np.ndarray]) -> Words:
    """Words and hashed features (affixes, n-grams, the word itself, its lexicons) of texts."""
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 1 for t in low], np.int64)
    code = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    h, start, end = run_hashes(code, _letters()[code])
    counts = np.bincount(np.searchsorted(np.cumsum(size), start, "right"), minlength=len(low))
    types, at, back = np.unique(h, return_index=True, return_inverse=True)
    start, end = start[at], end[at]
    owner, found = [np.arange(len(types))], [_bucket(types, 0)]
    code = code.astype(np.uint64)
    prefix = suffix = np.zeros(len(types), np.uint64)
    for k in AFFIXES:
        long = end - start >= k
        prefix = prefix * np.uint64(1114129) + np.where(long, code[np.minimum(start + k - 1, end - 1)], 0).astype(np.uint64)
        suffix = suffix * np.uint64(1114129) + np.where(long, code[np.maximum(end - k, start)], 0).astype(np.uint64)
        for kind, affix in ((2 * k, prefix), (2 * k + 1, suffix)):
            owner.append(np.flatnonzero(long))
            found.append(_bucket(affix[long], kind))
    length = end - start
    for n in GRAMS:  # over ^word$, the edges being code points 1 and 2
        times = length + 3 - n
        has = times > 0
        who = np.repeat(np.flatnonzero(has), times[has])
        offset = np.arange(len(who)) - np.repeat(np.cumsum(times[has]) - times[has], times[has]) - 1
        gram = np.zeros(len(who), np.uint64)
        for j in range(n):
            place = start[who] + offset + j
            unit = np.where(place < start[who], 1, np.where(place >= end[who], 2, code[np.clip(place, 0, len(code) - 1)])).astype(np.uint64)
            gram = gram * np.uint64(1114129) + unit
        owner.append(who)
        found.append(_bucket(gram, 20 + n))
    for i, lex in enumerate(lexicons):
        known = np.flatnonzero(np.isin(types, lex))
        owner.append(known)
        found.append(np.full(len(known), _bucket(np.array([i], np.uint64), 40)[0]))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return Words(h, counts, types, back, found[order], np.searchsorted(owner[order], np.arange(len(types))))


@dataclass
class Crf:
    langs: list[str]
    lexicons: list[np.ndarray]  # hashes of frequent words
    weights: np.ndarray  # bucket x language
    transitions: np.ndarray  # from x to

    def emissions(self, words: Words) -> np.ndarray:
        """Scores of each word's type, by language."""
        return np.add.reduceat(self.weights[words.features], words.first, axis=0)


#: Words of a block; the blocks of all texts go through the chain side by side.
BLOCK = 32


def forward_backward(e: np.ndarray, a: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Word posteriors (word, label) of texts that stand one after the other.

    e: emission scores (word, label); a: transition scores; counts: words of
    each text.  Every text is cut into blocks.  A block's steps multiply to
    one matrix; the vectors between blocks follow from these matrices, text by
    text side by side, and then all blocks are gone through from both ends.
    """
    k, t = e.shape[1], np.exp(a)
    blocks = -(-counts // BLOCK)
    n, first = int(blocks.sum()), np.cumsum(blocks) - blocks
    within = np.arange(len(e)) - np.repeat(np.cumsum(counts) - counts, counts)
    block = np.repeat(first, counts) + within // BLOCK
    x, real = np.ones((BLOCK, n, k), e.dtype), np.zeros((BLOCK, n), bool)
    x[within % BLOCK, block] = np.exp(e - e.max(1, keepdims=True))
    real[within % BLOCK, block] = True
    opens = np.zeros(n, bool)
    opens[first[counts > 0]] = True  # the first word of a text follows no other

    def one(m: np.ndarray) -> np.ndarray:
        return m / m.sum(-1, keepdims=True)

    whole = np.where(opens[:, None, None], np.ones_like(t), t) * x[0][:, None, :]
    for i in range(1, BLOCK):
        step = ((whole.reshape(-1, k) @ t).reshape(n, k, k)) * x[i][:, None, :]
        whole = np.where(real[i][:, None, None], step / step.sum((1, 2), keepdims=True), whole)
    enter, leave = np.full((n, k), 1.0 / k, e.dtype), np.ones((n, k), e.dtype)
    texts = np.argsort(-blocks, kind="stable")
    for i in range(1, int(blocks.max(initial=0))):
        here = first[texts[: np.searchsorted(-blocks[texts], -i, "left")]] + i
        enter[here] = one((enter[here - 1][:, None, :] @ whole[here - 1])[:, 0])
    for i in range(int(blocks.max(initial=0)) - 1, 0, -1):
        here = first[texts[: np.searchsorted(-blocks[texts], -i, "left")]] + i
        leave[here - 1] = one((whole[here] @ leave[here][:, :, None])[:, :, 0])
    alpha = np.empty_like(x)
    alpha[0] = one(np.where(opens[:, None], 1.0, enter @ t).astype(e.dtype) * x[0])
    for i in range(1, BLOCK):
        alpha[i] = np.where(real[i][:, None], one((alpha[i - 1] @ t) * x[i]), alpha[i - 1])
    for i in range(BLOCK - 1, -1, -1):
        back = one((x[i] * leave) @ t.T)
        alpha[i] = one(alpha[i] * leave)
        leave = np.where(real[i][:, None], back, leave)
    return alpha[within % BLOCK, block]


def _pairwise(e: np.ndarray, a: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For training sequences, filled up to equal length where not real: posteriors (0 there), expected transitions, summed log normaliser."""
    steps, n, k = e.shape
    top = e.max(2, keepdims=True)
    x, t = np.exp(e - top), np.exp(a)
    alpha, norm = np.empty_like(x), np.ones((steps, n))
    for i in range(steps):
        cur = x[i] if i == 0 else (alpha[i - 1] @ t) * x[i]
        norm[i] = np.where(real[i], cur.sum(1), 1.0)
        alpha[i] = np.where(real[i][:, None], cur / norm[i][:, None], alpha[i - 1] if i else cur)
    beta, post, moves = np.ones((n, k)), np.empty_like(x), np.zeros((k, k))
    for i in range(steps - 1, -1, -1):
        post[i] = alpha[i] * beta * real[i][:, None]
        if i:
            right = x[i] * beta / norm[i][:, None] * real[i][:, None]
            moves += t * (alpha[i - 1].T @ right)
            beta = np.where(real[i][:, None], right @ t.T, beta)
    return post, moves, float(np.log(norm).sum() + top[..., 0][real].sum())


def fit_rows(texts: list[str], langs: list[str], rounds: int = 40, rate: float = 0.3, l2: float = 1e-3) -> Crf:
    """A CRF from labelled texts, by AdaGrad on the whole sample; without languages if no text has a word."""
    words = words_of(texts, [])
    names = sorted({x for x, n in zip(langs, words.counts) if n})
    k = len(names)
    if not k:
        return Crf([], [], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    place = {x: i for i, x in enumerate(names)}
    label = np.array([place.get(x, -1) for x in langs], np.int64)
    y_of = np.repeat(label, words.counts)
    lexicons = []
    for y in range(k):
        types, n = np.unique(words.hashes[y_of == y], return_counts=True)
        lexicons.append(types[np.lexsort((types, -n))][:LEXICON])
    if k < 2:
        return Crf(names, lexicons, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32))
    words = words_of(texts, lexicons)
    at = np.cumsum(words.counts) - words.counts
    parts = [(words.type_of[a + i : a + min(i + SPAN, n)], y) for a, n, y in zip(at, words.counts, label) for i in range(0, n, SPAN)]
    rng = np.random.default_rng(7)
    order = rng.permutation(len(parts))
    seqs = [(w, np.full(len(w), y)) for w, y in parts]
    for a, b in zip(order[::4], order[1::4]):  # code-switched: the first words of one, the last of another
        turn = int(rng.integers(4, SPAN - 4))
        (w, y), (v, z) = parts[a], parts[b]
        w, v = w[:turn], v[max(len(v) - (SPAN - turn), 0) :]
        seqs.append((np.concatenate([w, v]), np.repeat([y, z], [len(w), len(v)])))
    size = np.array([len(w) for w, _ in seqs])
    real = np.arange(SPAN)[:, None] < size
    ids, ys = np.zeros(real.shape, np.int64), np.zeros(real.shape, np.int64)
    ids.T[real.T], ys.T[real.T] = np.concatenate([w for w, _ in seqs]), np.concatenate([y for _, y in seqs])
    truth = np.zeros((k, k))
    np.add.at(truth, (ys[:-1][real[1:]], ys[1:][real[1:]]), 1.0)
    types = len(words.first)
    ends = np.append(words.first[1:], len(words.features))
    some = max(AT_ONCE // (k * max(len(words.features) // types, 1)), 1)  # types and sequences gone through at a time
    runs = [slice(i, min(i + some, types)) for i in range(0, types, some)]
    many = max(AT_ONCE // (k * SPAN), 1)
    w, a = np.zeros((BUCKETS, k)), np.zeros((k, k))
    seen, seen_a, n = np.full((BUCKETS, k), 1e-8), np.full((k, k), 1e-8), int(size.sum())
    for _ in range(rounds):
        e = np.concatenate([np.add.reduceat(w[words.features[words.first[r.start] : ends[r.stop - 1]]], words.first[r] - words.first[r.start], axis=0) for r in runs])
        by_type, moves = np.zeros((types, k)), np.zeros((k, k))
        for i in range(0, len(seqs), many):
            part, here = ids[:, i : i + many], real[:, i : i + many]
            post, moved, _ = _pairwise(e[part], a, here)
            moves += moved
            step, seq = np.nonzero(here)
            post[step, seq, ys[:, i : i + many][here]] -= 1.0
            for j in range(k):
                by_type[:, j] += np.bincount(part.ravel(), post[:, :, j].ravel(), minlength=types)
        g = l2 * w / BUCKETS
        for r in runs:
            col = words.features[words.first[r.start] : ends[r.stop - 1]]
            row = np.repeat(np.arange(r.start, r.stop), ends[r] - words.first[r])
            for j in range(k):
                g[:, j] += np.bincount(col, by_type[row, j], minlength=BUCKETS) / n
        ga = (moves - truth) / n
        seen += g * g
        seen_a += ga * ga
        w -= rate * g / np.sqrt(seen)
        a -= rate * ga / np.sqrt(seen_a)
    return Crf(names, lexicons, w.astype(np.float32), a.astype(np.float32))


def fit_language(docs: DataFrame, per_lang: int = PER_LANG, window: int = WINDOW) -> Crf:
    """CRF from labelled texts outside the held-out third; only their windows reach the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang", "text")
    got = bounded_sample(known, "lang", per_lang).select("doc_id", text_window(F.col("text"), "doc_id", window), "lang").collect()
    rows = sorted({(r[0] is None, r[0] or 0, r[1], r[2]) for r in got})
    return fit_rows([r[2] for r in rows], [r[3] for r in rows])


def posteriors(texts: list[str | None], crf: Crf) -> list[np.ndarray]:
    """Word posteriors (word, label) of each text."""
    words = words_of(texts, crf.lexicons)
    if not len(words.hashes):
        return [np.empty((0, len(crf.langs)), np.float32)] * len(texts)
    post = forward_backward(crf.emissions(words)[words.type_of], crf.transitions, words.counts)
    return np.split(post, np.cumsum(words.counts)[:-1])


def _in_parts(texts: list[str | None], langs: int) -> list[list[str | None]]:
    """Neighbouring texts of about CHARS_AT_ONCE characters together; of fewer for many languages, as a block's matrix has langs x langs numbers."""
    out: list[list[str | None]] = [[]]
    most = int(CHARS_AT_ONCE * min(1.0, 64 / max(langs, 1)) ** 2)
    room = most
    for t in texts:
        if out[-1] and room < len(t or ""):
            out.append([])
            room = most
        out[-1].append(t)
        room -= len(t or "") + 1
    return out


def detect_language(docs: DataFrame, crf: Crf, segments: bool = False) -> DataFrame:
    """doc_id, lang_pred, its score, the share of each language; with segments=True also (word, words, lang) runs."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(cols: dict) -> dict:
        model = shared.value
        none = np.empty((0, 0))
        post = [p for part in _in_parts(cols["text"], len(model.langs)) for p in (posteriors(part, model) if model.langs else [none] * len(part))]
        out: dict = {"doc_id": cols["doc_id"], "lang_pred": [], "score": [], "shares": []}
        runs = []
        for p in post:
            if not len(p):
                out["lang_pred"].append("und")
                out["score"].append(0.0)
                out["shares"].append([])
                runs.append([])
                continue
            mean = p.mean(0, dtype=np.float64)
            mean = mean / mean.sum()
            best = int(mean.argmax())
            out["lang_pred"].append(model.langs[best])
            out["score"].append(min(1.0, float(mean[best])))
            out["shares"].append([{"lang": x, "share": float(s)} for x, s in zip(model.langs, mean)])
            if segments:
                y = p.argmax(1)
                edge = np.flatnonzero(np.diff(y, prepend=-1))
                size = np.diff(np.append(edge, len(y)))
                runs.append([{"word": int(s), "words": int(n), "lang": model.langs[y[s]]} for s, n in zip(edge, size)])
        return out | ({"segments": runs} if segments else {})

    schema = "doc_id long, lang_pred string, score double, shares array<struct<lang:string,share:double>>"
    more = ", segments array<struct<word:long,words:long,lang:string>>" if segments else ""
    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema + more)
