"""Quality rules: hashed n-gram logistic regression beside a few base counts.

Features of a text are its hashed words, character n-grams and word pairs,
each family as shares of its own total, shrunk where that total is small.  A
text is scored with array sums in Arrow batches.  Weights
are fitted on a bounded sample of labelled rows (PER_CLASS rows a label,
WINDOW characters of each) and calibrated by Platt's method on a part of that
sample that the weights haven't seen.

Defined results: a null text counts as empty; a text without words fails the
base rules, so it's never kept; repeated rows are scored alike; an empty table
or one without both labels gives a model that keeps what the base rules keep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_columns, sigmoid, text_window, utf8, window_hashes, word_hashes

#: Labelled rows of each label the model is fitted on, and characters of each.
PER_CLASS, WINDOW = 800, 2000
#: Buckets for each feature family.
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: A text is kept if P(good) reaches this.
KEEP_AT = 0.1
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


@dataclass
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def repeated_words(words: np.ndarray, k: int = REPEAT_WINDOW) -> int:
    """Words that lie in a k-word window which the text has twice or more."""
    h = window_hashes(words, k)
    if not len(h):
        return 0
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(h, twice))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None, hashes: np.ndarray) -> Measures:
    t = text or ""
    lines = [x for x in t.split("\n") if x.strip(_BLANKS)]
    return Measures(len(hashes), len(t) - sum(map(t.count, _BLANKS)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(hashes))


def _char_grams(text: bytes) -> np.ndarray:
    """Buckets of the text's character n-grams (1 to 3 bytes of its UTF-8, blanks included)."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    parts, gram = [], b
    for n in range(1, 4):
        if len(b) < n:
            break
        gram = b if n == 1 else gram[:-1] * np.uint32(257) + b[n - 1 :]
        parts.append(((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def feature_families(text: str | None, hashes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the text's words, character n-grams and word pairs."""
    low = np.uint64(64 - BUCKET_BITS)
    return [(hashes >> low).astype(np.int64), _char_grams(utf8(text)), (window_hashes(hashes, 2) >> low).astype(np.int64)]


def _trust(n: int) -> float:
    """How far a share over n things is trusted; few of them say little."""
    return n / (n + 20.0)


@dataclass
class QualityModel:
    """Weights by family (words, character n-grams, word pairs) and Platt's line."""

    weights: list[np.ndarray]
    scale: float
    shift: float

    def score(self, text: str | None, hashes: np.ndarray) -> float:
        return sum(float(w[got].mean()) * _trust(len(got)) for w, got in zip(self.weights, feature_families(text, hashes)) if len(got))

    def probability(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * z + self.shift)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a training text; the families follow one another."""
    cols, vals = [], []
    for family, got in enumerate(feature_families(text, word_hashes(utf8(text)))):
        if len(got):
            c, n = np.unique(got, return_counts=True)
            cols.append(c + family * BUCKETS)
            vals.append(n / n.sum() * _trust(len(got)))
    return (np.concatenate(cols), np.concatenate(vals)) if cols else (np.empty(0, np.int64), np.empty(0))


def fit_rows(texts: list[str], labels: list[int], steps: int = 60, rate: float = 4.0, l2: float = 1e-6) -> QualityModel:
    """Weights by AdaGrad on two thirds of the rows, Platt's line on the rest."""
    empty = QualityModel([np.zeros(BUCKETS) for _ in range(3)], 1.0, 5.0)
    y = np.asarray(labels, float)
    if not 0 < y.sum() < len(y):
        return empty
    got = [_features(t) for t in texts]
    fit = np.arange(len(y)) % 3 != 0
    if not 0 < y[fit].sum() < fit.sum() or not 0 < y[~fit].sum() < (~fit).sum():
        fit[:] = True
    row = np.repeat(np.arange(len(got)), [len(c) for c, _ in got])
    col, val = np.concatenate([c for c, _ in got]), np.concatenate([v for _, v in got])
    size = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * fit
    w, seen, b, bseen = np.zeros(3 * BUCKETS), np.full(3 * BUCKETS, 1e-8), 0.0, 1e-8
    for _ in range(steps):
        z = np.bincount(row, val * w[col], minlength=len(y)) + b
        r = size * (sigmoid(z) - y) / fit.sum()
        g = np.bincount(col, val * r[row], minlength=len(w)) + l2 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        bseen += r.sum() ** 2
        b -= 0.5 * r.sum() / np.sqrt(bseen)
    z = np.bincount(row, val * w[col], minlength=len(y))
    held = ~fit if (~fit).any() else fit
    a, c = _platt(z[held], y[held])
    return QualityModel(list(w.reshape(3, BUCKETS)), a, c)


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's sigmoid with his smoothed targets, by Newton's method on standard scores."""
    mid, wide = z.mean(), z.std() or 1.0
    x = np.column_stack([(z - mid) / wide, np.ones(len(z))])
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - goal) + 1e-6 * w)
        w = w - np.clip(step, -2, 2)
    return float(w[0] / wide), float(w[1] - w[0] * mid / wide)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, window: int = WINDOW) -> QualityModel:
    """Model from at most about per_class rows of each label; only their windows reach the driver.

    Labels other than 0 and 1 teach nothing; an id with both counts as 0.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = bounded_sample(known, "quality", per_class)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    got = sorted((r[0], r[1], r[2]) for r in rows.select("doc_id", text_window(F.col("text"), "doc_id", window), "quality").collect())
    return fit_rows([t for _, t, _ in got], [q for _, _, q in got])


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


def score_quality(docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: doc_id, the base measures, P(good) and the verdict, then the carried columns."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(cols: dict) -> dict:
        model = shared.value
        m, z = [], np.zeros(len(cols["text"]))
        for i, t in enumerate(cols["text"]):
            h = word_hashes(utf8(t))
            m.append(measure(t, h))
            z[i] = model.score(t, h)
        p = model.probability(z)
        failed = [x.base_failed for x in m]
        out = {k: [getattr(x, k) for x in m] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        out |= {"doc_id": cols["doc_id"], "base_failed": failed, "p_good": p.tolist(), "kept": [not f and bool(q >= keep_at) for f, q in zip(failed, p)]}
        return out | {f"in_{c}": cols[f"in_{c}"] for c in carry}

    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *(F.col(c).alias(f"in_{c}") for c in carry))
    kinds = "".join(f", in_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_columns(pick, run, _SCHEMA + kinds)


def keep_good(docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that pass, with docs' columns."""
    scored = score_quality(docs, model, keep_at, tuple(docs.columns))
    return scored.where("kept").select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))
