"""Body-text cleaning (T0-T13), tokenisation and n-gram counts (V1-V3) as narrow, per-row work.

Rules on characters in their context (T0-T5) are JVM expressions.  Rules on
words (T6-T13) and the counting of n-grams run on whole Arrow columns: a word is
looked at once for each batch it occurs in, not once for each occurrence, and
n-grams are numbers until their counts are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import LEMMA_RULES, MIN_STEM_LEN, SLANG_MAP, STOP_WORDS

# Python's str.split()/\s on ASCII text also treats 0x1C-0x1F as whitespace;
# Java's \s does not, so the class is spelled out.
WS = " \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F"
#: Bytes of text that are worked on at a time: memory is bounded whatever the size of a batch.
SLICE_BYTES = 1 << 22


def lemma(word: str) -> str:
    """T12 on one token: the first suffix rule that leaves enough characters; for the fixed slang values."""
    if len(word) > MIN_STEM_LEN:
        for suffix, rep in LEMMA_RULES:
            if word.endswith(suffix) and len(word) - len(suffix) + len(rep) >= MIN_STEM_LEN:
                return word[: len(word) - len(suffix)] + rep
    return word


def _survives(token: str) -> bool:
    return token not in set(STOP_WORDS) and len(token) > 2


# T10 and T11 of slang words are known beforehand: what is left of each, lemma included, or nothing.
_SLANG_KEPT = {k: lemma(v) for k, v in SLANG_MAP.items() if _survives(v)}
_DROPPED = set(STOP_WORDS) | (set(SLANG_MAP) - set(_SLANG_KEPT))


@lru_cache(maxsize=1 << 18)
def _word(word: str) -> str:
    """T8 and T10-T12 on a run of letters: what is left of it, or nothing."""
    word = re.sub(r"([a-z])\1{2,}", r"\1\1", word)
    if word in _SLANG_KEPT:
        return _SLANG_KEPT[word]
    return lemma(word) if len(word) > 2 and word not in _DROPPED else ""


def let(value: Column, body) -> Column:
    """body(value), the value being worked out (and written into the plan) once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_closed(text: Column, pattern: str, close: str, by: str) -> Column:
    """regexp_replace of a pattern that ends in the character `close`, which its inside can't hold.

    Only the text up to the last `close` is searched: behind it each opening
    character would be followed to the end in vain, with the square of their number.
    """
    tail = lambda t: F.substring_index(t, close, -1)
    head = lambda t: F.regexp_replace(F.left(t, F.length(t) - F.length(tail(t))), pattern, by)
    return let(text, lambda t: F.when(F.contains(t, F.lit(close)), F.concat(head(t), tail(t))).otherwise(t))


def normalise_text(text: Column) -> Column:
    """The rules that see a character in its context."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, "[^\\x00-\\x7F]+", "")                         # T1
    t = F.lower(t)                                                           # T2
    url = f"https?://[^{WS}]+|www\\.[^{WS}]+"
    t = let(t, lambda x: F.when(F.contains(x, F.lit("://")) | F.contains(x, F.lit("www.")), F.regexp_replace(x, url, " ")).otherwise(x))  # T3
    # a local part begins where its run of characters does (or the last match ended), so no run is tried from every place
    mail = "(?:\\G|(?<![a-z0-9_.+\\-]))[a-z0-9_.+\\-]++@[a-z0-9_.\\-]+"
    t = let(t, lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, mail, " ")).otherwise(x))  # T4
    return replace_closed(t, "<[^>]+>", ">", " ")                            # T5


def clean_text(text: Column) -> Column:
    """Cleaned text, tokens joined by one space."""
    return _clean_words(normalise_text(text))


def slices(text: pa.Array, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each (a longer row is a range of its own)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(text):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + (size or SLICE_BYTES), "right")))
        yield at, to
        at = to


#: Lower-case letters stay, all other bytes are blanks.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)


def _words_cleaned(text: pa.Array) -> pa.Array:
    """T6-T13 on some rows of ASCII text without nulls."""
    data = "\n".join(text.to_pylist()).encode()
    made = _LETTERS[np.frombuffer(data, np.uint8)]
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int32)  # the joining \n, a blank now, ends its row
    made = np.append(made, np.uint8(32))
    rows = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(starts), pa.py_buffer(made)])
    split = pc.ascii_split_whitespace(rows)
    words = split.flatten().dictionary_encode()
    left = pa.array([_word(w) for w in words.dictionary.to_pylist()], pa.string())
    code = words.indices.to_numpy(zero_copy_only=False)
    kept = pc.not_equal(left, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.empty(0, bool)
    row = np.repeat(np.arange(len(text)), pc.list_value_length(split).to_numpy(zero_copy_only=False))[kept]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(text)))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), left.take(pa.array(code[kept]))), " ")


@F.arrow_udf(T.StringType())
def _clean_words(text: pa.Array) -> pa.Array:
    parts = [_words_cleaned(text.slice(a, b - a)) for a, b in slices(text)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def vector_tokens(clean: Column) -> Column:
    """V1: the vectoriser's token pattern (two or more word chars) on cleaned text."""
    return F.filter(F.split(clean, " "), lambda x: F.length(x) >= 2)


class NgramCounts:
    """V1-V3 of some rows: pair i says that row[i] holds the n-gram names()[at[i]] tf[i] times; by row, then by term."""

    def __init__(self, clean: pa.Array, n_min: int = 1, n_max: int = 3):
        tokens = pc.split_pattern(pc.fill_null(clean, ""), " ")
        flat = tokens.flatten()
        own = np.repeat(np.arange(len(clean)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
        long = pc.greater_equal(pc.utf8_length(flat), 2)
        words, own = flat.filter(long).dictionary_encode(), own[long.to_numpy(zero_copy_only=False)]
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        number = rank[words.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.int64)
        self.words, self.base, self.n_max, self.n_rows = words.dictionary.take(pa.array(order)), len(order) + 1, n_max, len(clean)
        if self.base**n_max >= 1 << 63:
            raise OverflowError
        self.n_tokens = np.bincount(own, minlength=len(clean))
        keys, rows = [], []
        for n in range(n_min, n_max + 1):  # digits to the base, absent words as 0 behind: numbers in the order of the terms
            last = max(len(own) - n + 1, 0)
            within = np.flatnonzero(own[:last] == own[n - 1 : n - 1 + last])
            key = np.zeros(len(within), np.int64)
            for j in range(n_max):
                key = key * self.base + (number[within + j] if j < n else 0)
            keys.append(key)
            rows.append(own[within])
        code, unique = pd.factorize(np.concatenate(keys))
        order = np.argsort(unique)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys = unique[order]
        n = max(len(order), 1)
        pair = np.sort(np.concatenate(rows) * n + rank[code])
        cut = np.flatnonzero(np.diff(pair, prepend=-1))
        self.row, self.at = pair[cut] // n, pair[cut] % n
        self.tf = np.diff(np.append(cut, len(pair)))

    def digits(self, keys: np.ndarray) -> list[np.ndarray]:
        """Each key's words as numbers (place among self.words, and one), 0 behind the last."""
        out = []
        for _ in range(self.n_max):
            out.insert(0, keys % self.base)
            keys = keys // self.base
        return out

    def packed(self, place: np.ndarray, bits: int) -> np.ndarray:
        """The terms as numbers of `bits` a word, place[i] being the number (from 1 on) of self.words[i] in all tasks."""
        place, out = np.append(0, place), np.zeros(len(self.keys), np.int64)
        for d in self.digits(self.keys):
            out = (out << bits) | place[d]
        return out

    def names(self, which: np.ndarray | None = None) -> pa.Array:
        """The terms, all (ascending) or those at some places."""
        keys = self.keys if which is None else self.keys[which]
        return joined_words(self.words, self.digits(keys))


def joined_words(words: pa.Array, digits: list[np.ndarray]) -> pa.Array:
    """Terms of the words digits[0] - 1, digits[1] - 1, ..., up to the first 0."""
    length = sum((d > 0).astype(np.int64) for d in digits)
    parts, places = [], []
    for n in range(1, len(digits) + 1):
        here = np.flatnonzero(length == n)
        if len(here):
            parts.append(pc.binary_join_element_wise(*(words.take(pa.array(d[here] - 1)) for d in digits[:n]), " "))
            places.append(here)
    if not parts:
        return pa.array([], pa.string())
    back = np.empty(len(length), np.int64)
    back[np.concatenate(places)] = np.arange(len(length))
    return pa.concat_arrays(parts).take(pa.array(back))


class _PlainCounts:
    """The same of a single row with too many words for numbers of 63 bits."""

    def __init__(self, clean: pa.Array, n_min: int, n_max: int):
        words = [w for w in (clean[0].as_py() or "").split(" ") if len(w) >= 2]
        found: dict[str, int] = {}
        for n in range(n_min, n_max + 1):
            for i in range(len(words) - n + 1):
                term = " ".join(words[i : i + n])
                found[term] = found.get(term, 0) + 1
        self.terms, self.n_rows, self.n_tokens = sorted(found), 1, np.array([len(words)])
        self.row, self.at, self.tf = np.zeros(len(found), np.int64), np.arange(len(found)), np.array([found[t] for t in self.terms], np.int64)

    def names(self, which: np.ndarray | None = None) -> pa.Array:
        return pa.array(self.terms if which is None else [self.terms[i] for i in which], pa.string())


def ngram_counts(clean: pa.Array, n_min: int = 1, n_max: int = 3, size: int | None = None) -> Iterator[tuple[int, int, NgramCounts | _PlainCounts]]:
    """(first row, row behind the last, their counts) over all rows, a bounded slice at a time."""
    for a, b in slices(clean, size):
        part = clean.slice(a, b - a)
        try:
            yield a, b, NgramCounts(part, n_min, n_max)
        except OverflowError:
            if b - a == 1:
                yield a, b, _PlainCounts(part, n_min, n_max)
            else:
                half = (b - a) // 2
                for off, piece in ((a, part.slice(0, half)), (a + half, part.slice(half))):
                    for x, y, c in ngram_counts(piece, n_min, n_max, size):
                        yield off + x, off + y, c


class KnownTerms:
    """A vocabulary as numbers of its words: counts its terms in texts without spelling out any other n-gram."""

    def __init__(self, terms: pa.Array, n_min: int = 1, n_max: int = 3):
        split = pc.split_pattern(pc.fill_null(terms, ""), " ")
        length = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten().dictionary_encode()
        self.words, self.base, self.n_min, self.n_max, self.n_terms = words.dictionary, len(words.dictionary) + 1, n_min, n_max, max(len(terms), 1)
        if self.base**n_max >= 1 << 63:
            raise OverflowError
        number, starts = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.cumsum(length) - length
        which = np.flatnonzero((length >= n_min) & (length <= n_max))
        keys = np.zeros(len(which), np.int64)
        for j in range(n_max):
            here = length[which] > j
            digit = np.zeros(len(which), np.int64)
            digit[here] = number[starts[which[here]] + j]
            keys = keys * self.base + digit
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], which[order]

    def counts(self, clean: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, tf): row[i] holds the term at place[i] of the vocabulary tf[i] times; by row, then by place."""
        tokens = pc.split_pattern(pc.fill_null(clean, ""), " ")
        flat = tokens.flatten()
        own = np.repeat(np.arange(len(clean)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
        long = pc.greater_equal(pc.utf8_length(flat), 2)
        words, own = flat.filter(long).dictionary_encode(), own[long.to_numpy(zero_copy_only=False)]
        known = pc.fill_null(pc.index_in(words.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        number = known[words.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.int64)
        pairs = [np.empty(0, np.int64)]
        for n in range(self.n_min, self.n_max + 1) if len(self.keys) else ():
            last = max(len(own) - n + 1, 0)
            whole = own[:last] == own[n - 1 : n - 1 + last]
            for j in range(n):
                whole &= number[j : j + last] > 0
            within = np.flatnonzero(whole)
            key = np.zeros(len(within), np.int64)
            for j in range(self.n_max):
                key = key * self.base + (number[within + j] if j < n else 0)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            pairs.append(own[within[hit]] * self.n_terms + self.places[at[hit]])
        pair = np.sort(np.concatenate(pairs))
        cut = np.flatnonzero(np.diff(pair, prepend=-1))
        return pair[cut] // self.n_terms, pair[cut] % self.n_terms, np.diff(np.append(cut, len(pair)))


TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))
_TERM = pa.struct([("term", pa.string()), ("tf", pa.int32())])


def term_lists(c: NgramCounts | _PlainCounts) -> pa.Array:
    """Counts as a column of (term, tf) lists."""
    starts = np.concatenate([[0], np.cumsum(np.bincount(c.row, minlength=c.n_rows))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([c.names().take(pa.array(c.at)), pa.array(c.tf.astype(np.int32))], fields=list(_TERM))
    return pa.ListArray.from_arrays(pa.array(starts), pairs)


def term_counts(clean: Column, n_min: int = 1, n_max: int = 3) -> Column:
    """V1-V3: array<struct<term,tf>> of the distinct n-grams of cleaned text, by term; nothing is exchanged."""
    @F.arrow_udf(TERMS)
    def counted(text: pa.Array) -> pa.Array:
        parts = [term_lists(c) for _, _, c in ngram_counts(text, n_min, n_max)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_TERM))

    return counted(clean)


_FIGURES = [("n_tokens", T.IntegerType(), pa.int32()), ("n_ngrams", T.IntegerType(), pa.int32()), ("n_distinct", T.IntegerType(), pa.int32()), ("max_tf", T.LongType(), pa.int64())]


@F.arrow_udf(T.StructType([T.StructField(name, kind) for name, kind, _ in _FIGURES]))
def ngram_figures(clean: pa.Array) -> pa.Array:
    """V1-V3 in figures: a text's tokens, n-grams, distinct ones, and how often the most frequent one occurs."""
    n = len(clean)
    out = np.zeros((4, n), np.int64)
    for a, b, c in ngram_counts(clean):
        out[0, a:b], out[2, a:b] = c.n_tokens, np.bincount(c.row, minlength=b - a)
        out[1, a:b] = np.bincount(c.row, c.tf, minlength=b - a)
        np.maximum.at(out[3], a + c.row, c.tf)
    return pa.StructArray.from_arrays([pa.array(x).cast(k) for x, (_, _, k) in zip(out, _FIGURES)], fields=[pa.field(name, k) for name, _, k in _FIGURES])
