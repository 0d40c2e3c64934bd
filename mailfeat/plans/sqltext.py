"""ANSI/DuckDB SQL renderings of the cleaning rules, used by the oracle queries.

DuckDB's regex engine has no back-references and a narrower \\s, so the
repeated-letter rule becomes one rewrite per letter and whitespace is an
explicit class.  Built from the same fixed values as the Spark expressions.
"""

from __future__ import annotations

import string

from ..functions.constants import LEMMA_RULES, MIN_STEM_LEN, SLANG_MAP, STOP_WORDS

WS = " \\t\\n\\r\\x0B\\x0C\\x1C-\\x1F"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_normalise(col: str) -> str:
    t = f"coalesce({col}, '')"
    t = f"regexp_replace({t}, '[^\\x00-\\x7F]', '', 'g')"
    t = f"lower({t})"
    t = f"regexp_replace({t}, 'https?://[^{WS}]+|www\\.[^{WS}]+', ' ', 'g')"
    t = f"regexp_replace({t}, '[a-z0-9_.+\\-]+@[a-z0-9_.\\-]+', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = f"regexp_replace({t}, '[0-9]+', ' ', 'g')"
    t = f"regexp_replace({t}, '[^a-z{WS}]', ' ', 'g')"
    for ch in string.ascii_lowercase:
        t = f"regexp_replace({t}, '{ch}{{3,}}', '{ch}{ch}', 'g')"
    return t


def sql_lemma(x: str) -> str:
    parts = [f"CASE WHEN length({x}) <= {MIN_STEM_LEN} THEN {x}"]
    for suf, rep in LEMMA_RULES:
        parts.append(
            f"WHEN suffix({x}, {q(suf)}) AND length({x}) - {len(suf)} + {len(rep)} >= {MIN_STEM_LEN} "
            f"THEN left({x}, length({x}) - {len(suf)}) || {q(rep)}")
    parts.append(f"ELSE {x} END")
    return " ".join(parts)


def sql_clean_tokens(col: str) -> str:
    t = sql_normalise(col)
    toks = f"list_filter(string_split_regex({t}, '[{WS}]+'), lambda x: x <> '')"
    slang = "CASE x " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SLANG_MAP.items()) + " ELSE x END"
    toks = f"list_transform({toks}, lambda x: {slang})"
    stops = "[" + ", ".join(q(w) for w in dict.fromkeys(STOP_WORDS)) + "]"
    toks = f"list_filter({toks}, lambda x: NOT list_contains({stops}, x) AND length(x) > 2)"
    return f"list_transform({toks}, lambda x: {sql_lemma('x')})"


def sql_clean(col: str) -> str:
    return f"array_to_string({sql_clean_tokens(col)}, ' ')"


def sql_vector_tokens(clean: str) -> str:
    return f"list_filter(string_split({clean}, ' '), lambda x: length(x) >= 2)"


def sql_ngrams(toks: str) -> str:
    """Unigrams, bigrams, trigrams of a token list (1-based slices, inclusive)."""
    bi = f"list_transform(range(1, len({toks})), lambda i: array_to_string({toks}[i:i+1], ' '))"
    tri = f"list_transform(range(1, len({toks}) - 1), lambda i: array_to_string({toks}[i:i+2], ' '))"
    return f"list_concat(list_concat({toks}, {bi}), {tri})"
