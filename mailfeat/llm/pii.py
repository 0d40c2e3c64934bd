"""PII spans by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, plus signs, digits, schemes
and identifier cues); each anchor is expanded by a small deterministic parser
to the boundaries of an address or number, which is then validated.

Kinds: email, ip, card, phone (the base rules), then url (an address with
user information before its host), account (a checked number after a cue such
as IBAN or SSN) and secret (a quoted or assigned credential after a cue).

Defined results: null and empty texts have no spans; rows are handled one by
one, so ties, repeated rows and an empty table need nothing special; columns
other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE_KINDS = KINDS[:4]

_DIGITS = frozenset("0123456789")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_LOCAL = _LABEL | frozenset("._%+")
_PHONE = _DIGITS | frozenset(" ().-")

#: Identifier cues, by what they announce.
_ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport")
_SECRET_CUES = ("token", "api_key", "apikey", "api-key", "password", "passwd", "secret")
_KEY_IDS = ("AKIA", "ASIA")
_SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "smtp://")

_CUE_END = r"[ \t]*(?:no\.?|number)?[ \t]*[:=#]?[ \t]*"
_ACCOUNT = re.compile(_CUE_END + r"([0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]?[0-9]{8,12})(?![A-Za-z0-9])")
_IBAN = re.compile(_CUE_END + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: Length of an account number by its country.
_IBAN_LENGTHS = {k[:2]: int(k[2:]) for k in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}  # fmt: skip
_SECRET = re.compile(r"""[ \t]*[:=][ \t]*["']?([A-Za-z0-9_./+=-]{12,})["']?""")
_KEY_ID = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _iban(value: str) -> bool:
    s = value.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_span(t: str, at: int) -> tuple[int, int] | None:
    """A checked account number after the cue that ends at `at`.

    Capitals and digits after it look like more of it, so every word end is
    tried: the one at its country's length first, then from the longest on.
    """
    if not (m := _IBAN.match(t, at)):
        return None
    s, e = m.span(1)
    ends = [i for i in range(e, s, -1) if t[i - 1] != " " and not (t[i : i + 1].isascii() and t[i : i + 1].isalnum())]
    known = _IBAN_LENGTHS.get(t[s : s + 2])
    ends.sort(key=lambda i: len(t[s:i].replace(" ", "")) != known)
    return next(((s, i) for i in ends if _iban(t[s:i])), None)


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in sorted(_DIGITS):
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in _SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for cues, kind in ((_ACCOUNT_CUES, "account"), (_SECRET_CUES, "secret")):
        for c in cues:
            for form in {c, c.upper(), c.capitalize()}:
                a.add_word(form, (kind, len(form)))
    for k in _KEY_IDS:
        a.add_word(k, ("key", len(k)))
    a.make_automaton()
    return a


def _email(t: str, at: int, last: int) -> tuple[int, int] | None:
    """Local part to the left (not into the match before), dotted labels to the right."""
    s = at
    while s > last and t[s - 1] in _LOCAL:
        s -= 1
    n, e = len(t), at + 1
    while e < n and t[e] in _LABEL:
        e += 1
    if s == at or e == at + 1:
        return None
    dots = 0
    while e + 1 < n and t[e] == "." and t[e + 1] in _LABEL:
        e += 2
        while e < n and t[e] in _LABEL:
            e += 1
        dots += 1
    return (s, e) if dots else None


def _digit_runs(places: list[int]) -> list[tuple[int, int]]:
    """Neighbouring digit anchors as [start, end) runs."""
    runs: list[tuple[int, int]] = []
    for p in places:
        if runs and runs[-1][1] == p:
            runs[-1] = (runs[-1][0], p + 1)
        else:
            runs.append((p, p + 1))
    return runs


def _ips(t: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Four digit runs joined by single dots; a match uses its runs up."""
    out, i = [], 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(t[a[1]] == "." and a[1] + 1 == b[0] for a, b in zip(four, four[1:])):
            if all(int(t[a:b]) <= 255 if b - a < 10 else not t[a:b].lstrip("0") or int(t[a:b].lstrip("0")[:4]) <= 255 and len(t[a:b].lstrip("0")) <= 3 for a, b in four):
                out.append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    return out


def _cards(t: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Digit runs joined by single blanks or hyphens, 16 to 19 digits, Luhn."""
    out, i = [], 0
    while i < len(runs):
        j, digits = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j][1] + 1 == runs[j + 1][0] and t[runs[j][1]] in " -":
            j += 1
            digits += runs[j][1] - runs[j][0]
        if 16 <= digits <= 19:
            s, e = runs[i][0], runs[j][1]
            if luhn("".join(t[a:b] for a, b in runs[i : j + 1])):
                out.append((s, e))
        i = j + 1
    return out


def _phone(t: str, plus: int) -> tuple[int, int] | None:
    """+, a digit, then as far as phone characters go, back to the last digit."""
    n = len(t)
    if plus + 1 >= n or t[plus + 1] not in _DIGITS:
        return None
    e = plus + 2
    while e < n and t[e] in _PHONE:
        e += 1
    while e > plus + 2 and t[e - 1] not in _DIGITS:
        e -= 1
    return (plus, e) if e >= plus + 4 else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by kind in the order of KINDS, then start."""
    t = text or ""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    digits: list[int] = []
    ends = {"email": 0, "phone": 0, "url": 0, "account": 0, "secret": 0}

    def add(kind: str, span: tuple[int, int]) -> None:
        if span[0] >= ends[kind]:
            found[kind].append(span)
            ends[kind] = span[1]

    for last, (what, size) in _anchors().iter(t):
        start = last - size + 1
        if what == "digit":
            digits.append(last)
        elif what == "at":
            if span := _email(t, last, ends["email"]):
                add("email", span)
        elif what == "plus":
            if last >= ends["phone"] and (span := _phone(t, last)):
                ends["phone"] = span[1]
                if 8 <= sum(c in _DIGITS for c in t[span[0] : span[1]]) <= 15:
                    found["phone"].append(span)
        elif what == "scheme":
            if m := _USERINFO.match(t, last + 1):
                add("url", (start, m.end()))
        elif what == "account":
            if start == 0 or not t[start - 1].isalnum():
                if span := _iban_span(t, last + 1):
                    add("account", span)
                elif m := _ACCOUNT.match(t, last + 1):
                    add("account", m.span(1))
        elif what == "secret":
            if m := _SECRET.match(t, last + 1):
                add("secret", m.span(1))
        elif start == 0 or not t[start - 1].isalnum():
            if m := _KEY_ID.match(t, start):
                add("secret", m.span())
    runs = _digit_runs(digits)
    found["ip"], found["card"] = _ips(t, runs), _cards(t, runs)
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping ones the earliest, longest."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, counts of the base kinds, spans as a list of structs."""

    def run(cols: dict) -> dict:
        spans = [find_spans(t) for t in cols["text"]]
        out: dict = {"doc_id": cols["doc_id"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]}
        for kind in BASE_KINDS:
            out[f"n_{kind}"] = [sum(k == kind for k, _, _ in x) for x in spans]
        base = [join_spans([y for y in x if y[0] in BASE_KINDS]) for x in spans]
        out["base_sha256"] = [hashlib.sha256(b.encode()).hexdigest() for b in base]
        return out

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return map_columns(two, run, f"doc_id long, {counts}, base_sha256 string, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the personal data in its text masked; every row and column stays."""

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: mask(t, find_spans(t)), na_action="ignore")

    return docs.withColumn(text_col, masked(F.col(text_col)))
