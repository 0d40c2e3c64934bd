"""Plain versions of the operators' contracts, for comparison."""

import hashlib
import re

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed([int(x) for x in d])):
        c = c * 2 if i % 2 else c
        s += c - 9 if c > 9 else c
    return s % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def base_sha(text):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text)).encode()).hexdigest()


def quality_base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(docs):
    """doc_id: (least id of its component, number of similar documents), from all pairs."""
    ids = sorted(docs)
    sets = {i: shingles(docs[i]) for i in ids}
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        near = {}
        for s in sets[i]:
            for j in by[s]:
                near[j] = near.get(j, 0) + 1
        for j, n in near.items():
            if j > i and 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in ids}


def mix(rows, weights, default, budget, epochs):
    """rows: (domain, lang, source) -> tokens; budgets by repeated proportional sharing, top down."""
    levels = ("domain", "lang", "source")

    def cap(prefix):
        return sum(t * epochs for k, t in rows.items() if k[: len(prefix)] == prefix)

    out = {}

    def give(prefix, amount):
        if len(prefix) == 3:
            out[prefix] = amount
            return
        kids = sorted({k[: len(prefix) + 1] for k in rows if k[: len(prefix)] == prefix})
        open_ = {k: weights.get(levels[len(prefix)], {}).get(k[-1], default) for k in kids}
        share, left = dict.fromkeys(kids, 0.0), min(amount, cap(prefix))
        while open_ and left > 1e-9:
            total = sum(open_.values())
            over = {k for k, w in open_.items() if share[k] + left * w / total >= cap(k) - 1e-9}
            if not over:
                for k, w in open_.items():
                    share[k] += left * w / total
                break
            for k in over:
                left -= cap(k)
                share[k] = cap(k)
                del open_[k]
        for k in kids:
            give(k, share[k])

    give((), budget)
    return out
