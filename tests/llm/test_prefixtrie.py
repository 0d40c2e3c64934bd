"""Operator 13 against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from mailfeat.llm import prefixtrie as P
from mailfeat.llm.common import table
from mailfeat.llm.queries import op13_prefix_trie

SF = "/root/testdata/sf0.01"


def plain_trie(convs):
    """convs: id -> list of (role, text); rows by a dictionary of all prefixes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    rows = set()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        rows.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def rows_of(df):
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query(spark):
    own = defaultdict(list)
    for r in sorted(table(spark, SF, "conversations").collect(), key=lambda r: r.turn):
        own[r.conv_id].append((r.role or "", r.text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert rows_of(op13_prefix_trie(spark, SF)) == plain_trie(rebuilt)


@pytest.mark.parametrize("seed", range(3))
def test_many_borders(spark, monkeypatch, seed):
    """Few distinct turns, so that copies, ends and branches lie across every border; three levels of merges."""
    monkeypatch.setattr(P, "TURNS_A_PART", 12)
    monkeypatch.setattr(P, "FAN_IN", 3)
    monkeypatch.setattr(P, "PIECE_CHARS", 40)
    rng = random.Random(seed)
    convs = {c: [("user", rng.choice(["a b", "c", ""])) for _ in range(rng.choice([0, 1, 2, 2, 3, 6]))] for c in range(-5, 120)}
    convs |= {c: [("x", "same copy of all")] * 3 for c in range(200, 260)}
    rows = [(c, [hashlib.md5(f"{len(r)}:{r}:{t}".encode()).hexdigest() for r, t in turns], [len(t.split()) for _, t in turns]) for c, turns in convs.items()]
    seqs = spark.createDataFrame(rows, "conv_id long, digests array<string>, words array<long>")
    assert rows_of(P.prefix_trie(seqs)) == plain_trie(convs)


def test_defined_results(spark):
    schema = "conv_id long, turn long, role string, text string, parent long"
    assert P.prefix_trie(P.sequences(spark.createDataFrame([], schema))).collect() == []
    rows = [(1, 1, "user", "b", 0), (1, None, None, "a", 0), (1, 1, "user", "b", 0), (None, 1, "user", "z", 0), (2, 5, "", "a", 0), (3, 1, "user", "w " * 100_000, 0)]
    got = rows_of(P.prefix_trie(P.sequences(spark.createDataFrame(rows, schema))))
    assert got == plain_trie({1: [("", "a"), ("user", "b"), ("user", "b")], 2: [("", "a")], 3: [("user", "w " * 100_000)]})
    alone = P.prefix_trie(P.with_heads(P.sequences(spark.createDataFrame([(7, 1, "u", "t", 0)], schema)), P.F.lit(5).cast("long"), P.F.lit(2), 3))
    assert rows_of(alone) == plain_trie({7: []})
