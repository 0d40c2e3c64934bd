"""Operator 12 against a plain differencing that carries whole partitions, and the law's invariants."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mailfeat.llm import sharding as S
from mailfeat.llm.common import table
from mailfeat.llm.queries import op12_karmarkar_karp

SF = "/root/testdata/sf0.01"


def plain_differencing(sizes, shards):
    """Lists of (sum, members), sorted by sum; the two of largest spread are joined oppositely until one is left."""
    parts = [[(0, [])] * (shards - 1) + [(s, [i])] for i, s in enumerate(sizes)]
    spread = lambda p: p[-1][0] - p[0][0]
    while len(parts) > 1:
        parts.sort(key=spread)
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, b[::-1])), key=lambda t: t[0]))
    return [s for s, _ in parts[0]] if parts else [0] * shards


@pytest.mark.parametrize("shards", [2, 3, 7])
def test_equals_plain_differencing(shards):
    rng = np.random.default_rng(shards)
    for n in (1, 2, 5, 40, 200):
        sizes = rng.permutation(100_000)[:n].tolist()  # no ties, so the order of joining is one
        at = S.difference(sizes, shards)
        sums = sorted(sum(s for s, i in zip(sizes, at) if i == k) for k in range(shards))
        assert sums == sorted(plain_differencing(sizes, shards))


def test_base_is_levelled():
    rng = np.random.default_rng(1)
    sizes, base = rng.integers(16, 4000, 3000).tolist(), [900_000.0, 0.0, 100_000.0, 50_000.0]
    at = S.difference(sizes, 4, base)
    sums = [b + sum(s for s, i in zip(sizes, at) if i == k) for k, b in enumerate(base)]
    assert max(sums) - min(sums) <= 100
    assert S.open_shards([500.0, 10.0, 20.0, 0.0], 90) == [1, 2, 3] and S.open_shards([0.0, 0.0], 0) == [0, 1]


def laws(rows, texts, shards, level=None):
    """Invariants of a result; texts: list of (id, text)."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert {r.law for r in rows} <= {"bytes"} and {r.grown_shard for r in rows} <= {None} and all(0 <= r.shard < shards for r in rows)
    slots, size = defaultdict(list), Counter({k: 0 for k in range(shards)})
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = dict(texts)
    homes = defaultdict(set)
    for r in rows:
        homes[text[r.doc_id] or ""].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    if level is not None:
        assert max(size.values()) - min(size.values()) <= level
    return size


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    size = laws(op12_karmarkar_karp(spark, SF).collect(), texts, 40)
    groups = Counter()
    for _, t in texts:
        groups[t or ""] += len((t or "").encode()) + 16
    best = plain_differencing(list(groups.values()), 40)
    assert max(size.values()) - min(size.values()) <= max(2 * (best[-1] - best[0]), 400)


def test_many_parts_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_GROUPS", 200)
    rng = np.random.default_rng(3)
    texts = [(i, "hot text" * 30) for i in range(3000)] + [(3000 + i, "x%d " % i * int(rng.integers(1, 60))) for i in range(4000)] + [(8000, None), (8001, ""), (8002, "")]
    rows = S.shard_by_bytes(spark.createDataFrame(texts, "doc_id long, text string"), shards=8).collect()
    size = laws(rows, texts, 8)
    ordered = sorted(size.values())
    assert ordered[-1] == 3000 * (240 + 16) and ordered[-2] - ordered[0] <= 200


def test_defined_results(spark):
    assert S.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (1, None, 3), (1, "é" * 200_000, 4)], "doc_id long, text string, shard int")
    rows = S.shard_by_bytes(odd).collect()
    assert sorted(r.size for r in rows) == [16, 17, 17, 400_016] and len({r.shard for r in rows if r.size == 17}) == 1
    assert rows[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
