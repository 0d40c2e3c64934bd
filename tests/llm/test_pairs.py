"""String tiling and chosen paths against brute force, and their edge cases."""

import random

import brute
import numpy as np
import pytest

from mailfeat.llm import decontam, jaccard, queries
from mailfeat.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_tiles(p, t, least):
    """Greedy string tiling as its definition has it: the longest common unmarked runs, over and over."""
    mp, mt, covered = [False] * len(p), [False] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] != 0 and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        mp[i : i + n], mt[j : j + n] = [True] * n, [True] * n
        covered += n


@pytest.mark.parametrize("seed", range(4))
def test_tiles_equal_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(60):
        p = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))]
        t = [rng.randrange(0, 5) for _ in range(rng.randrange(1, 40))]
        got = decontam.greedy_tiles(p, t, 3)
        assert all(p[i : i + n] == t[j : j + n] and n >= 3 for i, j, n in got)
        used = [x for i, _, n in got for x in range(i, i + n)]
        assert len(used) == len(set(used))
        assert abs(len(used) - plain_tiles(p, t, 3)) <= 3  # ties may be broken in another order
    p = list(range(1, 61))
    assert sum(n for _, _, n in decontam.greedy_tiles(p, p[40:] + [99] + p[:20] + [98] + p[20:40], 5)) == 60


def test_reordered_passages_and_edges(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi rho."
    w = item.split()
    texts = {1: "x y z " + item + " more", 2: " ".join(w[8:]) + " | " + " ".join(w[:8]).upper(), 3: " ".join(w[:6]) + " other words here", 4: None, 5: "", 6: "x " * 30_000 + item, 7: item, 8: "short item one is here"}
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()] + [(7, item, "c"), (None, item, "c")], "doc_id long, text string, key string")
    items = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (13, "short item one"), (14, "ab")], "item_id long, text string")
    rows = decontam.find_contamination(df, items).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in rows) == [(0, 10), (1, 10), (2, 10), (6, 10), (7, 10), (7, 10), (8, 13)]
    assert {r.doc_id: r.tiles[0].word for r in rows if r.doc_id == 1} == {1: 3}
    left = decontam.drop_contaminated(df, items)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5]
    assert decontam.find_contamination(df.limit(0), items).count() == 0
    assert decontam.find_contamination(df, items.limit(0)).count() == 0


def test_items_without_or_with_the_same_id(spark):
    one, two = "Alpha beta gamma delta epsilon zeta eta theta", "Iota kappa lambda mu nu xi omicron pi rho"
    df = spark.createDataFrame([(1, "x " + one), (2, two + " y"), (3, "nothing of it in this text")], "doc_id long, text string")
    for first, second in ((None, None), (None, 5), (7, 7)):
        items = spark.createDataFrame([(first, one), (second, two), (first, one.upper() + ".")], "item_id long, text string")
        rows = decontam.find_contamination(df, items).collect()
        assert sorted((r.doc_id, r.item_id, r.item_words, r.covered) for r in rows) == [(1, first, 8, 8), (2, second, 9, 9)]
        assert [r.doc_id for r in decontam.drop_contaminated(df, items).collect()] == [3]


def test_op4_equals_seed_coverage(spark):
    """Every text against every item, without seeds, bitmap or stretches."""
    words = decontam.plain_words
    docs = {r[0]: words(r[1]).tolist() for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    want = set()
    for item, text in table(spark, SF, "benchmark").select("item_id", "text").collect():
        p = words(text).tolist()
        seeds = {tuple(p[i : i + 5]) for i in range(len(p) - 4)}
        for d, t in docs.items():
            if any(tuple(t[i : i + 5]) in seeds for i in range(len(t) - 4)) and plain_tiles(p, [x if x in p else 0 for x in t], 5) >= 0.6 * len(p):
                want.add((d, item))
    assert {(r.doc_id, r.item_id) for r in queries.op4_string_tiling(spark, SF).collect()} == want


def test_op7_equals_brute_force(spark):
    docs = {r[0]: r[1] for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()}
    want = brute.jaccard(docs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op7_jaccard_paths(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


@pytest.mark.parametrize("small", [1000, 7])
def test_groups_passages_and_edges(spark, monkeypatch, small):
    """A group of near copies larger than a bucket, a passage that many share, and rows that are odd."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    texts |= {100 + i: " ".join(f"u{rng.randrange(10**6)}" for _ in range(90)) + " " + passage for i in range(40)}
    texts |= {200: "one two", 201: "one two", 202: "one", 203: None, 204: "", 205: " \n", 206: "a b c d e", 207: "a b c d e"}
    rows = [(i, t, "x") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(df).collect()}
    assert got == brute.jaccard(texts)
    kept = jaccard.keep_one(spark.createDataFrame(rows + [(0, texts[0], "x"), (None, "a b c d e", "x"), (None, None, "x")], df.schema))
    assert kept.columns == df.columns
    want = sorted({c for c, _ in brute.jaccard(texts).values()})
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == want and kept.where("doc_id IS NULL").count() == 1
    assert jaccard.jaccard_join(df.limit(0)).count() == 0 and jaccard.keep_one(df.limit(0)).count() == 0


def test_repeated_ids_with_different_texts(spark):
    rows = [(5, "a b c d e f g"), (5, "h i j k l m n"), (3, "h i j k l m n"), (5, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.keep_one(df).collect())) == [(3, "h i j k l m n"), (5, "a b c d e f g")]


def test_components_and_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(25)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (jaccard.intersections(sets, columns=16) == want).all()
    m = np.zeros((6, 6), bool)
    m[0, 3] = m[3, 0] = m[3, 5] = m[5, 3] = m[1, 2] = m[2, 1] = True
    assert jaccard.components(m).tolist() == [0, 1, 1, 0, 4, 0]


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
