"""Early pruning of rare terms: the same rows as the plain count, fewer of them exchanged."""

import random

import numpy as np
from pyspark.sql import functions as F

from mailfeat.operators import bitmap as B
from mailfeat.operators import corpus as V

SCHEMA = "dataset string, msg_id string, label int, terms array<struct<term:string,tf:bigint>>"


def _docs(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = {f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randrange(0, 12))} | {f"own{i}"}
        rows.append(("xyz"[i % 3], f"m{i}", i % 2, [(w, 1 + rng.randrange(3)) for w in sorted(words)]))
    rows += [("x", "none", 0, []), ("x", "null", 1, None), (None, "anywhere", 0, [("w1", 1)]), ("x", "m0", 0, [("own0", 5)])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "msg_id")


def _counts(df):
    return sorted(map(tuple, df.select("dataset", "term", "df", "tf_total").collect()))


def test_same_rows_as_the_plain_count(spark):
    docs = _docs(spark).checkpoint()
    sizes = V.corpus_size(docs)
    plain = _counts(V.frequent_stats(docs, sizes, V.BodyParams()))
    assert plain and _counts(V.frequent_stats(docs, sizes, V.BodyParams(prune_early=True))) == plain
    assert ("x", "own0", 2) in [r[:3] for r in plain]  # two rows of one id count as two, as in the plain count
    assert _counts(V.frequent_stats(docs, sizes, V.BodyParams(prune_early=True, min_df=1))) == _counts(V.frequent_stats(docs, sizes, V.BodyParams(min_df=1)))
    occurrences = lambda d: d.agg(F.sum(F.size(F.coalesce("terms", F.array())))).first()[0]
    assert occurrences(B.without_singletons(docs)) < 0.75 * occurrences(docs)


def test_collisions_lose_nothing(spark, monkeypatch):
    docs = _docs(spark, 120, 2).checkpoint()
    sizes, plain = V.corpus_size(docs), V.BodyParams()
    want = _counts(V.frequent_stats(docs, sizes, plain))
    for largest in (64, 512):  # far too small: every slot is shared
        monkeypatch.setattr(B, "MIN_SLOTS", largest)
        monkeypatch.setattr(B, "MAX_SLOTS", largest)
        monkeypatch.setattr(B, "USELESS", 10**9)
        assert _counts(V.frequent_stats(docs, sizes, V.BodyParams(prune_early=True))) == want
    monkeypatch.setattr(B, "USELESS", 0)
    assert B.without_singletons(docs) is docs


def test_second_bits_by_brute_force(spark):
    docs = _docs(spark, 200, 3).checkpoint()
    slots = 1 << 16
    seen = [s for r in docs.select(B.term_slots(slots, ["dataset"]).alias("s")).collect() for s in r.s]
    want = {s for s in seen if seen.count(s) > 1}
    got = np.unpackbits(B.seen_again(docs, slots), bitorder="little")
    assert set(np.flatnonzero(got)) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert _counts(V.frequent_stats(none, V.corpus_size(none), V.BodyParams(prune_early=True))) == []


def test_vocabulary_is_the_same(spark):
    docs = _docs(spark).where("dataset IS NOT NULL AND terms IS NOT NULL").checkpoint()
    rows = lambda p: sorted((r.dataset, r.idx, r.term) for r in V.fit_vocabulary(docs, p).collect())
    assert rows(V.BodyParams()) == rows(V.BodyParams(prune_early=True))
