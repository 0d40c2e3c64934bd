"""Fitted state from batches that add up."""

import tempfile

import pytest
from pyspark.sql import functions as F

from mailfeat.operators import assemble as M
from mailfeat.operators import corpus as V
from mailfeat.operators import fitstore as S
from mailfeat.operators.fusion import FusionState
from mailfeat.plans import learn_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ft(spark):
    return learn_queries.labelled_features(spark, SF).checkpoint()


def _vocabulary(state):
    return sorted((r.dataset, r.idx, r.term, r.df, r.n_docs, round(r.idf, 12)) for r in state.vocab.collect())


def _numbers(df, *keys):
    return {tuple(r[k] for k in keys): [r[c] for c in sorted(set(df.columns) - set(keys))] for r in df.collect()}


def _same(a: FusionState, b: FusionState):
    assert _vocabulary(a) == _vocabulary(b)
    for x, y, keys in ((a.header, b.header, ["dataset"]), (a.scale, b.scale, ["dataset", "idx"])):
        one, two = _numbers(x, *keys), _numbers(y, *keys)
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-9, abs=1e-9) for k in one)


def test_batches_add_up_to_one_fit(spark, ft, monkeypatch):
    store = S.FitStore(spark, tempfile.mkdtemp(prefix="mailfeat-fit-"))
    part = lambda i: ft.where(F.pmod(F.xxhash64("msg_id"), F.lit(3)) == i)
    store.add(part(0), "mon")
    store.add(part(1), "tue")
    first = store.state()
    _same(first, FusionState().fit(part(0).unionByName(part(1))))

    counted = []
    real = V.term_stats
    monkeypatch.setattr(V, "term_stats", lambda docs, *a: counted.append(docs.count()) or real(docs, *a))
    store.add(part(2), "wed")
    assert counted == [part(2).count()]  # the earlier messages aren't counted again
    whole = store.state()
    assert len(counted) == 1
    monkeypatch.undo()
    _same(whole, FusionState().fit(ft))
    store.add(part(2), "wed")  # the same batch again takes its own place
    assert store.batches() == ["mon", "tue", "wed"] and store.sizes().agg(F.sum("n_docs")).first()[0] == ft.count()
    _same(store.state(["mon", "tue"]), first)
    store.drop("wed")
    _same(store.state(), first)
    with pytest.raises(ValueError, match="no such batch"):
        store.state(["mon", "wed"])
    vecs = sorted(map(tuple, whole.transform(ft).select("msg_id", F.col("fusion_vec").cast("string")).collect()))
    assert len(vecs) == ft.count()


@pytest.mark.parametrize("offset, rel", [(0.0, 1e-12), (1e9, 1e-6)])  # a mean of 1e9 has a last place of 1e-7
def test_moments_by_brute_force(spark, offset, rel):
    rows = [("x", offset + v, b) for v, b in ((1.0, 0), (2.0, 0), (4.0, 1), (8.0, 1), (8.0, 2))] + [("y", 3.0, 0)]
    df = spark.createDataFrame(rows, "dataset string, f double, b int")
    parts = [S.header_moments(df.where(F.col("b") == i), ["f"]) for i in range(4)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = _numbers(S.stats_of_moments(S.merged_moments(every), ["f"]), "dataset")
    want = _numbers(M.header_stats(df, ["f"]), "dataset")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=rel) for k in want)
    assert got["x",][1] == pytest.approx((sum((v - 4.6) ** 2 for v in (1, 2, 4, 8, 8)) / 5) ** 0.5, rel=rel)


def test_unfinished_and_empty_batches(spark, ft, monkeypatch):
    store = S.FitStore(spark, tempfile.mkdtemp(prefix="mailfeat-fit-"))
    assert store.batches() == [] and store.counts().count() == 0
    store.add(ft, "all")
    want = _vocabulary(store.state())
    monkeypatch.setattr(S, "header_moments", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.add(ft, "killed")
    monkeypatch.undo()
    assert store.batches() == ["all"] and _vocabulary(store.state()) == want
    store.add(ft.limit(0), "nothing")
    assert store.batches() == ["all", "nothing"] and _vocabulary(store.state()) == want
    for bad in ("", "a/b", ".x", "_x"):
        with pytest.raises(ValueError):
            store.add(ft, bad)
    strict = S.FitStore(spark, tempfile.mkdtemp(prefix="mailfeat-fit-"), V.BodyParams(min_df=10_000))
    strict.add(ft, "a")
    with pytest.raises(ValueError, match="no term"):
        strict.state()
