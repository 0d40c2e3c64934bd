"""Vectors from one pass over cleaned texts that looks up the vocabulary's terms alone."""

import tempfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailfeat.functions.constants import ALL_HEADER_FEATURES
from mailfeat.functions.text import KnownTerms
from mailfeat.operators import corpus as V
from mailfeat.operators.fitstore import FitStore
from mailfeat.operators.fusion import FusionState, stored
from mailfeat.plans import flows, learn_queries

TEXTS = ["win prize win prize win", "", None, "a bb a bb", "x", "ab abc ab a b abc", "win", "prize win prize"]


@pytest.mark.parametrize(("n_min", "n_max"), [(1, 3), (2, 2), (1, 1)])
def test_known_terms_by_brute_force(n_min, n_max):
    terms = ["ab abc", "abc", "bb bb", "prize win", "prize win prize", "unseen", "win", "win unseen"]
    known = KnownTerms(pa.array(terms), n_min, n_max)
    got = Counter({(int(r), terms[p]): int(tf) for r, p, tf in zip(*known.counts(pa.array(TEXTS)))})
    want = Counter()
    for i, t in enumerate(TEXTS):
        words = [w for w in (t or "").split(" ") if len(w) >= 2]
        want.update((i, g) for n in range(n_min, n_max + 1) for j in range(len(words) - n + 1) if (g := " ".join(words[j : j + n])) in terms)
    assert got == want and want
    assert [len(x) for x in KnownTerms(pa.array([], pa.string())).counts(pa.array(TEXTS))] == [0, 0, 0]
    with pytest.raises(OverflowError):
        KnownTerms(pa.array(terms), 1, 40)


def _features(spark):
    """Messages of two datasets, some twice, with null labels and bodies."""
    rows = [(f"d{i % 2}", i // 2, None if i % 7 == 0 else i % 3 % 2, TEXTS[i % len(TEXTS)]) for i in range(60)]
    ft = spark.createDataFrame(rows, "dataset string, msg_id long, label int, body_text string")
    return ft.select("*", *[(F.xxhash64("msg_id", F.lit(f)) % 3).cast("double").alias(f) for f in ALL_HEADER_FEATURES])


def test_vectors_in_one_pass_are_those_of_the_join(spark, monkeypatch):
    ft, params = _features(spark), V.BodyParams(min_df=1, max_df=1.0)
    state = FusionState(params).fit(stored(ft))
    cols = ["dataset", "msg_id", "label", *(F.col(c).cast("string") for c in ("header_vec", "body_vec", "fusion_vec"))]
    one = state.transform(ft)
    got = one.collect()
    monkeypatch.setattr(V, "INDEX_TERMS", 0)
    other = FusionState(params).fit(ft)
    key = lambda r: (r.dataset, r.msg_id, r.label is None, r.label or 0, r.fusion_vec.toArray().tolist())
    far = other.transform(stored(ft).dropDuplicates(["dataset", "msg_id"])).collect()  # the join gathers by message
    near = {(r.dataset, r.msg_id): r for r in got}
    assert len(got) == 60 and len(cols) == 6 and sorted(map(key, got)) and len(far) == len(near)
    for r in far:
        mine = near[r.dataset, r.msg_id]
        assert r.header_vec == mine.header_vec and r.body_vec.size == mine.body_vec.size
        assert r.fusion_vec.toArray() == pytest.approx(mine.fusion_vec.toArray(), rel=1e-9)
        assert mine.body_vec.indices.tolist() == sorted(mine.body_vec.indices.tolist())


def test_figures_of_all_conditions_from_one_pass(spark):
    ft = stored(_features(spark))
    made = learn_queries._vector_figures(FusionState(V.BodyParams(min_df=1, max_df=1.0)).fit(ft).transform(ft))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan  # once a condition before
    assert "_clean_words" not in plan  # the text was cleaned before the fit, once
    assert Counter(r.condition for r in made.collect()) == {"header_only": 60, "body_only": 60, "fusion": 60}


def test_a_batch_keeps_texts_and_not_its_n_grams(spark):
    store = FitStore(spark, tempfile.mkdtemp(prefix="mailfeat-fit-"), V.BodyParams(min_df=1, max_df=1.0))
    store.add(_features(spark), "a")
    kept = store.table("texts")
    assert kept.columns == ["dataset", "msg_id", "label", "clean"] and kept.count() == 60
    assert store.state().sizes().count() == 2


def test_fits_fill_the_cluster(spark, monkeypatch):
    pools = []
    monkeypatch.setattr(flows, "AT_ONCE", 1)
    monkeypatch.setattr(flows, "ThreadPool", lambda n, real=flows.ThreadPool: pools.append(n) or real(n))
    flows._side_by_side([lambda: None])
    assert pools == [max(1, spark.sparkContext.defaultParallelism)]
