"""Fitted state, saved models, flows and scoring, on small settings."""

import tempfile

import pytest
from pyspark.sql import functions as F

from mailfeat.operators import corpus as V
from mailfeat.operators import forest
from mailfeat.operators import learn as L
from mailfeat.operators import metrics as E
from mailfeat.operators.fusion import FusionState, NotFitted
from mailfeat.operators.prefix import prefix_sums
from mailfeat.plans import flows, learn_queries, stream_queries
from mailfeat.sources.tables import messages
from mailfeat.streaming.score import score_messages

SF = "/root/testdata/sf0.001"
SMALL = L.Settings(num_trees=4, max_depth=4, fourier=16, svm_max_iter=10, platt_folds=2)


@pytest.fixture(scope="module")
def ft(spark):
    return learn_queries.labelled_features(spark, SF).checkpoint()


def test_state_round_trip_and_guards(spark, ft):
    with pytest.raises(NotFitted):
        FusionState().transform(ft)
    with pytest.raises(ValueError, match="no term"):
        FusionState(V.BodyParams(min_df=10_000)).fit(ft)
    state = FusionState().fit(ft)
    path = tempfile.mkdtemp(prefix="mailfeat-state-")
    state.save(path)
    cols = ["dataset", "msg_id", F.col("fusion_vec").cast("string").alias("v")]
    a, b = (sorted(map(tuple, s.transform(ft).select(*cols).collect())) for s in (state, FusionState.load(spark, path)))
    assert a == b and len(a) == ft.count()
    size = {r.dataset: r.vocab_size for r in state.sizes().collect()}
    for r in state.transform(ft).collect():
        assert (r.header_vec.size, r.body_vec.size, r.fusion_vec.size) == (33, size[r.dataset], size[r.dataset] + 33)


def test_fit_save_score_batch_and_stream(spark, ft):
    path = tempfile.mkdtemp(prefix="mailfeat-models-")
    flows.fit_matrix(ft, path, ["fusion"], ["RF"], settings=SMALL)
    names = flows.dataset_names(ft)
    msgs = messages(spark, SF, labelled=False).select("msg_id", "dataset", "raw")
    rows = sorted(map(tuple, score_messages(msgs, path, names).collect()))
    assert len(rows) == 200 and {r[2:4] for r in rows} == {("fusion", "RF")}
    stream = stream_queries.score_stream(spark, SF, path, names)
    assert sorted(map(tuple, stream.select("msg_id", "dataset", "condition", "classifier", "pred", "confidence", "verdict").collect())) == rows


def test_cv_flow(spark, ft):
    res = flows.run_cv_experiment(ft, 2, ["header_only", "fusion"], ["NB", "RF", "SVM"], settings=SMALL).collect()
    assert len(res) == 3 * 2 * 3 and all(0 <= r.accuracy <= 1 for r in res)
    assert all(r.n_features == 33 if r.condition == "header_only" else r.n_features > 33 for r in res)
    own = flows.run_cv_experiment(ft.where("dataset = 'd0'"), 2, ["fusion"], ["RF"], settings=SMALL, fit_scope="fold").collect()
    assert len(own) == 1


def test_split_flow_and_counts(spark, ft):
    res = flows.run_split_flow(ft, conditions=["fusion"], classifiers=["RF"], settings=SMALL).collect()
    assert {r.phase for r in res} <= {"val", "test"} and len(res) >= 3
    n = flows.split_counts(ft).collect()
    assert sum(r.n for r in n) == ft.count()


def test_grid_search_and_importance(spark, ft):
    one = ft.where("dataset = 'd1'")
    state = FusionState().fit(one)
    frame = flows.vectors(one, state).checkpoint()
    table, best = flows.grid_search(frame, SMALL, [{"num_trees": 2}, {"num_trees": 3}], [{"svm_c": 1.0, "svm_kernel": "linear"}], folds=2)
    assert table.count() == 3 and best["d1"].num_trees in (2, 3) and best["d1"].svm_kernel == "linear"
    top = L.feature_importance(L.fit_model("RF", frame, "fusion_vec", SMALL), state.names(), 5).collect()
    assert 0 < len(top) <= 5 and all(r.family in ("base", "extended", "body") for r in top)


def test_rbf_features_approach_the_kernel(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    x, y = np.array([1.0, 0.0, 2.0]), np.array([0.5, 1.0, 1.5])
    df = spark.createDataFrame([(Vectors.dense(x),), (Vectors.sparse(3, [0, 1, 2], y),)], ["v"])
    z = [np.array(r.k) for r in L.FourierFeatures("v", "k", 4096, 0.3, 3, 1).transform(df).collect()]
    assert abs(z[0] @ z[1] - np.exp(-0.3 * ((x - y) ** 2).sum())) < 0.05


def test_prefix_sums_with_null_keys_stay_on_the_jvm(spark):
    df = spark.range(100).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS k", "id AS o", "1L AS v", "id AS other")
    out = prefix_sums(df, ["k"], [F.col("o").asc()], ["v"])
    rows = {}
    for r in out.collect():
        rows.setdefault(r.k, []).append((r.o, r.cum_v))
    assert all([c for _, c in sorted(x)] == list(range(1, len(x) + 1)) for x in rows.values()) and len(rows) == 3
    assert dict(out.dtypes)["other"] == "bigint"
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_half_to_even(spark):
    rows = [("g", 1, int(i < 29), 0.5) for i in range(32)]
    df = spark.createDataFrame(rows, "g string, label int, pred int, score double")
    assert E.metric_bundle(df, ["g"]).first().accuracy == 0.9062


def test_grid_grows_common_trees_once(spark, ft, monkeypatch):
    one = ft.where("dataset = 'd1'")
    frame = flows.vectors(one, FusionState().fit(one)).checkpoint()
    grid = [{"num_trees": t, "max_depth": d} for t in (2, 3) for d in (3, 6)]
    calls, grown = [], forest._grown
    monkeypatch.setattr(forest, "_grown", lambda *a: calls.append(a) or grown(*a))
    found = {r.point: r.f1 for r in flows.grid_search(frame, SMALL, grid, [], folds=2)[0].collect()}
    assert len(calls) == 2  # one for each fold
    calls.clear()
    together = forest.fit_all
    monkeypatch.setattr(forest, "fit_all", lambda df, col, points: [together(df, col, [s])[0] for s in points])
    assert found == {r.point: r.f1 for r in flows.grid_search(frame, SMALL, grid, [], folds=2)[0].collect()}
    assert len(calls) == 8
