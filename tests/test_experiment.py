"""A run that is killed between cells goes on where it stopped, and settings found by the grid reach it."""

import tempfile

import pytest

from mailfeat.operators import learn as L
from mailfeat.plans import experiment, flows, learn_queries

SF = "/root/testdata/sf0.001"
SMALL = L.Settings(num_trees=4, max_depth=4, landmarks=16, svm_max_iter=10, platt_folds=2)
HOW = {"k": 2, "conditions": ["header_only"], "classifiers": ["NB", "RF", "SVM"]}


def rows(df):
    return sorted(map(tuple, df.select("dataset", "condition", "classifier", "accuracy", "f1", "auc_roc", "n_samples", "n_features").collect()))


def test_killed_and_started_again(spark, monkeypatch):
    ft = learn_queries.labelled_features(spark, SF).checkpoint()
    whole, ledger = experiment.run_experiment(ft, tempfile.mkdtemp(prefix="mailfeat-exp-") + "/e", settings=SMALL, **HOW)
    want = rows(whole)
    assert len(want) == 3 * 3 and len([m for m in ledger.made if "by=cell" in m]) == 3 * 2 * 2
    path, fit = tempfile.mkdtemp(prefix="mailfeat-exp-") + "/e", L.fit_model

    def dies(classifier, train, col, settings):
        if classifier == "RF" and train.where("fold = 1").isEmpty():
            raise RuntimeError("killed")
        return fit(classifier, train, col, settings)

    monkeypatch.setattr(L, "fit_model", dies)
    with pytest.raises(RuntimeError, match="killed"):
        experiment.run_experiment(ft, path, settings=SMALL, **HOW)
    monkeypatch.setattr(L, "fit_model", fit)
    again, ledger = experiment.run_experiment(ft, path, settings=SMALL, **HOW)
    assert rows(again) == want
    assert sorted(m for m in ledger.made if "by=cell" in m) == [f"scored/by=cell/dataset=d{i}/condition=header_only/classifier=RF/fold=1" for i in range(3)]
    assert "vectors" not in ledger.made and "state-committed" not in ledger.made and "scored/by=machines" in ledger.made
    monkeypatch.setattr(L, "fit_model", lambda *a: pytest.fail("nothing is left to fit"))
    third, ledger = experiment.run_experiment(ft, path, settings=SMALL, **HOW)
    assert rows(third) == want and ledger.made == []


def test_grid_settings_reach_the_flows(spark, monkeypatch):
    ft = learn_queries.labelled_features(spark, SF).checkpoint()
    monkeypatch.setattr(flows, "RF_GRID", [{"num_trees": 3}])
    monkeypatch.setattr(flows, "SVM_GRID", [{"svm_c": 10.0, "svm_kernel": "linear"}])
    seen, fit = [], L.fit_model

    def watched(classifier, train, col, settings):
        seen.append((classifier, settings.num_trees, settings.svm_c, settings.svm_kernel))
        return fit(classifier, train, col, settings)

    monkeypatch.setattr(L, "fit_model", watched)
    res = flows.run_split_flow(ft, conditions=["header_only"], classifiers=["RF"], settings=SMALL, tune=True)
    assert res.count() >= 3 and set(seen[-3:]) == {("RF", 3, 10.0, "linear")}
