import pytest
from pyspark.sql import functions as F

from mailfeat.operators import assemble as M
from mailfeat.operators import corpus as V


def test_tfidf_golden(spark):
    docs = spark.createDataFrame(
        [("d1", 1, "win prize win"), ("d2", 1, "win prize"), ("d3", 0, "meeting notes")],
        "msg_id string, label int, clean string").withColumn("dataset", F.lit("x"))
    p = V.BodyParams(ngram_min=1, ngram_max=1)
    docs = V.with_terms(docs, p)
    vocab = V.fit_vocabulary(docs, p)
    v = {r.term: r for r in vocab.collect()}
    assert sorted(r.idx for r in v.values()) == [0, 1]
    order = [r.term for r in sorted(v.values(), key=lambda r: r.idx)]
    assert order == ["win", "prize"]
    assert v["win"].idf == pytest.approx(1.2876820725)
    assert v["win"].score == pytest.approx(20.4800112699, rel=1e-9)
    assert v["prize"].score == pytest.approx(20.2253968321, rel=1e-9)
    w = {(r.msg_id, r.term): r.w for r in V.transform_long(docs, vocab).collect()}
    assert w[("d1", "win")] == pytest.approx(0.8610369959)
    assert w[("d1", "prize")] == pytest.approx(0.5085423203)
    assert w[("d2", "win")] == pytest.approx(0.7071067812)
    assert ("d3", "win") not in w
    sc = {r.idx: r.scale for r in M.body_scale(V.transform_long(docs, vocab), V.corpus_size(docs)).collect()}
    assert sc[0] == pytest.approx(0.3749191349)


def test_l2_norm_is_one(spark):
    from mailfeat.plans.text_queries import _labelled_terms
    docs = _labelled_terms(spark, "/root/testdata/sf0.001")
    long = V.transform_long(docs, V.fit_vocabulary(docs))
    norms = long.groupBy("msg_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert norms and all(abs(r.n - 1.0) < 1e-9 for r in norms)


def test_top_k_in_two_steps(spark):
    rows = [("x", f"t{i}", (i * 37) % 101) for i in range(400)] + [("y", "only", 1)]
    df = spark.createDataFrame(rows, "dataset string, term string, n long")
    order = [F.col("n").desc(), F.col("term").asc()]
    got = V.top_k_per_group(df, 20, order, salts=7)
    want = sorted((r for r in rows if r[0] == "x"), key=lambda r: (-r[2], r[1]))[:20]
    assert [(r.term, r.rank) for r in got.where("dataset = 'x'").orderBy("rank").collect()] == [(t, i) for i, (_, t, _) in enumerate(want, 1)]
    assert got.where("dataset = 'y'").count() == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2 and "_salt" in plan  # no window over a bare dataset on all terms


def test_feature_names(spark):
    vocab = spark.createDataFrame([("x", "b", 1), ("x", "a", 0)], "dataset string, term string, idx long")
    assert [r.term for r in V.feature_names(vocab).collect()] == ["a", "b"]


def test_every_message_has_a_row_of_weights(spark):
    from mailfeat.plans import text_queries as T
    from mailfeat.sources.tables import labelled_documents, table

    sf = "/root/testdata/sf0.001"
    lab = table(spark, sf, "labels").select("doc_id")
    n_labelled, n_unseen = labelled_documents(spark, sf).count(), table(spark, sf, "documents").join(lab, "doc_id", "left_anti").count()
    for got, n in ((T.q_tfidf_weights(spark, sf).collect(), n_labelled), (T.q_tfidf_transform_unseen(spark, sf).collect(), n_unseen)):
        assert len(got) == n and all(r.sum_w is not None and abs(r.sum_w2 - (r.nnz > 0)) < 1e-5 for r in got)
    docs = V.with_terms(spark.createDataFrame([("a", 1, "win prize win", "x"), ("b", 0, "", "x"), ("c", 0, "win", "x"), ("d", 1, "other", "x")], "msg_id string, label int, clean string, dataset string"), V.BodyParams(ngram_min=1, ngram_max=1))
    vocab = spark.createDataFrame([("x", "win", 0, 1.0), ("x", "prize", 1, 1.0)], "dataset string, term string, idx long, idf double")
    rows = {r.msg_id: tuple(r)[2:] for r in T._weights_summary(V.transform_long(docs, vocab), docs).collect()}
    assert rows["b"] == rows["d"] == (0, 0.0, 0.0, 0.0) and rows["a"][0] == 2 and rows["c"] == (1, 1.0, 1.0, 0.0)


def test_weights_stay_in_the_row(spark, monkeypatch):
    """Index and join give the same cells; with the index nothing is exchanged by message."""
    import random

    rng = random.Random(1)
    rows = [(f"m{i}", i % 2, " ".join(rng.choices(["win", "prize", "call", "now", "plan", "menu", "sun"], k=rng.randrange(0, 9))), "xy"[i % 2]) for i in range(60)]
    docs = V.with_terms(spark.createDataFrame(rows, "msg_id string, label int, clean string, dataset string")).checkpoint()
    vocab = V.fit_vocabulary(docs).checkpoint()
    got = V.transform_cells(docs, vocab, extra=("label",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(msg_id" not in plan and "msg_id#" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
    as_rows = lambda df: {r.msg_id: {(c.term, c.idx): round(c.w, 12) for c in r.cells} for r in df.collect()}
    near = as_rows(got)
    monkeypatch.setattr(V, "INDEX_TERMS", 0)
    assert as_rows(V.transform_cells(docs, vocab, extra=("label",))) == near and len(near) == 60
    long = {(r.msg_id, r.term): round(r.w, 12) for r in V.transform_long(docs, vocab).collect()}
    assert long == {(m, t): w for m, cells in near.items() for (t, _), w in cells.items()}
    scale = M.body_scale(V.transform_long(docs, vocab), V.corpus_size(docs)).checkpoint()
    entries = lambda: {r.msg_id: (r.at, [round(x, 10) for x in r.v]) for r in M.body_entries(got, scale, extra=("label",)).collect()}
    near = entries()
    monkeypatch.setattr(M, "SCALE_ENTRIES", 0)
    assert entries() == near and all(at == sorted(at) for at, _ in near.values())


def test_term_frequency_is_counted_in_the_row(spark):
    from mailfeat.plans import text_queries as T

    docs = V.with_terms(spark.createDataFrame([("x", "a", "win prize win"), ("x", "b", ""), ("y", "c", None)], "dataset string, msg_id string, clean string"), V.BodyParams(ngram_min=1, ngram_max=2))
    assert {tuple(r) for r in V.doc_term_rows(docs).collect()} == {("x", "a", "win", 2), ("x", "a", "prize", 1), ("x", "a", "win prize", 1), ("x", "a", "prize win", 1)}
    plan = T.q_term_frequency(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
