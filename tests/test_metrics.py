import pytest
from pyspark.sql import functions as F

from mailfeat.operators import metrics as E
from mailfeat.operators.prefix import prefix_sums

K = ["g"]


def _scored(spark, rows):
    return spark.createDataFrame(rows, "g string, label int, score double").withColumn(
        "pred", (F.col("score") >= 0.5).cast("int"))


def test_metric_golden(spark):
    df = _scored(spark, [("a", 1, .9), ("a", 0, .8), ("a", 1, .8), ("a", 1, .4), ("a", 0, .1)])
    b = E.metric_bundle(df, K).first()
    assert (b.accuracy, b.precision, b.recall, b.f1) == (0.6, 0.6667, 0.6667, 0.6667)
    assert (b.auc_roc, b.pr_auc, b.fpr_at_95tpr) == (0.75, 0.8056, 0.5)
    c = E.confusion(df, K).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (1, 1, 1, 2)
    t = E.pr_trapezoid(E.score_points(df, K), K).first()
    assert t.pr_trapezoid == pytest.approx(0.8472, abs=1e-4)


def test_edges(spark):
    df = _scored(spark, [("a", 1, .1), ("a", 0, .2), ("b", 1, .9), ("b", 1, .7)])
    b = {r.g: r for r in E.metric_bundle(df, K).collect()}
    assert b["a"].precision == 0.0          # no predicted positive
    assert b["b"].auc_roc is None           # single class


def test_auc_matches_brute_force_and_repartition(spark):
    import random
    rnd = random.Random(7)
    rows = [("g%d" % (i % 3), rnd.randint(0, 1), round(rnd.random(), 2)) for i in range(600)]
    df = _scored(spark, rows)
    got = {r.g: r.auc_roc for r in E.auc_roc(E.score_points(df.repartition(5), K), K).collect()}
    for g in {r[0] for r in rows}:
        pos = [s for gg, l, s in rows if gg == g and l == 1]
        neg = [s for gg, l, s in rows if gg == g and l == 0]
        u = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
        assert got[g] == pytest.approx(u / (len(pos) * len(neg)), abs=1e-12)


def test_prefix_sums_cross_partitions(spark):
    df = spark.range(0, 1000).selectExpr("id % 2 AS k", "id AS o", "1L AS v")
    out = prefix_sums(df, ["k"], [F.col("o").asc()], ["v"], num_partitions=7)
    for r in out.collect():
        assert r.cum_v == r.o // 2 + 1
