"""Driver queries for metrics (E1-E12) on a deterministic scored table.

The scored table is derived from documents ⋈ labels: nine (condition,
classifier) score columns are integer blends of document length, a doc_id
hash and the quality label, so both engines compute bit-identical scores,
with many ties (quality-only scores take two values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as E
from ..sources.tables import table

KEYS = ["dataset", "condition", "classifier"]
R = 6

# (condition, classifier, w_len, w_hash, w_quality) — fixed fixture weights
COMBOS = [
    ("header_only", "NB", 1, 0, 0), ("header_only", "RF", 0, 1, 0), ("header_only", "SVM", 1, 1, 0),
    ("body_only", "NB", 0, 0, 1), ("body_only", "RF", 1, 0, 1), ("body_only", "SVM", 0, 1, 1),
    ("fusion", "NB", 1, 1, 1), ("fusion", "RF", 2, 1, 0), ("fusion", "SVM", 0, 2, 1),
]
# a length score below 1000 that keeps growing with the length
_NUM = ("(w1 * ((coalesce(n_chars, 0) * 1000) {div} (coalesce(n_chars, 0) + 4000)) + w2 * ((doc_id * 7919) % 1000)"
        " + w3 * quality * 1000) {div} (w1 + w2 + w3)")


# result tables carry the published dataset names, so that baselines meet them
DATASETS = ["SpamAssassin", "Nazario", "TREC7"]
DATASET_SQL = "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(DATASETS)) + " END"


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    combos = F.broadcast(spark.createDataFrame(
        COMBOS, "condition string, classifier string, w1 int, w2 int, w3 int"))  # 9 rows
    d = docs.join(lab, "doc_id").crossJoin(combos)
    d = d.withColumn("score", F.expr(_NUM.format(div="div")) / 1000.0)
    return d.select(
        F.expr(DATASET_SQL).alias("dataset"),
        "condition", "classifier", F.col("doc_id").alias("msg_id"),
        F.col("toxic").cast("int").alias("label"),
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("pred"),
        "score")


def _r(c, dp=R):
    return F.round(F.col(c), dp).alias(c)


def q_confusion(spark, sf):
    return E.confusion(scored_rows(spark, sf), KEYS)


def q_confusion_normalised(spark, sf):
    c = E.confusion_normalised(scored_rows(spark, sf), KEYS)
    return c.select(*KEYS, "true_label", "pred_label", "n", _r("share"))


def q_basic_metrics(spark, sf):
    b = E.basic_metrics(scored_rows(spark, sf), KEYS)
    return b.select(*KEYS, _r("accuracy"), _r("precision"), _r("recall"), _r("f1"))


def _points(spark, sf):
    return E.score_points(scored_rows(spark, sf), KEYS)


def q_roc_points(spark, sf):
    r = E.roc_points(_points(spark, sf), KEYS)
    return r.select(*KEYS, "point", "threshold", _r("fpr"), _r("tpr"))


def q_auc_roc(spark, sf):
    return E.auc_roc(_points(spark, sf), KEYS).select(*KEYS, _r("auc_roc"))


def q_avg_precision(spark, sf):
    return E.average_precision(_points(spark, sf), KEYS).select(*KEYS, _r("pr_auc"))


def q_fpr_at_tpr(spark, sf):
    p = _points(spark, sf)
    return E.fpr_at_tpr(E.roc_points(p, KEYS), KEYS).select(*KEYS, _r("fpr_at_95tpr"))


def q_pr_curve(spark, sf):
    p = E.pr_curve(_points(spark, sf), KEYS)
    return p.select(*KEYS, "point", "threshold", _r("recall"), _r("precision"))


def q_pr_trapezoid(spark, sf):
    return E.pr_trapezoid(_points(spark, sf), KEYS).select(*KEYS, _r("pr_trapezoid"))


def q_metric_bundle(spark, sf):
    return E.metric_bundle(scored_rows(spark, sf), KEYS)


QUERIES = {
    "confusion": q_confusion,
    "confusion_normalised": q_confusion_normalised,
    "basic_metrics": q_basic_metrics,
    "roc_points": q_roc_points,
    "auc_roc": q_auc_roc,
    "avg_precision": q_avg_precision,
    "fpr_at_tpr": q_fpr_at_tpr,
    "pr_curve": q_pr_curve,
    "pr_trapezoid": q_pr_trapezoid,
    "metric_bundle": q_metric_bundle,
}

_VALUES = ", ".join(f"('{c}', '{k}', {a}, {b}, {q})" for c, k, a, b, q in COMBOS)
SCORED_SQL = f"""
scored AS (
  SELECT {DATASET_SQL.replace('doc_id', 'd.doc_id')} AS dataset, c.condition, c.classifier, d.doc_id AS msg_id,
         CAST(l.toxic AS INTEGER) AS label,
         CASE WHEN s.score >= 0.5 THEN 1 ELSE 0 END AS pred, s.score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  CROSS JOIN (VALUES {_VALUES}) c(condition, classifier, w1, w2, w3)
  CROSS JOIN LATERAL (SELECT CAST({_NUM.format(div='//').replace('n_chars', 'd.n_chars').replace('doc_id', 'd.doc_id').replace('quality', 'l.quality').replace('w1', 'c.w1').replace('w2', 'c.w2').replace('w3', 'c.w3')} AS DOUBLE) / 1000.0 AS score) s)"""
K = "dataset, condition, classifier"
CONF_SQL = f"""
conf AS (SELECT {K},
  CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM scored GROUP BY {K}),
basic AS (SELECT *,
  CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1
  FROM conf)"""
POINTS_SQL = f"""
agg AS (SELECT {K}, score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
               CAST(sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg FROM scored GROUP BY ALL),
pts AS (SELECT *,
  sum(n_pos) OVER w AS cum_pos, sum(n_neg) OVER w AS cum_neg, row_number() OVER w AS point,
  sum(n_pos) OVER (PARTITION BY {K}) AS P, sum(n_neg) OVER (PARTITION BY {K}) AS N,
  count(*) OVER (PARTITION BY {K}) AS m,
  lead(n_pos) OVER w AS nx_pos, lead(n_neg) OVER w AS nx_neg
  FROM agg WINDOW w AS (PARTITION BY {K} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
roc AS (
  SELECT {K}, point, score AS threshold, cum_neg / CAST(N AS DOUBLE) AS fpr, cum_pos / CAST(P AS DOUBLE) AS tpr
  FROM pts WHERE NOT (point > 1 AND point < m AND m > 2 AND nx_pos = n_pos AND nx_neg = n_neg)
  UNION ALL SELECT DISTINCT {K}, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), 0.0, 0.0 FROM agg),
auc AS (SELECT {K}, CASE WHEN max(P) > 0 AND max(N) > 0 THEN
           sum(CAST(n_neg * (2 * cum_pos - n_pos) AS DOUBLE)) / (2.0 * max(P) * max(N)) END AS auc_roc
        FROM pts GROUP BY {K}),
ap AS (SELECT {K}, CASE WHEN max(P) > 0 THEN
          sum(n_pos * (cum_pos / CAST(cum_pos + cum_neg AS DOUBLE))) / max(P) END AS pr_auc FROM pts GROUP BY {K}),
f95 AS (SELECT g.dataset, g.condition, g.classifier, h.fpr_at_95tpr FROM (SELECT DISTINCT {K} FROM agg) g
        LEFT JOIN (SELECT {K}, arg_min(fpr, point) AS fpr_at_95tpr FROM roc WHERE tpr >= 0.95 GROUP BY {K}) h
        USING ({K}))"""


def _w(*parts):
    return "WITH " + ",".join(parts)


ORACLE = {
    "confusion": _w(SCORED_SQL, CONF_SQL) + f" SELECT {K}, tn, fp, fn, tp FROM conf",
    "confusion_normalised": _w(SCORED_SQL) + f"""
SELECT g.dataset, g.condition, g.classifier, t.true_label, p.pred_label,
       count(s.msg_id) AS n, round(count(s.msg_id) / CAST(nullif(max(nt.n_true), 0) AS DOUBLE), 6) AS share
FROM (SELECT DISTINCT {K} FROM scored) g CROSS JOIN (VALUES (0), (1)) t(true_label) CROSS JOIN (VALUES (0), (1)) p(pred_label)
LEFT JOIN scored s ON s.dataset = g.dataset AND s.condition = g.condition AND s.classifier = g.classifier AND s.label = t.true_label AND s.pred = p.pred_label
LEFT JOIN (SELECT {K}, label, count(*) AS n_true FROM scored GROUP BY ALL) nt
  ON nt.dataset = g.dataset AND nt.condition = g.condition AND nt.classifier = g.classifier AND nt.label = t.true_label
GROUP BY ALL""",
    "basic_metrics": _w(SCORED_SQL, CONF_SQL) + f"""
SELECT {K}, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM basic""",
    "roc_points": _w(SCORED_SQL, POINTS_SQL) + f" SELECT {K}, point, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc",
    "auc_roc": _w(SCORED_SQL, POINTS_SQL) + f" SELECT {K}, round(auc_roc, 6) AS auc_roc FROM auc",
    "avg_precision": _w(SCORED_SQL, POINTS_SQL) + f" SELECT {K}, round(pr_auc, 6) AS pr_auc FROM ap",
    "fpr_at_tpr": _w(SCORED_SQL, POINTS_SQL) + f" SELECT {K}, round(fpr_at_95tpr, 6) AS fpr_at_95tpr FROM f95",
    "pr_curve": _w(SCORED_SQL, POINTS_SQL) + f"""
SELECT {K}, point, score AS threshold, round(cum_pos / CAST(P AS DOUBLE), 6) AS recall,
       round(cum_pos / CAST(cum_pos + cum_neg AS DOUBLE), 6) AS precision FROM pts
UNION ALL SELECT DISTINCT {K}, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), 0.0, 1.0 FROM agg""",
    "pr_trapezoid": _w(SCORED_SQL, POINTS_SQL) + f"""
SELECT {K}, CASE WHEN max(P) > 0 THEN round(sum(n_pos / CAST(P AS DOUBLE) * (
         cum_pos / CAST(cum_pos + cum_neg AS DOUBLE) +
         CASE WHEN cum_pos - n_pos + cum_neg - n_neg = 0 THEN 1.0
              ELSE (cum_pos - n_pos) / CAST(cum_pos - n_pos + cum_neg - n_neg AS DOUBLE) END) / 2.0), 6) END
       AS pr_trapezoid FROM pts GROUP BY {K}""",
    "metric_bundle": _w(SCORED_SQL, CONF_SQL, POINTS_SQL) + f"""
SELECT b.dataset, b.condition, b.classifier, round_even(accuracy, 4) AS accuracy, round_even(precision, 4) AS precision,
       round_even(recall, 4) AS recall, round_even(f1, 4) AS f1, round_even(auc_roc, 4) AS auc_roc, round_even(pr_auc, 4) AS pr_auc,
       round_even(fpr_at_95tpr, 4) AS fpr_at_95tpr, tn + fp + fn + tp AS n_samples
FROM basic b JOIN auc USING ({K}) JOIN ap USING ({K}) JOIN f95 USING ({K})""",
}
