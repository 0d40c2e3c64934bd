"""Driver queries for the reports (R1-R12) on result tables computed from the
scored fixture: CV-flavour results over all rows and test-phase results over
the stratified test split."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ALL_HEADER_FEATURES, CLASSIFIERS, CONDITIONS, HEADER_BASELINE_ACCURACY, PUBLISHED_BASELINES
from ..operators import corpus as V
from ..operators import learn as L
from ..operators import metrics as E
from ..operators import report as R
from ..sources.tables import labelled_documents
from . import learn_queries as LQ
from . import metric_queries as MQ
from . import text_queries as TQ

KEYS = MQ.KEYS
N_HEADER = len(ALL_HEADER_FEATURES)


def results_cv(spark, sf) -> DataFrame:
    return E.metric_bundle(MQ.scored_rows(spark, sf), KEYS)


def with_n_features(res: DataFrame, vocab: DataFrame) -> DataFrame:
    """n_features of each condition from the size of the dataset's fitted vocabulary."""
    names = F.element_at(F.array(*map(F.lit, MQ.DATASETS)), F.substring("dataset", 2, 1).cast("int") + 1)
    size = vocab.groupBy("dataset").agg(F.count(F.lit(1)).alias("v")).select(names.alias("dataset"), "v")
    n = (F.when(F.col("condition") == "header_only", F.lit(N_HEADER)).when(F.col("condition") == "body_only", F.col("v"))
         .otherwise(F.col("v") + N_HEADER))
    return res.join(size, "dataset", "left").withColumn("n_features", n.cast("int")).drop("v")


def results_test(spark, sf) -> DataFrame:
    base = labelled_documents(spark, sf).select("msg_id", "dataset", "label")
    test = L.stratified_split(base).where(F.col("split") == "test").select("msg_id")
    b = E.metric_bundle(MQ.scored_rows(spark, sf).join(test, "msg_id"), KEYS)
    return b.drop("n_samples").withColumn("phase", F.lit("test"))


def q_summary_union(spark, sf):
    vocab = V.fit_vocabulary(TQ._labelled_terms(spark, sf))
    return R.summary_union([with_n_features(results_cv(spark, sf), vocab), results_test(spark, sf)])


def q_ordered_table(spark, sf):
    return R.ordered_table(results_cv(spark, sf))


def q_test_summary(spark, sf):
    return R.display_table(results_test(spark, sf))


def q_best_per_condition(spark, sf):
    return R.best_per_condition(results_cv(spark, sf)).select(*KEYS, "accuracy", "f1")


def q_fusion_gain(spark, sf):
    return R.fusion_gain(results_cv(spark, sf))


def q_baseline_compare(spark, sf):
    return R.baseline_compare(results_cv(spark, sf), R.baselines(spark))


def q_baseline_diff(spark, sf):
    return R.baseline_diff(results_cv(spark, sf))


def q_f1_pivot(spark, sf):
    return R.f1_pivot(results_cv(spark, sf))


def q_f1_grouped(spark, sf):
    return R.f1_grouped(results_cv(spark, sf))


def q_full_report(spark, sf):
    return R.report_long(results_cv(spark, sf), R.baselines(spark))


QUERIES = {
    "summary_union": q_summary_union,
    "ordered_table": q_ordered_table,
    "test_summary": q_test_summary,
    "best_per_condition": q_best_per_condition,
    "fusion_gain": q_fusion_gain,
    "baseline_compare": q_baseline_compare,
    "baseline_diff": q_baseline_diff,
    "f1_pivot": q_f1_pivot,
    "f1_grouped": q_f1_grouped,
    "full_report": q_full_report,
}

# ---------------------------------------------------------------- oracle
K = MQ.K
_NAMES = ["conf", "basic", "agg", "pts", "roc", "auc", "ap", "f95"]


def _bundle(src: str, sfx: str) -> str:
    body = MQ.CONF_SQL + "," + MQ.POINTS_SQL
    body = body.replace("FROM scored", f"FROM {src}")
    body = re.sub(r"\b(" + "|".join(_NAMES) + r")\b", lambda m: m.group(1) + sfx, body)
    return body + f""",
bundle{sfx} AS (SELECT b.dataset, b.condition, b.classifier, round_even(accuracy, 4) AS accuracy,
       round_even(precision, 4) AS precision, round_even(recall, 4) AS recall, round_even(f1, 4) AS f1,
       round_even(auc_roc, 4) AS auc_roc, round_even(pr_auc, 4) AS pr_auc, round_even(fpr_at_95tpr, 4) AS fpr_at_95tpr,
       tn + fp + fn + tp AS n_samples
  FROM basic{sfx} b JOIN auc{sfx} USING ({K}) JOIN ap{sfx} USING ({K}) JOIN f95{sfx} USING ({K}))"""


RES = (MQ.SCORED_SQL + "," + _bundle("scored", "") + "," + LQ._LABDOCS + "," + LQ._RANKED + f""",
split AS (SELECT msg_id, {LQ._SPLIT} AS split FROM ranked),
scored_t AS (SELECT s.* FROM scored s JOIN split p ON s.msg_id = p.msg_id WHERE p.split = 'test'),"""
       + _bundle("scored_t", "_t") + f""",
res AS (SELECT * FROM bundle),
res_t AS (SELECT {K}, accuracy, precision, recall, f1, auc_roc, pr_auc, fpr_at_95tpr, 'test' AS phase FROM bundle_t),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, condition ORDER BY f1 DESC,
           CASE classifier {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSIFIERS))} ELSE {len(CLASSIFIERS)} END) AS rn
         FROM res) WHERE rn = 1)""")


_VSIZE = f"""vsize AS (SELECT {MQ.DATASET_SQL.replace("doc_id % 3", "CAST(substr(dataset, 2, 1) AS INTEGER)")} AS dataset, count(*) AS v FROM vocab GROUP BY dataset)"""
_NF = f"CAST(CASE condition WHEN 'header_only' THEN {N_HEADER} WHEN 'body_only' THEN v ELSE v + {N_HEADER} END AS INTEGER)"


def _display(src):
    cond = "CASE condition " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CONDITIONS)) + f" ELSE {len(CONDITIONS)} END"
    from ..functions.constants import CLF_DISPLAY, COND_DISPLAY
    cl = "CASE condition " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COND_DISPLAY.items()) + " ELSE condition END"
    kl = "CASE classifier " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLF_DISPLAY.items()) + " ELSE classifier END"
    pct = ", ".join(f"round({m} * 100.0, 2) AS {m}_pct" for m in ("accuracy", "precision", "recall", "f1"))
    return (f"SELECT {K}, {cond} AS cond_order, {cl} AS condition_label, {kl} AS classifier_label, {pct}, "
            f"round(auc_roc, 4) AS auc_roc, round(pr_auc, 4) AS pr_auc, round(fpr_at_95tpr, 4) AS fpr_at_95tpr FROM {src}")


def _ordered(src):
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY dataset ORDER BY cond_order, classifier) AS INTEGER) AS place FROM ({_display(src)})"


_BASE_VALUES = ", ".join(
    "('{}', '{}', {}, '{}')".format(s, d, "NULL" if a is None else f"CAST({a} AS DOUBLE)", m)
    for s, d, a, m in PUBLISHED_BASELINES)
_METHOD = "CASE condition WHEN 'fusion' THEN 'Our Fusion (Best)' WHEN 'header_only' THEN 'Header-only (ours)' WHEN 'body_only' THEN 'Body-only (ours)' ELSE condition END"

_GAIN = "SELECT dataset, " + ", ".join(f"max(CASE WHEN condition = '{c}' THEN classifier END) AS best_{c}" for c in CONDITIONS) + """,
       round((max(CASE WHEN condition = 'fusion' THEN f1 END) - max(CASE WHEN condition = 'header_only' THEN f1 END)) * 100.0, 2) AS gain_vs_header,
       round((max(CASE WHEN condition = 'fusion' THEN f1 END) - max(CASE WHEN condition = 'body_only' THEN f1 END)) * 100.0, 2) AS gain_vs_body
FROM best GROUP BY dataset HAVING max(CASE WHEN condition = 'fusion' THEN f1 END) IS NOT NULL"""
_PCT = ("accuracy", "f1", "precision", "recall")
_COMPARE = f"""
SELECT b.dataset, {_METHOD} AS method, classifier, {", ".join(f"round({m} * 100.0, 2) AS {m}_pct" for m in _PCT)},
       round(pr_auc, 4) AS pr_auc, round(fpr_at_95tpr, 4) AS fpr_at_95tpr
FROM best b WHERE dataset IN (SELECT dataset FROM res WHERE condition = 'fusion')
UNION ALL
SELECT p.dataset, p.source || ' [' || p.method || ']', CAST(NULL AS VARCHAR), p.accuracy, {", ".join(["CAST(NULL AS DOUBLE)"] * 5)}
FROM (VALUES {_BASE_VALUES}) p(source, dataset, accuracy, method)
WHERE p.accuracy IS NOT NULL AND dataset IN (SELECT dataset FROM res WHERE condition = 'fusion')"""
_DIFF = f"""SELECT dataset, round(accuracy * 100.0, 2) AS our_accuracy_pct, round(accuracy * 100.0 - {HEADER_BASELINE_ACCURACY}, 2) AS diff_pct
FROM best WHERE condition = 'fusion' AND contains(dataset, 'SpamAssassin')"""
_PIVOT = f"""SELECT dataset, condition, {', '.join(f"first(CASE WHEN classifier = '{c}' THEN round(f1 * 100.0, 2) END) FILTER (WHERE classifier = '{c}') AS {c}" for c in CLASSIFIERS)}
FROM res GROUP BY dataset, condition"""
_GROUPED = f"""SELECT g.dataset, g.classifier, g.condition, round(coalesce(r.f1, 0.0) * 100.0, 2) AS f1_pct
FROM (SELECT d.dataset, dims.condition, dims.classifier FROM (SELECT DISTINCT dataset FROM res) d
      CROSS JOIN (VALUES {', '.join(f"('{c}', '{k}')" for c in CONDITIONS for k in CLASSIFIERS)}) dims(condition, classifier)) g
LEFT JOIN res r USING ({K})"""


def _long(part: str, sql: str, names: list[str], measures: list[str]) -> str:
    item = " || ' / ' || ".join(names) if names else "''"
    return " UNION ALL ".join(f"SELECT '{part}' AS part, dataset, {item} AS item, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({sql})" for m in measures)


_REPORT = {"ordered": _ordered("res"), "best": "SELECT * FROM best", "comparison": _COMPARE, "gain": _GAIN, "baseline_diff": _DIFF, "f1_pivot": _PIVOT, "f1_grouped": _GROUPED}
ORACLE = {
    "summary_union": f"""WITH {RES}, {TQ._DISC.replace('score AS (', 'vscore AS (').replace('FROM score)', 'FROM vscore)')}, {_VSIZE}
SELECT {K}, accuracy, precision, recall, f1, auc_roc, pr_auc, fpr_at_95tpr, n_samples, {_NF} AS n_features,
       CAST(NULL AS VARCHAR) AS phase FROM res LEFT JOIN vsize USING (dataset)
UNION ALL SELECT {K}, accuracy, precision, recall, f1, auc_roc, pr_auc, fpr_at_95tpr, CAST(NULL AS BIGINT),
       CAST(NULL AS INTEGER), phase FROM res_t""",
    "ordered_table": f"WITH {RES} {_ordered('res')}",
    "test_summary": f"WITH {RES} {_display('res_t')}",
    "best_per_condition": f"WITH {RES} SELECT {K}, accuracy, f1 FROM best",
    "fusion_gain": f"WITH {RES} {_GAIN}",
    "baseline_compare": f"WITH {RES} {_COMPARE}",
    "baseline_diff": f"WITH {RES} {_DIFF}",
    "f1_pivot": f"WITH {RES} {_PIVOT}",
    "f1_grouped": f"WITH {RES} {_GROUPED}",
    "full_report": f"WITH {RES} " + " UNION ALL ".join(_long(p, sql, *R._PARTS[p]) for p, sql in _REPORT.items()),
}
