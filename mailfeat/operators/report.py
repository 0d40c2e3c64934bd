"""Reporting queries over result tables.

Result tables hold one row per (dataset, condition, classifier[, phase]) —
bounded by the experiment matrix — so ranking windows here are over tiny
groups by construction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import (CLASSIFIERS, CLF_DISPLAY, COND_DISPLAY, CONDITIONS, HEADER_BASELINE_ACCURACY,
                                   HEADER_BASELINE_DATASET, METRIC_COLS, PUBLISHED_BASELINES)


def summary_union(frames: list[DataFrame]) -> DataFrame:
    """Concatenate result tables (missing columns become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _order(col: str, values: list[str]):
    e = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        e = F.when(F.col(col) == v, F.lit(i)).otherwise(e)
    return e


def cond_order():
    return _order("condition", CONDITIONS)


def clf_order():
    return _order("classifier", CLASSIFIERS)


def _label(col: str, mapping: dict):
    e = F.col(col)
    for k, v in mapping.items():
        e = F.when(F.col(col) == k, F.lit(v)).otherwise(e)
    return e


def display_table(res: DataFrame) -> DataFrame:
    """Display labels, percentages (2 dp) and the condition sort key."""
    pct = [F.round(F.col(m) * 100.0, 2).alias(f"{m}_pct") for m in ("accuracy", "precision", "recall", "f1")]
    return res.select(
        "dataset", "condition", "classifier", cond_order().alias("cond_order"),
        _label("condition", COND_DISPLAY).alias("condition_label"),
        _label("classifier", CLF_DISPLAY).alias("classifier_label"), *pct,
        F.round("auc_roc", 4).alias("auc_roc"), F.round("pr_auc", 4).alias("pr_auc"),
        F.round("fpr_at_95tpr", 4).alias("fpr_at_95tpr"))


def ordered_table(res: DataFrame) -> DataFrame:
    """R2: the rows of each table in their display order, with their place in it."""
    w = Window.partitionBy("dataset").orderBy("cond_order", "classifier")
    return display_table(res).withColumn("place", F.row_number().over(w)).orderBy("dataset", "place")


def best_per_condition(res: DataFrame) -> DataFrame:
    """Highest F1 per (dataset, condition); ties -> first classifier (NB, RF, SVM)."""
    w = Window.partitionBy("dataset", "condition").orderBy(F.col("f1").desc(), clf_order())
    return res.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def fusion_gain(res: DataFrame) -> DataFrame:
    """Fusion F1 gain in points over the best header-only and body-only rows, and whose rows these are."""
    b = best_per_condition(res)
    aggs = [F.max(F.when(F.col("condition") == c, F.col(m))).alias(f"{m}_{c}") for m in ("f1", "classifier") for c in CONDITIONS]
    g = b.groupBy("dataset").agg(*aggs).where(F.col("f1_fusion").isNotNull())
    return g.select(
        "dataset", *[F.col(f"classifier_{c}").alias(f"best_{c}") for c in CONDITIONS],
        F.round((F.col("f1_fusion") - F.col("f1_header_only")) * 100.0, 2).alias("gain_vs_header"),
        F.round((F.col("f1_fusion") - F.col("f1_body_only")) * 100.0, 2).alias("gain_vs_body"))


def baselines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PUBLISHED_BASELINES, "source string, dataset string, accuracy double, method string")


_METHODS = {"fusion": "Our Fusion (Best)", "header_only": "Header-only (ours)", "body_only": "Body-only (ours)"}


def baseline_compare(res: DataFrame, base: DataFrame) -> DataFrame:
    """Best rows of each condition (datasets with a fusion result) + published baselines."""
    b = best_per_condition(res)
    has_fusion = res.where(F.col("condition") == "fusion").select("dataset").distinct()
    percent = ["accuracy", "f1", "precision", "recall"]
    shares = ["pr_auc", "fpr_at_95tpr"]
    ours = b.join(has_fusion, "dataset").select(
        "dataset", _label("condition", _METHODS).alias("method"), "classifier",
        *[F.round(F.col(m) * 100.0, 2).alias(f"{m}_pct") for m in percent], *[F.round(m, 4).alias(m) for m in shares])
    none = F.lit(None).cast("double")
    pub = base.where(F.col("accuracy").isNotNull()).join(has_fusion, "dataset").select(
        "dataset", F.concat(F.col("source"), F.lit(" ["), F.col("method"), F.lit("]")).alias("method"),
        F.lit(None).cast("string").alias("classifier"), F.col("accuracy").alias("accuracy_pct"),
        *[none.alias(f"{m}_pct") for m in percent[1:]], *[none.alias(m) for m in shares])
    return ours.unionByName(pub)


def baseline_diff(res: DataFrame) -> DataFrame:
    """Best-fusion accuracy minus the published header baseline, for matching dataset names."""
    b = best_per_condition(res).where((F.col("condition") == "fusion")
                                      & F.col("dataset").contains(HEADER_BASELINE_DATASET))
    acc = F.col("accuracy") * 100.0
    return b.select("dataset", F.round(acc, 2).alias("our_accuracy_pct"),
                    F.round(acc - HEADER_BASELINE_ACCURACY, 2).alias("diff_pct"))


def f1_pivot(res: DataFrame) -> DataFrame:
    """F1 % as condition x classifier."""
    return res.groupBy("dataset", "condition").pivot("classifier", CLASSIFIERS).agg(
        F.first(F.round(F.col("f1") * 100.0, 2)))


def f1_grouped(res: DataFrame) -> DataFrame:
    """Dataset x classifier x condition F1 %, missing combinations -> 0."""
    spark = res.sparkSession
    dims = spark.createDataFrame([(c, k) for c in CONDITIONS for k in CLASSIFIERS], "condition string, classifier string")
    grid = res.select("dataset").distinct().crossJoin(F.broadcast(dims))  # datasets x 9 fixed combos
    j = grid.join(res.select("dataset", "condition", "classifier", "f1"), ["dataset", "condition", "classifier"], "left")
    return j.select("dataset", "classifier", "condition",
                    F.round(F.coalesce(F.col("f1"), F.lit(0.0)) * 100.0, 2).alias("f1_pct"))


def full_report(res: DataFrame, base: DataFrame) -> dict[str, DataFrame]:
    """Every report for all datasets at once."""
    return {
        "ordered": ordered_table(res),
        "best": best_per_condition(res),
        "comparison": baseline_compare(res, base),
        "gain": fusion_gain(res),
        "baseline_diff": baseline_diff(res),
        "f1_pivot": f1_pivot(res),
        "f1_grouped": f1_grouped(res),
    }


# of each part of the report: what names a row, and its numbers
_PARTS = {
    "ordered": (["condition", "classifier"], ["place", "accuracy_pct", "precision_pct", "recall_pct", "f1_pct", "auc_roc", "pr_auc", "fpr_at_95tpr"]),
    "best": (["condition", "classifier"], ["accuracy", "f1"]),
    "comparison": (["method"], ["accuracy_pct", "f1_pct", "precision_pct", "recall_pct", "pr_auc", "fpr_at_95tpr"]),
    "gain": ([], ["gain_vs_header", "gain_vs_body"]),
    "baseline_diff": ([], ["our_accuracy_pct", "diff_pct"]),
    "f1_pivot": (["condition"], CLASSIFIERS),
    "f1_grouped": (["condition", "classifier"], ["f1_pct"]),
}


def report_long(res: DataFrame, base: DataFrame) -> DataFrame:
    """R12 as one table: part, dataset, item, measure, value (a null value where a part has none)."""
    out = None
    for part, df in full_report(res, base).items():
        names, measures = _PARTS[part]
        item = F.concat_ws(" / ", *names) if names else F.lit("")
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
        rows = df.select(F.lit(part).alias("part"), "dataset", item.alias("item"), pairs.alias("x")).select("part", "dataset", "item", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


__all__ = ["summary_union", "display_table", "ordered_table", "best_per_condition", "fusion_gain",
           "baseline_compare", "baseline_diff", "f1_pivot", "f1_grouped", "full_report", "report_long", "METRIC_COLS"]
