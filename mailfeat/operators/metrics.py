"""Exact classification metrics as grouped queries.

Input: (keys..., label, pred, score).  Threshold metrics work on the table of
distinct scores per group (ties pre-aggregated with map-side combine), whose
running sums come from the range-partitioned `prefix_sums` — no window ever
holds a whole group.  The 'next point' that the collinear-point rule needs is
an equi-join on the running point number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TARGET_TPR
from .prefix import prefix_sums

DP = 4  # published metric precision


def _ratio(num, den):
    """num/den, 0 when den = 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tn, fp, fn, tp per group."""
    lab, pr = F.col("label"), F.col("pred")
    return df.groupBy(*keys).agg(
        F.sum(((lab == 0) & (pr == 0)).cast("long")).alias("tn"),
        F.sum(((lab == 0) & (pr == 1)).cast("long")).alias("fp"),
        F.sum(((lab == 1) & (pr == 0)).cast("long")).alias("fn"),
        F.sum(((lab == 1) & (pr == 1)).cast("long")).alias("tp"),
    )


def confusion_normalised(df: DataFrame, keys: list[str]) -> DataFrame:
    """All four cells, each as a share of its true label's rows (null if that label has none)."""
    cells = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"), F.col(c).alias("n"))
                      for c, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    c = confusion(df, keys).select(*keys, "tn", "fp", "fn", "tp", F.explode(cells).alias("cell"))
    n_true = F.when(F.col("cell.true_label") == 0, F.col("tn") + F.col("fp")).otherwise(F.col("fn") + F.col("tp"))
    return c.select(*keys, "cell.*", F.try_divide(F.col("cell.n"), n_true).alias("share"))


def basic_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """E3-E6 from the confusion counts."""
    c = confusion(df, keys)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *keys, "tn", "fp", "fn", "tp",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def score_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct scores per group, descending, with running counts.

    Columns: keys, score, n_pos, n_neg, n_pts(=1), cum_pos, cum_neg, point
    (1-based position), P, N (group totals), m (points in group).
    """
    agg = df.groupBy(*keys, "score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("n_pos"),
        F.sum((F.col("label") != 1).cast("long")).alias("n_neg"),
    ).withColumn("n_pts", F.lit(1).cast("long"))
    cum = prefix_sums(agg, keys, [F.col("score").desc()], ["n_pos", "n_neg", "n_pts"])
    tot = agg.groupBy(*keys).agg(F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"),
                                 F.count(F.lit(1)).alias("m"))
    cum = (cum.withColumnRenamed("cum_n_pts", "point").withColumnRenamed("cum_n_pos", "cum_pos")
           .withColumnRenamed("cum_n_neg", "cum_neg"))
    return cum.join(tot, keys)


def auc_roc(points: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid under the ROC curve (null for a single-class group)."""
    area = F.col("n_neg") * (2 * F.col("cum_pos") - F.col("n_pos"))
    return points.groupBy(*keys).agg(
        F.sum(area.cast("double")).alias("_a"), F.first("P").alias("P"), F.first("N").alias("N")
    ).select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0),
                           F.try_divide(F.col("_a"), 2.0 * F.col("P") * F.col("N"))).alias("auc_roc"))


def average_precision(points: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over thresholds of (recall step) x precision."""
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return points.groupBy(*keys).agg(
        F.sum(F.col("n_pos") * prec).alias("_s"), F.first("P").alias("P")
    ).select(*keys, F.when(F.col("P") > 0, F.try_divide(F.col("_s"), F.col("P"))).alias("pr_auc"))


def roc_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """ROC points with collinear interior points dropped, plus the (0,0) start.

    Columns: keys, point (0 = start), threshold, fpr, tpr.
    """
    nxt = points.select(*keys, (F.col("point") - 1).alias("point"),
                        F.col("n_pos").alias("nx_pos"), F.col("n_neg").alias("nx_neg"))
    j = points.join(nxt, [*keys, "point"], "left")
    interior = (F.col("point") > 1) & (F.col("point") < F.col("m")) & (F.col("m") > 2)
    same = (F.col("nx_pos") == F.col("n_pos")) & (F.col("nx_neg") == F.col("n_neg"))
    kept = j.where(~(interior & same))
    pts = kept.select(*keys, "point", F.col("score").alias("threshold"),
                      F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"),
                      F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"))
    start = points.select(*keys).distinct().select(
        *keys, F.lit(0).cast("long").alias("point"), F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def fpr_at_tpr(roc: DataFrame, keys: list[str], target: float = TARGET_TPR) -> DataFrame:
    """Fpr of the first kept ROC point whose tpr reaches the target."""
    hit = roc.where(F.col("tpr") >= target).groupBy(*keys).agg(
        F.min_by("fpr", "point").alias("fpr_at_95tpr"))
    return roc.select(*keys).distinct().join(hit, keys, "left")


def pr_curve(points: DataFrame, keys: list[str]) -> DataFrame:
    """E11 points: (recall, precision) per threshold, plus the final (0, 1)."""
    pts = points.select(*keys, "point", F.col("score").alias("threshold"),
                        F.try_divide(F.col("cum_pos"), F.col("P")).alias("recall"),
                        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"))
    end = points.select(*keys).distinct().select(
        *keys, F.lit(0).cast("long").alias("point"), F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return pts.unionByName(end)


def pr_trapezoid(points: DataFrame, keys: list[str]) -> DataFrame:
    """E11 area: trapezoid over recall, starting at (0, 1)."""
    prev_pos = F.col("cum_pos") - F.col("n_pos")
    prev_all = prev_pos + F.col("cum_neg") - F.col("n_neg")
    prev_prec = F.when(prev_all == 0, F.lit(1.0)).otherwise(prev_pos / prev_all)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    area = F.try_divide(F.col("n_pos"), F.col("P")) * (prec + prev_prec) / 2.0
    return points.groupBy(*keys).agg(F.sum(area).alias("_a"), F.first("P").alias("P")).select(
        *keys, F.when(F.col("P") > 0, F.col("_a")).alias("pr_trapezoid"))


def metric_bundle(df: DataFrame, keys: list[str], dp: int = DP) -> DataFrame:
    """The seven published metrics per group, rounded; plus n_samples."""
    pts = score_points(df, keys)  # its running sums rest in the checkpoint folder
    basic = basic_metrics(df, keys)
    out = (basic.join(auc_roc(pts, keys), keys)
           .join(average_precision(pts, keys), keys)
           .join(fpr_at_tpr(roc_points(pts, keys), keys), keys))
    r = lambda c: F.bround(F.col(c), dp).alias(c)  # half to even, as the published tables
    return out.select(*keys, r("accuracy"), r("precision"), r("recall"), r("f1"), r("auc_roc"),
                      r("pr_auc"), r("fpr_at_95tpr"),
                      (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_samples"))
