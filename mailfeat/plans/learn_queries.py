"""Driver queries for splits, scaling, naive Bayes and the Spark ML models (L, M)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ALL_HEADER_FEATURES, CONDITIONS, CV_FOLDS
from ..operators import assemble as M
from ..operators import corpus as V
from ..operators import headers as H
from ..operators import learn as L
from ..operators import metrics as E
from ..operators.fitstore import FitStore
from ..operators.fusion import CONDITION_COLUMNS, FusionState, stored
from ..session import checkpoint_dir
from ..sources.raw import parse_text
from ..sources.tables import labelled_documents, messages, table
from . import flows
from . import header_queries as HQ
from . import text_queries as TQ

FEATURES = ALL_HEADER_FEATURES
R = 6
#: Exact means of 0/1 features have short decimals that end in 5 at the sixth place; at this one they don't.
NB_DIGITS = 9


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table of labelled, kept messages."""
    parsed = parse_text(messages(spark, sf_dir, labelled=True))
    return H.feature_table(H.header_features(parsed))


def q_stratified_folds(spark, sf):
    d = labelled_documents(spark, sf).select("msg_id", "dataset", "label")
    return L.stratified_folds(d, CV_FOLDS).select("msg_id", "dataset", "label", "fold")


def q_stratified_split(spark, sf):
    d = labelled_documents(spark, sf).select("msg_id", "dataset", "label")
    return L.stratified_split(d).select("msg_id", "dataset", "label", "split")


def q_class_weights(spark, sf):
    d = labelled_documents(spark, sf)
    return L.class_weights(d).select("dataset", "label", F.round("weight", R).alias("weight"))


def q_header_zscore(spark, sf):
    ft = labelled_features(spark, sf)
    long = M.header_stats_long(M.header_stats(ft, FEATURES), FEATURES)
    return long.select("dataset", "feature", F.round("mean", R).alias("mean"), F.round("scale", R).alias("scale"))


def q_nb_parameters(spark, sf):
    ft = labelled_features(spark, sf)
    p = L.nb_params_long(L.nb_fit(ft, FEATURES), FEATURES)
    return p.select("dataset", "label", "feature", F.round("prior", NB_DIGITS).alias("prior"),
                    F.round("mean", NB_DIGITS).alias("mean"), F.round("var", NB_DIGITS).alias("var"))


def q_nb_predict(spark, sf):
    checkpoint_dir(spark)
    ft = labelled_features(spark, sf).drop("body_text").checkpoint()  # read by the split, the fit and the prediction
    sp = L.stratified_split(ft.select("msg_id", "dataset", "label")).select("msg_id", "split")
    ft = ft.join(sp, "msg_id")
    params = L.nb_fit(ft.where(F.col("split") == "train"), FEATURES)
    pred = L.nb_predict(ft.where(F.col("split") == "test"), params, FEATURES)
    return pred.select("msg_id", "dataset", "label", "pred", F.round("score", R).alias("score"))


def q_body_scale(spark, sf):
    docs = TQ._labelled_terms(spark, sf)
    vocab = V.fit_vocabulary(docs).checkpoint()
    sc = M.scale_of_sums(V.weight_sums(docs, vocab, V.BodyParams()), V.corpus_size(docs))
    return sc.select("dataset", F.col("idx").cast("long").alias("idx"), F.round("scale", R).alias("scale"))


def q_fusion_vectors(spark, sf):
    """M3-M6: size, stored cells and length of each condition's vector, by message."""
    ft = stored(labelled_features(spark, sf))
    return _vector_figures(FusionState().fit(ft).transform(ft))


def q_fusion_vectors_merged(spark, sf):
    """fusion_vectors with a state added up from four batches of messages."""
    base = f"{checkpoint_dir(spark)}/fitstore-{uuid.uuid4().hex}"
    ft = stored(labelled_features(spark, sf))
    store = FitStore(spark, base)
    for i in range(4):
        store.add(ft.where(F.pmod(F.xxhash64("msg_id"), F.lit(4)) == i), f"batch-{i}")
    return _vector_figures(store.state().transform(ft))


def _vector_figures(v):
    """Rows of all conditions from one pass over the vectors."""
    parts = []
    for cond, col in CONDITION_COLUMNS.items():
        p = F.unwrap_udt(F.col(col))
        norm = F.sqrt(F.aggregate(p["values"], F.lit(0.0), lambda a, x: a + x * x))
        parts.append(F.struct(F.lit(cond).alias("condition"), p["size"].cast("long").alias("size"), F.size(p["values"]).alias("nnz"), F.round(norm, 4).alias("norm")))
    return v.select("dataset", "msg_id", F.explode(F.array(*parts)).alias("p")).select("dataset", "msg_id", "p.*")


#: AUC that models of the body must pass on a label which the body carries; a constant has 0.5, an inverted model less.
AUC_BOUND = 0.8


def language_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled messages' feature table, with the document's language (English or not) as label."""
    english = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), (F.col("lang") == "en").cast("int").alias("english"))
    return labelled_features(spark, sf_dir).join(english, "msg_id").withColumn("label", F.coalesce("english", F.lit(0))).drop("english")


def _oof(spark, sf, classifier):
    """L10 over all folds, conditions and datasets: rows, messages, folds and, with the body, whether the AUC passes the bound."""
    ft = stored(language_features(spark, sf))
    frame = flows.with_folds(flows.vectors(ft, FusionState().fit(ft)), CV_FOLDS).checkpoint()
    scored = flows.out_of_fold(frame, classifiers=[classifier])
    keys = flows.KEYS
    per_fold = scored.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("n"))
    spread = per_fold.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), F.min("n").alias("fold_min"), F.max("n").alias("fold_max"))
    whole = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("msg_id").alias("n_messages"), F.sum("label").alias("n_pos"))
    passes = F.when(F.col("condition") != "header_only", F.col("auc_roc") >= AUC_BOUND).alias("auc_passes")
    auc = E.auc_roc(E.score_points(scored, keys), keys).select(*keys, passes)
    return whole.join(spread, keys).join(auc, keys)


def q_rf_oof(spark, sf):
    return _oof(spark, sf, "RF")


def q_svm_oof(spark, sf):
    return _oof(spark, sf, "SVM")


def q_grid_search(spark, sf):
    """Mean F1 of every point of both full grids on the fusion vectors, its place, and whether it is the dataset's choice."""
    ft = stored(language_features(spark, sf))
    points, best = flows.grid_search(flows.vectors(ft, FusionState().fit(ft)).checkpoint())
    chosen = [(ds, clf, p) for ds, s in best.items() for clf, grid in (("RF", flows.RF_GRID), ("SVM", flows.SVM_GRID))
              for p, g in enumerate(grid) if all(getattr(s, k) == v for k, v in g.items())]
    mark = spark.createDataFrame(chosen, "dataset string, classifier string, point int").withColumn("chosen", F.lit(True))
    return points.join(mark, ["dataset", "classifier", "point"], "left").select("dataset", "classifier", "point", "parameters", F.round("f1", 4).alias("f1"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


def q_split_counts(spark, sf):
    return flows.split_counts(labelled_documents(spark, sf))


def q_feature_importance(spark, sf):
    """The 30 features that matter most to each dataset's fusion forest."""
    ft = stored(labelled_features(spark, sf))
    state = FusionState().fit(ft)
    frame, names = flows.vectors(ft, state).checkpoint(), state.names()
    out = None
    for ds in flows.dataset_names(frame):
        model = L.fit_model("RF", frame.where(F.col("dataset") == ds), "fusion_vec")
        top = L.feature_importance(model, names.where(F.col("dataset") == ds)).select("dataset", "name", "family", "importance")
        out = top if out is None else out.unionByName(top)
    return out


def q_fit_matrix(spark, sf):
    """Every model fitted on the training split, saved, loaded, and its metrics on the others."""
    checkpoint_dir(spark)
    return flows.run_split_flow(labelled_features(spark, sf))


QUERIES = {
    "stratified_folds": q_stratified_folds,
    "stratified_split": q_stratified_split,
    "class_weights": q_class_weights,
    "header_zscore": q_header_zscore,
    "nb_parameters": q_nb_parameters,
    "nb_predict": q_nb_predict,
    "body_scale": q_body_scale,
    "rf_oof": q_rf_oof,
    "svm_oof": q_svm_oof,
    "fusion_vectors": q_fusion_vectors,
    "fusion_vectors_merged": q_fusion_vectors_merged,
    "grid_search": q_grid_search,
    "split_counts": q_split_counts,
    "feature_importance": q_feature_importance,
    "fit_matrix": q_fit_matrix,
}

# ---------------------------------------------------------------- oracle
_RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset, label
                       ORDER BY md5(CAST(msg_id AS VARCHAR) || ':42'), msg_id) AS rk,
                  count(*) OVER (PARTITION BY dataset, label) AS n_s FROM base)"""
_SPLIT = "CASE WHEN rk <= (n_s * 70 + 50) // 100 THEN 'train' WHEN rk <= (n_s * 70 + 50) // 100 + (n_s * 15 + 50) // 100 THEN 'val' ELSE 'test' END"
_LABDOCS = """
base AS (SELECT d.doc_id AS msg_id, 'd' || CAST(d.doc_id % 3 AS VARCHAR) AS dataset, CAST(l.toxic AS INTEGER) AS label
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_FT = f"""{HQ.MSGS},
ft AS (SELECT msg_id, dataset, label, {HQ._select(FEATURES)} FROM msgs WHERE NOT bad AND label IS NOT NULL)"""


def _stats_long(src, stat_sql, cols):
    return " UNION ALL ".join(
        f"SELECT dataset, {q_(f)} AS feature, {stat_sql.format(f=f)} FROM {src} GROUP BY dataset" for f in cols)


def q_(s):
    return "'" + s + "'"


_NB_CLASS = " UNION ALL ".join(
    f"SELECT dataset, label, {q_(f)} AS feature, avg({f}) AS mean, var_pop({f}) AS v, count(*) AS n_c FROM ft GROUP BY dataset, label"
    for f in FEATURES)
_NB_EPS = "SELECT dataset, count(*) AS n, greatest(" + ", ".join(f"var_pop({f})" for f in FEATURES) + ") * 1e-9 AS eps FROM ft GROUP BY dataset"

_BODY_CELLS = f"""{TQ._DISC.replace("documents d JOIN labels l", "documents d JOIN ft ON ft.msg_id = d.doc_id JOIN labels l")},
fw AS (SELECT tf.dataset, tf.msg_id, v.idx, (1 + ln(tf.tf)) * v.idf AS w_raw FROM tf JOIN vocab v USING (dataset, term)),
fn AS (SELECT *, w_raw / sqrt(sum(w_raw * w_raw) OVER (PARTITION BY dataset, msg_id)) AS w FROM fw),
sd AS (SELECT dataset, idx, sqrt(greatest(sum(w * w) / any_value(n_docs) - (sum(w) / any_value(n_docs)) * (sum(w) / any_value(n_docs)), 0)) AS sd
       FROM fn JOIN sizes USING (dataset) GROUP BY dataset, idx),
cells AS (SELECT fn.dataset, fn.msg_id, fn.w / (CASE WHEN sd = 0 THEN 1.0 ELSE sd END) AS v FROM fn JOIN sd USING (dataset, idx))"""
_HEAD_CELLS = " UNION ALL ".join(
    f"SELECT dataset, msg_id, ({f} - avg({f}) OVER (PARTITION BY dataset)) / (CASE WHEN stddev_pop({f}) OVER (PARTITION BY dataset) = 0 THEN 1.0 ELSE stddev_pop({f}) OVER (PARTITION BY dataset) END) AS v FROM ft"
    for f in FEATURES)
N_HEAD = len(ALL_HEADER_FEATURES)


def _oof_sql(classifier: str) -> str:
    return f"""WITH {_FT},
ft3 AS (SELECT ft.dataset, ft.msg_id, CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS label FROM ft JOIN documents d ON d.doc_id = ft.msg_id),
f AS (SELECT dataset, msg_id, label, (row_number() OVER (PARTITION BY dataset ORDER BY label, md5(CAST(msg_id AS VARCHAR) || ':42'), msg_id) - 1) % {CV_FOLDS} AS fold FROM ft3),
n AS (SELECT dataset, fold, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT dataset, count(*) AS n_folds, min(n) AS fold_min, max(n) AS fold_max FROM n GROUP BY dataset)
SELECT f.dataset, c.condition, '{classifier}' AS classifier, count(*) AS n, count(DISTINCT msg_id) AS n_messages, CAST(sum(label) AS BIGINT) AS n_pos,
       any_value(n_folds) AS n_folds, any_value(fold_min) AS fold_min, any_value(fold_max) AS fold_max, CASE WHEN c.condition <> 'header_only' THEN true END AS auc_passes
FROM f JOIN s USING (dataset) CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in CONDITIONS)}) c(condition) GROUP BY f.dataset, c.condition"""


ORACLE = {
    "rf_oof": _oof_sql("RF"),
    "svm_oof": _oof_sql("SVM"),
    "split_counts": f"""WITH {_LABDOCS},{_RANKED}, s AS (SELECT dataset, label, {_SPLIT} AS split FROM ranked)
SELECT dataset, split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos,
       round(count(*) * 100.0 / (SELECT count(*) FROM s t WHERE t.dataset = s.dataset), 2) AS pct_of_total FROM s GROUP BY dataset, split""",
    "fusion_vectors": f"""WITH {_FT}, {_BODY_CELLS},
hc AS ({_HEAD_CELLS}),
h AS (SELECT dataset, msg_id, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS nnz, sum(v * v) AS ss FROM hc GROUP BY ALL),
b AS (SELECT dataset, msg_id, count(*) AS nnz, sum(v * v) AS ss FROM cells GROUP BY ALL),
z AS (SELECT dataset, count(*) AS v FROM vocab GROUP BY dataset),
a AS (SELECT h.dataset, h.msg_id, z.v, h.nnz AS hn, h.ss AS hs, coalesce(b.nnz, 0) AS bn, coalesce(b.ss, 0) AS bs
      FROM h JOIN z USING (dataset) LEFT JOIN b USING (dataset, msg_id))
SELECT dataset, msg_id, 'header_only' AS condition, CAST({N_HEAD} AS BIGINT) AS size, CAST(hn AS INTEGER) AS nnz, round(sqrt(hs), 4) AS norm FROM a
UNION ALL SELECT dataset, msg_id, 'body_only', v, CAST(bn AS INTEGER), round(sqrt(bs), 4) FROM a
UNION ALL SELECT dataset, msg_id, 'fusion', v + {N_HEAD}, CAST(hn + bn AS INTEGER), round(sqrt(hs + bs), 4) FROM a""",
    "stratified_folds": f"""WITH {_LABDOCS}
SELECT msg_id, dataset, label, CAST((row_number() OVER (PARTITION BY dataset ORDER BY label, md5(CAST(msg_id AS VARCHAR) || ':42'), msg_id) - 1) % {CV_FOLDS} AS INTEGER) AS fold FROM base""",
    "stratified_split": f"WITH {_LABDOCS},{_RANKED} SELECT msg_id, dataset, label, {_SPLIT} AS split FROM ranked",
    "class_weights": f"""WITH {_LABDOCS}
SELECT c.dataset, c.label, round(t.n / (2.0 * c.n_c), 6) AS weight
FROM (SELECT dataset, label, count(*) AS n_c FROM base GROUP BY ALL) c
JOIN (SELECT dataset, count(*) AS n FROM base GROUP BY ALL) t USING (dataset)""",
    "header_zscore": f"""WITH {_FT}
SELECT dataset, feature, round(mean, 6) AS mean, round(CASE WHEN sd = 0 THEN 1.0 ELSE sd END, 6) AS scale FROM (
{_stats_long('ft', 'avg({f}) AS mean, stddev_pop({f}) AS sd', FEATURES)})""",
    "nb_parameters": f"""WITH {_FT},
cls AS ({_NB_CLASS}), eps AS ({_NB_EPS})
SELECT c.dataset, c.label, c.feature, round(c.n_c / CAST(e.n AS DOUBLE), 9) AS prior, round(c.mean, 9) AS mean,
       round(c.v + e.eps, 9) AS var FROM cls c JOIN eps e USING (dataset)""",
    "nb_predict": f"""WITH {_FT},
base AS (SELECT msg_id, dataset, label FROM ft), {_RANKED.strip()},
sp AS (SELECT msg_id, {_SPLIT} AS split FROM ranked),
ft2 AS (SELECT ft.*, sp.split FROM ft JOIN sp USING (msg_id)),
tr AS (SELECT * FROM ft2 WHERE split = 'train'),
cls AS ({_NB_CLASS.replace('FROM ft', 'FROM tr')}),
eps AS ({_NB_EPS.replace('FROM ft', 'FROM tr')}),
par AS (SELECT c.dataset, c.label, c.feature, c.n_c / CAST(e.n AS DOUBLE) AS prior, c.mean, c.v + e.eps AS var
        FROM cls c JOIN eps e USING (dataset)),
te AS (SELECT * FROM ft2 WHERE split = 'test'),
lng AS ({' UNION ALL '.join(f"SELECT msg_id, dataset, label, {q_(f)} AS feature, {f} AS x FROM te" for f in FEATURES)}),
jl AS (SELECT l.msg_id, l.dataset, l.label, p.label AS cls, ln(max(p.prior)) +
              sum(-0.5 * ln(2.0 * pi() * p.var) - 0.5 * (l.x - p.mean) * (l.x - p.mean) / p.var) AS j
       FROM lng l JOIN par p ON l.dataset = p.dataset AND l.feature = p.feature GROUP BY ALL),
pv AS (SELECT msg_id, dataset, label, max(CASE WHEN cls = 0 THEN j END) AS j0, max(CASE WHEN cls = 1 THEN j END) AS j1
       FROM jl GROUP BY ALL)
SELECT msg_id, dataset, label, CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS pred,
       round(1.0 / (1.0 + exp(j0 - j1)), 6) AS score FROM pv""",
    "body_scale": f"""WITH {TQ._DISC},
fw AS (SELECT tf.dataset, tf.msg_id, v.idx, (1 + ln(tf.tf)) * v.idf AS w_raw FROM tf JOIN vocab v USING (dataset, term)),
fn AS (SELECT *, w_raw / sqrt(sum(w_raw * w_raw) OVER (PARTITION BY dataset, msg_id)) AS w FROM fw),
s AS (SELECT dataset, idx, sum(w) AS s1, sum(w * w) AS s2 FROM fn GROUP BY ALL)
SELECT s.dataset, CAST(s.idx AS BIGINT) AS idx,
       round(CASE WHEN sqrt(greatest(s2 / n_docs - (s1 / n_docs) * (s1 / n_docs), 0)) = 0 THEN 1.0
                  ELSE sqrt(greatest(s2 / n_docs - (s1 / n_docs) * (s1 / n_docs), 0)) END, 6) AS scale
FROM s JOIN sizes USING (dataset)""",
}
ORACLE["fusion_vectors_merged"] = ORACLE["fusion_vectors"]
