"""Driver queries for cleaning, corpus statistics and TF-IDF (T, V)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import clean_text, ngram_figures
from ..operators import corpus as V
from ..session import checkpoint_dir
from ..sources.tables import all_documents, labelled_documents, table, text_table
from .sqltext import sql_clean, sql_ngrams, sql_vector_tokens

R = 6  # decimals kept in float outputs


def _stored_terms(docs: DataFrame, params: V.BodyParams) -> DataFrame:
    """Terms of documents whose cleaned text, the costly part, is written once for all passes over it."""
    checkpoint_dir(docs.sparkSession)
    return V.with_terms(V.with_clean(docs).drop("body_text").checkpoint(), params)


def _labelled_terms(spark, sf_dir, params=V.BodyParams()):
    return _stored_terms(labelled_documents(spark, sf_dir), params)


def _all_terms(spark, sf_dir, params=V.BodyParams()):
    """Terms of every document, labelled or not (V4, V5, V13 need no label)."""
    return V.with_terms(V.with_clean(all_documents(spark, sf_dir)).drop("body_text"), params)


def q_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_table(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", clean_text(F.col("text")).alias("clean"))


def q_text_clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = text_table(spark, sf_dir, "pages", "page_id")
    return p.select("page_id", clean_text(F.concat_ws(" ", "url", "html")).alias("clean"))


def q_tokens_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", clean_text(F.col("text")).alias("clean"))
    return d.withColumn("g", ngram_figures(F.col("clean"))).select("doc_id", "g.*")


def q_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: how often each n-gram occurs in each message; counted in the row, nothing is exchanged."""
    long = V.doc_term_rows(_all_terms(spark, sf_dir))
    return long.select("dataset", "msg_id", "term", F.col("tf").cast("long").alias("tf"))


def q_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _stored_terms(all_documents(spark, sf_dir), V.BodyParams())
    sizes = V.corpus_size(docs)
    pr = V.pruned_stats(V.term_stats(docs, min_df=V.BodyParams().min_df), sizes, V.BodyParams())
    return pr.select("dataset", "term", F.col("df").cast("long").alias("df"),
                     F.col("tf_total").cast("long").alias("tf_total"))


def q_document_frequency_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_frequency with terms of one document pruned before the exchange."""
    checkpoint_dir(spark)
    docs = V.term_lists_of(_all_terms(spark, sf_dir), ["dataset", "msg_id", "label"])
    pr = V.frequent_stats(docs, V.corpus_size(docs), V.BodyParams(prune_early=True))
    return pr.select("dataset", "term", F.col("df").cast("long").alias("df"), F.col("tf_total").cast("long").alias("tf_total"))


def q_vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = V.BodyParams(discriminative=False)
    vocab = V.fit_vocabulary(_stored_terms(all_documents(spark, sf_dir), params), params)
    return vocab.select("dataset", "term", F.col("idx").cast("long").alias("idx"),
                        F.col("df").cast("long").alias("df"))


def q_discriminative_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = V.fit_vocabulary(_labelled_terms(spark, sf_dir))
    return vocab.select("dataset", "term", F.col("idx").cast("long").alias("idx"),
                        F.round("score", R).alias("score"), F.round("idf", R).alias("idf"))


def _weights_summary(long: DataFrame, docs: DataFrame) -> DataFrame:
    """A row for every message of `docs`; a message without a term of the vocabulary has nnz 0 and sums 0.0."""
    w, zero = F.col("w"), F.lit(0.0)
    none = docs.select("dataset", "msg_id", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("double").alias("w"))
    return long.select("dataset", "msg_id", F.col("idx").cast("long").alias("idx"), "w").unionByName(none).groupBy("dataset", "msg_id").agg(
        F.count("idx").alias("nnz"),
        F.round(F.coalesce(F.sum(w), zero), R).alias("sum_w"),
        F.round(F.coalesce(F.sum(w * w), zero), R).alias("sum_w2"),
        F.round(F.coalesce(F.sum(F.col("idx") * w), zero), 4).alias("idx_w"),
    )


def _cells_summary(cells: DataFrame) -> DataFrame:
    """The same figures from the cells within each row."""
    total = lambda f: F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + f(c))
    return cells.select("dataset", "msg_id", F.size("cells").cast("long").alias("nnz"), F.round(total(lambda c: c["w"]), R).alias("sum_w"),
                        F.round(total(lambda c: c["w"] * c["w"]), R).alias("sum_w2"), F.round(total(lambda c: c["idx"] * c["w"]), 4).alias("idx_w"))


def q_tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _labelled_terms(spark, sf_dir)
    vocab = V.fit_vocabulary(docs).checkpoint()
    return _cells_summary(V.transform_cells(docs, vocab))


def q_tfidf_transform_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on labelled documents, transform the unlabelled ones."""
    docs = _labelled_terms(spark, sf_dir)
    vocab = V.fit_vocabulary(docs).checkpoint()
    lab = table(spark, sf_dir, "labels").select("doc_id")
    unseen = text_table(spark, sf_dir, "documents", "doc_id").join(lab, "doc_id", "left_anti").select(
        F.col("doc_id").alias("msg_id"),
        F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")).alias("dataset"),
        F.coalesce(F.col("text"), F.lit("")).alias("body_text"))
    unseen = V.with_terms(V.with_clean(unseen))
    return _cells_summary(V.transform_cells(unseen, vocab))


QUERIES = {
    "text_clean": q_text_clean,
    "text_clean_html": q_text_clean_html,
    "tokens_ngrams": q_tokens_ngrams,
    "term_frequency": q_term_frequency,
    "document_frequency": q_document_frequency,
    "document_frequency_early": q_document_frequency_early,
    "vocab_topk": q_vocab_topk,
    "discriminative_vocab": q_discriminative_vocab,
    "tfidf_weights": q_tfidf_weights,
    "tfidf_transform_unseen": q_tfidf_transform_unseen,
}

# --------------------------------------------------------------------------
# Oracle SQL
# --------------------------------------------------------------------------
K = C.TFIDF_MAX_FEATURES
_LAB = f"""
lab AS (
  SELECT d.doc_id AS msg_id, 'd' || CAST(d.doc_id % 3 AS VARCHAR) AS dataset, CAST(l.toxic AS INTEGER) AS label,
         {sql_clean('d.text')} AS clean
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tok AS (SELECT *, {sql_vector_tokens('clean')} AS toks FROM lab),
ng AS (SELECT dataset, msg_id, label, unnest({sql_ngrams('toks')}) AS term FROM tok),
tf AS (SELECT dataset, msg_id, label, term, count(*) AS tf FROM ng GROUP BY ALL),
sizes AS (SELECT dataset, count(*) AS n_docs, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS n_pos,
                 sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS n_neg FROM lab GROUP BY dataset),
stats AS (SELECT dataset, term, count(*) AS df, sum(tf) AS tf_total FROM tf GROUP BY ALL),
pruned AS (SELECT s.*, z.n_docs FROM stats s JOIN sizes z USING (dataset)
           WHERE df >= {C.MIN_DF} AND df <= CAST({C.MAX_DF} AS DOUBLE) * n_docs)"""

_ALL = _LAB.replace("JOIN labels l", "LEFT JOIN labels l")

_DISC = f"""{_LAB},
pre AS (SELECT *, ln((1 + CAST(n_docs AS DOUBLE)) / (1 + CAST(df AS DOUBLE))) + 1 AS idf FROM (
          SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY tf_total DESC, term) AS rk FROM pruned)
        WHERE rk <= {K * C.PRE_VOCAB_FACTOR}),
w AS (SELECT tf.dataset, tf.msg_id, tf.label, tf.term, (1 + ln(tf.tf)) * p.idf AS w_raw
      FROM tf JOIN pre p USING (dataset, term)),
wn AS (SELECT *, w_raw / sqrt(sum(w_raw * w_raw) OVER (PARTITION BY dataset, msg_id)) AS w FROM w),
sc AS (SELECT dataset, term, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS s_pos,
              sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS s_neg FROM wn GROUP BY ALL),
score AS (SELECT sc.*, abs(ln((s_pos / greatest(n_pos, 1) + CAST(1e-9 AS DOUBLE)) /
                              (s_neg / greatest(n_neg, 1) + CAST(1e-9 AS DOUBLE)))) AS score
          FROM sc JOIN sizes USING (dataset)),
vocab AS (SELECT v.dataset, v.term, v.idx, v.score, p.idf FROM (
            SELECT dataset, term, score,
                   row_number() OVER (PARTITION BY dataset ORDER BY round(score, 10) DESC, term) - 1 AS idx
            FROM score) v JOIN pre p USING (dataset, term) WHERE v.idx < {K})"""

_SUMMARY = """
SELECT a.dataset, a.msg_id, count(idx) AS nnz, round(coalesce(sum(w), 0.0), 6) AS sum_w, round(coalesce(sum(w * w), 0.0), 6) AS sum_w2,
       round(coalesce(sum(idx * w), 0.0), 4) AS idx_w
FROM {messages} a LEFT JOIN (SELECT *, w_raw / sqrt(sum(w_raw * w_raw) OVER (PARTITION BY dataset, msg_id)) AS w FROM fw) USING (dataset, msg_id)
GROUP BY a.dataset, a.msg_id"""

ORACLE = {
    "text_clean": f"SELECT doc_id, {sql_clean('text')} AS clean FROM documents",
    "text_clean_html": "SELECT page_id, " + sql_clean("concat_ws(' ', url, html)") + " AS clean FROM pages",
    "tokens_ngrams": f"""
WITH c AS (SELECT doc_id, {sql_vector_tokens(sql_clean('text'))} AS toks FROM documents),
g AS (SELECT doc_id, toks, {sql_ngrams('toks')} AS ng FROM c),
u AS (SELECT doc_id, unnest(ng) AS term FROM g),
t AS (SELECT doc_id, count(DISTINCT term) AS n_distinct, max(cnt) AS max_tf FROM (
        SELECT doc_id, term, count(*) AS cnt FROM u GROUP BY ALL) GROUP BY doc_id)
SELECT g.doc_id, CAST(len(g.toks) AS INTEGER) AS n_tokens, CAST(len(g.ng) AS INTEGER) AS n_ngrams,
       CAST(coalesce(t.n_distinct, 0) AS INTEGER) AS n_distinct, CAST(coalesce(t.max_tf, 0) AS BIGINT) AS max_tf
FROM g LEFT JOIN t USING (doc_id)""",
    "term_frequency": f"WITH {_ALL} SELECT dataset, msg_id, term, CAST(tf AS BIGINT) AS tf FROM tf",
    "document_frequency": f"WITH {_ALL} SELECT dataset, term, CAST(df AS BIGINT) AS df, CAST(tf_total AS BIGINT) AS tf_total FROM pruned",
    "vocab_topk": f"""WITH {_ALL}
SELECT dataset, term, CAST(row_number() OVER (PARTITION BY dataset ORDER BY term) - 1 AS BIGINT) AS idx,
       CAST(df AS BIGINT) AS df
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY tf_total DESC, term) AS rk FROM pruned)
WHERE rk <= {K}""",
    "discriminative_vocab": f"""WITH {_DISC}
SELECT dataset, term, CAST(idx AS BIGINT) AS idx, round(score, 6) AS score, round(idf, 6) AS idf FROM vocab""",
    "tfidf_weights": f"""WITH {_DISC},
fw AS (SELECT tf.dataset, tf.msg_id, v.idx, (1 + ln(tf.tf)) * v.idf AS w_raw FROM tf JOIN vocab v USING (dataset, term))
{_SUMMARY.format(messages="lab")}""",
    "tfidf_transform_unseen": f"""WITH {_DISC},
un AS (SELECT d.doc_id AS msg_id, 'd' || CAST(d.doc_id % 3 AS VARCHAR) AS dataset,
              {sql_vector_tokens(sql_clean('d.text'))} AS toks
       FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)),
ung AS (SELECT dataset, msg_id, unnest({sql_ngrams('toks')}) AS term FROM un),
utf AS (SELECT dataset, msg_id, term, count(*) AS tf FROM ung GROUP BY ALL),
fw AS (SELECT u.dataset, u.msg_id, v.idx, (1 + ln(u.tf)) * v.idf AS w_raw FROM utf u JOIN vocab v USING (dataset, term))
{_SUMMARY.format(messages="un")}""",
}
ORACLE["document_frequency_early"] = ORACLE["document_frequency"]
