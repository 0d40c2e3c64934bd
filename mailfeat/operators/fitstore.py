"""Fitted state that can be extended (M5, S18): partial statistics of batches that add up.

A batch (a day's messages, say) is cleaned and counted once and leaves four tables:

    moments   dataset, feature, n, mean, m2      of the 33 header features
    sizes     dataset, n_docs, n_pos, n_neg
    counts    dataset, term, df, tf_total        of every term, none pruned
    texts     dataset, msg_id, label, clean      the cleaned text of each message

State of any set of batches comes from sums of the first three, so no message's n-grams
are counted twice however often the state is extended; the term weights, which
depend on the merged idf, are a pass over the stored texts that looks up the vocabulary's terms alone.  fit of
A and then B equals fit of A and B together: vocabulary, df and idf exactly, means and
scales but for the last digits of the floating point sums.

A batch counts once its marker is there.  Adding it again replaces it,
dropping it takes its messages back.  A message id in two batches is two messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import ALL_HEADER_FEATURES
from ..session import checkpoint_dir
from . import assemble as M
from . import corpus as V
from .fusion import FusionState, cleaned

_TABLES = {
    "moments": "dataset string, feature string, n long, mean double, m2 double",
    "sizes": "dataset string, n_docs long, n_pos long, n_neg long",
    "counts": "dataset string, term string, df long, tf_total long",
    "texts": "dataset string, msg_id string, label int, clean string",
}


# ------------------------------------------------------------ header moments
def header_moments(ft: DataFrame, features=ALL_HEADER_FEATURES) -> DataFrame:
    """n, mean and sum of squares about the mean of each feature: one aggregation, one row a dataset and feature."""
    aggs = [x for f in features for x in (F.count(f).alias(f"n__{f}"), F.avg(f).alias(f"mu__{f}"), F.var_pop(f).alias(f"va__{f}"))]
    wide = ft.groupBy("dataset").agg(*aggs)
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f"n__{f}").alias("n"), F.col(f"mu__{f}").alias("mean"), (F.col(f"va__{f}") * F.col(f"n__{f}")).alias("m2")) for f in features]
    return wide.select("dataset", F.explode(F.array(*parts)).alias("s")).select("dataset", "s.*")


def merged_moments(moments: DataFrame) -> DataFrame:
    """Moments of all batches together: each batch's m2, and n times the squared way of its mean from the joint one."""
    w = Window.partitionBy("dataset", "feature")  # one row a batch
    joint = moments.where("n > 0").withColumn("_n", F.sum("n").over(w)).withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("_n"))
    away = F.col("mean") - F.col("_mean")
    return joint.groupBy("dataset", "feature").agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * away * away).alias("m2"))


def stats_of_moments(moments: DataFrame, features=ALL_HEADER_FEATURES) -> DataFrame:
    """The wide row of means and deviations that assemble.scale_headers takes."""
    of = lambda f, c: F.max(F.when(F.col("feature") == f, c))
    sd = F.sqrt(F.col("m2") / F.col("n"))
    return moments.groupBy("dataset").agg(*[x for f in features for x in (of(f, F.col("mean")).alias(f"mu__{f}"), of(f, sd).alias(f"sd__{f}"))])


# ------------------------------------------------------------ the store
class FitStore:
    """Batches of partial statistics below `path`; n-grams are counted by `params`."""

    def __init__(self, spark: SparkSession, path: str, params: V.BodyParams = V.BodyParams()):
        self.spark, self.path, self.params = spark, path.rstrip("/"), params

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def batches(self) -> list[str]:
        """Names of the complete batches."""
        fs, p = self._fs(f"{self.path}/committed")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def drop(self, batch: str) -> None:
        """A batch that doesn't count any more; its tables stay until it is added again."""
        fs, p = self._fs(f"{self.path}/committed/{batch}")
        fs.delete(p, False)

    def add(self, ft: DataFrame, batch: str) -> None:
        """Clean and count the messages of a feature table; a batch of the same name is replaced."""
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError(f"no name for a batch: {batch!r}")
        self.drop(batch)
        base = f"{self.path}/batches/{batch}"
        cols = ["dataset", F.col("msg_id").cast("string").alias("msg_id"), F.col("label").cast("int").alias("label"), "clean" if "clean" in ft.columns else "body_text"]
        checkpoint_dir(self.spark)
        self._write(cleaned(ft.select(*cols)), base, "texts")
        docs = V.with_terms(self._read(base, "texts"), self.params)
        self._write(V.term_stats(docs), base, "counts")
        self._write(V.corpus_size(docs), base, "sizes")
        self._write(header_moments(ft), base, "moments")
        fs, p = self._fs(f"{self.path}/committed/{batch}")
        fs.create(p, True).close()

    def _write(self, df: DataFrame, base: str, name: str) -> None:
        df.to(self.spark.createDataFrame([], _TABLES[name]).schema).write.mode("overwrite").parquet(f"{base}/{name}")

    def _read(self, base: str, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{base}/{name}")

    def table(self, name: str, batches: list[str] | None = None) -> DataFrame:
        """Rows of one of the four tables, of some batches or of all complete ones."""
        here = self.batches()
        asked = here if batches is None else batches
        if missing := sorted(set(asked) - set(here)):
            raise ValueError(f"no such batch: {missing}")
        if not asked:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(*(f"{self.path}/batches/{b}/{name}" for b in asked))

    def sizes(self, batches: list[str] | None = None) -> DataFrame:
        return self.table("sizes", batches).groupBy("dataset").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_pos", "n_neg")])

    def counts(self, batches: list[str] | None = None) -> DataFrame:
        return self.table("counts", batches).groupBy("dataset", "term").agg(F.sum("df").alias("df"), F.sum("tf_total").alias("tf_total"))

    def state(self, batches: list[str] | None = None) -> FusionState:
        """The fitted state of the batches; a dataset whose pruned vocabulary is empty is an error, as in FusionState.fit."""
        checkpoint_dir(self.spark)
        docs, sizes = V.with_terms(self.table("texts", batches), self.params), self.sizes(batches).checkpoint()  # sizes: one row a dataset
        vocab = V.fit_vocabulary(docs, self.params, sizes=sizes, stats=self.counts(batches)).checkpoint()
        scale = M.scale_of_sums(V.weight_sums(docs, vocab, self.params), sizes).checkpoint()
        header = stats_of_moments(merged_moments(self.table("moments", batches))).checkpoint()
        return FusionState(self.params, header, vocab, scale).complete(sizes)
