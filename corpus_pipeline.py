"""The training-data pipeline: stages over documents, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailfeat.llm import common, decontam, jaccard, mixing, pii, quality, queries


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, quality.fit_quality(docs, common.table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the least id."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; n_chars is that of the masked text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often and how far each is read."""
    mixed = mixing.mix_sources(docs, queries.MIX, queries.source_domain(), carry=("text", "n_chars"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "domain", "tokens", "epochs", "extra_tokens")


Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]
STAGES: list[Stage] = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("source_mixing", mixing_stage),
]
#: A trained model and sampled paths take part, which SQL can't express; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; between stages the rows rest as Parquet in the shared folder."""
    common.use_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i:
            docs.write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
        docs = stage(spark, docs, sf_dir)
    return docs
