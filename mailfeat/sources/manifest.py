"""A feature table that follows its folder of raw files, file by file.

A refresh lists the files (path, length, time of change; contents aren't read),
compares the list with the manifest of the last refresh and parses only files
that are new or have changed.  Their rows are a generation of their own:

    <table>/features/gen=3/dataset=Demo/*.parquet    rows parsed by refresh 3
    <table>/manifest/3/*.parquet                     every live file, and the generation of its row
    <table>/gone/3/*.parquet                         rows of older generations that don't count any more

Rows are never rewritten.  A refresh counts from the moment its manifest, written last,
is complete; one that is killed before leaves what readers see as it was, and the
next one writes over its generation.  One writer at a time.

A file that changes without a change of its length or time isn't noticed: use
rebuild for that.  A file that another process deletes while a refresh runs may stop
that refresh; the next one goes on from the last complete manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ALL_HEADER_FEATURES
from ..operators import headers as H
from .raw import _exists, list_raw, parse_raw, scan_files

_KEY = ["msg_id", "length", "changed"]
_MANIFEST = "msg_id string, dataset string, length long, changed timestamp, gen int"


@dataclass(frozen=True)
class Refreshed:
    """What a refresh has done: its generation, files parsed, rows' files dropped (or replaced), files left as they were."""

    gen: int
    parsed: int
    removed: int
    kept: int


class FeatureTable:
    """The feature rows of the raw files below `root`, kept at `path`."""

    def __init__(self, spark: SparkSession, root: str, path: str):
        self.spark, self.root, self.path = spark, root, path.rstrip("/")

    # ------------------------------------------------------------ versions
    def _complete(self, gen: int) -> bool:
        return _exists(self.spark, f"{self.path}/manifest/{gen}/_SUCCESS")

    def generation(self) -> int:
        """The last complete refresh; 0 before the first."""
        folder = f"{self.path}/manifest"
        if not _exists(self.spark, folder):
            return 0
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(folder)
        names = [f.getPath().getName() for f in p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
        return max((int(n) for n in names if n.isdigit() and self._complete(int(n))), default=0)

    def manifest(self, gen: int | None = None) -> DataFrame:
        gen = self.generation() if gen is None else gen
        if not gen:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{gen}")

    def _gone(self, gen: int) -> DataFrame:
        schema = "msg_id string, gen int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/gone/{gen}") if gen else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------ refresh
    def refresh(self, datasets: list[str], rebuild: bool = False) -> Refreshed:
        """Bring the rows of `datasets` in line with their files; other datasets stay as they are.

        rebuild parses every file of `datasets` again.  Nothing is committed
        where nothing has changed.
        """
        last = self.generation()
        gen, old = last + 1, self.manifest(last)
        before = old.where(F.col("dataset").isin(datasets))
        found = list_raw(self.spark, self.root, datasets).withColumnRenamed("path", "msg_id")
        listed = self._stored(found, f"listing/{gen}")  # once: every step speaks of the same files
        todo = listed if rebuild else listed.join(before, _KEY, "left_anti")
        same = before.limit(0) if rebuild else before.join(listed, _KEY, "left_semi")
        removed = before.join(same, _KEY, "left_anti").select("msg_id", "gen")
        n_before, n_parsed, n_gone = before.count(), todo.count(), removed.count()
        if n_parsed + n_gone == 0:
            return Refreshed(last, 0, 0, n_before)
        raw = scan_files(self.spark, self.root, datasets, todo.withColumnRenamed("msg_id", "path"))
        rows = H.feature_table(H.header_features(parse_raw(raw)))
        rows.write.mode("overwrite").partitionBy("dataset").parquet(f"{self.path}/features/gen={gen}")
        kept = old.where(~F.col("dataset").isin(datasets)).unionByName(same.select(*old.columns))
        self._commit(gen, kept.unionByName(todo.withColumn("gen", F.lit(gen)).select(*old.columns)), self._gone(last).unionByName(removed))
        return Refreshed(gen, n_parsed, n_gone, n_before - n_gone)

    def compact(self) -> Refreshed:
        """All live rows as one new generation, so that readers open few files and join nothing away."""
        last = self.generation()
        gen, old = last + 1, self.manifest(last)
        self.rows().write.mode("overwrite").partitionBy("dataset").parquet(f"{self.path}/features/gen={gen}")
        self._commit(gen, old.withColumn("gen", F.lit(gen)), self._gone(0))
        return Refreshed(gen, 0, 0, old.count())

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _commit(self, gen: int, live: DataFrame, gone: DataFrame) -> None:
        """Write what is gone, then the manifest, which makes the generation count."""
        gone.write.mode("overwrite").parquet(f"{self.path}/gone/{gen}")
        live.write.mode("overwrite").parquet(f"{self.path}/manifest/{gen}")

    # ------------------------------------------------------------ rows
    def rows(self, datasets: list[str] | None = None) -> DataFrame:
        """The feature table as of the last complete refresh (of `datasets`, else of all)."""
        last = self.generation()
        live = [r.gen for r in self.manifest(last).select("gen").distinct().collect()]  # at most one a refresh
        columns = [f"{f} double" for f in ALL_HEADER_FEATURES]
        schema = ", ".join(["msg_id string", "label int", "body_text string", *columns, "dataset string", "gen int"])
        if live:
            every = self.spark.read.schema(schema).parquet(f"{self.path}/features").where(F.col("gen").isin(live))
        else:
            every = self.spark.createDataFrame([], schema)
        if datasets is not None:
            every = every.where(F.col("dataset").isin(datasets))
        gone = self._gone(last).where(F.col("gen").isin(live))
        return every.join(gone, ["msg_id", "gen"], "left_anti").select("msg_id", "dataset", "label", "body_text", *ALL_HEADER_FEATURES)
