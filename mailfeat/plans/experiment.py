"""A resumable experiment matrix (L11, L17, L18; S16, R12).

The end of a run are the result sink (path/results) and the report as one table (path/report).
Every step and every cell (dataset, condition, classifier, fold) is a Parquet
folder under the experiment's path, and counts as done once its writer has
committed it (`_SUCCESS`).  A run that was killed goes on where it stopped: what
is committed is read, what is missing or half written is made again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CLASSIFIERS, CONDITIONS, CV_FOLDS
from ..operators import batched_svm as S
from ..operators import corpus as V
from ..operators import learn as L
from ..operators import metrics as E
from ..operators.fusion import CONDITION_COLUMNS, FusionState
from ..operators.report import baselines, report_long
from ..sources.raw import read_results, write_results
from . import flows

SCORED = "msg_id long, label int, pred int, score double, dataset string, condition string, classifier string, fold int"


class Ledger:
    """Folders under a path, each made once; `made` lists what this run has made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.made = spark, path.rstrip("/"), []

    def done(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)

    def make(self, name: str, rows: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> None:
        """Write the rows as a folder of that name, unless it has been committed."""
        if not self.done(name):
            rows().write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{name}")
            self.made.append(name)

    def read(self, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        self.make(name, rows)
        return self.spark.read.parquet(f"{self.path}/{name}")


def run_experiment(ft: DataFrame, path: str, k: int = CV_FOLDS, conditions: Sequence[str] = CONDITIONS, classifiers: Sequence[str] = CLASSIFIERS,
                   params: V.BodyParams = V.BodyParams(), settings: L.Settings | dict[str, L.Settings] = L.Settings()) -> tuple[DataFrame, Ledger]:
    """Metrics of every dataset x condition x classifier from out-of-fold scores, kept under path/results; and the ledger.

    settings: one for all, or by dataset (as grid_search chooses them).  Called
    again with the same path it fits nothing that has been committed.
    """
    spark = ft.sparkSession
    ledger = Ledger(spark, path)
    of = lambda ds: settings[ds] if isinstance(settings, dict) else settings
    some = next(iter(settings.values())) if isinstance(settings, dict) else settings
    folded = ledger.read("features", lambda: flows.with_folds(ft, k, some.seed))

    def fitted() -> DataFrame:
        FusionState(params).fit(folded).save(f"{ledger.path}/state")
        return spark.range(1)

    ledger.make("state-committed", fitted)
    state = FusionState.load(spark, f"{ledger.path}/state")
    frame = ledger.read("vectors", lambda: flows.vectors(folded, state).join(folded.select("dataset", "msg_id", "fold"), ["dataset", "msg_id"]))
    names = flows.dataset_names(folded.select("dataset"))

    def cell(ds: str, cond: str, clf: str, fold: int) -> Callable[[], None]:
        def scored() -> DataFrame:
            rows = frame.where(F.col("dataset") == ds)
            model = L.fit_model(clf, rows.where(F.col("fold") != fold), CONDITION_COLUMNS[cond], of(ds))
            return L.score(model, rows.where(F.col("fold") == fold), ["msg_id", "label"])

        return lambda: ledger.make(f"scored/by=cell/dataset={ds}/condition={cond}/classifier={clf}/fold={fold}", scored)

    flows._side_by_side(cell(*x) for x in product(names, conditions, [c for c in classifiers if c != "SVM"], range(k)))
    if "SVM" in classifiers:  # one fit, one commit
        ledger.make("scored/by=machines", lambda: S.score_folds(frame, {c: CONDITION_COLUMNS[c] for c in conditions}, k, {ds: [of(ds)] for ds in names}, some)
                    .drop("point").withColumn("classifier", F.lit("SVM")), ["dataset", "condition", "classifier", "fold"])
    kinds = ["cell"] * (set(classifiers) != {"SVM"}) + ["machines"] * ("SVM" in classifiers)
    scored = None
    for kind in kinds:
        part = spark.read.schema(SCORED).parquet(f"{ledger.path}/scored/by={kind}")
        scored = part if scored is None else scored.unionByName(part)
    ledger.make("metrics", lambda: flows._n_features(E.metric_bundle(scored, flows.KEYS), state))
    results = f"{ledger.path}/results"
    write_results(spark.read.parquet(f"{ledger.path}/metrics"), results)
    found = read_results(spark, results)
    write_results(report_long(found, baselines(spark)), f"{ledger.path}/report", ["part"])
    return found, ledger
