"""Exact running sums over a data-sized ordered input, without a global window.

A window ordered over a whole group puts the group in one task; here the input
is range-partitioned on (keys, order) and written to the shared checkpoint
folder with its partition number.  Within (partition, keys) the running sums
are an ordinary window; the totals of the partitions before, one row for each
partition and key, give every partition its starting offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def prefix_sums(df: DataFrame, keys: list[str], order: list, values: list[str],
                num_partitions: int | None = None) -> DataFrame:
    """Adds inclusive running sums cum_<v> for each value column, per key group,
    in `order` (a list of sort Columns, e.g. [F.col("score").desc()]).

    Ties in the order columns must be pre-aggregated by the caller.  A null
    key is a group of its own.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    local = ranged.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    totals = local.groupBy("_pid", *keys).agg(*[F.sum(v).alias("t_" + v) for v in values])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_pid").alias("_at"), *[F.col(k).alias("_k_" + k) for k in keys],
                            *[F.coalesce(F.sum("t_" + v).over(before), F.lit(0)).alias("o_" + v) for v in values])
    here = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = local.select("*", *[F.sum(v).over(here).alias("c_" + v) for v in values])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys], F.col("_pid") == F.col("_at"))
    return running.join(offsets, same).select(
        *df.columns, *[(F.col("c_" + v) + F.col("o_" + v)).cast(df.schema[v].dataType).alias("cum_" + v) for v in values])
