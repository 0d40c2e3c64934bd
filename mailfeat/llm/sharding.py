"""Sharding by Karmarkar-Karp differencing (operator 12).

Rows of one group (equal texts) stay together, and the shards' bytes shall be
near equal.  A partial partition is a list of as many sums as there are shards;
an item begins as (size, 0, ..., 0).  The two partial partitions with the largest
spread are joined, the largest sum of the one to the smallest of the other, and
so on, until one is left; the way back down deals the groups out.

At scale: a group is a key with its bytes and rows.  The few heavy groups (those
of over 1 / (shards * HEAVY) of all bytes or rows, so at most twice shards *
HEAVY of them) are differenced first, on the driver.  A shard that they fill
beyond the level which all the rest can reach is closed.  Their sums on the open
shards are one more partial partition, dealt in proportion to the parts in which
the light groups lie, PART_GROUPS groups a part: each part differences its
share and its groups in a task of its own.  Heavy groups meet their rows by a
broadcast of that bounded list, light ones in a join on the key.  Slots number
the rows of a shard: counted within partitions as they lie, after the counts of
the partitions before.

Defined results: a null text has no bytes, is equal to the empty one and has
crc32 0.  Null and repeated ids are rows like others.  Groups go by a 64-bit
hash of the text; two texts that collide would only stay together.  A group
beyond a shard's even share fills a shard alone, the others are level.  Other
columns of the input are passed over.  An empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut

SHARDS = 40
ROW_BYTES = 16
#: A group of over 1 / (shards * HEAVY) of all bytes or of all rows is heavy.
HEAVY = 64
#: Light groups in each part.
PART_GROUPS = 20_000
#: Starts of slots (partitions x shards) up to which they are broadcast; beyond that they meet the rows in a shuffle.
BROADCAST_STARTS = 200_000


# ------------------------------------------------------------ differencing
def difference(sizes: list[int], shards: int, base: list[float] | None = None) -> list[int]:
    """Shard of each item, by Karmarkar-Karp differencing; base: sums that the shards have already.

    Of equal spreads the earlier one goes first, so the result is fixed.
    """
    if not sizes:
        return []
    n = len(sizes)
    leaves: list[np.ndarray] = []
    if shards == 1:
        return [0] * n
    first = np.zeros(shards)
    for s in sizes:
        sums = first.copy()
        sums[-1] = s
        leaves.append(sums)
    root_order = None
    if base is not None:
        start = np.asarray(base, float)
        root_order = np.argsort(start, kind="stable")
        leaves.append(start[root_order] - start.min())
    parts = leaves
    heap = [(-float(p[-1]), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray]] = []
    n_leaves = len(parts)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sums = parts[a] + parts[b][::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        parts[a] = parts[b] = None  # type: ignore[call-overload]
        heapq.heappush(heap, (-float(sums[-1]), len(parts)))
        parts.append(sums)
        joined.append((a, b, order.astype(np.int32)))
    labels: list[np.ndarray | None] = [None] * len(parts)
    labels[-1] = np.arange(shards, dtype=np.int32)
    for at in range(len(joined) - 1, -1, -1):
        a, b, order = joined[at]
        own = np.empty(shards, np.int32)
        own[order] = labels[n_leaves + at]
        labels[n_leaves + at] = None
        labels[a], labels[b] = own, own[::-1]
    name = np.arange(shards)
    if root_order is not None:  # the slots of the base are the shards they stand for
        name[labels[n]] = root_order
    return [int(name[labels[i][-1]]) for i in range(n)]


def open_shards(sums: list[float], rest: float) -> list[int]:
    """The shards that stay below the level which the rest, dealt out evenly over them, can reach."""
    order = sorted(range(len(sums)), key=lambda i: sums[i])
    total = float(rest)
    for k, i in enumerate(order):
        if k and sums[i] * k > total:
            return sorted(order[:k])
        total += sums[i]
    return sorted(order)


# ------------------------------------------------------------ the job
_PLACED = "g long, shard int"


def _deal_light(light: DataFrame, open_: list[int], base: list[float], light_bytes: int) -> DataFrame:
    """Each part differences its groups with its share of what the open shards hold."""
    arrow = arrow_schema(_PLACED)
    level = np.asarray([base[i] for i in open_], float)

    def deal(part: pa.Table) -> pa.Table:
        g, size = part.column("g").to_numpy(), part.column("size").to_numpy()
        order = np.lexsort((g, -size))
        g, size = g[order], size[order]
        share = level * (float(size.sum()) / light_bytes)
        at = difference(size.tolist(), len(open_), share.tolist())
        return pa.table([pa.array(g), pa.array([open_[i] for i in at], pa.int32())], schema=arrow)

    return light.groupBy("part").applyInArrow(deal, _PLACED)


def place_groups(groups: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """groups: g, size and rows of each group -> (heavy, light) as g and shard; heavy is a bounded list."""
    session = groups.sparkSession
    total = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("size"), F.sum("rows").alias("rows")).first()
    size, rows, n = total["size"] or 0, total["rows"] or 0, total["groups"]
    is_heavy = (F.col("size") * (shards * HEAVY) > size) | (F.col("rows") * (shards * HEAVY) > rows)
    heavy = sorted(((r["size"], r["g"]) for r in groups.where(is_heavy).select("g", "size").collect()), key=lambda x: (-x[0], x[1]))
    at = difference([s for s, _ in heavy], shards)
    sums = [0.0] * shards
    for (s, _), i in zip(heavy, at):
        sums[i] += s
    rest = size - sum(s for s, _ in heavy)
    open_ = open_shards(sums, rest)
    parts = max(1, -(-n // PART_GROUPS))
    light = groups.where(~is_heavy).select("g", "size", F.pmod(F.xxhash64("g"), F.lit(parts)).alias("part"))
    placed = session.createDataFrame([(g, i) for (_, g), i in zip(heavy, at)], _PLACED)
    return placed, _deal_light(light, open_, sums, max(rest, 1))


def shard_by_bytes(rows: DataFrame, text_col: str = "text", id_col: str = "doc_id", shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = cut(rows.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g")))
    groups = cut(thin.groupBy("g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    heavy, light = place_groups(groups, shards)
    heavy = F.broadcast(heavy.withColumnRenamed("g", "heavy_g"))  # at most 2 * shards * HEAVY rows
    known = thin.join(heavy, F.col("g") == F.col("heavy_g"), "left")
    first = known.where(F.col("heavy_g").isNotNull()).select("id", "size", "crc", "shard")
    other = known.where(F.col("heavy_g").isNull()).select("id", "size", "crc", "g").join(light, "g").select("id", "size", "crc", "shard")
    placed = with_slots(first.unionByName(other))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard.

    The rows are written once; each partition numbers its own as it reads
    them, and begins after the rows of the partitions before.
    """
    lying = cut(placed.withColumn("pid", F.spark_partition_id()))
    counts = lying.groupBy("pid", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pid", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lying.schema) + ", place long"
    arrow = arrow_schema(schema)
    at_shard = placed.columns.index("shard")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            place = []
            for s in batch.column(at_shard).to_pylist():
                place.append(seen.get(s, 0))
                seen[s] = place[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], schema=arrow)

    shards = counts.agg(F.countDistinct("shard")).first()[0]
    if lying.rdd.getNumPartitions() * shards <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    return lying.mapInArrow(number, schema).join(starts, ["pid", "shard"]).withColumn("slot", F.col("place") + F.col("start")).drop("pid", "place", "start")
