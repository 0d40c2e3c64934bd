"""Exact pruning of rare n-grams before they are shuffled (V4).

A term that occurs in one message only can't reach a document frequency of two,
yet most n-grams of a corpus are of that kind, and all of them would be
exchanged to find out.  Here every term is hashed to a slot of two bits, "seen"
and "seen again".  A task keeps one such bitmap for all its messages; bitmaps
are cut into chunks, exchanged by chunk and added up (again = again or again or
both seen), so what moves is bounded by tasks x bitmap and not by the n-grams.
A term of two messages always has its second bit set, whatever collides with it,
so no such term is lost; the count that follows is the ordinary, exact one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots for each occurrence, and the bounds of a bitmap (2^27 slots: 32 MB a task, 16 MB broadcast).
SLOTS_A_TERM, MIN_SLOTS, MAX_SLOTS = 4, 1 << 16, 1 << 27
#: Bytes of a chunk.
CHUNK = 1 << 13
#: Occurrences a slot of the largest bitmap beyond which nearly every slot is seen again: nothing would be spared.
USELESS = 4


class SeenTwice:
    """Two bits a slot: seen, and seen again."""

    def __init__(self, slots: int):
        self.once, self.again = np.zeros(slots // 8, np.uint8), np.zeros(slots // 8, np.uint8)

    def add(self, slots: np.ndarray) -> None:
        u, n = np.unique(slots, return_counts=True)
        at, bit = u >> 3, (1 << (u & 7)).astype(np.uint8)
        known = (n > 1) | ((self.once[at] & bit) > 0)
        np.bitwise_or.at(self.again, at[known], bit[known])
        np.bitwise_or.at(self.once, at, bit)

    def sent(self) -> Iterator[pa.RecordBatch]:
        return _batches(self.chunks())

    def chunks(self) -> Iterator[dict]:
        for i in range(0, len(self.once), CHUNK):
            once = self.once[i : i + CHUNK]
            if once.any():
                yield {"chunk": i // CHUNK, "once": once.tobytes(), "again": self.again[i : i + CHUNK].tobytes()}


CHUNKS = "chunk int, once binary, again binary"
_ARROW = pa.schema([("chunk", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])
_ROWS_A_BATCH = 256


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS_A_BATCH:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def term_slots(slots: int, group) -> Column:
    """Slots of a row's distinct terms."""
    return F.transform(F.coalesce("terms", F.array().cast("array<struct<term:string,tf:bigint>>")),
                       lambda t: F.pmod(F.xxhash64(*group, t["term"]), F.lit(slots)))


def seen_again(docs: DataFrame, slots: int, group=("dataset",)) -> np.ndarray:
    """The second bits, packed, of all (group, term) pairs of `docs` (distinct terms in each row)."""
    def of_task(batches):
        seen = SeenTwice(slots)
        for batch in batches:
            seen.add(batch.column(0).flatten().to_numpy())
        yield from seen.sent()

    return added_up(docs.select(term_slots(slots, group).alias("s")).mapInArrow(of_task, CHUNKS), slots)


def added_up(tasks: DataFrame, slots: int) -> np.ndarray:
    """The second bits, packed, of the bitmaps that tasks have sent."""
    def added(batches):
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for chunk, once, again in zip(*(c.to_pylist() for c in batch.columns)):
                o, a = np.frombuffer(once, np.uint8), np.frombuffer(again, np.uint8)
                if chunk in total:
                    both, more = total[chunk]
                    more |= a | (both & o)
                    both |= o
                else:
                    total[chunk] = [o.copy(), a.copy()]
        yield from _batches({"chunk": c, "once": b"", "again": a.tobytes()} for c, (_, a) in total.items() if a.any())

    parts = min(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(slots // 8 // CHUNK, 1))
    out = np.zeros(slots // 8, np.uint8)
    for row in tasks.repartition(parts, "chunk").mapInArrow(added, CHUNKS).collect():
        out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + CHUNK] = np.frombuffer(row["again"], np.uint8)
    return out


def hashed(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys mixed with a salt (the steps of splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bitmap_slots(occurrences: int) -> int:
    wanted = 1 << max(SLOTS_A_TERM * occurrences - 1, 1).bit_length()
    return min(max(wanted, MIN_SLOTS), MAX_SLOTS)


def without_singletons(docs: DataFrame, group=("dataset",)) -> DataFrame:
    """`docs` whose `terms` have lost those that no other row of the group has.

    `docs` is read three times: store it before.  Terms whose slot another term
    shares may stay; none that two rows hold ever goes.  A corpus too large for
    the largest bitmap comes back as it is.
    """
    occurrences = docs.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    slots = bitmap_slots(occurrences)
    if occurrences > USELESS * slots:
        return docs
    again = seen_again(docs, slots, group)
    bits = docs.sparkSession.sparkContext.broadcast(again)

    @F.arrow_udf("array<boolean>")
    def known(rows: pa.Array) -> pa.Array:
        at = rows.flatten().to_numpy()
        hit = (bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        starts = rows.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), pa.array(hit.astype(bool)))

    marked = docs.withColumn("_known", known(term_slots(slots, group)))
    return marked.withColumn("terms", F.filter("terms", lambda t, i: F.get("_known", i))).drop("_known")
