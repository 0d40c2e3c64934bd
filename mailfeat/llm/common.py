"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Distinct words a Python worker remembers before it starts over.
WORD_CACHE = 200_000
#: Rows a Python worker handles at a time; bounds its memory for long texts.
ROWS_AT_ONCE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() write to the shared folder in spark.checkpoint.dir.

    A folder of our own is set only where that setting is absent (tests).
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="llm-ckpt-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tree_merge(rows: DataFrame, merge: Callable[[list[dict]], dict], schema: str, parts: int, fan_in: int) -> dict | None:
    """One row out of at most one for each `pid` below parts: fan_in neighbours a task, level by level.

    merge gets the rows of a group in order of pid and gives their sum; the
    driver gets the last row only, or None if there was none.
    """
    arrow = arrow_schema(schema)

    def together(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["pid"])
        return pa.Table.from_pylist([{**merge(found), "pid": found[0]["pid"] // fan_in}], schema=arrow)

    while parts > 1:
        rows = rows.groupBy(F.floor(F.col("pid") / fan_in)).applyInArrow(together, schema)
        parts = -(-parts // fan_in)
    found = rows.collect()
    return found[0].asDict() if found else None


def id_hash(doc_id: Column | str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the third of the documents no model may learn from."""
    return id_hash(doc_id) % 3 == 1


#: Classes up to which a sample's shares stand in one expression; a small table is joined beyond.
FEW_CLASSES = 64


def bounded_sample(df: DataFrame, class_col: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """About per_class rows of each class, picked by a hash of the id.

    Only a count for each class reaches the driver, whatever the number of
    classes; the rows themselves are kept or passed over in place, so no
    shuffle of texts.
    """
    counts = df.groupBy(class_col).count().collect()
    rank = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col).cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    if len(counts) > FEW_CLASSES:
        name, share = fresh(df, "class"), fresh(df, "share")
        kind = df.schema[class_col].dataType.simpleString()
        shares = df.sparkSession.createDataFrame([(r[0], min(1.0, per_class / r[1])) for r in counts], f"`{name}` {kind}, `{share}` double")
        picked = df.join(F.broadcast(shares), F.col(class_col).eqNullSafe(F.col(name)))
        return picked.where(rank < F.col(share)).select(*df.columns)
    keep = F.lit(False)
    for row in sorted(counts, key=lambda r: (-r[1], r[0] is not None, r[0])):
        keep = keep | (F.col(class_col).eqNullSafe(F.lit(row[0])) & (rank < F.lit(min(1.0, per_class / row[1]))))
    return df.where(keep)


def text_window(text: Column, id_col: str, chars: int) -> Column:
    """At most `chars` characters of a text, from a place the id decides."""
    room = F.greatest(F.length(text) - F.lit(chars), F.lit(0)) + F.lit(1)
    return F.substring(text, F.pmod(F.xxhash64(F.lit("window"), F.col(id_col).cast("string")), room).cast("int") + 1, F.lit(chars))


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string; to be called on the driver."""
    kind = _parse_datatype_string(ddl)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)


def map_columns(df: DataFrame, fn: Callable[[dict[str, list[Any]]], dict[str, list[Any]]], schema: str) -> DataFrame:
    """Arrow batches through fn: lists of the input columns to lists of the output columns.

    Batches are cut to ROWS_AT_ONCE rows, so that a few very long texts never
    meet many others in one call.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: Bytes of a text that are hashed at a time; bounds the tables of powers.
PIECE = 1 << 20
_STEP = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BLANK_BYTES = [bytes([i]) for i in np.flatnonzero(_BLANK)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _STEP and of its inverse modulo 2 ** 64, n of each."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            factors = np.full(size, base % (1 << 64), np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(units: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every maximal run of units that are inside, by sums of powers."""
    n = len(units)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return mix64(h ^ (end - start).astype(np.uint64)), start, end


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of a UTF-8 text, in order."""
    out = []
    while len(raw) > PIECE:  # cut at the last blank of the piece, or else after a word that is longer
        at = max(raw.rfind(c, 0, PIECE) for c in _BLANK_BYTES)
        if at <= 0:
            at = min((i for i in (raw.find(c, PIECE) for c in _BLANK_BYTES) if i > 0), default=len(raw))
        out.append(_hash_piece(raw[:at]))
        raw = raw[at:]
    return np.concatenate([*out, _hash_piece(raw)])


def _hash_piece(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    return run_hashes(b, ~_BLANK[b])[0]


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-word window (polynomial in the word hashes, then mixed)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n]
    for j in range(1, k):
        h = h * _MULTIPLIER + words[j : j + n]
    return mix64(h)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def ridge_logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 40) -> np.ndarray:
    """Weights (last one the intercept, not shrunk) by Newton's method; for few dense features."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], l2)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + pull * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
