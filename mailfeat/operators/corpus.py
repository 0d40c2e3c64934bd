"""Corpus statistics, vocabulary selection and TF-IDF.

Design: a document never leaves its row until its n-grams are counted
(as numbers, in Arrow batches), so per-document term frequency costs no shuffle.  Corpus statistics are one `groupBy(dataset, term)` with
map-side partial aggregation.  Weights are worked out inside the row too: a
vocabulary is broadcast where its counted terms allow it, Arrow batches look
their terms up a column at a time, and the norm is a sum over the row's own cells.
Beyond that size the exploded terms meet the vocabulary in a join.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import constants as C
from ..functions.text import KnownTerms, clean_text, joined_words, ngram_counts, slices, term_counts
from ..session import checkpoint_dir
from . import bitmap as B


@dataclass(frozen=True)
class BodyParams:
    """Featuriser parameters."""
    max_features: int = C.TFIDF_MAX_FEATURES
    ngram_min: int = C.TFIDF_NGRAM_MIN
    ngram_max: int = C.TFIDF_NGRAM_MAX
    sublinear_tf: bool = C.TFIDF_SUBLINEAR_TF
    discriminative: bool = True
    min_df: int = C.MIN_DF
    max_df: float = C.MAX_DF
    prune_early: bool = False  # V4 by `bitmap`: one pass more over the terms, about half the shuffle


def with_clean(df: DataFrame, text_col: str = "body_text", out: str = "clean") -> DataFrame:
    return df.withColumn(out, clean_text(F.col(text_col)))


def with_terms(df: DataFrame, params: BodyParams = BodyParams(), clean_col: str = "clean") -> DataFrame:
    """Adds `terms`: array<struct<term,tf>> of the document's distinct n-grams (V1-V3).

    The column notes which text it comes from: while that text is beside it, the
    operators below count n-grams where they use them, so terms never travel as
    one large list a row.
    """
    counts = {"text": clean_col, "n_min": params.ngram_min, "n_max": params.ngram_max}
    return df.withColumn("terms", term_counts(F.col(clean_col), params.ngram_min, params.ngram_max).alias("terms", metadata={"ngrams": counts}))


def _counted(df: DataFrame) -> dict | None:
    """The text and n-gram lengths that `terms` stands for, if the text is still there."""
    of = df.schema["terms"].metadata.get("ngrams")
    return of if of and of["text"] in df.columns else None


#: Rows of ready-made term lists, and bytes of text, that are worked on at a time.
ROWS_AT_ONCE, LARGE_SLICE = 512, 1 << 23


def _counts_of(column: pa.Array, of: dict | None, size: int | None = None):
    """(first row, row behind the last, row, at, tf, names) of the n-grams of texts or of term lists, slice by slice."""
    if of:
        for a, b, c in ngram_counts(column, of["n_min"], of["n_max"], size):
            yield a, b, c.row, c.at, c.tf, c.names
        return
    for a in range(0, len(column), ROWS_AT_ONCE):
        part = column.slice(a, ROWS_AT_ONCE)
        lengths = np.nan_to_num(pc.list_value_length(part).to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = part.flatten()
        terms = flat.field("term")
        yield (a, a + len(part), np.repeat(np.arange(len(part)), lengths), np.arange(len(flat)), flat.field("tf").to_numpy(zero_copy_only=False),
               lambda which=None, terms=terms: terms if which is None else terms.take(pa.array(which)))


def doc_term_rows(df: DataFrame, keys=("dataset", "msg_id"), extra=()) -> DataFrame:
    """Long form (keys..., term, tf) from the in-row counts."""
    beside = [*keys, *extra]
    if of := _counted(df):
        rows = df.select(*beside, of["text"])
        schema = T.StructType([*rows.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
        arrow = to_arrow_schema(schema)

        def run(batches):
            for batch in batches:
                for a, _, row, at, tf, names in _counts_of(batch.column(len(beside)), of, 1 << 20):
                    which = pa.array(a + row)
                    cols = [*(batch.column(i).take(which) for i in range(len(beside))), names().take(pa.array(at)), pa.array(tf.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

        return rows.mapInArrow(run, schema)
    cols = [F.col(k) for k in beside]
    # explode_outer + null filter: plain explode makes the optimizer infer a
    # size(terms) > 0 filter and push the whole n-gram expression into the scan.
    return df.select(*cols, F.explode_outer("terms").alias("x")).where(F.col("x").isNotNull()).select(
        *[F.col(k) for k in beside], F.col("x.term").alias("term"), F.col("x.tf").alias("tf"))


def term_lists_of(df: DataFrame, keys) -> DataFrame:
    """(keys, terms) of documents `with_terms`, stored; what is stored is the text they are counted from where it is there, as lists are many times larger."""
    of = _counted(df)
    if not of:
        return df.select(*keys, "terms").checkpoint()
    return with_terms(df.select(*keys, of["text"]).checkpoint(), BodyParams(ngram_min=of["n_min"], ngram_max=of["n_max"]), of["text"])


def corpus_size(df: DataFrame, group=("dataset",)) -> DataFrame:
    """Documents and class counts per group (one row per dataset)."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("n_neg"),
    )


def term_stats(terms_df: DataFrame, group=("dataset",), min_df: int = 1, early: bool = False) -> DataFrame:
    """V4: df and total tf per (group, term) in one pass, of the terms that min_df rows have.

    Texts are counted a slice at a time in their task, so what is summed up by
    Spark is a row for each term of a slice, not for each term of a message.  While
    the words of all texts fit a broadcast (and their numbers 63 bits an n-gram), terms
    are exchanged as such numbers and spelled out at the end.  early: n-grams that one
    row of a group has are left out before (the texts are read twice more).
    """
    if of := _counted(terms_df):
        words = _known_words(terms_df, of)
        again = _seen_again(terms_df, of, words, group) if early and min_df >= 2 else None
        if words:
            return _numbered_stats(terms_df, of, *words, group, min_df, again)
        rows = terms_df.select(*group, of["text"])
        schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, t) for c, t in (("term", T.StringType()), ("df", T.LongType()), ("tf_total", T.LongType())))])
        arrow, n = to_arrow_schema(schema), len(group)

        def run(batches):
            for name, part in _by_group(batches, n):
                for _, _, _, at, tf, names in _counts_of(part.column(n), of, LARGE_SLICE):
                    terms = names()
                    found = pa.array(np.bincount(at, minlength=len(terms))), pa.array(np.bincount(at, tf, minlength=len(terms)).astype(np.int64))
                    if again:
                        kept = pa.array(_hit(again, _term_keys(terms), name))
                        terms, *found = (x.filter(kept) for x in (terms, *found))
                    for i in range(0, len(terms), ROWS_A_BATCH):
                        cols = [c.slice(i, ROWS_A_BATCH) for c in (terms, *found)]
                        yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(cols[0]), f.type) for x, f in zip(name, arrow)), *cols], schema=arrow)

        return rows.mapInArrow(run, schema).groupBy(*group, "term").agg(F.sum("df").alias("df"), F.sum("tf_total").alias("tf_total")).where(F.col("df") >= min_df)
    long = doc_term_rows(terms_df, keys=(*group, "msg_id"))
    return long.groupBy(*group, "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf_total")).where(F.col("df") >= min_df)


#: Distinct words of a corpus up to which they are broadcast (some 12 bytes a word, and a lookup table in each Python worker).
WORDS = 1_500_000


def _known_words(terms_df: DataFrame, of: dict) -> tuple[Broadcast, int] | None:
    """All words of the texts, ascending, in a broadcast, and the bits of a word's number; None where they are too many."""
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                flat = pc.split_pattern(pc.fill_null(batch.column(0).slice(a, b - a), ""), " ").flatten().unique()
                yield pa.RecordBatch.from_arrays([flat.filter(pc.greater_equal(pc.utf8_length(flat), 2))], names=["word"])

    bits = 63 // of["n_max"]
    most = min(WORDS, (1 << bits) - 2)
    found = terms_df.select(of["text"]).mapInArrow(run, "word string").distinct().limit(most + 1).toArrow().column("word").combine_chunks()
    if len(found) > most:
        return None
    return terms_df.sparkSession.sparkContext.broadcast(found.take(pc.sort_indices(found)).cast(pa.string())), bits


def _term_keys(terms: pa.Array) -> np.ndarray:
    """The same 64-bit number for a term in all tasks."""
    return pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False)


def _slots(keys: np.ndarray, name: tuple, slots: int) -> np.ndarray:
    """Slots of a group's terms (slots: a power of two)."""
    return (B.hashed(keys, zlib.crc32(repr(name).encode())) & np.uint64(slots - 1)).astype(np.int64)


def _hit(again: Broadcast, keys: np.ndarray, name: tuple) -> np.ndarray:
    slot = _slots(keys, name, 8 * len(again.value))
    return (again.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _seen_again(terms_df: DataFrame, of: dict, words: tuple[Broadcast, int] | None, group) -> Broadcast | None:
    """Second bits (see `bitmap`) of the n-grams of texts, from their numbers or else their spelling; None where the largest bitmap is too small."""
    rows, n, n_max = terms_df.select(*group, of["text"]), len(group), of["n_max"]
    occurrences = (rows.agg(F.sum(F.size(F.split(of["text"], " ")).cast("long"))).first()[0] or 0) * (n_max - of["n_min"] + 1)
    slots = B.bitmap_slots(occurrences)
    if occurrences > B.USELESS * slots:
        return None

    def of_task(batches):
        seen = B.SeenTwice(slots)
        for name, part in _by_group(batches, n):
            if words:
                for _, _, c in ngram_counts(part.column(n), of["n_min"], n_max, LARGE_SLICE):
                    add(seen, c.packed(_places(c, words[0]), words[1]), c.at, name)
            else:
                for _, _, _, at, _, names in _counts_of(part.column(n), of, LARGE_SLICE):
                    add(seen, _term_keys(names()), at, name)
        yield from seen.sent()

    def add(seen, keys, at, name):
        slot = _slots(keys, name, slots)
        seen.add(np.concatenate([slot, slot[np.bincount(at, minlength=len(slot)) > 1]]))  # twice is as good as more often

    return terms_df.sparkSession.sparkContext.broadcast(B.added_up(rows.mapInArrow(of_task, B.CHUNKS), slots))


def _places(c, words: Broadcast) -> np.ndarray:
    """Numbers, from 1 on, of the words of some counts among all words."""
    return pc.index_in(c.words, value_set=words.value).to_numpy(zero_copy_only=False).astype(np.int64) + 1


#: Bytes of text for each bucket of n-grams: what one call of the sums below holds (some 20 bytes for each n-gram of a slice).
BUCKET_BYTES = 1 << 22


def _numbered_stats(terms_df: DataFrame, of: dict, words: Broadcast, bits: int, group, min_df: int, again: Broadcast | None = None) -> DataFrame:
    """term_stats by numbers: a slice's counts go out as one packed row a bucket (by hash of the n-gram), a bucket is summed up at once."""
    rows = terms_df.select(*group, of["text"])
    buckets = max(8, (rows.agg(F.sum(F.octet_length(of["text"]))).first()[0] or 0) // BUCKET_BYTES)
    own = rows.schema.fields[:-1]
    packed = T.StructType([*own, T.StructField("_bucket", T.IntegerType()), T.StructField("_counts", T.BinaryType())])
    schema = T.StructType([*own, *(T.StructField(c, T.LongType()) for c in ("_key", "df", "tf_total"))])
    sent, arrow, n, n_max = to_arrow_schema(packed), to_arrow_schema(schema), len(group), of["n_max"]

    def run(batches):
        for name, part in _by_group(batches, n):
            for _, _, c in ngram_counts(part.column(n), of["n_min"], n_max, LARGE_SLICE):
                key = c.packed(_places(c, words), bits)
                counts = np.stack([key, np.bincount(c.at, minlength=len(key)), np.bincount(c.at, c.tf, minlength=len(key)).astype(np.int64)], axis=1)
                if again:
                    counts = counts[_hit(again, key, name)]
                    key = counts[:, 0]
                mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                bucket = (mixed % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                counts, cut = counts[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                blobs = pa.array([counts[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(full), f.type) for x, f in zip(name, sent)), pa.array(full.astype(np.int32)), blobs], schema=sent)

    def added(table: pa.Table) -> pa.Table:
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in table.column("_counts").combine_chunks()])
        counts = counts[np.argsort(counts[:, 0])]
        cut = np.flatnonzero(np.diff(counts[:, 0], prepend=-1))
        sums = np.add.reduceat(counts[:, 1:], cut, axis=0)
        kept = sums[:, 0] >= min_df
        cut, sums = cut[kept], sums[kept]
        same = [pa.array(table.column(i)[:1].to_pylist() * len(cut), f.type) for i, f in zip(range(n), arrow)]
        return pa.Table.from_arrays([*same, pa.array(counts[cut, 0]), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())], schema=arrow)

    @F.arrow_udf(T.StringType())
    def spelled(key: pa.Array) -> pa.Array:
        k = key.to_numpy(zero_copy_only=False)
        return joined_words(words.value, [(k >> (bits * i)) & ((1 << bits) - 1) for i in reversed(range(n_max))])

    sums = rows.mapInArrow(run, packed).groupBy(*group, "_bucket").applyInArrow(added, schema)
    return sums.select(*group, spelled("_key").alias("term"), "df", "tf_total")


def pruned_stats(stats: DataFrame, sizes: DataFrame, params: BodyParams, group=("dataset",)) -> DataFrame:
    """V4: keep min_df <= df <= max_df * N."""
    s = stats.join(F.broadcast(sizes.select(*group, "n_docs")), list(group))
    return s.where((F.col("df") >= params.min_df) & (F.col("df") <= F.lit(params.max_df) * F.col("n_docs")))


def frequent_stats(docs: DataFrame, sizes: DataFrame, params: BodyParams, group=("dataset",)) -> DataFrame:
    """V4: df and total tf of the terms within the limits of df.

    With prune_early, terms of a single row don't reach the exchange (see
    `bitmap`); `docs` is then read several times more and should be stored.  The
    rows are the same either way.
    """
    early = params.prune_early and params.min_df >= 2
    kept = B.without_singletons(docs.select(*group, "msg_id", "terms"), group) if early and not _counted(docs) else docs
    return pruned_stats(term_stats(kept, group, params.min_df, early), sizes, params, group)


ROWS_A_BATCH = 100_000


def _by_group(batches, n: int):
    """(group values, rows) of each group of each batch; the first n columns are the group."""
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(n))))
        for name in dict.fromkeys(names):
            yield name, batch.filter(pa.array([x == name for x in names]))


def top_k_per_group(df: DataFrame, k: int, order, group=("dataset",), rank_col: str = "rank",
                    salts: int = 256, key: str = "term") -> DataFrame:
    """Top-k rows per group, with their rank, in two steps.

    The rows of a group are dealt into `salts` parts by a hash of `key`, and
    each part keeps its own top k; only the salts * k survivors of a group
    meet in one task.  (Spark's own group limit stops at k = 1000.)
    """
    part = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    w = Window.partitionBy(*group, "_salt").orderBy(*order)
    best = part.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k).drop("_salt", rank_col)
    return best.withColumn(rank_col, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank_col) <= k)


def smooth_idf(df_col, n_col):
    """V6: ln((1+N)/(1+df)) + 1."""
    return F.log((F.lit(1.0) + n_col) / (F.lit(1.0) + df_col)) + F.lit(1.0)


def tf_weight(tf_col, sublinear: bool = True):
    """V7: 1 + ln(tf) (or raw tf)."""
    return (F.lit(1.0) + F.log(tf_col.cast("double"))) if sublinear else tf_col.cast("double")


def preliminary_vocab(pruned: DataFrame, params: BodyParams, group=("dataset",)) -> DataFrame:
    """V5: top (3 x max_features, or max_features) terms by total tf, ties by term."""
    k = params.max_features * (C.PRE_VOCAB_FACTOR if params.discriminative else 1)
    top = top_k_per_group(pruned, k, [F.col("tf_total").desc(), F.col("term").asc()], group)
    return top.select(*group, "term", "df", "n_docs", "tf_total")


#: Terms of all datasets up to which a vocabulary is broadcast (some 60 bytes a term).
INDEX_TERMS = 500_000
_CELL = "struct<term:string,idx:bigint,w:double>"


def vocabulary_entries(vocab: DataFrame, group, of: dict | None) -> dict[tuple, tuple]:
    """group values -> (terms, idx, idf, the terms as numbers); terms ascend.  The caller has counted the rows.

    The numbers are for texts (of: their n-gram lengths), and left out where 63 bits don't hold them.
    """
    parts: dict[tuple, list] = {}
    for r in vocab.select(*group, "term", "idx", "idf").collect():
        parts.setdefault(tuple(r[: len(group)]), []).append(r[len(group) :])
    made = {}
    for k, rows in parts.items():
        rows.sort(key=lambda r: r[0])
        terms, known = pa.array([t for t, _, _ in rows], pa.string()), None
        if of:
            try:
                known = KnownTerms(terms, of["n_min"], of["n_max"])
            except OverflowError:
                pass
        made[k] = terms, np.array([i for _, i, _ in rows], np.int64), np.array([f for _, _, f in rows], float), known
    return made


NO_TERMS = (pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0), None)


def weighed(column: pa.Array, of: dict | None, entry: tuple, sublinear: bool):
    """(first row, row behind the last, row, place, w) of texts or term lists, slice by slice: weights of the terms of an
    entry of vocabulary_entries, by row and place; a row's squares add up to 1."""
    terms, _, idf, known = entry
    if of and known:
        found = ((a, b, *known.counts(column.slice(a, b - a))) for a, b in slices(column))
    else:
        found = _looked_up(column, of, terms)
    for a, b, row, place, tf in found:
        tf = tf.astype(float)
        w = (1.0 + np.log(tf) if sublinear else tf) * idf[place]
        yield a, b, row, place, w / np.sqrt(np.bincount(row, w * w, minlength=b - a))[row]


def _looked_up(column: pa.Array, of: dict | None, known: pa.Array):
    """The same counts by spelled out terms."""
    for a, b, row, at, tf, names in _counts_of(column, of):
        place = pc.fill_null(pc.index_in(names(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[at]
        hit = np.flatnonzero(place >= 0)
        yield a, b, row[hit], place[hit], tf[hit]


def tfidf_rows(terms_df: DataFrame, vocab: DataFrame, params: BodyParams, group=("dataset",), extra=("label",)) -> DataFrame:
    """V6-V8 in the row: (group, msg_id, extra, cells), cells being (term, idx, w) of the vocabulary's terms.

    Nothing is exchanged by message.  A message without such a term, or of a
    group without a vocabulary, has no cells.
    """
    keys = [*group, "msg_id", *extra]
    of = _counted(terms_df)
    rows = terms_df.select(*keys, of["text"] if of else "terms")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("cells", T._parse_datatype_string(f"array<{_CELL}>"))])
    arrow, sublinear, n = to_arrow_schema(schema), params.sublinear_tf, len(group)
    index = vocab.sparkSession.sparkContext.broadcast(vocabulary_entries(vocab, group, of))

    def run(batches):
        for name, part in _by_group(batches, n):
            entry = index.value.get(name, NO_TERMS)
            for a, b, row, place, w in weighed(part.column(len(keys)), of, entry, sublinear):
                starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))]).astype(np.int32)
                cells = pa.StructArray.from_arrays([entry[0].take(pa.array(place)), pa.array(entry[1][place]), pa.array(w)], ["term", "idx", "w"])
                cells = pa.ListArray.from_arrays(pa.array(starts), cells)
                yield pa.RecordBatch.from_arrays([*part.slice(a, b - a).columns[: len(keys)], cells.cast(arrow.field("cells").type)], schema=arrow)

    return rows.mapInArrow(run, schema)


_SUMS = ("s_pos", "s_neg", "s1", "s2")


def weight_sums(terms_df: DataFrame, vocab: DataFrame, params: BodyParams, group=("dataset",)) -> DataFrame:
    """(group, term, idx) and the sums of the term's weights over label 1, over label 0, over all messages, and of their squares.

    A task adds up the cells of its messages and sends a row for each term it has met.
    """
    keys = [*group, "term", "idx"]
    if not fits_index(vocab):
        w, zero = F.col("w"), F.lit(0.0)
        long = _joined_weights(terms_df, vocab, params, group)
        each = [F.when(F.col("label") == 1, w).otherwise(zero), F.when(F.col("label") == 0, w).otherwise(zero), w, w * w]
        return long.groupBy(*keys).agg(*[F.sum(x).alias(s) for x, s in zip(each, _SUMS)])
    of = _counted(terms_df)
    rows = terms_df.select(*group, F.col("label").cast("int").alias("label"), of["text"] if of else "terms")
    schema = T.StructType([*rows.schema.fields[: len(group)], T.StructField("term", T.StringType()), T.StructField("idx", T.LongType()), *(T.StructField(s, T.DoubleType()) for s in _SUMS)])
    arrow, sublinear, n = to_arrow_schema(schema), params.sublinear_tf, len(group)
    index = vocab.sparkSession.sparkContext.broadcast(vocabulary_entries(vocab, group, of))

    def run(batches):
        totals: dict[tuple, np.ndarray] = {}
        for name, part in _by_group(batches, n):
            if name not in index.value:
                continue
            entry = index.value[name]
            label = pc.fill_null(part.column(n), -1).to_numpy(zero_copy_only=False)
            for a, b, row, place, w in weighed(part.column(n + 1), of, entry, sublinear):
                own, size = label[a:b][row], len(entry[0])
                sums = totals.setdefault(name, np.zeros((5, size)))
                for i, x in enumerate((w * (own == 1), w * (own == 0), w, w * w, None)):
                    sums[i] += np.bincount(place, x, minlength=size)
        for name, sums in totals.items():
            terms, idx, *_ = index.value[name]
            met = np.flatnonzero(sums[4])
            for i in range(0, len(met), ROWS_A_BATCH):
                at = met[i : i + ROWS_A_BATCH]
                same = [pa.array([x] * len(at), f.type) for x, f in zip(name, arrow)]
                yield pa.RecordBatch.from_arrays([*same, terms.take(pa.array(at)), pa.array(idx[at]), *(pa.array(s[at]) for s in sums[:4])], schema=arrow)

    return rows.mapInArrow(run, schema).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in _SUMS])


def _joined_weights(terms_df: DataFrame, vocab: DataFrame, params: BodyParams, group=("dataset",), extra=("label",)) -> DataFrame:
    """The same cells in long form, for a vocabulary of any size: a join by term, then norms by message."""
    long = doc_term_rows(terms_df, keys=(*group, "msg_id"), extra=extra)
    j = long.join(vocab, [*group, "term"])
    j = j.withColumn("w_raw", tf_weight(F.col("tf"), params.sublinear_tf) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w_raw") * F.col("w_raw")).over(Window.partitionBy(*group, "msg_id")))
    return j.select(*group, "msg_id", *extra, "term", F.col("idx").cast("long").alias("idx"), (F.col("w_raw") / norm).alias("w"))


def fits_index(vocab: DataFrame) -> bool:
    return vocab.count() <= INDEX_TERMS


def tfidf_cells(terms_df: DataFrame, vocab: DataFrame, params: BodyParams, group=("dataset",), extra=("label",)) -> DataFrame:
    """tfidf_rows, or where the vocabulary is too large for an index the joined weights gathered by message."""
    if fits_index(vocab):
        return tfidf_rows(terms_df, vocab, params, group, extra)
    keys = [*group, "msg_id"]
    long = _joined_weights(terms_df, vocab, params, group, ())
    cells = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("term", "idx", "w"))).alias("cells"))
    none = F.array().cast(f"array<{_CELL}>")
    return terms_df.select(*keys, *extra).join(cells, keys, "left").withColumn("cells", F.coalesce("cells", none))


def tfidf_long(terms_df: DataFrame, vocab: DataFrame, params: BodyParams, group=("dataset",),
               extra=("label",)) -> DataFrame:
    """V6-V8: (group, msg_id, extra, term, idx, w) L2-normalised over the vocabulary (group, term, idx, idf)."""
    if not fits_index(vocab):
        return _joined_weights(terms_df, vocab, params, group, extra)
    rows = tfidf_rows(terms_df, vocab, params, group, extra)
    keys = [*group, "msg_id", *extra]
    return rows.select(*keys, F.explode_outer("cells").alias("c")).where(F.col("c").isNotNull()).select(*keys, "c.term", "c.idx", "c.w")


def discriminative_scores(sums: DataFrame, sizes: DataFrame, group=("dataset",)) -> DataFrame:
    """|log-odds| of each term from its class-conditional weight sums."""
    s = sums.select(*group, "term", "s_pos", "s_neg").join(F.broadcast(sizes), list(group))
    n1 = F.greatest(F.col("n_pos"), F.lit(1))
    n0 = F.greatest(F.col("n_neg"), F.lit(1))
    ratio = (F.col("s_pos") / n1 + C.LOG_ODDS_EPS) / (F.col("s_neg") / n0 + C.LOG_ODDS_EPS)
    return s.withColumn("score", F.abs(F.log(ratio)))


def fit_vocabulary(docs: DataFrame, params: BodyParams = BodyParams(), group=("dataset",),
                   sizes: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Fit the body vocabulary: (group, term, idx, df, n_docs, idf[, score]).

    `docs` needs (group, msg_id, label, terms).  Discriminative mode ranks the
    preliminary vocabulary by |log-odds| (V9-V11, ties by term); otherwise the
    top terms by total tf are indexed alphabetically (V13).  Sizes and term
    counts (corpus_size, term_stats) of the same documents are taken as they are
    where they are given.
    """
    sizes = corpus_size(docs, group) if sizes is None else sizes
    frequent = frequent_stats(docs, sizes, params, group) if stats is None else pruned_stats(stats, sizes, params, group)
    pre = preliminary_vocab(frequent, params, group)
    pre = pre.withColumn("idf", smooth_idf(F.col("df"), F.col("n_docs"))).withColumn("idx", F.lit(0))
    if not params.discriminative:
        w = Window.partitionBy(*group).orderBy("term")
        return pre.withColumn("idx", F.row_number().over(w) - 1).select(
            *group, "term", "idx", "df", "n_docs", "idf")
    checkpoint_dir(pre.sparkSession)
    pre = pre.checkpoint()  # at most 3 x max_features rows a group: counted, then broadcast
    scored = discriminative_scores(weight_sums(docs, pre, params, group), sizes, group)
    top = top_k_per_group(scored, params.max_features,
                          [F.round("score", 10).desc(), F.col("term").asc()], group)
    vocab = top.select(*group, "term", (F.col("rank") - 1).alias("idx"), "score")
    # Refit on the fixed vocabulary -> df and idf over the same corpus.
    return vocab.join(F.broadcast(pre.select(*group, "term", "df", "n_docs", "idf")), [*group, "term"])


def transform_long(docs: DataFrame, vocab: DataFrame, params: BodyParams = BodyParams(),
                   group=("dataset",), extra=()) -> DataFrame:
    """(group, msg_id, extra, idx, w) with the fitted vocabulary and idf."""
    v = vocab.select(*group, "term", "idx", "idf")
    return tfidf_long(docs, v, params, group, extra=extra).select(
        *group, "msg_id", *extra, "idx", "term", "w")


def transform_cells(docs: DataFrame, vocab: DataFrame, params: BodyParams = BodyParams(), group=("dataset",), extra=()) -> DataFrame:
    """V12/V14 in the row: (group, msg_id, extra, cells), a row for every message."""
    return tfidf_cells(docs, vocab.select(*group, "term", "idx", "idf"), params, group, extra)


def feature_names(vocab: DataFrame, group=("dataset",)) -> DataFrame:
    """Term by index."""
    return vocab.select(*group, "idx", "term").orderBy(*group, "idx")
