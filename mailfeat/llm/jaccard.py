"""N-gram Jaccard join by chosen paths.

A text is its set of five-word shingles; two texts are linked if the Jaccard
similarity of their sets is 0.8 or more.  Texts with equal sets are one class,
and the join runs over classes.

Chosen paths: in each of RUNS runs every class starts at the root and goes on
to the tokens (shingles) that a hash of (run, path, token) samples with
probability 1 / (0.8 |set|).  Classes that chose the same path share a
bucket.  Paths start with FIRST tokens, as buckets of one common token
would be large.  Buckets of SMALL classes or fewer are searched; larger ones
are split by a further sampled token, DEPTH tokens deep.  Two linked classes share
at least one path of a run with the chance that `survival` gives, and the
number of runs follows from the target recall.  A bucket that is still large
at the last level (a group of near copies never gets smaller) is searched in
blocks, pair of blocks by pair of blocks, so none is given up.

A bucket is searched with one-permutation minhash sketches and only gives a spanning
forest of its similar classes, never its pairs.  The components of all
forests are the candidates: each component's sets come together once, in
blocks, and every pair in it is decided exactly, by integer intersection
sizes.  What leaves a block is each class's number of links and a spanning
forest of the exact links, so a group of n near copies costs n rows and its
links are all counted.

Defined results: null texts and texts without a word have no shingles and no
links; texts of one to four words have one shingle, the whole text; rows with
equal sets (repeated rows among them) are each other's links; a null doc_id
takes part, and its class_id is the least id in its class, null if none has
one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, fresh, map_columns, mix64, utf8, window_hashes, word_hashes

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Classes in a bucket or block that are compared side by side, and shingles in a block.
SMALL, BLOCK_SHINGLES = 1000, 2_000_000
#: Tokens in the first paths that are searched, and in the last.
FIRST, DEPTH = 2, 3
SKETCH = 128
#: Sketch similarity from which two classes are candidates; over 4 standard deviations below SIMILARITY.
CANDIDATE = 0.6
_U64 = np.uint64


def survival(depth: int, similarity: float = SIMILARITY) -> float:
    """Least chance that two linked sets share a path of `depth` tokens in one run."""
    shared = 2 * similarity / (1 + similarity) / similarity  # expected common children of a common path, equal sizes
    shared = min(shared, 1.0)  # with unequal sizes no more than this is certain
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-shared * p)
    return p


RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - survival(DEPTH)))


def children(paths: np.ndarray, shingles: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The paths one token longer that a set goes on to from some paths: (place of the parent, path).

    A path's odd key times a shingle's hash is the number that decides, the
    same for every set that holds the shingle.
    """
    paths = paths.view(_U64)
    seed = mix64(paths)
    odds = 1.0 / (similarity * len(shingles))
    if odds < 1.0:
        p, t = np.nonzero(shingles[None, :] * (seed[:, None] | _U64(1)) < _U64(int(odds * 2.0**64)))
    else:
        p, t = np.repeat(np.arange(len(paths)), len(shingles)), np.tile(np.arange(len(shingles)), len(paths))
    return p, mix64(shingles[t] ^ seed[p]).view(np.int64)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    words = word_hashes(utf8(text))
    return np.unique(window_hashes(words, min(k, len(words)))) if len(words) else np.empty(0, _U64)


def signature(shingles: np.ndarray) -> bytes | None:
    import hashlib

    return hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None


def sketch(shingles: np.ndarray) -> bytes:
    """One-permutation minhash: of the least shingle in each of SKETCH equal ranges a byte from 1 to 255, 0 for an empty range."""
    low = np.searchsorted(shingles, _RANGES)  # shingles are sorted
    full = low < np.append(low[1:], len(shingles))
    least = shingles[np.minimum(low, len(shingles) - 1)]
    return np.where(full, (mix64(least) % _U64(255)) + _U64(1), _U64(0)).astype(np.uint8).tobytes()


_RANGES = np.arange(SKETCH, dtype=_U64) * _U64((1 << 64) // SKETCH)


def components(linked: np.ndarray) -> np.ndarray:
    """Least member of each row's component in a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    left = np.ones(n, bool)
    for i in range(n):
        if not left[i]:
            continue
        edge = np.zeros(n, bool)
        edge[i] = True
        left[i] = False
        while edge.any():
            edge = linked[edge].any(0) & left
            label[edge] = i
            left &= ~edge
    return label


def _like(sketches: np.ndarray) -> np.ndarray:
    """Which rows' sketches agree in CANDIDATE or more of the ranges that either of them fills."""
    n = len(sketches)
    same = np.zeros((n, n), np.uint8)
    for col in sketches.T:
        same += col[:, None] == col[None, :]
    empty = (sketches == 0).astype(np.float32)
    neither = empty @ empty.T
    return same - neither >= CANDIDATE * (SKETCH - neither)


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of their incidence matrix."""
    n = len(sets)
    if n == 2:
        both = float(np.intersect1d(sets[0], sets[1], assume_unique=True).size)
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], place[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(col, [at, at + columns])
        part = np.zeros((n, min(columns, int(shared.sum()) - at)), np.float32)
        part[row[a:b], col[a:b] - at] = 1.0
        out += part @ part.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def exact_links(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets have Jaccard similarity 4/5 or more (in whole numbers), themselves left out."""
    inter = intersections(sets).astype(np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    linked = 9 * inter >= 4 * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    return linked


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list[Any]]]]:
    """Runs of rows with equal keys from sorted batches; a group is held until its last row is there."""
    at, rows = None, None
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        ks = list(zip(*(cols[k].to_pylist() for k in keys)))
        rest = {n: (c if pa.types.is_list(c.type) else c.to_pylist()) for n, c in cols.items() if n not in keys}
        for i, k in enumerate(ks):
            if k != at:
                if rows is not None:
                    yield at, rows
                at, rows = k, {n: [] for n in rest}
            for n, c in rest.items():
                rows[n].append(c[i].values.to_numpy(zero_copy_only=False) if isinstance(c, pa.ListArray) else c[i])
    if rows is not None:
        yield at, rows


def _grouped(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Rows brought together by keys and streamed through fn(key, columns) group by group.

    Groups are bounded by whoever made the keys; a task holds one at a time.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict[str, Any]] = []
        for key, cols in _groups(batches, keys):
            out += fn(key, cols)
            if len(out) >= 8192:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and, of its shingle set, the signature, size, sketch and the sampled paths of each depth from FIRST on (with the place of their parent in the depth before)."""
    roots = np.arange(1, RUNS + 1, dtype=np.int64)

    def run(cols: dict) -> dict:
        out: dict[str, list[Any]] = {"doc_id": cols["doc_id"], "sig": [], "size": [], "sketch": [], "paths": []}
        for t in cols["text"]:
            s = shingle_set(t)
            out["sig"].append(signature(s))
            out["size"].append(len(s))
            out["sketch"].append(sketch(s) if len(s) else None)
            levels, above = [], roots
            for depth in range(1, DEPTH + 1 if len(s) else 1):
                parent, above = children(above, s)
                if depth >= FIRST:
                    levels.append({"parent": parent.tolist() if depth > FIRST else None, "path": above.tolist()})
            out["paths"].append(levels)
        return out

    pick = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(map_columns(pick, run, "doc_id long, sig binary, size int, sketch binary, paths array<struct<parent:array<int>,path:array<long>>>"))


def _crowded(paths: DataFrame) -> DataFrame:
    """Rows (path, cid) with their bucket's size n, where there are two or more."""
    sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(paths.join(sizes, "path").select("path", "cid", "n"))


#: Large buckets up to which their paths (8 bytes each) are broadcast; beyond, all paths of the next depth are shuffled.
BROADCAST_PARENTS = 1_000_000


def _buckets(classes: DataFrame) -> DataFrame:
    """Rows (path, cid, n) of all buckets to search: small ones, and large ones of the last depth.

    A large bucket's rows go on to their paths one token longer, which every
    class brings along from the scan.
    """
    out, large = None, None
    for i in range(DEPTH - FIRST + 1):
        path = F.col("paths")[i]["path"]
        if large is None:
            rows = classes.select("cid", F.explode(path).alias("path"))
        else:
            before = F.col("paths")[i - 1]["path"]
            above = F.transform(F.col("paths")[i]["parent"], lambda x: F.element_at(before, x + 1))
            rows = classes.select("cid", F.explode(F.arrays_zip(above.alias("parent"), path.alias("path"))).alias("x")).select("cid", "x.parent", "x.path")
            parents = cut(large.select(F.col("path").alias("parent")).distinct())
            rows = rows.join(F.broadcast(parents) if parents.count() <= BROADCAST_PARENTS else parents, "parent")
        found = _crowded(rows.select("path", "cid"))
        small, large = found.where(F.col("n") <= SMALL), found.where(F.col("n") > SMALL)
        out = small if out is None else out.unionByName(small)
        if large.isEmpty():
            return out
    return out.unionByName(large)


def _in_blocks(rows: DataFrame, blocks, by: str) -> DataFrame:
    """Each row once for every pair of blocks its own block is in: columns i <= j and own."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def _forest(members: list, linked: np.ndarray) -> list[dict[str, Any]]:
    return [{"a": members[x], "b": members[y]} for x, y in enumerate(components(linked)) if x != y]


def _candidate_edges(classes: DataFrame) -> DataFrame:
    """Edges between classes of a bucket whose sketches are alike: a spanning forest of each bucket or block pair."""
    rows = _buckets(classes).join(classes.select("cid", "sketch"), "cid")
    rows = _in_blocks(rows, F.ceil(F.col("n") / F.lit(SMALL)), "cid").select("path", "i", "j", "cid", "sketch")

    def search(key: tuple, cols: dict) -> list[dict[str, Any]]:
        if len(cols["cid"]) < 2:
            return []
        order = np.argsort(cols["cid"])
        return _forest([cols["cid"][x] for x in order], _like(np.frombuffer(b"".join(cols["sketch"][x] for x in order), np.uint8).reshape(-1, SKETCH)))

    return _grouped(rows, ["path", "i", "j"], search, "a long, b long").distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node on an edge, the root being the least of its component.

    Alternating large-star and small-star steps; the edge list is written to
    the shared folder after each round, until a round changes nothing.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


#: Members up to which their ids are broadcast (16 bytes each and their block); beyond, texts and members meet in a shuffle.
BROADCAST_MEMBERS = 500_000


def _exact(docs: DataFrame, doc_id: str, text: str, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(cid, root, links) rows of the exact links within candidate components; found: node, root.

    The text of one document of each member is read once more for its set; a
    member's set then goes to the block pairs of its component.
    """
    members = found.select(F.col("node").alias("cid"), F.col("root").alias("comp")).join(classes.select("cid", "sig", "rep", "weight", "size"), "cid")
    total = members.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(SMALL), F.col("s") / F.lit(BLOCK_SHINGLES)))
    members = cut(members.join(total, "comp").select("comp", "cid", "sig", F.col("rep").alias("rep_id"), "weight", blocks.alias("n_blocks")))
    side = F.broadcast(members) if members.count() <= BROADCAST_MEMBERS else members
    pick = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = pick.join(side, F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("comp", "cid", "sig", "weight", "n_blocks", "text")

    def shingled(cols: dict) -> dict:
        out: dict[str, list[Any]] = {"comp": [], "cid": [], "weight": [], "n_blocks": [], "shingles": []}
        for i, t in enumerate(cols["text"]):
            s = shingle_set(t)
            if signature(s) == cols["sig"][i]:  # a row with the same id may hold another text
                out["shingles"].append(s.view(np.int64).tolist())
                for k in ("comp", "cid", "weight", "n_blocks"):
                    out[k].append(cols[k][i])
        return out

    sets = map_columns(texts, shingled, "comp long, cid long, weight long, n_blocks long, shingles array<long>")
    rows = _in_blocks(sets, F.col("n_blocks"), "cid").select("comp", "i", "j", "own", "cid", "weight", "shingles")

    def search(key: tuple, cols: dict) -> list[dict[str, Any]]:
        order = list({c: x for x, c in sorted(enumerate(cols["cid"]), key=lambda y: y[1])}.values())  # a repeated row once
        if len(order) < 2:
            return []
        own, weight = np.array([cols["own"][x] for x in order]), np.array([cols["weight"][x] for x in order], np.int64)
        linked = exact_links([cols["shingles"][x] for x in order])
        counted = linked if key[1] == key[2] else linked & (own[:, None] != own[None, :])  # a block's own pairs count where i = j
        links = counted.astype(np.int64) @ weight
        label = components(linked)
        return [{"cid": cols["cid"][x], "links": int(links[p]), "root": cols["cid"][order[label[p]]]} for p, x in enumerate(order) if linked[p].any()]

    return cut(_grouped(rows, ["comp", "i", "j"], search, "cid long, links long, root long"))


def _joined(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and sig of each row, root and class_id of its class, and n_links."""
    rows = _scan(docs, doc_id, text)
    classes = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), *[F.first(c).alias(c) for c in ("size", "sketch", "paths")])
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    links = _exact(docs, doc_id, text, classes, connected(_candidate_edges(classes)))
    roots = connected(links.select(F.col("cid").alias("a"), F.col("root").alias("b")).where("a <> b")).select(F.col("node").alias("cid"), "root")
    placed = classes.select("cid", "sig", "rep", "weight").join(roots, "cid", "left").join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    placed = cut(placed.select("sig", "rep", F.coalesce("root", "cid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    least = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    placed = placed.join(least, "root").select("sig", "root", "class_id", "n_links")
    alone = F.col("sig").isNull()
    return rows.select("doc_id", "sig").join(placed, "sig", "left").select("doc_id", "sig", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (least id of its component), n_links (documents that are similar to it)."""
    return _joined(docs, doc_id, text).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class stays, one with its least id; the columns stay as they are.

    Rows without a word are in no class and all stay.  Where several rows have
    the id that stays, their text decides, then one of the equal rows is taken.
    """
    @F.pandas_udf("binary")
    def sig_of(texts):
        return texts.map(lambda t: signature(shingle_set(t)))

    joined = cut(_joined(docs, doc_id, text).where("sig IS NOT NULL").select("doc_id", "sig", "root", "class_id"))
    stay = joined.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "sig")).alias("s")).select("s.*")
    many = joined.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("many"))
    key, sig, repeated = fresh(docs, "key"), fresh(docs, "sig"), fresh(docs, "many")
    stay = cut(stay.join(many.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id"))).select(F.col("doc_id").alias(key), F.col("sig").alias(sig), F.col("many").alias(repeated)))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.where(worded).join(stay, F.col(doc_id).cast("long").eqNullSafe(F.col(key)))
    once = kept.where(~F.col(repeated)).select(*docs.columns)
    which = kept.where(F.col(repeated)).where(sig_of(F.col(text)) == F.col(sig)).dropDuplicates([key, sig]).select(*docs.columns)
    return once.unionByName(which).unionByName(docs.where(~worded))
