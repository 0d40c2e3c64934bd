"""Conversation prefix trie by union-find over LCP edges (operator 13).

A conversation becomes the list of its turns' digests (16 bytes each) and word
counts; texts go no further.  Conversations are sorted by that list and cut into
ranges, ties by id, so that even equal ones are spread over partitions.  Within a
partition every conversation starts as a chain of nodes, and every pair of
neighbours is an edge as deep as their longest common prefix (LCP).  Edges are
taken in descending depth; union-find joins the two components and the nodes of
both chains up to that depth, which makes the branching node.  Afterwards only
nodes on the partition's left or right border can have more members elsewhere:
the partition is contracted to these two chains.  Contracted forests are merged
in the same way, FAN_IN neighbours a task, level by level; what no longer lies on
a border is final.  A child whose parent was still open keeps a reference to it,
which the merges resolve.

The ids that end in a node are hashed where they lie; only those of the first and
last conversation of a partition wait, as pieces of joined text, for one stream.

State a task: the nodes of one range (TURNS_A_PART turns) or the borders of
FAN_IN forests.  A conversation is one row of 24 bytes a turn.

Defined results: null role and text are empty; turns are ordered by turn, nulls
first, and by digest among equal ones; rows without a conv_id belong to no
conversation; repeated rows are turns of their own.  A conversation without a
turn is a member of the root.  No conversation, no node.  Other columns are
passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut

#: Turns in each range of the sorted conversations.
TURNS_A_PART = 100_000
FAN_IN = 16
#: Characters of joined ids in a piece that waits for its stream.
PIECE_CHARS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, digests (array<string>, hex) and words (array<long>) of every conversation, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text))
    at = F.struct(F.col("turn").isNotNull().alias("late"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), at.alias("at"))
    # digests and counts, never texts, are gathered: 24 bytes a turn of one conversation
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return found.select("conv_id", F.col("at.digest").alias("digests"), F.col("at.words").alias("words"))


def with_heads(seqs: DataFrame, base: Column, turns: Column, most: int) -> DataFrame:
    """Each conversation's first `turns` (at most `most`) replaced by those of conversation `base`, if there is one."""
    heads = seqs.select(F.col("conv_id").alias("_base"), F.slice("digests", 1, most).alias("_hd"), F.slice("words", 1, most).alias("_hw"))
    own = seqs.withColumn("_base", base).withColumn("_n", turns)
    rest = F.greatest(F.size("digests") - F.col("_n"), F.lit(0))
    both = [F.concat(F.slice(F.coalesce(head, F.array().cast(kind)), F.lit(1), F.col("_n")), F.slice(col, F.col("_n") + 1, rest)).alias(col)
            for col, head, kind in (("digests", F.col("_hd"), "array<string>"), ("words", F.col("_hw"), "array<long>"))]
    return own.join(heads, "_base", "left").select("conv_id", *both)


# ------------------------------------------------------------ forests
class Forest:
    """Nodes with union-find, and the components (a left and a right border chain each) they form."""

    def __init__(self) -> None:
        self.up: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.digest: list[bytes] = []
        self.words: list[int] = []
        self.n: list[int] = []
        self.least: list[int] = []
        self.kids: list[int] = []
        self.leaves: list[int] = []
        self.saved: list[int] = []
        self.ends: list[str | None] = []  # hash of the ids that end here; of a run at a border: its key

    def node(self, parent: int, depth: int, digest: bytes, words: int, n: int, least: int, kids: int, leaves: int, saved: int, ends: str | None) -> int:
        for column, value in ((self.parent, parent), (self.depth, depth), (self.digest, digest), (self.words, words), (self.n, n), (self.least, least),
                              (self.kids, kids), (self.leaves, leaves), (self.saved, saved), (self.ends, ends), (self.up, len(self.up))):
            column.append(value)
        return len(self.up) - 1

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def chain(self, conv: int, digests: list[bytes], words: list[int]) -> list[int]:
        """A conversation's nodes, the root first."""
        out, at, last = [], -1, len(digests)
        for d in range(last + 1):
            at = self.node(at, d, digests[d - 1] if d else b"", words[d - 1] if d else 0, 1, conv, int(d < last), 1, 0, None)
            out.append(at)
        return out

    def common(self, a: list[int], b: list[int]) -> int:
        """Depth up to which two chains agree."""
        most = min(len(a), len(b)) - 1
        d = 0
        while d < most and self.digest[a[d + 1]] == self.digest[b[d + 1]]:
            d += 1
        return d

    def join(self, right: list[int], left: list[int], depth: int) -> None:
        """The nodes of a right border and the left border beside it are the same down to `depth`.

        From there up to the root, sums over a subtree change by what the joined
        child has more or less than the two it was.
        """
        kids, leaves, saved = self.kids, self.leaves, self.saved
        more_leaves = more_saved = 0
        for d in range(depth, -1, -1):
            a, c = self.find(right[d]), self.find(left[d])
            n, words = self.n[a] + self.n[c], self.words[a]
            was_leaves, was_saved = leaves[a] + leaves[c], saved[a] + saved[c]
            if d == depth:
                kids_now = kids[a] + kids[c]
                leaves_now = (leaves[a] if kids[a] else 0) + (leaves[c] if kids[c] else 0) or 1
            else:
                kids_now = kids[a] + kids[c] - 1
                leaves_now = was_leaves + more_leaves
            # (n - 1) words of the one node instead of (n_a - 1) + (n_c - 1) of the two
            saved_now = was_saved + words + more_saved
            more_leaves, more_saved = leaves_now - was_leaves, saved_now - was_saved
            self.up[c] = a
            self.n[a], self.kids[a], leaves[a], saved[a] = n, kids_now, leaves_now, saved_now
            self.least[a] = min(self.least[a], self.least[c])
            if self.ends[a] is None:
                self.ends[a] = self.ends[c]

    def merge(self, parts: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
        """Neighbouring components (left and right border) to one: union-find over their edges, the deepest first."""
        edges = sorted(((-self.common(parts[i][1], parts[i + 1][0]), i) for i in range(len(parts) - 1)))
        first, last = list(range(len(parts))), list(range(len(parts)))  # of a component, by its last and its first part
        for depth, i in edges:
            left, right = first[i], last[i + 1]
            self.join(parts[i][1], parts[i + 1][0], -depth)
            first[right], last[left] = left, right
        return parts[0][0], parts[-1][1]


_COLUMNS = ["depth", "words", "n", "least", "kids", "leaves", "saved", "ends"]
#: kind 'f': a final node (parent known, or a reference to the open one); 'o': an open one, index idx of its
#: forest's border; 'm': the open node idx of forest gid, a level below, is now node to_idx of its forest or a
#: final one of conversation least; 'e': piece of ids that end in one sequence.
_SCHEMA = ("kind string, gid int, idx int, depth int, words long, n long, least long, kids long, leaves long, saved long, ends string, "
           "digest binary, on_left boolean, on_right boolean, parent long, to_gid int, to_idx int, text string")


def _emit(forest: Forest, left: list[int], right: list[int], gid: int, last: bool, sources: list[tuple[int, int, int]]) -> Iterator[dict]:
    """Rows of a merged forest; sources: (node, gid, idx) of what it was loaded from."""
    lefts, rights = [forest.find(i) for i in left], [forest.find(i) for i in right]
    border: dict[int, int] = {}
    if not last:
        for i in (*lefts, *rights):
            border.setdefault(i, len(border))
    own = {"gid": gid, "on_left": None, "on_right": None}
    on_left, on_right = set(lefts), set(rights)
    for i in range(len(forest.up)):
        if forest.up[i] != i:
            continue
        row = own | {c: getattr(forest, c)[i] for c in _COLUMNS}
        if i in border:
            yield row | {"kind": "o", "idx": border[i], "digest": forest.digest[i], "on_left": i in on_left, "on_right": i in on_right}
        elif forest.parent[i] < 0:
            yield row | {"kind": "f"}
        else:
            p = forest.find(forest.parent[i])
            yield row | {"kind": "f"} | ({"to_gid": gid, "to_idx": border[p]} if p in border else {"parent": forest.least[p]})
    for i, from_gid, idx in sources:
        i = forest.find(i)
        yield {"kind": "m", "gid": from_gid, "idx": idx} | ({"to_gid": gid, "to_idx": border[i]} if i in border else {"least": forest.least[i]})


def ids_hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _partition_forest(rows: Iterator[tuple[int, int, bytes, list[int]]]) -> Iterator[dict]:
    """One sorted partition (pid, conv_id, key, words): its final nodes, borders and pieces of ids."""
    forest, parts, runs, gid = Forest(), [], [], 0
    for gid, conv, key, words in rows:
        digests = [key[i : i + DIGEST] for i in range(0, len(key), DIGEST)]
        chain = forest.chain(conv, digests, words)
        if runs and runs[-1][0] == key:
            runs[-1][2].append(conv)
        else:
            runs.append((key, chain[-1], [conv]))
        parts.append((chain, chain))
    if not parts:
        return
    pieces = []
    for at, (key, node, ids) in enumerate(runs):
        if 0 < at < len(runs) - 1:
            forest.ends[node] = ids_hash(ids)
        else:  # others may end here in the next partitions
            forest.ends[node] = name = "*" + hashlib.sha256(key).hexdigest()
            room = max(1, PIECE_CHARS // 20)
            pieces += [{"kind": "e", "ends": name, "least": ids[i], "text": ",".join(map(str, ids[i : i + room]))} for i in range(0, len(ids), room)]
    yield from _emit(forest, *forest.merge(parts), gid, False, [])
    yield from pieces


def _merge_forests(rows: list[dict], gid: int, last: bool) -> Iterator[dict]:
    """Contracted neighbours, as rows of kind 'o', to one forest."""
    forest, parts, sources = Forest(), [], []
    by_gid: dict[int, list[dict]] = {}
    for r in rows:
        by_gid.setdefault(r["gid"], []).append(r)
    for at in sorted(by_gid):
        left, right = [], []
        for r in sorted(by_gid[at], key=lambda r: r["depth"]):
            side = left if r["on_left"] else right
            i = forest.node(side[-1] if side else -1, r["depth"], r["digest"], r["words"], r["n"], r["least"], r["kids"], r["leaves"], r["saved"], r["ends"])
            if r["on_left"]:
                left.append(i)
            if r["on_right"]:
                right.append(i)
            sources.append((i, at, r["idx"]))
        parts.append((left, right))
    yield from _emit(forest, *forest.merge(parts), gid, last, sources)


def _merging(arrow: pa.Schema, fan_in: int, last: bool):
    def together(neighbours: pa.Table) -> pa.Table:
        rows = neighbours.to_pylist()
        return pa.Table.from_pylist(list(_merge_forests(rows, rows[0]["gid"] // fan_in, last)), schema=arrow)

    return together


def _resolved(levels: list[DataFrame]) -> DataFrame | None:
    """(gid, idx) of the open nodes of the lowest level -> parent, through the merges of all levels."""
    known = None
    for rows in reversed(levels):
        here = rows.where("kind = 'm'").select("gid", "idx", "least", "to_gid", "to_idx")
        if known is None:
            known = here.select("gid", "idx", F.col("least").alias("parent"))
            continue
        above = known.select(F.col("gid").alias("to_gid"), F.col("idx").alias("to_idx"), "parent")
        known = here.join(above, ["to_gid", "to_idx"], "left").select("gid", "idx", F.coalesce("least", "parent").alias("parent"))
    return known


def _streamed_ends(pieces: DataFrame) -> DataFrame:
    """ends (key of a sequence) -> hash of all ids, from pieces in order of their first id; a piece at a time."""
    schema = "ends string, hash string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = name, hashlib.sha256(text.encode())
                else:
                    digest.update(("," + text).encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], schema=arrow)

    ordered = pieces.repartition("ends").sortWithinPartitions("ends", "least")
    return ordered.select("ends", "text").mapInArrow(run, schema)


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """seqs: conv_id, digests, words -> a row for each distinct prefix of digests.

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.
    """
    arrow = arrow_schema(_SCHEMA)
    keyed = cut(seqs.select("conv_id", F.unhex(F.array_join("digests", "")).alias("key"), "words"))
    n = keyed.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TURNS_A_PART))
    ranged = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").select(F.spark_partition_id().alias("pid"), "conv_id", "key", "words")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def batched(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in found:
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    low = cut(ranged.mapInArrow(lambda batches: batched(_partition_forest(rows_of(batches))), _SCHEMA))
    levels, rows = [], low
    count = ranged.rdd.getNumPartitions()
    while count > 1 or not levels:
        count = -(-count // FAN_IN)
        rows = cut(rows.where("kind = 'o'").groupBy(F.floor(F.col("gid") / FAN_IN)).applyInArrow(_merging(arrow, FAN_IN, count == 1), _SCHEMA))
        levels.append(rows)
    final = None
    for i, level in enumerate([low, *levels]):
        nodes = level.where("kind = 'f'")
        known = _resolved(levels[i:])
        if known is not None:  # children of nodes that were open at their level
            refs = known.select(F.col("gid").alias("to_gid"), F.col("idx").alias("to_idx"), F.col("parent").alias("_found"))
            waiting = nodes.where(F.col("to_idx").isNotNull()).join(refs, ["to_gid", "to_idx"], "left").withColumn("parent", F.col("_found")).drop("_found")
            nodes = nodes.where(F.col("to_idx").isNull()).unionByName(waiting)
        final = nodes if final is None else final.unionByName(nodes)
    open_end = F.coalesce(F.col("ends").startswith("*"), F.lit(False))
    hashed = _streamed_ends(low.where("kind = 'e'").select("ends", "least", "text"))
    final = final.where(~open_end).unionByName(final.where(open_end).join(hashed, "ends", "left").withColumn("ends", F.col("hash")).drop("hash"))
    return final.select(F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(ids_hash([]))).alias("ends_sha256"))
