"""Mixing sources to target weights by hierarchical budgets.

The corpus is a tree of domains, languages and sources.  A token budget goes
down the tree in proportion to the weights; a child that can't use its part
(its documents, repeated for max_epochs at most, hold fewer tokens) keeps what
it can, and its siblings share the rest by weight.  As the capacity of a node
is that of its whole subtree, only what no sibling can take is left to the
node's own siblings, then to those of its parent.  Each leaf then takes its
documents in whole epochs and, of one more epoch in an order drawn from the
seed, the prefix of tokens that fills its budget; the document at the edge is
cut.

The order is by md5 of (seed, epoch, doc_id).  The prefix is found by radix:
tokens are summed by the first three hex digits, then by the next three inside
the one bucket where the cut lies, and only rows that share all six digits
with the cut are ordered among themselves.  So no leaf, however large, is
gathered in one task.

Defined results: a null level counts as the empty name; a weight that isn't
listed is the level's default; a zero weight gets nothing; null and empty
texts hold no tokens and are never taken; rows with equal ids stand side by
side in the order (by their tokens), so repeated rows are told apart only by
place; from an empty table nothing is taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TOKEN = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Target weights of each level's names, and how much to take."""

    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    default: float = 1.0
    budget_share: float = 0.5  # of all tokens of the corpus
    max_epochs: int = 2
    seed: int = 17

    def weight(self, level: str) -> Column:
        out = F.lit(self.default)
        for name, w in sorted(self.weights.get(level, {}).items()):
            out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
        return out


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def water_fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """alloc of each child: columns weight, cap and budget (the parent's) in, alloc out.

    Children are taken by rising cap/weight; those whose cap is below the
    common level keep their cap, the others get level times weight.
    """
    w = Window.partitionBy(*parent).orderBy("ratio", name) if parent else Window.partitionBy(F.lit(0)).orderBy("ratio", name)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    some = children.where(F.col("weight") > 0).withColumn("ratio", F.col("cap") / F.col("weight"))
    some = some.withColumn("level_here", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    some = some.withColumn("full", F.col("ratio") <= F.col("level_here"))
    some = some.withColumn("level", F.max(F.when(~F.col("full"), F.col("level_here"))).over(whole))
    alloc = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.greatest(F.col("level") * F.col("weight"), F.lit(0.0))))
    return some.withColumn("alloc", alloc).drop("ratio", "level_here", "full", "level", "weight")


def allocate(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Token budget of every leaf; leaves: domain, lang, source, leaf_tokens (a row for each leaf)."""
    caps = leaves.withColumn("cap", (F.col("leaf_tokens") * mix.max_epochs).cast("double"))
    total = (leaves.agg(F.sum("leaf_tokens")).first()[0] or 0) * mix.budget_share  # one number
    nodes, parent = None, []
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        # a zero weight anywhere below takes its subtree out of the capacity
        usable = caps.where(F.lit(True))
        for lower in LEVELS:
            usable = usable.where(mix.weight(lower) > 0)
        children = usable.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", mix.weight(level))
        with_budget = children.join(nodes, parent) if parent else children.withColumn("budget", F.lit(float(total)))
        nodes = water_fill(with_budget, parent, level).select(*keys, F.col("alloc").alias("budget"))
        parent = keys
    out = leaves.join(nodes, list(LEVELS)).withColumn("leaf_budget", F.floor(F.col("budget") + F.lit(1e-6)).cast("long"))
    epochs = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("leaf_budget") / F.col("leaf_tokens"))).otherwise(0).cast("long")
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("leaf_budget") - F.col("epochs") * F.col("leaf_tokens")).drop("budget")


def _cut_bucket(rows: DataFrame, digits: str, rest: str) -> DataFrame:
    """Of each leaf, the bucket of `digits` where the cumulated tokens reach `rest`, and what of it is left there."""
    sums = rows.groupBy(*LEVELS, rest, digits).agg(F.sum("tokens").alias("in_bucket"))
    w = Window.partitionBy(*LEVELS).orderBy(digits).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(w), F.lit(0)))
    here = (F.col("before") < F.col(rest)) & (F.col(rest) <= F.col("before") + F.col("in_bucket"))
    return sums.where(here).select(*LEVELS, F.col(digits).alias(f"cut_{digits}"), (F.col(rest) - F.col("before")).alias(f"rest_{digits}"))


#: Leaves up to which their budgets and cuts are broadcast; beyond that rows meet them in a shuffle by leaf.
BROADCAST_LEAVES = 200_000


def _near(leaves: DataFrame) -> DataFrame:
    """A table of a row a leaf, written already, with a hint that keeps texts from being shuffled by hot leaves."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def _at_place(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """Rows that hold tokens, with their leaf's epochs and rest, and their place in its order."""
    place = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    r = rows.where("tokens > 0").join(_near(leaves.select(*LEVELS, "epochs", "rest")), list(LEVELS)).withColumn("place", place)
    return r.withColumn("d1", F.substring("place", 1, 3)).withColumn("d2", F.substring("place", 4, 3))


def cuts(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """Of each leaf that takes a prefix: the six digits where it ends, and the tokens left for rows with just these digits."""
    keys = list(LEVELS)
    r = _at_place(rows, leaves, mix).where("rest > 0")
    first = cut(_cut_bucket(r, "d1", "rest"))
    second = _cut_bucket(r.join(_near(first), keys).where("d1 = cut_d1"), "d2", "rest_d1")
    return cut(first.select(*keys, "cut_d1").join(second, keys))


def select_prefix(rows: DataFrame, leaves: DataFrame, ends: DataFrame, mix: Mix) -> DataFrame:
    """rows with epochs and extra_tokens; those of which nothing is taken are left out.

    A row away from its leaf's cut is decided by itself; only rows at the cut
    are ordered among themselves.
    """
    keys = list(LEVELS)
    r = _at_place(rows, leaves, mix).join(_near(ends), keys, "left")
    at_edge = F.coalesce((F.col("d1") == F.col("cut_d1")) & (F.col("d2") == F.col("cut_d2")), F.lit(False))
    inside = F.coalesce((F.col("d1") < F.col("cut_d1")) | ((F.col("d1") == F.col("cut_d1")) & (F.col("d2") < F.col("cut_d2"))), F.lit(False))
    clear = r.where(~at_edge).withColumn("extra_tokens", F.when(inside, F.col("tokens")).otherwise(F.lit(0).cast("long")))
    w = Window.partitionBy(*keys).orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = r.where(at_edge).withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    edge = edge.withColumn("extra_tokens", F.greatest(F.least(F.col("rest_d2") - F.col("before"), F.col("tokens")), F.lit(0)).cast("long")).drop("before")
    return clear.unionByName(edge).where((F.col("epochs") > 0) | (F.col("extra_tokens") > 0)).select(*rows.columns, "epochs", "extra_tokens")


def mix_sources(docs: DataFrame, mix: Mix, domain: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of each document that is taken: doc_id, its leaf, tokens, whole epochs, and tokens of the last, cut epoch.

    domain: the expression that names a row's domain.  Columns of docs named in
    carry come last.  The budgets and cuts are worked out on ids, leaf names
    and token counts; the texts are only read again and decided row by row.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
                        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                        n_tokens(F.col("text")).alias("tokens"), *(F.col(c).alias(f"in_{c}") for c in carry))
    rows = cut(named.select("doc_id", *LEVELS, "tokens"))
    leaves = cut(allocate(cut(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("leaf_tokens"))), mix))
    got = select_prefix(named if carry else rows, leaves, cuts(rows, leaves, mix), mix)
    return got.select("doc_id", *LEVELS, "tokens", "epochs", "extra_tokens", *(F.col(f"in_{c}").alias(c) for c in carry))
