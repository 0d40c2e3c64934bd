"""Benchmark decontamination by greedy string tiling.

Seeds are windows of `least` words.  The hashes of all benchmark seeds go into
a bitmap of fixed size (BITS bits whatever the benchmark), with which one pass
over the documents keeps the stretches of words that may match; only those are
joined, by seed, with the benchmark's seeds.  Each (stretches, item) pair is
tiled with running Karp-Rabin: the longest common runs of unmarked words are
marked, again and again down to `least` words, so that passages whose parts
were put in another order are covered too.  A document is contaminated by an
item if its tiles cover at least `coverage` of the item's words.

Words are compared without case and ASCII punctuation.  Nothing is lost by keeping
stretches only: a tile is a common run of at least `least` words, so each of
its windows is a shared seed.  Documents with equal stretches are tiled once.

Defined results: null and empty texts match nothing; items of fewer than
`least` words are matched by their whole length if they have MIN_ITEM words,
and are left out if shorter; repeated documents are repeated in the result,
repeated items (the same id and words) count once, the others are compared one
by one, also under the same id; an item without an id is reported with a null
id; with an empty table on either side there are no matches.
"""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, map_columns, utf8, window_hashes, word_hashes

LEAST, COVERAGE = 5, 0.6
#: Items of fewer words are common phrases: they contaminate only a text that consists of them and nothing else.
MIN_ITEM = 3
#: Contaminated rows up to which they are broadcast to the documents; beyond that both sides meet in a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bits of the seed bitmap; 2 ** 26 are 8 MB.
BITS = 1 << 26
_PRIME = (1 << 61) - 1
_BASE = 1_000_003


#: ASCII characters that a word is compared without (all but letters, digits and blanks).
_DROPPED = bytes(c for c in range(128) if not chr(c).isalnum() and chr(c) not in "\t\n\x0b\x0c\r ")


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of a text's words without case and ASCII punctuation; none is 0, which stands for a gap."""
    h = word_hashes(utf8((text or "").lower()).translate(None, _DROPPED))
    return np.maximum(h, np.uint64(1))


def greedy_tiles(p: list[int], t: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in p, place in t, length) of two sequences by running Karp-Rabin; words 0 never match."""
    used_p, used_t = [x == 0 for x in p], [x == 0 for x in t]
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(p), 20))
    while True:
        found = _scan(p, t, used_p, used_t, size)
        longest = max((n for _, _, n in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        for i, j, n in sorted(found, key=lambda x: (-x[2], x[0], x[1])):
            if not any(used_p[i : i + n]) and not any(used_t[j : j + n]):
                used_p[i : i + n], used_t[j : j + n] = [True] * n, [True] * n
                tiles.append((i, j, n))
        if size > 2 * least:
            size //= 2
        elif size > least:
            size = least
        elif not any(not any(used_p[i : i + n]) and not any(used_t[j : j + n]) for i, j, n in _scan(p, t, used_p, used_t, least)):
            return sorted(tiles)


def _rolling(s: list[int], used: list[bool], size: int):
    """(place, Karp-Rabin hash) of every window of unmarked words."""
    top = pow(_BASE, size - 1, _PRIME)
    h = run = 0
    for i, x in enumerate(s):
        if used[i]:
            h = run = 0
            continue
        if run >= size:
            h = (h - s[i - size] * top) % _PRIME
        h = (h * _BASE + x) % _PRIME
        run += 1
        if run >= size:
            yield i - size + 1, h


def _scan(p: list[int], t: list[int], used_p: list[bool], used_t: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Common unmarked runs of at least `size` words, drawn out to their full length."""
    places: dict[int, list[int]] = {}
    for j, h in _rolling(t, used_t, size):
        places.setdefault(h, []).append(j)
    out, reach = [], {}
    for i, h in _rolling(p, used_p, size):
        for j in places.get(h, ()):
            if reach.get(j - i, -1) >= i + size or p[i : i + size] != t[j : j + size]:
                continue  # inside a run that was found further left, or a clash of hashes
            n = size
            while i + n < len(p) and j + n < len(t) and not used_p[i + n] and not used_t[j + n] and p[i + n] == t[j + n]:
                n += 1
            reach[j - i] = i + n
            out.append((i, j, n))
    return out


def _seeds_of_items(items: DataFrame, item_id: str, text: str, least: int) -> DataFrame:
    """item_id, a key of its own (of id and words), words and distinct seeds of each item that has a word."""
    def run(cols: dict) -> dict:
        got = [plain_words(t) for t in cols["text"]]
        seeds = [np.unique(window_hashes(w, min(least, max(len(w), 1)))).view(np.int64).tolist() for w in got]
        keys = [hashlib.md5(f"{i}:".encode() + w.tobytes()).digest() for i, w in zip(cols["item_id"], got)]
        return {"item_id": cols["item_id"], "item_key": keys, "n_words": [len(w) for w in got], "words": [w.view(np.int64).tolist() for w in got], "seeds": seeds}

    pick = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).dropDuplicates()
    found = map_columns(pick, run, "item_id long, item_key binary, n_words int, words array<long>, seeds array<long>").where(F.size("seeds") > 0)
    return cut(found.dropDuplicates(["item_key"]))


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bytes of a bitmap of BITS bits with the bit of every seed; at most BITS / 8 bytes come to the driver."""
    bit = F.pmod(F.col("seed"), F.lit(BITS)).cast("long")
    parts = seeds.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(BITS // 8 + 4096, np.uint8)
    for r in parts.collect():
        # bits are numbered from 0 in buckets whose numbers begin at 1 for positive values and at 0 for value 0
        at = max(r.b - 1, 0) * 4096
        out[at : at + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return out


def _position(seeds: np.ndarray) -> np.ndarray:
    """Place of a seed's bit in the bitmap, as Spark's functions number it."""
    v = seeds.view(np.int64) & (BITS - 1)  # as pmod, BITS being a power of two
    return v - (v > 0)


def _stretches(docs: DataFrame, doc_id: str, text: str, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """Of each document with a possible seed: its stretches of words (0 between two), their places, and the seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    def run(cols: dict) -> dict:
        out: dict[str, list[Any]] = {"doc_id": [], "key": [], "words": [], "at": [], "seeds": []}
        table = shared.value
        for i, t in zip(cols["doc_id"], cols["text"]):
            w = plain_words(t)
            edge, seeds = np.zeros(len(w) + 1, np.int64), []
            for k in sizes:
                if k < MIN_ITEM and len(w) != k:
                    continue
                h = window_hashes(w, k)
                if len(h):
                    p = _position(h)
                    hit = np.flatnonzero(table[p >> 3] >> (p & 7).astype(np.uint8) & 1)
                    edge[hit] += 1
                    edge[hit + k] -= 1
                    seeds.append(h[hit])
            covered = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            if not len(covered):
                continue
            gaps = np.flatnonzero(np.diff(covered) > 1) + 1
            kept, places = np.insert(w[covered], gaps, 0), np.insert(covered, gaps, -1)
            out["doc_id"].append(i)
            out["key"].append(hashlib.md5(kept.tobytes()).digest())
            out["words"].append(kept.view(np.int64).tolist())
            out["at"].append(places.tolist())
            out["seeds"].append(np.unique(np.concatenate(seeds)).view(np.int64).tolist())
        return out

    pick = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(map_columns(pick, run, "doc_id long, key binary, words array<long>, at array<long>, seeds array<long>"))


def _tile(pairs: DataFrame, least: int) -> DataFrame:
    """Covered words and tiles of (stretches, item) pairs."""

    def run(cols: dict) -> dict:
        out: dict[str, list[Any]] = {"key": cols["key"], "item_id": cols["item_id"], "item_words": [len(x) for x in cols["item"]], "tiles": []}
        for item, words in zip(cols["item"], cols["words"]):
            tiles = greedy_tiles(item, words, min(least, len(item)))
            out["tiles"].append([{"item_at": i, "at": j, "length": n} for i, j, n in tiles])
        return out | {"covered": [sum(x["length"] for x in t) for t in out["tiles"]]}

    return map_columns(pairs.select("key", "item_id", "item", "words"), run, "key binary, item_id long, item_words long, covered long, tiles array<struct<item_at:long,at:long,length:long>>")


def find_contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """A row for each contaminated document and item: covered words, coverage, tiles with their word places in the document."""
    bench = _seeds_of_items(items, item_id, item_text, least)
    sizes = sorted(r[0] for r in bench.select(F.least("n_words", F.lit(least))).distinct().collect())
    seeds = bench.select("item_key", F.explode("seeds").alias("seed"))
    hits = _stretches(docs, doc_id, text, _bitmap(seeds), sizes)
    once = hits.dropDuplicates(["key"]).select("key", "words", "seeds")
    pairs = once.select("key", F.explode("seeds").alias("seed")).join(seeds, "seed").select("key", "item_key").distinct()
    pairs = pairs.join(once.select("key", "words"), "key").join(bench.select("item_key", "item_id", F.col("words").alias("item")), "item_key")
    tiled = _tile(pairs, least).withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= coverage)
    found = hits.select("doc_id", "key", "at").join(cut(tiled), "key")
    places = F.transform("tiles", lambda t: F.struct(t["item_at"].alias("item_at"), F.element_at("at", (t["at"] + 1).cast("int")).alias("word"), t["length"].alias("length")))
    return found.select("doc_id", "item_id", "item_words", "covered", F.round("coverage", 6).alias("coverage"), places.alias("tiles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **how: Any) -> DataFrame:
    """The documents that no item contaminates, as they are; rows with a null id go by their text alone."""
    row = fresh(docs, "row")
    marked = docs.withColumn(row, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
    bad = cut(find_contamination(marked, items, doc_id=row, **how).select(F.col("doc_id").alias(row)).distinct())
    if bad.count() <= BROADCAST_ROWS:  # then the texts stay where they are
        bad = F.broadcast(bad)
    return marked.join(bad, row, "left_anti").select(*docs.columns)
