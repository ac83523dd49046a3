"""Benchmark decontamination: SimHash of item-sized windows, Hamming search by blocks, exact weighted check.

Documents and items are sequences of words (PLAIN, A-Z lowered) and multisets of their 5-word shingles. A shingle weighs the
bytes of its words, so runs of very short words say little. The similarity of a window and an item is
the sum of the smaller weights over the sum of the larger. A document is contaminated by an item of n words if some window of
n words has a SimHash within ``radius`` bits of the item's and a similarity of at least the threshold. A document of fewer than
n words is one window.

1. The benchmark is read in blocks of bounded size: per item its shingles, weights and 64-bit SimHash.
2. A window without any shingle of an item has similarity 0 with it. So one vectorised pass marks the places of a document
   that hold a benchmark shingle, and windows are fingerprinted around these places, for the sizes of the items met.
3. Fingerprints are cut into 8 blocks of 8 bits. Two fingerprints within the radius differ in at most radius // 8 bits in some
   block, so looking up every block value with all its neighbours at that distance misses none. Survivors are compared in full.
4. Candidates are verified with the exact shingles and weights.

At 0.8 similarity two fingerprints differ in about 10 of 64 bits; the default radius of 20 keeps all but about one in a
thousand of such windows, and the blocks still spare most comparisons.

An item of fewer than 5 words is one shingle, its whole sequence: it is found where its words stand consecutively. Items without a
word match nothing. Null or empty texts are clean. Repeated rows and equal items
each give their own result. An empty benchmark leaves every document clean; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import arrow_batches

K = 5
THRESHOLD = 0.8
RADIUS = 20
BLOCKS, BITS = 8, 8
#: Bytes of item text in one block of the benchmark; a block is what a task holds. 16 MB of text make about 60 MB of index.
BLOCK_BYTES = 16 << 20

HITS = "doc_id long, text_hash long, item_id long, start long, length long, distance int, similarity double"


class Index(NamedTuple):
    """A block of the benchmark. Items in order of their size."""
    ids: np.ndarray
    size: np.ndarray          # words
    fingerprint: np.ndarray
    shingle: np.ndarray       # all shingles, sorted, and the item of each
    item: np.ndarray
    sets: list[tuple[np.ndarray, np.ndarray]]  # per item: distinct shingles, weights


def weighted(found: W.Words, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, first word) of all runs of k words within a unit."""
    shingle = W.shingles(found.hash, k)
    size = np.concatenate(([0], np.cumsum(found.end - found.start)))
    weight = (size[k:] - size[:-k]) if len(shingle) else size[:0]
    inside = found.unit[:len(shingle)] == found.unit[k - 1:] if len(shingle) else np.zeros(0, bool)
    return shingle[inside], weight[inside], np.flatnonzero(inside)


def planes(shingle: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit of each shingle."""
    bits = (shingle[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return bits.astype(np.int8) * 2 - 1


def packed(sign: np.ndarray) -> np.ndarray:
    return (sign.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(-1, dtype=np.uint64)


def window_fingerprints(shingle: np.ndarray, weight: np.ndarray, windows: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the windows of n shingles that start at ``windows``, from running sums of the bit planes."""
    total = np.zeros((len(shingle) + 1, 64), np.int64)
    np.cumsum(planes(shingle) * weight[:, None], axis=0, out=total[1:])
    return packed(total[windows + n] - total[windows] > 0)


def multiset(shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, inverse = np.unique(shingle, return_inverse=True)
    return value, np.bincount(inverse, weight, len(value))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    return low / (float(a[1].sum() + b[1].sum()) - low)


def build(ids: list[int], texts: list[str]) -> Index:
    rows = []
    for a, b, data, bounds in W.slices(pa.array(texts, pa.string())):
        found = W.words(data, bounds)
        edge = np.searchsorted(found.unit, np.arange(b - a + 1))
        for i, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            if hi > lo:
                shingle, weight, _ = weighted(W.Words(*(x[lo:hi] for x in found)), min(K, hi - lo))
                rows.append((ids[a + i], hi - lo, shingle, weight))
    rows.sort(key=lambda r: (r[1], r[0]))
    sets = [multiset(s, w) for _, _, s, w in rows]
    prints = [window_fingerprints(s, w, np.array([0]), len(s))[0] for _, _, s, w in rows]
    every = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets]) if sets else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    return Index(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64),
                 np.array(prints, np.uint64), every[order], item[order], sets)


def neighbours(value: int, distance: int) -> Iterator[int]:
    for d in range(min(distance, BITS) + 1):
        for flip in combinations(range(BITS), d):
            yield value ^ sum(1 << b for b in flip)


class HammingBlocks:
    """Multi-index over fingerprints: every fingerprint within ``radius`` of a query is found."""

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.fingerprints, self.radius = fingerprints, radius
        self.tables: list[dict[int, list[int]]] = []
        for b in range(BLOCKS):
            table: dict[int, list[int]] = {}
            for i, f in enumerate(fingerprints.tolist()):
                table.setdefault(f >> (b * BITS) & 0xFF, []).append(i)
            self.tables.append(table)
        self.near = {v: list(neighbours(v, radius // BLOCKS)) for v in range(1 << BITS)}

    def within(self, fingerprint: int) -> list[tuple[int, int]]:
        """(position, distance) of the stored fingerprints within the radius."""
        found: set[int] = set()
        for b, table in enumerate(self.tables):
            for v in self.near[fingerprint >> (b * BITS) & 0xFF]:
                found.update(table.get(v, ()))
        out = []
        for i in sorted(found):
            d = (fingerprint ^ int(self.fingerprints[i])).bit_count()
            if d <= self.radius:
                out.append((i, d))
        return out


def matches(shingle: np.ndarray, weight: np.ndarray, index: Index, by_size: dict, threshold: float, k: int = K) -> list[tuple]:
    """(item position, start, distance, similarity) of the best window of each item found in one document's shingles.

    The document's shingles are consecutive: the shingle at i is made of the k words from i on. Items of fewer than K words are met
    by shingles of their own size only, the others by those of K words.
    """
    lo, hi = np.searchsorted(index.shingle, shingle, "left"), np.searchsorted(index.shingle, shingle, "right")
    starts: dict[int, set[int]] = {}
    for p in np.flatnonzero(hi > lo).tolist():
        for n in {int(index.size[i]) for i in index.item[lo[p]:hi[p]]}:
            # A document shorter than the window is one window itself.
            if min(n, K) == k:
                starts.setdefault(n, set()).update(range(max(0, p - (n - k)), min(p, max(0, len(shingle) - (n - k + 1))) + 1))
    best: dict[int, tuple] = {}
    for n, found in starts.items():
        begin = np.array(sorted(found), np.int64)
        if not len(begin):
            continue
        first, blocks_of = by_size[n]
        span = min(n - k + 1, len(shingle))
        cuts = np.flatnonzero(np.diff(begin) > span) + 1
        for run in np.split(begin, cuts):  # only the stretch that the windows cover is summed
            lo_, hi_ = int(run[0]), int(run[-1]) + span
            prints = window_fingerprints(shingle[lo_:hi_], weight[lo_:hi_], run - lo_, span)
            for start, fingerprint in zip(run.tolist(), prints.tolist()):
                for i, distance in blocks_of.within(fingerprint):
                    own = multiset(shingle[start:start + span], weight[start:start + span])
                    value = similarity(own, index.sets[first + i])
                    if value >= threshold - 1e-12:
                        key = (-value, start)
                        if first + i not in best or key < best[first + i][0]:
                            best[first + i] = (key, start, distance, value)
    return [(i, start, distance, value) for i, (_, start, distance, value) in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, text: str, ids: str) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of at most BLOCK_BYTES (or one item), read one after another."""
    part_ids, part_texts, size = [], [], 0
    rows = benchmark.select(F.col(ids).cast("long"), F.col(text).cast("string")).where(f"`{text}` is not null")
    for item, value in rows.toLocalIterator():
        if part_ids and size + len(value) > BLOCK_BYTES:
            yield part_ids, part_texts
            part_ids, part_texts, size = [], [], 0
        part_ids.append(item)
        part_texts.append(value)
        size += len(value)
    if part_ids:
        yield part_ids, part_texts


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", ids: str = "doc_id", item_text: str = "text",
         item_ids: str = "item_id", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(HITS): for each row and item that contaminates it, the best window (first word, words)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    # Rows of one id may differ: a row is told by its id and the hash of its text.
    rows = docs.select(F.col(ids).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    out = None
    for block in benchmark_blocks(benchmark, item_text, item_ids):
        items = spark.sparkContext.broadcast(block)

        def scan(batches, items=items):
            index = build(*items.value)
            by_size = {int(n): (int(np.searchsorted(index.size, n)), HammingBlocks(index.fingerprint[index.size == n], radius))
                       for n in np.unique(index.size)}
            sieve = np.zeros(1 << 20, bool)
            sieve[(index.shingle >> np.uint64(44)).astype(np.int64)] = True
            lengths = np.unique(np.minimum(index.size, K)).tolist()
            for batch in batches:
                doc, text_hash = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                found_rows = []
                for a, b, data, bounds in W.slices(batch.column(1)):
                    found = W.words(data, bounds)
                    for k in lengths:
                        every = W.shingles(found.hash, k)
                        maybe = np.flatnonzero(sieve[(every >> np.uint64(44)).astype(np.int64)])
                        if not len(maybe):
                            continue
                        at = np.minimum(np.searchsorted(index.shingle, every[maybe]), len(index.shingle) - 1)
                        maybe = maybe[index.shingle[at] == every[maybe]]
                        for unit in np.unique(found.unit[maybe]).tolist():
                            lo, hi = np.searchsorted(found.unit, [unit, unit + 1])
                            own = W.Words(*(x[lo:hi] for x in found))
                            shingle, weight, _ = weighted(own, k)
                            for i, start, distance, value in matches(shingle, weight, index, by_size, threshold, k):
                                found_rows.append((doc[a + unit], text_hash[a + unit], int(index.ids[i]), start, min(int(index.size[i]), len(own.hash)), distance, value))
                if found_rows:
                    kinds = [pa.int64()] * 5 + [pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found_rows), kinds)],
                                                     [x.split()[0] for x in HITS.split(", ")])

        part = rows.mapInArrow(scan, HITS)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], HITS) if out is None else out


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", ids: str = "doc_id", **settings) -> DataFrame:
    """One row per document id: doc_id, contaminated, item_ids (sorted), max_similarity, spans (item, start, length, similarity)."""
    found = (hits(docs, benchmark, text, ids, **settings)
             .groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
             .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("max_similarity"),
                  F.array_sort(F.collect_set(F.struct("item_id", "start", "length", "similarity"))).alias("spans")))
    every = docs.select(F.col(ids).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))
    return (every.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
            .select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"),
                    F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
                    F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"), "spans"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", ids: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns."""
    bad = hits(docs, benchmark, text, ids, **settings).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    same = docs[ids].cast("long").eqNullSafe(bad["hit_id"]) & (F.xxhash64(docs[text].cast("string")) == bad["hit_hash"])
    return docs.join(bad, same, "left_anti")
