"""Random forest for squared error whose work and traffic follow the rows, not the nodes.

A deep tree has about as many nodes as rows, so a histogram for every node, added up over all tasks, costs far more than the rows
themselves, and a pass over all rows costs much even for the last large node. Here only nodes of more than ``LOCAL`` bagged rows are split by summed histograms, all trees in the same passes over the binned,
packed rows. The rows of the smaller nodes are then dealt by (tree, node), each such node is grown to its end in a task, and its
subtree is written. A forest of many rows has as many nodes; the driver holds those above ``LOCAL`` rows only.

For predictions the rows meet the subtrees by (tree, node) in the same way, and the values of a row are added by the block it came in.
Bags are Poisson(1) draws from a hash of the row and the tree; features are cut at ``BINS`` - 1 quantiles, as the boosted trees' are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import finite
from ..session import discard, materialise
from .boosting import BINS, ROWS, TRAIN, Block, Table, binned, by_feature, code, filled, rows_of, shared, uniform
from .encode import Encoder

#: Bagged rows of a node that one task grows to the end: some 100 MB there at 14 features.
LOCAL = 1 << 20
#: Bytes of routed rows and subtrees that a task of a prediction reads, about, and most tasks that grow nodes.
TASK_BYTES, GROWERS = 64 << 20, 2000
#: Histograms or subtrees of one record batch.
BATCH = 256
#: Chances of at most 0, 1, ... draws of a row.
POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(20)])
SUBTREE = "key bigint, feature binary, cut binary, below binary, value binary"


@dataclass
class Top:
    """The nodes of a tree above the dealt ones. The children of node i are ``below[i]`` (bin at most ``cut[i]``) and the next."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    below: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    dealt: list[bool] = field(default_factory=lambda: [False])
    open: list[int] = field(default_factory=lambda: [0])

    def child(self, n: float, s: float, depth: int, most: int) -> int:
        at = len(self.feature)
        small = n <= LOCAL
        for column, v in ((self.feature, -1), (self.cut, 0), (self.below, 0), (self.value, s / n), (self.depth, depth)):
            column.append(v)
        self.dealt.append(small and depth < most)
        if not small and depth < most:
            self.open.append(at)
        return at

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut), np.array(self.below)


def walked(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, below: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The node in which each row of ``x`` (feature, row) ends, or each of some rows."""
    if rows is None:
        rows = np.arange(x.shape[1])
    flat, wide = np.ascontiguousarray(x).reshape(-1), x.shape[1]
    node, here, place = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
    while len(rows):
        f = feature.take(here).astype(np.int64)
        inner = f >= 0
        if not inner.all():
            ended = ~inner
            node[place[ended]] = here[ended]
            rows, here, f, place = rows[inner], here[inner], f[inner], place[inner]
        here = below.take(here) + (flat.take(f * wide + rows) > cut.take(here))
    return node


def bagged(hashes: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row."""
    u, out = uniform(hashes, seed, tree), np.zeros(len(hashes), np.uint8)
    for chance in POISSON:
        more = u >= chance
        if not more.any():
            break
        out += more
    return out


def node_rows(block: Block, tops: Sequence[Top], seed: int, trees: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By tree, for some trees: the rows in its bag, their label, draws and top node."""
    known, bins = np.isfinite(block.labels[0]), block.bins(0).T
    for t in trees:
        w = bagged(block.hashes, seed, t)
        rows = np.flatnonzero(known & (w > 0))
        yield t, rows, block.labels[0][rows], w[rows], walked(bins, *tops[t].arrays(), rows)


def level_splits(table: Table, tops: Sequence[Top], seed: int, min_leaf: int, tasks: int) -> dict[tuple[int, int], tuple]:
    """By tree and open node: gain, feature, cut, draws and sum of the left child and of the node. The driver gets one split a node."""
    widths = [len(e) for e in table.edges]
    width, radix = widths[0], [len(e) + 1 for e in table.edges[0]]
    growing = [t for t, top in enumerate(tops) if top.open]
    groups = shared(radix) if max(len(top.open) for top in tops) <= 16 else shared(radix, 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for block in rows_of(batches, widths):
            codes = [code(block.bins(0).T, group, radix) for group in groups]
            for t, rows, y, w, node in node_rows(block, tops, seed, growing):
                k = len(tops[t].open)
                place = np.full(len(tops[t].feature), -1)
                place[tops[t].open] = np.arange(k)
                place = place[node]
                here = np.flatnonzero(place >= 0)
                if not len(here):
                    continue
                rows, slot, weight = rows[here], place[here], w[here].astype(float)
                away, both = weight * y[here], np.zeros((2, width, k, BINS))
                for group, own in zip(groups, codes):
                    size = int(np.prod([radix[f] for f in group]))
                    at = slot * size + own[rows]
                    for kind, v in enumerate((weight, away)):
                        for f, sums in by_feature(np.bincount(at, v, k * size).reshape(k, size), group, radix):
                            both[kind, f, :, :radix[f]] = sums
                total[t] = total[t] + both if t in total else both
        found = [(t << 32 | n, both[:, :, i].tobytes()) for t, both in total.items() for i, n in enumerate(tops[t].open)]
        for i in range(0, len(found), BATCH):
            keys, blobs = zip(*found[i:i + BATCH])
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = np.frombuffer(blob)
                total[key] = total[key] + value if key in total else value
        out = []
        for key, value in total.items():
            n, s = value.reshape(2, width, BINS)
            left_n, left_s = n.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
            all_n, all_s = n[0].sum(), s[0].sum()
            right_n, right_s = all_n - left_n, all_s - left_s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left_s**2 / left_n + right_s**2 / right_n - all_s**2 / all_n
            gain = np.where((left_n >= min_leaf) & (right_n >= min_leaf), gain, -1.0)
            noise = 1e-12 * all_s**2 / all_n
            f, b = np.unravel_index((gain >= gain.max() - noise).argmax(), gain.shape)  # the first of equals, whatever the order of adding
            real = gain[f, b] > noise
            out.append((key, float(gain[f, b]) if real else -1.0, int(f), int(b), float(left_n[f, b]), float(left_s[f, b]), float(all_n), float(all_s)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "gain", "f", "b", "ln", "ls", "n", "s"])

    sums = table.blocks.mapInArrow(add, "key bigint, blob binary").repartition(tasks, "key")
    found = sums.mapInArrow(best, "key bigint, gain double, f bigint, b bigint, ln double, ls double, n double, s double").collect()
    return {(r["key"] >> 32, r["key"] & 0xFFFFFFFF): tuple(r)[1:] for r in found}


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Feature, cut, first child and value of the nodes of a tree on the rows of ``x`` (feature, row), level after level.

    While a level has few nodes for its rows their bins are counted; later its rows are sorted by (node, bin) once a feature, so that
    a level costs its rows whatever the number of its nodes.
    """
    radix = [int(own.max(initial=0)) + 1 for own in x]
    least = max(min_leaf, 1)
    levels: list[tuple[np.ndarray, ...]] = []
    node, nodes, ahead = np.zeros(len(y), np.int64), 1, 1
    w = w.astype(float)
    while nodes:
        n = np.bincount(node, w, nodes)
        mean = np.bincount(node, w * y, nodes) / n
        away = w * (y - mean[node])
        spread = np.bincount(node, away * (y - mean[node]), nodes)
        gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        if len(levels) < depth:
            before_n = np.cumsum(n) - n
            rest = np.bincount(node, away, nodes)
            before_s = np.cumsum(rest) - rest
            narrow = node.astype(np.int32) * np.int32(BINS)
            for f, r in enumerate(radix):
                if nodes * r <= 2 * len(y):
                    slot = node * r + x[f]
                    left = np.bincount(slot, w, nodes * r).reshape(nodes, r).cumsum(1)[:, :-1]
                    total = np.bincount(slot, away, nodes * r).reshape(nodes, r).cumsum(1)[:, :-1]
                    if r == 1:
                        continue
                    right = n[:, None] - left
                    own = np.where((left >= least) & (right >= least), total**2 / np.maximum(left, 1) + total**2 / np.maximum(right, 1), -1.0)
                    top = own.max(1)
                    chosen = np.flatnonzero(top > gain * (1 + 1e-9))
                    first = (own[chosen] >= top[chosen, None] * (1 - 1e-9)).argmax(1)  # the first of equal cuts
                    gain[chosen], feature[chosen], cut[chosen] = top[chosen], f, first
                    continue
                key = narrow + x[f]
                order = np.argsort(key)
                key = key[order]
                of = key // BINS
                end = np.flatnonzero((key[1:] != key[:-1]) & (of[1:] == of[:-1]))
                if not len(end):
                    continue
                at = of[end]
                left, total = np.cumsum(w[order])[end] - before_n[at], np.cumsum(away[order])[end] - before_s[at]
                right = n[at] - left
                fine = (left >= min_leaf) & (right >= min_leaf)
                own = np.where(fine, total**2 / left + total**2 / np.maximum(right, 1), -1.0)
                first = np.flatnonzero(np.diff(at, prepend=-1))
                top = np.maximum.reduceat(own, first)
                high = np.flatnonzero(own >= np.repeat(top, np.diff(first, append=len(at))) * (1 - np.sign(own) * 1e-9))
                high = high[np.diff(at[high], prepend=-1) > 0]  # the first of equal cuts
                better = top > gain[at[first]] * (1 + 1e-9)
                chosen = at[first][better]
                gain[chosen], feature[chosen], cut[chosen] = top[better], f, key[end[high[better]]] % BINS
        split = (gain > 1e-9 * spread) & (spread > 1e-18 * n * np.maximum(mean**2, 1e-300))
        feature = np.where(split, feature, -1)
        below = ahead + 2 * (np.cumsum(split) - split)
        levels.append((feature.astype(np.int16), cut.astype(np.uint8), np.where(split, below, 0).astype(np.int32), mean))
        rows = np.flatnonzero(split[node])
        x, y, w, node = x[:, rows], y[rows], w[rows], node[rows]
        node = below[node] - ahead + (x[feature[node], np.arange(len(rows))] > cut[node])
        nodes = 2 * int(split.sum())
        ahead += nodes
    return tuple(np.concatenate(c) for c in zip(*levels))


@dataclass(frozen=True, eq=False)
class Forest:
    """The nodes above ``LOCAL`` rows of every tree, and the written subtrees of the others by (tree, node)."""

    tops: list[Top]
    subtrees: DataFrame
    edges: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.tops)

    def predict(self, df: DataFrame, encoder: Encoder, output: str) -> DataFrame:
        """``df`` with the mean over all trees. The rows are written once under a number of their own, as they may repeat."""
        rows = materialise(df.drop(output).withColumn("__row", F.monotonically_increasing_id()), "rows")
        sums = self._sums(encoder.with_array(rows, "__x").select("__row", "__x"), rows.count())
        return rows.join(sums, "__row").withColumn(output, F.col("__sum") / F.lit(float(len(self)))).drop("__row", "__sum")

    def partitions(self, rows: int) -> tuple[int, int]:
        """Tasks that walk the subtrees and tasks that add up: as many as the bytes of both ask for, whatever the session's number."""
        least = int(self.subtrees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        nodes = self.subtrees.agg(F.sum(F.octet_length("cut"))).first()[0] or 0
        routed = rows * len(self)
        return tuple(max(least, -(-b // TASK_BYTES)) for b in (nodes * 15 + routed * (len(self.edges) + 4), routed * 12))

    def _sums(self, encoded: DataFrame, n: int) -> DataFrame:
        walkers, adders = self.partitions(n)
        tops = [(*t.arrays(), np.array(t.value), np.array(t.dealt)) for t in self.tops]
        edges, width = self.edges, len(self.edges)
        kinds = "key bigint, block bigint, rows binary, x binary, value binary"

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filled(batches):
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    ids = part.column(0).to_numpy()
                    raw = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
                    x = np.stack([np.searchsorted(cut, raw[:, f]) for f, cut in enumerate(edges)]).astype(np.uint8)
                    known, found = np.zeros(len(ids)), []
                    for t, (feature, cut, below, value, dealt) in enumerate(tops):
                        node = walked(x, feature, cut, below)
                        known += np.where(dealt[node], 0.0, value[node])
                        order = np.argsort(node, kind="stable")
                        for at in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                            if dealt[node[at[0]]]:
                                found.append((t << 32 | int(node[at[0]]), int(ids[0]), at.astype(np.uint32).tobytes(), x[:, at].tobytes(), None))
                    found.append((-1 - int(ids[0]), int(ids[0]), ids.tobytes(), None, known.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), types)], names)

        names, types = ["key", "block", "rows", "x", "value"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for batch in batches:
                found = []
                for key, block, rows, x, value, *nodes in zip(*(c.to_pylist() for c in batch.columns)):
                    if nodes[0] is not None:
                        tree = opened(nodes, value)
                    elif x is None:
                        found.append((block, True, rows, value))
                    else:
                        feature, cut, below, leaf = tree
                        ends = walked(np.frombuffer(x, np.uint8).reshape(width, -1), feature, cut, below)
                        found.append((block, False, rows, leaf[ends].tobytes()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["block", "whole", "rows", "value"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = total = None
            for batch in batches:
                for _, whole, rows, value in zip(*(c.to_pylist() for c in batch.columns)):
                    if whole:  # the first record of a block
                        if ids is not None:
                            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["__row", "__sum"])
                        ids, total = np.frombuffer(rows, np.int64), np.frombuffer(value).copy()
                    else:
                        total[np.frombuffer(rows, np.uint32)] += np.frombuffer(value)
            if ids is not None:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["__row", "__sum"])

        routed = encoded.mapInArrow(route, kinds)
        both = routed.unionByName(self.subtrees, allowMissingColumns=True).select("key", "block", "rows", "x", "value", "feature", "cut", "below")
        ended = both.repartition(walkers, "key").sortWithinPartitions("key", F.col("feature").isNull()).mapInArrow(
            finish, "block bigint, whole boolean, rows binary, value binary")
        return ended.repartition(adders, "block").sortWithinPartitions("block", F.col("whole").desc(), "value").mapInArrow(add, "__row bigint, __sum double")


def opened(nodes: Sequence[bytes], value: bytes) -> tuple[np.ndarray, ...]:
    return (*(np.frombuffer(b, k) for b, k in zip(nodes, (np.int16, np.uint8, np.int32))), np.frombuffer(value))


def fit(train: DataFrame, encoder: Encoder, label: str, row: Column, seed: int, trees: int, min_leaf: int, depth: int) -> Forest:
    """``row``: a hash that tells rows apart. Rows without a label are left out."""
    y = finite(label)
    table = binned(train, row, [encoder], [F.lit(True)], [y], [F.when(y.isNotNull(), TRAIN).otherwise(0)])
    spark = train.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tops = [Top() for _ in range(trees)]
    if table.hash_bytes <= 8 * LOCAL // 2:  # a bag may be somewhat larger than the table
        for top in tops:
            top.open, top.dealt = [], [True]
    while any(top.open for top in tops):
        found = level_splits(table, tops, seed, min_leaf, tasks)
        for t, top in enumerate(tops):
            now, top.open = top.open, []
            for node in now:
                if (t, node) not in found:
                    continue  # an empty bag
                gain, f, b, left_n, left_s, n, s = found[t, node]
                top.value[node] = s / n
                if gain <= 0 or top.depth[node] >= depth:
                    continue
                top.feature[node], top.cut[node] = f, b
                top.below[node] = top.child(left_n, left_s, top.depth[node] + 1, depth)
                top.child(n - left_n, s - left_s, top.depth[node] + 1, depth)
    widths = [len(e) for e in table.edges]
    kept = [(t, np.array(top.dealt)) for t, top in enumerate(tops)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_of(batches, widths):
            x = block.bins(0).T
            for t, rows, label, w, node in node_rows(block, tops, seed, some):
                order = np.argsort(node, kind="stable")
                found = []
                for at in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    if len(at) and kept[t][1][node[at[0]]]:
                        key = t << 32 | int(node[at[0]])
                        found.append((place[key], key, x.take(rows[at], 1).tobytes(), label[at].tobytes(), w[at].tobytes()))
                if found:
                    columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.int64(), *[pa.binary()] * 3))]
                    yield pa.RecordBatch.from_arrays(columns, ["place", "key", "x", "y", "w"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: int, parts: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
            x, y, w = zip(*parts)
            nodes = grown(np.concatenate([np.frombuffer(b, np.uint8).reshape(widths[0], -1) for b in x], 1), np.frombuffer(b"".join(y)),
                          np.frombuffer(b"".join(w), np.uint8), depth - tops[key >> 32].depth[key & 0xFFFFFFFF], min_leaf)
            return pa.RecordBatch.from_arrays([pa.array([key]), *[pa.array([c.tobytes()]) for c in nodes]], ["key", "feature", "cut", "below", "value"])

        last, parts = None, []
        for batch in batches:
            for key, *part in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if key != last and parts:
                    yield done(last, parts)
                    parts = []
                last = key
                parts.append(part)
        if parts:
            yield done(last, parts)

    nodes = [t << 32 | int(n) for t, dealt in kept for n in np.flatnonzero(dealt)]
    partitions = max(1, min(len(nodes), max(GROWERS, 4 * max(tasks, spark.sparkContext.defaultParallelism))))
    some = [t for t, dealt in kept if dealt.any()]
    place = {key: i % partitions for i, key in enumerate(nodes)}  # no task gets many nodes while others get none
    dealt = table.blocks.mapInArrow(deal, "place int, key bigint, x binary, y binary, w binary")
    by_node = dealt.repartitionById(partitions, F.col("place")).sortWithinPartitions("key", "y", "x")
    subtrees = materialise(by_node.mapInArrow(finish, SUBTREE), "forest")
    discard(table.blocks)
    there = {r["key"] for r in subtrees.select("key").collect()}  # nodes that were dealt
    bare = [t for t, top in enumerate(tops) if top.dealt[0] and t << 32 not in there]
    if bare:  # no row of a tiny table was drawn
        mean = train.agg(F.avg(y)).first()[0]
        if mean is None:
            raise ValueError("a forest has no training row with a label")
        for t in bare:
            tops[t].dealt, tops[t].value = [False], [mean]
    return Forest(tops, subtrees, table.edges[0])
