"""Boosted trees for absolute error, many models in the same passes over the rows.

Nested validation fits the same rows dozens of times. Here the rows are encoded and binned once, packed into blocks and written; each
row carries its role (none, train, validation) in every model. A pass over the blocks then serves all models:

- Each level of the trees under construction is one pass. A task sums, for every open node and feature bin, the weights and the
  signs of the residuals; the sums are added and turned into best splits by key (model, group of features) in several tasks.
  The driver gets one split a node and group of features, never a histogram.
- The first level's pass also gives each model's absolute error after the trees so far. A model stops ``patience`` trees after its best
  validation error; nothing is fitted beyond that. Models that have stopped drop out of later passes.
- Trees since the last refresh are applied in the task; every ``REFRESH`` trees the predictions are written with the blocks.

A split reduces the variance of the residuals' signs, which is the gradient of the absolute error. A leaf's value is the learning rate
times mean sign times mean absolute residual: the Newton step for residuals that follow a Laplace law. Sums of signs are whole numbers, so
given the bins (Spark's quantile sketch) splits do not depend on the order of adding. Rows are sampled per tree by a hash.

A pass has a fixed cost, hundreds of trees have as many passes a level. Where the binned rows of every model stay within ``ALONE`` bytes, each model's
rows are dealt to a task of its own instead, which grows the same trees from them without another pass (``fitted_alone``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import number
from ..session import discard, materialise
from .encode import Encoder

BINS = 64
#: Rows of a block, at most, and rows for which a task of its own is worth while.
ROWS, TASK_ROWS = 20_000, 4096
#: Bytes of a block's bins, about: a writer holds a hundred blocks before it looks at their size.
BLOCK_BYTES = 2 << 20
REFRESH = 12
#: Features whose histograms of one model are added in one task.
GROUP = 8
#: Bytes of histograms that the tasks of a level may send to the driver at once; more are added up by key in tasks.
GATHER = 32 << 20
TRAIN, VALIDATION = 1, 2
#: Deepest level whose nodes are all compared with whole columns.
COMPARED = 6
#: Bytes that the rows of a model may take in a task of its own. Models of more rows are fitted in common passes.
ALONE = 384 << 20
#: Rows of such a model that are counted at once, and the values that features counted together may have.
PART, SHARED = 1 << 18, 4096


@dataclass(frozen=True)
class BoostedParams:
    """Settings of one boosted-tree fit (absolute-error loss)."""

    trees: int = 800
    depth: int = 5
    step_size: float = 0.05
    subsample: float = 0.8
    feature_fraction: float = 0.8
    min_instances: int = 1
    min_info_gain: float = 0.0


@dataclass(frozen=True, eq=False)
class BoostedTrees:
    """Trees as heaps: the children of node i are 2i + 1 (value at most the split) and 2i + 2. A leaf has feature -1."""

    start: float
    feature: np.ndarray  # (tree, node)
    split: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.feature)

    def first(self, count: int) -> BoostedTrees:
        return BoostedTrees(self.start, self.feature[:count], self.split[:count], self.value[:count])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Predictions of encoded rows."""
        return self.start + sum(staged(x, self.feature, self.split, self.value), np.zeros(len(x)))

    def column(self, features: str) -> Column:
        """Prediction of an array of encoded features; row-wise, so also on a stream."""

        @F.pandas_udf("double")
        def boosted(x: pd.Series) -> pd.Series:
            return pd.Series(self.raw(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        return boosted(F.col(features))


def staged(x: np.ndarray, feature: np.ndarray, split: np.ndarray, value: np.ndarray) -> Iterator[np.ndarray]:
    """What each tree adds to the rows, one tree after another."""
    columns = np.ascontiguousarray(x.T)
    for f, s, v in zip(feature, split, value):
        levels = (len(f) + 1).bit_length() - 2
        if levels > COMPARED:
            yield v[reached(x, np.arange(len(x)), f, s, len(f))]
            continue
        below = v[:1]
        for level in range(levels):
            first = (1 << level) - 1
            leaf = np.repeat(f[first:2 * first + 1] < 0, 2)  # what lies below a leaf has its value
            below = np.where(leaf, np.repeat(below, 2), v[2 * first + 1:4 * first + 3])
        yield below[landed(columns, f, s, levels)]


def landed(columns: np.ndarray, feature: np.ndarray, split: np.ndarray, level: int) -> np.ndarray:
    """The place of each row among the nodes of a level; below a leaf rows go left. All nodes above are compared with whole
    columns, which for shallow trees takes far less time than to look up each row's own node."""
    kind = int if columns.dtype == np.uint8 else float  # bins are compared with bins
    taken: list[np.ndarray] = []
    place = np.zeros(columns.shape[1], np.uint8)
    for above in range(level):
        nodes = slice((1 << above) - 1, (2 << above) - 1)
        right = [columns[f] > s if f >= 0 else None for f, s in zip(feature[nodes].tolist(), split[nodes].astype(kind).tolist())]
        for way in reversed(taken):
            right = [chosen(way, *right[i:i + 2]) for i in range(0, len(right), 2)]
        taken.append(np.zeros(len(place), bool) if right[0] is None else right[0])
        place = (place << 1) | taken[-1]
    return place.astype(np.intp)


def chosen(way: np.ndarray, left: np.ndarray | None, right: np.ndarray | None) -> np.ndarray | None:
    """``right`` where ``way``, else ``left``; None is False throughout."""
    if left is None:
        return None if right is None else right & way
    return left & ~way if right is None else left ^ ((left ^ right) & way)


def reached(x: np.ndarray, rows: np.ndarray, feature: np.ndarray, split: np.ndarray, most: int) -> np.ndarray:
    """The node in which each row ends, among the first ``most`` of a tree."""
    node = np.zeros(len(x), np.int64)
    while True:
        f = feature[node]
        child = 2 * node + 1 + (x[rows, np.maximum(f, 0)] > split[node])
        move = (f >= 0) & (child < most)
        if not move.any():
            return node
        node = np.where(move, child, node)


@dataclass(frozen=True)
class Model:
    """One of the models fitted together: its features, label, role and settings. Without ``patience`` all trees are fitted."""

    encoding: int
    label: int
    role: int
    params: BoostedParams
    seed: int
    patience: int | None = None


@dataclass
class Fit:
    trees: BoostedTrees
    curve: list[float] = field(default_factory=list)  # validation error after each tree


@dataclass(frozen=True)
class Table:
    """Binned rows in blocks, and what turns bins back into values."""

    blocks: DataFrame
    edges: list[list[np.ndarray]]   # by encoding and feature: upper bounds of the bins but the last
    encoders: list[Encoder]
    keys: tuple[str, ...]
    hash_bytes: int                 # eight a row

    def tasks(self) -> int:
        return max(1, -(-self.hash_bytes // (8 * TASK_ROWS)))

    def few(self, blocks: DataFrame) -> DataFrame:
        """Blocks of a small table in as few tasks as it fills; a table of more blocks than tasks stays as it is."""
        return blocks.coalesce(self.tasks())


BLOCK = "hashes binary, labels binary, weights binary, roles binary, bins array<binary>, keys array<array<string>>, base array<binary>"


def bin_edges(df: DataFrame, encoders: Sequence[Encoder], fitted: Sequence[Column]) -> list[list[np.ndarray]]:
    """Quantiles of the numeric features over the rows that each encoder was fitted on, in one pass; other features are 0 or 1."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    numeric = list(dict.fromkeys(c for encoder in encoders for c in encoder.numeric))
    found: dict[tuple[int, str], list[float]] = {}
    if numeric:
        mine = F.array_compact(F.array(*[F.when(rows, F.lit(e)) for e, rows in enumerate(fitted)]))  # the encoders of a row
        grouped = df.select(F.explode(mine).alias("e"), *[number(c).alias(f"x{i}") for i, c in enumerate(numeric)]).groupBy("e").agg(
            *[F.percentile_approx(f"x{i}", shares, 10 * BINS).alias(f"q{i}") for i in range(len(numeric))])
        found = {(r["e"], c): r[f"q{i}"] for r in grouped.collect() for i, c in enumerate(numeric)}  # BINS numbers an encoder and feature
    out = []
    for e, encoder in enumerate(encoders):
        out.append([])
        for name in encoder.feature_names:
            cuts = found.get((e, name)) if name in encoder.numeric else [0.5]
            out[-1].append(np.unique(np.array(cuts or [0.0], float)))
    return out


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches put together while they stay within ``ROWS`` rows: the work on a block has a fixed part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.num_rows for b in held) + batch.num_rows > ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def raw_rows(df: DataFrame, row: Column, encoders: Sequence[Encoder], labels: Sequence[Column], roles: Sequence[Column],
             keys: Sequence[str] = (), weights: Sequence[Column] | None = None) -> DataFrame:
    """What the tasks that bin rows read. Raw columns reach them once, whatever the number of encoders."""
    numeric = list(dict.fromkeys(c for e in encoders for c in e.numeric))
    texts = list(dict.fromkeys(c for e in encoders for c in e.categorical))
    return df.select(row.cast("bigint").alias("h"), F.array(*[x.cast("double") for x in labels]).alias("y"),
                     F.array(*(weights or [F.lit(1.0)] * len(labels))).cast("array<double>").alias("w"),
                     F.array(*[x.cast("int") for x in roles]).alias("r"),
                     F.array(*[F.col(k).cast("string") for k in keys]).cast("array<string>").alias("k"),
                     F.array(*[encoders[0].checked(c) for c in numeric]).cast("array<double>").alias("x"),
                     F.array(*[F.col(c).cast("string") for c in texts]).cast("array<string>").alias("t"))


def parsed(batches: Iterator[pa.RecordBatch], encoders: Sequence[Encoder], edges: Sequence[Sequence[np.ndarray]], n_labels: int,
           n_roles: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]]:
    """At most ``ROWS`` of the ``raw_rows`` at a time, fewer with many encodings: the batch, labels, weights, roles, and the bins (feature, row) by encoding."""
    numeric = list(dict.fromkeys(c for e in encoders for c in e.numeric))
    texts = list(dict.fromkeys(c for e in encoders for c in e.categorical))
    most = min(ROWS, max(1024, BLOCK_BYTES // max(1, sum(map(len, edges)))))

    def matrix(column: pa.Array, width: int, kind) -> np.ndarray:
        flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind)

    def bins(raw: Mapping[str, np.ndarray]) -> Iterator[np.ndarray]:
        for encoder, own in zip(encoders, edges):
            yield np.stack([np.searchsorted(cut, v) for cut, v in zip(own, encoder.arrays(raw))]).astype(np.uint8)

    for batch in filled(batches):
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            x, text = matrix(part.column(5), len(numeric), float), matrix(part.column(6), len(texts), object)
            raw = {c: x[:, j] for j, c in enumerate(numeric)} | {c: text[:, j] for j, c in enumerate(texts)}
            yield (part, matrix(part.column(1), n_labels, float), matrix(part.column(2), n_labels, float),
                   matrix(part.column(3), n_roles, np.uint8), bins(raw))


def binned(df: DataFrame, row: Column, encoders: Sequence[Encoder], fitted: Sequence[Column], labels: Sequence[Column],
           roles: Sequence[Column], keys: Sequence[str] = (), weights: Sequence[Column] | None = None,
           edges: list[list[np.ndarray]] | None = None) -> Table:
    """The rows of ``df`` packed for fitting. ``row``: a hash that tells rows apart. ``fitted``: by encoder, the rows it was fitted on.
    ``labels`` are doubles, null for a row that a model of the label leaves out; ``roles`` give TRAIN, VALIDATION or another
    number. ``keys`` group the rows in ``scores``."""
    edges = bin_edges(df, encoders, fitted) if edges is None else edges
    n_labels, n_roles, grouped = len(labels), len(roles), bool(keys)
    encoders = list(encoders)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y, w, r, bins in parsed(batches, encoders, edges, n_labels, n_roles):
            named = part.column(4).to_pylist() if grouped else []
            yield pa.RecordBatch.from_pydict({
                "hashes": pa.array([part.column(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                "labels": pa.array([y.T.tobytes()], pa.binary()), "weights": pa.array([w.T.tobytes()], pa.binary()),
                "roles": pa.array([r.T.tobytes()], pa.binary()),
                "bins": pa.array([[x.tobytes() for x in bins]], pa.list_(pa.binary())), "keys": pa.array([named], pa.list_(pa.list_(pa.string()))),
                "base": pa.array([[]], pa.list_(pa.binary()))})

    blocks = materialise(raw_rows(df, row, encoders, labels, roles, keys, weights).mapInArrow(pack, BLOCK), "binned")
    table = Table(blocks, edges, encoders, tuple(keys), blocks.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0)
    wanted = min(table.tasks(), df.sparkSession.sparkContext.defaultParallelism)
    if blocks.rdd.getNumPartitions() >= wanted:
        return table
    spread = materialise(blocks.repartition(wanted), "spread")  # a few large files would keep most cores idle in every pass
    discard(blocks)
    return replace(table, blocks=spread)


class Block:
    """A block's arrays in a task."""

    def __init__(self, row: Sequence, widths: Sequence[int]):
        hashes, labels, weights, roles, bins, self.keys, self.base = row
        self.hashes = np.frombuffer(hashes, np.uint64)
        self.n = len(self.hashes)
        self.labels = np.frombuffer(labels).reshape(-1, self.n)
        self.weights = np.frombuffer(weights).reshape(-1, self.n)
        self.roles = np.frombuffer(roles, np.uint8).reshape(-1, self.n)
        self._bins, self._widths, self._plain = bins, widths, {}

    def bins(self, encoding: int) -> np.ndarray:
        """(row, feature), feature after feature in memory."""
        return np.frombuffer(self._bins[encoding], np.uint8).reshape(self._widths[encoding], self.n).T

    def plain(self, label: int) -> bool:
        """Whether all rows weigh 1."""
        if label not in self._plain:
            self._plain[label] = bool((self.weights[label] == 1).all())
        return self._plain[label]


def rows_of(batches: Iterator[pa.RecordBatch], widths: Sequence[int]) -> Iterator[Block]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield Block(row, widths)


@dataclass
class Growing:
    """A model under construction. Nodes of the present tree are filled level by level."""

    at: int
    model: Model
    start: float
    nodes: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    pending: int = 0          # trees that the blocks' base does not hold yet
    before: int = 0           # trees before those in ``trees``
    curve: list[float] = field(default_factory=list)
    scale: float = 0.0        # mean absolute residual
    feature: np.ndarray | None = None
    split: np.ndarray | None = None
    count: np.ndarray | None = None
    sign: np.ndarray | None = None

    def begin(self) -> None:
        self.feature, self.split = np.full(self.nodes, -1), np.zeros(self.nodes)
        self.count, self.sign = np.zeros(self.nodes), np.zeros(self.nodes)

    def finish(self) -> None:
        step = self.model.params.step_size * float(f"{self.scale:.9g}")
        self.trees.append((self.feature, self.split, step * np.divide(self.sign, self.count, out=np.zeros(self.nodes), where=self.count > 0)))
        self.pending += 1
        self.feature = None

    def best(self) -> int:
        return int(np.argmin(self.curve)) + 1 if self.curve else len(self.trees)

    def done(self) -> bool:
        if len(self.trees) >= self.model.params.trees:
            return True
        return self.model.patience is not None and len(self.curve) - self.best() >= self.model.patience

    def sent(self) -> Growing:
        """What a task needs of it: of its trees only those that the blocks' base does not hold."""
        held = len(self.trees) - self.pending
        return replace(self, trees=self.trees[held:], before=self.before + held, curve=[], count=None, sign=None)

    def chosen_features(self, width: int) -> np.ndarray:
        """Features of the present tree."""
        some = max(1, round(self.model.params.feature_fraction * width))
        rng = np.random.default_rng([self.model.seed & 0xFFFFFFFF, len(self.trees)])
        mask = np.zeros(width, bool)
        mask[rng.choice(width, some, replace=False)] = True
        return mask


def uniform(hashes: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Numbers in [0, 1) by row and tree."""
    x = hashes ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def sampled(hashes: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    if share >= 1:
        return np.ones(len(hashes), bool)
    return uniform(hashes, seed, tree) < share


def predicted(block: Block, g: Growing, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Predictions of some rows by the trees so far; ``x`` holds their bins."""
    held = len(g.trees) - g.pending
    out = np.frombuffer(block.base[g.at])[rows].copy() if g.before + held else np.full(len(rows), g.start)
    recent = g.trees[held:]
    for part in staged(x, *zip(*recent)) if recent else ():
        out += part
    return out


def level_sums(blocks: DataFrame, growing: Sequence[Growing], level: int, widths: Sequence[int]) -> DataFrame:
    """(key, blob): histograms of a level by model and group of features, and at the first level the models' errors (key below 0)."""
    base, wide = (1 << level) - 1, 1 << level
    growing = [g.sent() for g in growing]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors: dict[int, np.ndarray] = {}
        counted: dict[int, np.ndarray] = {}   # (feature, node, sign, bin): rows of weight 1
        weighed: dict[int, np.ndarray] = {}   # (weights or signs, feature, node, bin)

        def add(sums: dict[int, np.ndarray], key: int, value: np.ndarray) -> None:
            if key in sums:
                sums[key] += value
            else:
                sums[key] = value

        for block in rows_of(batches, widths):
            for g in growing:
                m = g.model
                role, y, width = block.roles[m.role], block.labels[m.label], widths[m.encoding]
                known = np.isfinite(y)
                train = (role == TRAIN) & known
                keep = train & sampled(block.hashes, m.seed, g.before + len(g.trees), m.params.subsample)
                seen = keep
                if level == 0:
                    seen = train | ((role == VALIDATION) & known) if m.patience is not None else train
                rows = np.flatnonzero(seen)
                if not len(rows):
                    continue
                x = block.bins(m.encoding).T.take(rows, 1).T
                residual = y[rows] - predicted(block, g, x, rows)
                weight = block.weights[m.label][rows]
                if level == 0:
                    error, fit = np.abs(residual), train[rows]
                    held = ~fit
                    add(errors, -1 - g.at, np.array([(weight * error)[fit].sum(), weight[fit].sum(), error[held].sum(), held.sum()], float))
                    node, here = np.zeros(len(rows), np.intp), keep[rows]
                else:
                    if level > COMPARED:
                        node = reached(x, np.arange(len(x)), g.feature, g.split, base + wide) - base
                    else:
                        node = landed(x.T, g.feature, g.split, level)
                    here = (node >= 0) & (g.feature[np.maximum((node + base - 1) // 2, 0)] >= 0)
                if not here.any():
                    continue
                if not here.all():
                    x, node, residual, weight = x.T.compress(here, 1).T, node[here], residual[here], weight[here]
                sign = np.sign(residual)
                if block.plain(m.label):
                    slot = (node * 3 + sign.astype(np.intp) + 1) * BINS
                    add(counted, g.at, np.stack([np.bincount(slot + x[:, j], minlength=wide * 3 * BINS) for j in range(width)]))
                else:
                    slot = node * BINS
                    add(weighed, g.at, np.stack([[np.bincount(slot + x[:, j], v, wide * BINS) for j in range(width)] for v in (weight, sign * weight)]))
        out = dict(errors)
        for at in counted.keys() | weighed.keys():
            both = 0.0
            if at in counted:
                n = counted[at].reshape(-1, wide, 3, BINS)
                both = np.stack([n.sum(2), n[:, :, 2] - n[:, :, 0]]).astype(float)
            if at in weighed:
                both = both + weighed[at].reshape(2, -1, wide, BINS)
            for group, first in enumerate(range(0, both.shape[1], GROUP)):
                out[at * 4096 + group] = both[:, first:first + GROUP].transpose(0, 2, 1, 3)  # (weights or signs, node, feature, bin)
        if out:
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(out), pa.int64()), "blob": pa.array([v.tobytes() for v in out.values()], pa.binary())})

    return blocks.mapInArrow(read, "key bigint, blob binary")


def node_splits(sums: np.ndarray, mask: np.ndarray, min_instances: int, first: int) -> np.ndarray:
    """(node, 7) gain, feature, bin, weight and sign of the left child and of the node, from (weights or signs, node, feature, bin);
    ``mask``: features of the tree, counted from ``first``."""
    count, sign = sums
    wide = len(count)
    n, s = count[:, :1].sum(2), sign[:, :1].sum(2)
    left_n, left_s = count.cumsum(2)[:, :, :-1], sign.cumsum(2)[:, :, :-1]
    right_n, right_s = n[:, :, None] - left_n, s[:, :, None] - left_s
    least = max(min_instances, 1e-9)
    fine = (left_n >= least) & (right_n >= least) & mask[None, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left_s**2 / left_n + right_s**2 / right_n - (s**2 / n)[:, :, None]) / n[:, :, None]
    gain = np.where(fine, gain, -1.0).reshape(wide, -1)
    pick = gain.argmax(1)
    node, f, b = np.arange(wide), pick // (BINS - 1), pick % (BINS - 1)
    return np.column_stack([gain[node, pick], f + first, b, left_n[node, f, b], left_s[node, f, b], n[:, 0], s[:, 0]])


def best_splits(sums: DataFrame, growing: Sequence[Growing], level: int, widths: Sequence[int], tasks: int,
                senders: int) -> dict[int, np.ndarray]:
    """By key: (node, 7) gain, feature, bin, weight and sign of the left child and of the node; or the summed errors."""
    wide = 1 << level
    by_at = {g.at: g for g in growing}
    masks = {g.at: g.chosen_features(widths[g.model.encoding]) for g in growing}

    def split(key: int, total: np.ndarray) -> np.ndarray:
        g, group = by_at[key // 4096], key % 4096
        mask = masks[g.at][group * GROUP:(group + 1) * GROUP]
        return node_splits(total.reshape(2, wide, len(mask), BINS), mask, g.model.params.min_instances, group * GROUP)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = np.frombuffer(blob)
                total[key] = total[key] + value if key in total else value
        out = {key: value if key < 0 else split(key, value) for key, value in total.items()}
        if out:
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(out), pa.int64()), "blob": pa.array([v.tobytes() for v in out.values()], pa.binary())})

    groups = sum(-(-widths[g.model.encoding] // GROUP) for g in growing)
    if senders * (groups * 16 * wide * GROUP * BINS) <= GATHER:
        batch = sums.toArrow()  # at most GATHER bytes; the same sums, one stage less
        found = [(k, b) for part in read(iter(batch.to_batches())) for k, b in zip(*(c.to_pylist() for c in part.columns))]
    else:
        found = sums.repartition(tasks, "key").mapInArrow(read, "key bigint, blob binary").collect()  # a few numbers a node
    return {key: np.frombuffer(bytes(blob)) if key < 0 else np.frombuffer(bytes(blob)).reshape(-1, 7) for key, blob in found}


def place_splits(g: Growing, found: Mapping[int, np.ndarray], level: int) -> bool:
    """Best splits of the level's nodes over the groups of features; whether any node was split."""
    tables = [t for key, t in sorted(found.items()) if key >= 0 and key // 4096 == g.at]
    if not tables:
        return False
    base, split = (1 << level) - 1, False
    for i in range(1 << level):
        gain, feature, cut, left_n, left_s, n, s = max((t[i] for t in tables), key=lambda r: (r[0], -r[1]))
        if n <= 0:
            continue
        node = base + i
        if level == 0:
            g.count[0], g.sign[0] = n, s
        if gain <= max(g.model.params.min_info_gain, 1e-12):
            continue
        split = True
        g.feature[node], g.split[node] = int(feature), cut
        g.count[2 * node + 1], g.sign[2 * node + 1] = left_n, left_s
        g.count[2 * node + 2], g.sign[2 * node + 2] = n - left_n, s - left_s
    return split


def refreshed(blocks: DataFrame, growing: Sequence[Growing], models: int, widths: Sequence[int]) -> DataFrame:
    """The blocks with the predictions of all trees so far."""
    growing = [g.sent() for g in growing]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                block, base = Block(row, widths), [b""] * models
                every = np.arange(block.n)
                for g in growing:
                    base[g.at] = predicted(block, g, block.bins(g.model.encoding), every).tobytes()
                out.append(base)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.list_(pa.binary()))], batch.schema.names)

    return materialise(blocks.mapInArrow(read, BLOCK), "boosting")


def starts(models: Sequence[Model], df: DataFrame, labels: Sequence[Column], roles: Sequence[Column]) -> tuple[list[float], list[tuple[int, int]]]:
    """Median label of each model's training rows, and how many rows it is trained and validated on."""
    pairs = list(dict.fromkeys((m.role, m.label) for m in models))
    asked = []
    for i, (role, label) in enumerate(pairs):
        known = F.when(~F.isnan(labels[label]), labels[label])
        asked += [F.percentile_approx(F.when(roles[role] == TRAIN, labels[label]), F.lit(0.5), 10_000).alias(f"m{i}"),
                  F.count(F.when(roles[role] == TRAIN, known)).alias(f"t{i}"), F.count(F.when(roles[role] == VALIDATION, known)).alias(f"v{i}")]
    found = df.agg(*asked).first()
    if any(found[f"m{i}"] is None for i in range(len(pairs))):
        raise ValueError("a model has no training row with a label")
    at = [pairs.index((m.role, m.label)) for m in models]
    return [float(found[f"m{i}"]) for i in at], [(found[f"t{i}"], found[f"v{i}"]) for i in at]


def fits_alone(rows: Sequence[tuple[int, int]], models: Sequence[Model], edges: Sequence[Sequence[np.ndarray]]) -> bool:
    """Whether every model's rows fit a task: their bins, what is counted of them, hash, label, prediction and short-lived copies."""
    return all((train + held) * (2 * len(edges[m.encoding]) + 48) <= ALONE for (train, held), m in zip(rows, models))


def shared(radix: Sequence[int], most: int = SHARED) -> list[list[int]]:
    """Neighbouring features that are counted together: their bins have at most ``most`` combinations."""
    groups: list[list[int]] = []
    for f, r in enumerate(radix):
        if groups and r * int(np.prod([radix[g] for g in groups[-1]])) <= most:
            groups[-1].append(f)
        else:
            groups.append([f])
    return groups


def code(x: np.ndarray, group: Sequence[int], radix: Sequence[int]) -> np.ndarray:
    """One number a row for its bins in the features of a group."""
    if len(group) == 1:
        return x[group[0]]
    out = x[group[0]].astype(np.uint16)
    for f in group[1:]:
        out *= np.uint16(radix[f])
        out += x[f]
    return out


def by_feature(found: np.ndarray, group: Sequence[int], radix: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(node, bin) of each feature from the (node, code) of its group."""
    found = found.reshape(len(found), *[radix[f] for f in group])
    for i, f in enumerate(group):
        others = tuple(j + 1 for j in range(len(group)) if j != i)
        yield f, found.sum(others) if others else found


class Alone:
    """The rows of one model in its task, training rows apart from validation rows."""

    def __init__(self, edges: Sequence[np.ndarray], train: int, held: int):
        self.radix = [len(e) + 1 for e in edges]
        self.x, self.held_x = np.empty((len(edges), train), np.uint8), np.empty((len(edges), held), np.uint8)
        self.hashes, self.y, self.held_y = np.empty(train, np.uint64), np.empty(train), np.empty(held)
        self.weights: np.ndarray | None = None
        self.keys: list[pa.Array] = []
        self.train = self.held = 0

    def add(self, hashes: np.ndarray, y: np.ndarray, weights: np.ndarray | None, bins: np.ndarray, keys: pa.Array) -> None:
        """Rows of a batch, those of training first, which alone have hashes."""
        n = len(hashes)
        at, held = slice(self.train, self.train + n), slice(self.held, self.held + len(y) - n)
        x = bins.reshape(len(self.radix), len(y))
        self.x[:, at], self.held_x[:, held] = x[:, :n], x[:, n:]
        self.hashes[at], self.y[at], self.held_y[held] = hashes, y[:n], y[n:]
        if weights is not None:
            if self.weights is None:
                self.weights = np.ones(len(self.y))
            self.weights[at] = weights
        self.keys.append(keys)
        self.train, self.held = at.stop, held.stop

    def sums(self, g: Growing, level: int, state: np.ndarray, codes: Sequence) -> np.ndarray:
        """(weights or signs, node, feature, bin) of a level; ``state``: sign + 1 of the rows in the tree's sample, 3 for others."""
        wide = 1 << level
        if wide * 4 > 64:  # many nodes: tables of features counted together would not stay near the processor
            codes = [([f], self.x[f]) for f in range(len(self.radix))]
        out = np.zeros((2, wide, len(self.radix), BINS))
        total: list = [0] * len(codes)
        for start in range(0, self.train, PART):
            at = slice(start, start + PART)
            slot = state[at].astype(np.intp)
            if level > COMPARED:
                x = self.x[:, at].T
                node = reached(x, np.arange(len(x)), g.feature, g.split, 2 * wide - 1) - (wide - 1)
                slot = np.where(node < 0, 3, slot + 4 * node)
            elif level:
                slot += 4 * landed(self.x[:, at], g.feature, g.split, level)
            for i, (group, own) in enumerate(codes):
                size = int(np.prod([self.radix[f] for f in group]))
                weights = None if self.weights is None else self.weights[at]
                total[i] = total[i] + np.bincount(slot * size + own[at], weights, wide * 4 * size)
        for (group, _), found in zip(codes, total):
            found = found.reshape(wide, 4, -1)
            for kind, part in enumerate((found[:, :3].sum(1), found[:, 2] - found[:, 0])):
                for f, sums in by_feature(part, group, self.radix):
                    out[kind, :, f, :self.radix[f]] = sums
        if level:  # rows below a leaf
            out[:, np.repeat(g.feature[wide // 2 - 1:wide - 1] < 0, 2)] = 0
        return out

    def grow(self, model: Model, start: float) -> Growing:
        """The trees that common passes would give the model."""
        g = Growing(0, model, start, (2 << model.params.depth) - 1)
        predicted, held = np.full(self.train, start), np.full(self.held, start)
        state = np.empty(self.train, np.uint8)
        codes = [(group, code(self.x, group, self.radix)) for group in shared(self.radix, SHARED if self.train > SHARED else 1)]
        weight = float(self.train) if self.weights is None else self.weights.sum()
        while True:
            g.begin()
            total = 0.0
            for first in range(0, self.train, PART):
                at = slice(first, first + PART)
                residual = self.y[at] - predicted[at]
                error = np.abs(residual)
                total += error.sum() if self.weights is None else (self.weights[at] * error).sum()
                own = np.sign(residual).astype(np.int8) + 1
                own[~sampled(self.hashes[at], model.seed, len(g.trees), model.params.subsample)] = 3
                state[at] = own
            g.scale = total / weight if weight else 0.0
            if model.patience is not None and g.trees:
                g.curve.append(float(np.abs(self.held_y - held).sum() / self.held) if self.held else 0.0)
            if g.done():
                return g
            mask = g.chosen_features(len(self.radix))
            for level in range(model.params.depth):
                best = node_splits(self.sums(g, level, state, codes), mask, model.params.min_instances, 0)
                if not place_splits(g, {0: best}, level):
                    break
            g.finish()
            tree = [np.stack([c]) for c in g.trees[-1]]
            for x, out in ((self.x, predicted), (self.held_x, held)):
                for first in range(0, len(out), PART):
                    at = slice(first, first + PART)
                    out[at] += next(staged(x[:, at].T, *tree))


def fitted_alone(raw: DataFrame, encoders: Sequence[Encoder], edges: Sequence[Sequence[np.ndarray]], models: Sequence[Model], n_labels: int, n_roles: int,
                 start: Sequence[float], rows: Sequence[tuple[int, int]], keys: Sequence[str], board: bool) -> tuple[list[Fit], DataFrame | None]:
    """Each model fitted in a task that gets its rows of ``raw_rows``; with ``board`` also what ``scores`` gives at the best tree counts."""
    by_encoding = [[i for i, m in enumerate(models) if m.encoding == e] for e in range(len(encoders))]
    encoders = list(encoders)
    dealt = "model int, hashes binary, labels binary, weights binary, bins binary, keys array<array<string>>"
    kinds = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.list_(pa.string()))]
    none = pa.array([[]], kinds[5])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y, w, r, bins in parsed(batches, encoders, edges, n_labels, n_roles):
            hashes, named = part.column(0).to_numpy(zero_copy_only=False), part.column(4)
            for own, x in zip(by_encoding, bins):
                found, groups = [], []
                for i in own:
                    m = models[i]
                    role, known = r[:, m.role], np.isfinite(y[:, m.label])
                    train = np.flatnonzero((role == TRAIN) & known)
                    held = np.flatnonzero((role == VALIDATION) & known)
                    some = np.concatenate([train, held])
                    if len(some):
                        weights = w[train, m.label]
                        found.append((i, hashes[train].tobytes(), y[some, m.label].tobytes(), None if (weights == 1).all() else weights.tobytes(), x[:, some].tobytes()))
                        groups.append(pa.ListArray.from_arrays([0, len(held)], named.take(pa.array(held)).cast(kinds[5].value_type)) if board else none)
                if found:
                    columns = [*[pa.array(c, k) for c, k in zip(zip(*found), kinds)], pa.concat_arrays(groups)]
                    yield pa.RecordBatch.from_arrays(columns, ["model", "hashes", "labels", "weights", "bins", "keys"])

    out = "model int, feature binary, split binary, value binary, curve binary, truth double, prediction double"
    names = [field.split()[0] for field in out.split(", ")]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for at in range(batch.num_rows):
                hashes, y, weights, bins = (np.frombuffer(b, k) if b is not None else None for b, k in
                                            zip((batch.column(c)[at].as_buffer() for c in range(1, 5)), (np.uint64, float, float, np.uint8)))
                if own is None:
                    i = batch.column(0)[at].as_py()
                    own = Alone(edges[models[i].encoding], *rows[i])
                own.add(hashes, y, weights, bins, batch.column(5)[at].values)
        if own is None:
            return
        g = own.grow(models[i], start[i])
        trees = [np.stack(c) if g.trees else np.zeros((0, 1)) for c in zip(*g.trees)] if g.trees else [np.zeros((0, 1))] * 3
        blank = [pa.array([None], pa.string())] * len(keys)
        yield pa.RecordBatch.from_arrays([
            pa.array([i], pa.int32()), *[pa.array([np.ascontiguousarray(c, k).tobytes()], pa.binary()) for c, k in zip(trees, (np.int16, np.int16, float))],
            pa.array([np.array(g.curve).tobytes()], pa.binary()), pa.array([None], pa.float64()), pa.array([None], pa.float64()), *blank], [*names, *keys])
        if board and own.held:
            best = g.trees[:g.best()]
            n, nothing = own.held, pa.nulls(own.held, pa.binary())
            predicted = start[i] + sum(staged(own.held_x.T, *zip(*best)) if best else (), np.zeros(n))
            grouped = pa.concat_arrays(own.keys).flatten().to_numpy(zero_copy_only=False).reshape(n, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), *[nothing] * 4, pa.array(own.held_y), pa.array(predicted),
                                              *[pa.array(grouped[:, j], pa.string()) for j in range(len(keys))]], [*names, *keys])

    by_model = raw.mapInArrow(deal, dealt).repartitionById(len(models), F.col("model"))
    table = materialise(by_model.mapInArrow(fit, out + "".join(f", `{k}` string" for k in keys)), "alone")
    fits: dict[int, Fit] = {}
    for row in table.filter("feature is not null").select(*names[:5]).collect():  # the trees, one row a model
        m = models[row["model"]]
        nodes = (2 << m.params.depth) - 1
        trees = [np.frombuffer(bytes(row[c]), k).reshape(-1, nodes) for c, k in (("feature", np.int16), ("split", np.int16), ("value", float))]
        g = Growing(0, m, start[row["model"]], nodes, trees=list(zip(*trees)), curve=np.frombuffer(bytes(row["curve"])).tolist())
        fits[row["model"]] = Fit(as_values(g, edges[m.encoding]), g.curve)
    scored = table.filter("feature is null").select("model", "truth", "prediction", *keys) if board else None
    if not board:
        discard(table)
    return [fits[i] for i in range(len(models))], scored


def boost(table: Table, models: Sequence[Model], start: Sequence[float], observe: Callable[[int, int], None] | None = None) -> list[Fit]:
    """Fit all models together. ``observe`` hears the number of trees and of models of each round."""
    widths = [len(e) for e in table.edges]
    spark = table.blocks.sparkSession
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(models) // 8))
    everyone = [Growing(i, m, s, (2 << m.params.depth) - 1) for i, (m, s) in enumerate(zip(models, start))]
    written, blocks, active = table.blocks, table.few(table.blocks), everyone
    senders = blocks.rdd.getNumPartitions()
    while active:
        for g in active:
            g.begin()
        found = best_splits(level_sums(blocks, active, 0, widths), active, 0, widths, tasks, senders)
        still = []
        for g in active:
            total, n, held, m = found[-1 - g.at]
            g.scale = total / n if n else 0.0
            if g.model.patience is not None and g.trees:
                g.curve.append(held / m if m else 0.0)
            if not g.done():
                still.append(g)
        active = still
        if not active:
            break
        if observe:
            observe(len(active[0].trees), len(active))
        growing, level = [g for g in active if place_splits(g, found, 0)], 1
        while growing := [g for g in growing if level < g.model.params.depth]:
            found = best_splits(level_sums(blocks, growing, level, widths), growing, level, widths, tasks, senders)
            growing, level = [g for g in growing if place_splits(g, found, level)], level + 1
        for g in active:
            g.finish()
        if max(g.pending for g in active) >= REFRESH:
            before, written = written, refreshed(blocks, active, len(models), widths)
            blocks = table.few(written)
            senders = blocks.rdd.getNumPartitions()
            for g in active:
                g.pending = 0
            if before is not table.blocks:
                discard(before)
    if written is not table.blocks:
        discard(written)
    return [Fit(as_values(g, table.edges[g.model.encoding]), g.curve) for g in everyone]


def as_values(g: Growing, edges: Sequence[np.ndarray]) -> BoostedTrees:
    """The trees with values instead of bins."""
    feature, cut, value = (np.stack(x) for x in zip(*g.trees)) if g.trees else (np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    split = np.zeros(feature.shape)
    for f in np.unique(feature[feature >= 0]).tolist():
        here = feature == f
        split[here] = edges[f][np.minimum(cut[here].astype(int), len(edges[f]) - 1)]
    return BoostedTrees(g.start, feature.astype(np.int32), split, value)


def scores(table: Table, models: Sequence[Model], fits: Sequence[BoostedTrees]) -> DataFrame:
    """(model, truth, prediction, keys) of the validation rows of all models, in one pass."""
    widths = [len(e) for e in table.edges]
    tops = [[np.append(cut, np.inf) for cut in own] for own in table.edges]
    names = table.keys

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_of(batches, widths):
            for i, (m, trees) in enumerate(zip(models, fits)):
                rows = np.flatnonzero((block.roles[m.role] == VALIDATION) & np.isfinite(block.labels[m.label]))
                if not len(rows):
                    continue
                x = block.bins(m.encoding)[rows]
                # a bin's upper bound goes the way of all its values
                values = np.column_stack([tops[m.encoding][j][x[:, j]] for j in range(x.shape[1])])
                yield pa.RecordBatch.from_pydict({
                    "model": pa.array(np.full(len(rows), i, np.int32)), "truth": pa.array(block.labels[m.label][rows]),
                    "prediction": pa.array(trees.raw(values)),
                    **{k: pa.array([block.keys[r][j] for r in rows.tolist()], pa.string()) for j, k in enumerate(names)}})

    kinds = "".join(f", `{k}` string" for k in names)
    return table.few(table.blocks).mapInArrow(read, f"model int, truth double, prediction double{kinds}")
