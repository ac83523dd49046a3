"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Each tree is grown from at most 256 hash-chosen rows, one small group per tree. Scoring walks all
trees, whose size depends only on the settings, at once over pieces of Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encode import Encoder

EULER_GAMMA = 0.5772156649015329
OFFSET = -0.5
#: Rows walked through all trees at once.
SCORED_AT_ONCE = 512
TREE_SCHEMA = "tree int, feature array<int>, split array<double>, left array<int>, right array<int>, size array<int>"


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def grow(x: np.ndarray, seed: int) -> dict[str, list]:
    """One tree over the given rows as parallel node lists; leaves have feature -1."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes = {"feature": [], "split": [], "left": [], "right": [], "size": []}

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(nodes["size"])
        for name, value in (("feature", -1), ("split", 0.0), ("left", -1), ("right", -1), ("size", len(rows))):
            nodes[name].append(value)
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else ()
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            below = rows[:, f] <= cut
            nodes["feature"][me], nodes["split"][me] = f, cut
            nodes["left"][me] = add(rows[below], depth + 1)
            nodes["right"][me] = add(rows[~below], depth + 1)
        return me

    add(x, 0)
    return nodes


@dataclass(frozen=True)
class Stack:
    """The nodes of all trees in one set of arrays. A leaf is its own child, so every row walks the same number of steps."""

    root: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray  # two a node: at most the split, above it
    path: np.ndarray  # depth of a node and the expected rest below it
    levels: int

    def mean_depth(self, x: np.ndarray) -> np.ndarray:
        """Path length of each row, averaged over the trees."""
        out = np.empty(len(x))
        width = x.shape[1]
        for a in range(0, len(x), SCORED_AT_ONCE):
            part = x[a:a + SCORED_AT_ONCE]
            flat, base = part.ravel(), (np.arange(len(part), dtype=np.int32) * width)[:, None]
            node = np.tile(self.root, (len(part), 1))
            for _ in range(self.levels):
                above = ~(flat[base + self.feature[node]] <= self.split[node])
                node = self.child[2 * node + above]
            out[a:a + SCORED_AT_ONCE] = self.path[node].mean(axis=1)
        return out


def stacked(trees: tuple[dict, ...]) -> Stack:
    size = np.concatenate([np.asarray(t["size"]) for t in trees])
    root = np.cumsum([0] + [len(t["size"]) for t in trees[:-1]]).astype(np.int32)
    feature = np.concatenate([np.asarray(t["feature"], np.int32) for t in trees])
    leaf = feature < 0
    itself = np.arange(len(size), dtype=np.int32)
    sides = [np.concatenate([np.asarray(t[side], np.int32) + o for t, o in zip(trees, root)]) for side in ("left", "right")]
    child = np.stack([np.where(leaf, itself, x) for x in sides], axis=1)
    depth = np.zeros(len(size))
    level, levels = root, 0
    while len(level := level[~leaf[level]]):
        levels += 1
        for side in (0, 1):
            depth[child[level, side]] = levels
        level = child[level].ravel()
    split = np.where(leaf, np.inf, np.concatenate([np.asarray(t["split"], float) for t in trees]))
    return Stack(root, np.maximum(feature, 0), split, child.ravel().astype(np.int32), depth + mean_path(size), levels)


def tree_samples(df: DataFrame, n_rows: int, trees: int, sample: int, seed: int, id_column: str) -> DataFrame:
    """``df`` rows with a ``tree`` number, at most ``sample`` per tree.

    Few rows: each goes to several different trees. Many rows: they are thinned by hash to
    about twice the need first. The per-tree limit is the sampling rule of the method; the
    rank filter runs in every task before the shuffle.
    """
    share = min(1.0, 2.0 * sample / max(n_rows, 1))
    copies = max(1, int(np.ceil(trees * share)))
    keep = min(1.0, trees * share)
    h = F.abs(F.xxhash64(F.lit(seed), id_column) % F.lit(1_000_000_007))
    thinned = df.withColumn("__h", h)
    if keep < 1.0:
        u = F.abs(F.xxhash64(F.lit(seed + 1), id_column) % F.lit(1_000_003)) / F.lit(1_000_003.0)
        thinned = thinned.filter(u < keep)
    numbered = thinned.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(min(copies, trees) - 1))))
    tree = ((F.col("__h") + F.col("__i")) % F.lit(trees)).cast("int")
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 2), "tree", id_column))
    return (
        numbered.withColumn("tree", tree).withColumn("__r", F.row_number().over(order))
        .filter(F.col("__r") <= sample).drop("__h", "__i", "__r")
    )


@dataclass(frozen=True)
class IsolationForest:
    """Fitted trees; their total size is bounded by trees x 2 x sample nodes."""

    encoder: Encoder
    trees: tuple[dict, ...]
    sample: int

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` (negative is anomalous) and ``is_anomaly``."""
        forest = stacked(self.trees)
        scale = float(mean_path(self.sample))

        @F.pandas_udf("double")
        def anomaly(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            return pd.Series(-np.exp2(-forest.mean_depth(rows) / scale) - OFFSET)

        scored = self.encoder.with_array(df, "__x").withColumn("anomaly_score", anomaly("__x"))
        return scored.drop("__x").withColumn("is_anomaly", F.col("anomaly_score") < 0)


def fit_isolation_forest(
    train: DataFrame, encoder: Encoder, trees: int = 300, sample: int = 256, seed: int = 42, id_column: str = "sample_id"
) -> IsolationForest:
    """Grow the trees in parallel, one group of at most ``sample`` rows each."""
    n = train.count()
    rows = encoder.with_array(tree_samples(train, n, trees, sample, seed, id_column), "x").select("tree", id_column, "x")

    def one_tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(id_column)
        nodes = grow(np.stack(ordered["x"].to_numpy()), seed + int(key[0]))
        return pd.DataFrame({"tree": [int(key[0])], **{k: [v] for k, v in nodes.items()}})

    grown = rows.groupBy("tree").applyInPandas(one_tree, TREE_SCHEMA).collect()  # one row per tree
    ordered = sorted(grown, key=lambda r: r["tree"])
    fitted = tuple({k: list(r[k]) for k in ("feature", "split", "left", "right", "size")} for r in ordered)
    return IsolationForest(encoder, fitted, min(sample, n))
