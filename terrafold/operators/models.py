"""Tree models on blocked folds: search, refit, out-of-fold tables and batch scoring."""

from __future__ import annotations

import hashlib
import math
import statistics
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import finite
from ..functions.heat import heat_weight
from ..functions.physics import COMPONENT_TARGETS, component_targets
from ..functions.predictors import PredictorPolicy
from ..session import concurrently, discard, materialise
from . import boosting, forest
from .boosting import BoostedParams, BoostedTrees
from .encode import Encoder, fit_encoder, fit_encoders
from .folds import SplitDesign, dual_blocked_parts, in_part, nested_parts, with_frozen_folds, with_parts
from .linear import LinearFit, candidate_scores, fit_elastic_net
from .metrics import grouped_mae, high_value_mae

# Search space of the boosted trees, by Spark parameter.
SEARCH_SPACE = {
    "trees": ("int", 300, 1500, 25),
    "depth": ("int", 3, 8, 1),
    "step_size": ("log", 0.01, 0.10),
    "subsample": ("linear", 0.60, 1.00),
    "feature_fraction": ("linear", 0.60, 1.00),
    "min_instances": ("log", 1.0, 30.0),
    "min_info_gain": ("linear", 0.0, 5.0),
}
PATIENCE = 50


@dataclass
class FittedModel:
    """Boosted trees, a forest, or a stored Spark ML tree model, with their encoder."""

    model: object
    encoder: Encoder
    tree_count: int
    variant: str = "primary_unweighted"
    curve: tuple[float, ...] = ()  # validation error after each fitted tree

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        if isinstance(self.model, BoostedTrees):
            scored = self.encoder.with_array(df.drop(output), "__x")
            return scored.withColumn(output, self.model.column("__x")).drop("__x")
        if isinstance(self.model, forest.Forest):
            return self.model.predict(df, self.encoder, output)
        scored = self.model.setPredictionCol(output).transform(self.encoder.with_features(df.drop(output)))
        return scored.drop("features")


def unit_draw(seed: int, trial: int, name: str) -> float:
    """Uniform number in [0, 1) from a digest, the same on every machine."""
    digest = hashlib.sha256(f"{seed}|{trial}|{name}".encode()).hexdigest()
    return int(digest[:13], 16) / 16**13


def candidates(n: int, seed: int, space: Mapping[str, tuple] = SEARCH_SPACE) -> list[BoostedParams]:
    """Seeded random candidates of the search space."""
    out = []
    for trial in range(n):
        values: dict[str, float] = {}
        for name, (kind, low, high, *step) in space.items():
            u = unit_draw(seed, trial, name)
            if kind == "int":
                values[name] = low + step[0] * int(u * ((high - low) // step[0] + 1))
            elif kind == "log":
                values[name] = math.exp(math.log(low) + u * (math.log(high) - math.log(low)))
            else:
                values[name] = low + u * (high - low)
        values["min_instances"] = max(1, round(values.get("min_instances", 1)))
        out.append(BoostedParams(**values))
    return out


def _labelled(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("__label", finite(label))


@dataclass(frozen=True)
class Wanted:
    """A model to be fitted together with others on the same table."""

    encoder: Encoder
    label: str
    train: Column
    params: BoostedParams
    seed: int
    validation: Column | None = None
    patience: int | None = None
    weights: tuple[Sequence[float], Sequence[float]] | None = None


def row_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c).cast("string") for c in columns])


def fit_together(df: DataFrame, wanted: Sequence[Wanted], block: Sequence[str] = (), observe=None, board: bool = False):
    """``(fits, scores)``: every wanted model, fitted in common passes, and with ``board`` their predictions of validation rows at the best
    tree count as (model, truth, prediction, block), where model is the position in ``wanted``."""
    encoders, labels, roles = [], [], []

    def place(items: list, item) -> int:
        for i, x in enumerate(items):
            if x is item or (not isinstance(item, tuple) and x == item):
                return i
        items.append(item)
        return len(items) - 1

    fitted: list[Column] = []
    named: dict[tuple, int] = {}
    models = []
    for i, w in enumerate(wanted):
        e = place(encoders, w.encoder)
        if e == len(fitted):
            fitted.append(w.train)
        label = named.setdefault((w.label, w.weights), len(named))
        if label == len(labels):
            labels.append((w.label, w.weights))
        same = [j for j in range(i) if wanted[j].train is w.train and wanted[j].validation is w.validation]
        if same:
            role = models[same[0]].role
        else:
            role = len(roles)
            held = F.lit(False) if w.validation is None else w.validation
            roles.append(F.when(w.train, boosting.TRAIN).when(held, boosting.VALIDATION).otherwise(0))
        models.append(boosting.Model(e, label, role, w.params, w.seed, w.patience))
    values = [finite(name) for name, _ in labels]
    weights = [F.lit(1.0) if steps is None else F.coalesce(heat_weight(finite(name), *steps), F.lit(1.0)) for name, steps in labels]
    predictors = list(dict.fromkeys(c for e in encoders for c in e.predictors))
    row = row_hash([*predictors, *dict.fromkeys(name for name, _ in labels)])
    edges = boosting.bin_edges(df, encoders, fitted)
    start, rows = boosting.starts(models, df, values, roles)
    if boosting.fits_alone(rows, models, edges):
        raw = boosting.raw_rows(df, row, encoders, values, roles, block, weights)
        fits, scores = boosting.fitted_alone(raw, encoders, edges, models, len(values), len(roles), start, rows, block, board)
        for trees in range(max(len(f.trees) for f in fits) if observe else 0):
            observe(trees, sum(len(f.trees) > trees for f in fits))
        return fits, scores
    table = boosting.binned(df, row, encoders, fitted, values, roles, block, weights, edges)
    fits = boosting.boost(table, models, start, observe)
    scores = None
    if board:
        best = [f.trees.first(best_tree_count(f.curve, m.patience or PATIENCE)) if f.curve else f.trees for f, m in zip(fits, models)]
        scores = materialise(boosting.scores(table, models, best), "scores")
    discard(table.blocks)
    return fits, scores


def fit_boosted(
    train: DataFrame, label: str, policy: PredictorPolicy, predictors: Sequence[str],
    params: BoostedParams, seed: int, predictor_set: str = "core",
    weights: tuple[Sequence[float], Sequence[float]] | None = None, encoder: Encoder | None = None,
    validation: DataFrame | None = None, patience: int = PATIENCE,
) -> FittedModel:
    """Fit on all given rows; optional (thresholds, weights) by label value.

    With ``validation`` the fit ends ``patience`` trees after the best validation error and keeps the trees up to it.
    """
    encoder = encoder or fit_encoder(train, policy, predictor_set, predictors)
    used = list(dict.fromkeys([label, *encoder.predictors]))
    weights = None if weights is None else (tuple(weights[0]), tuple(weights[1]))
    variant = "primary_unweighted" if weights is None else "secondary_heat_weighted"
    mark = "__held"
    rows = train.select(*used).withColumn(mark, F.lit(False))
    if validation is not None:
        rows = rows.unionByName(validation.select(*used).withColumn(mark, F.lit(True)))
    one = Wanted(encoder, label, ~F.col(mark), params, seed, F.col(mark) if validation is not None else None,
                 patience if validation is not None else None, weights)
    (fit,), _ = fit_together(rows, [one])
    if validation is not None:
        count = best_tree_count(fit.curve, patience)
        return FittedModel(fit.trees.first(count), encoder, count, variant, tuple(fit.curve))
    return FittedModel(fit.trees, encoder, params.trees, variant)


def best_tree_count(losses: Sequence[float], patience: int = PATIENCE) -> int:
    """Trees at the first minimum that ``patience`` further trees do not improve."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def loss_curve(fitted: FittedModel, validation: DataFrame, label: str) -> list[float]:
    """Mean absolute error on the given rows after each tree, in one pass."""
    trees, steps = fitted.model, boosting.staged
    rows = fitted.encoder.with_array(_labelled(validation, label), "__x").filter("__label is not null").select("__x", "__label")

    def add(batches):
        n, total = 0, np.zeros(len(trees))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            left = batch.column(1).to_numpy() - trees.start
            n += len(left)
            for i, part in enumerate(steps(x, trees.feature, trees.split, trees.value)):
                left = left - part
                total[i] += np.abs(left).sum()
        yield pa.RecordBatch.from_pydict({"tree": pa.array(range(len(trees)), pa.int32()), "total": pa.array(total), "n": pa.array([n] * len(trees), pa.int64())})

    found = rows.mapInArrow(add, "tree int, total double, n bigint").groupBy("tree").agg((F.sum("total") / F.sum("n")).alias("loss"))
    return [r["loss"] for r in found.orderBy("tree").collect()]  # one number a tree


@dataclass
class Selection:
    """Chosen candidate with its fold evidence."""

    params: BoostedParams
    tree_count: int
    objective: float
    scores: list[dict] = field(default_factory=list)


def clamp_count(counts: Sequence[int], minimum: int, maximum: int) -> int:
    return min(maximum, max(minimum, math.floor(statistics.median(counts) + 0.5)))


def first_trees(fitted: FittedModel, count: int) -> FittedModel:
    """The boosted model as it was after its first ``count`` trees."""
    return FittedModel(fitted.model.first(count), fitted.encoder, count, fitted.variant, fitted.curve)


#: Train and validation rows of the inner folds of a search.
Parts = Sequence[tuple[Column, Column]]


def fold_encoders(df: DataFrame, searches: Mapping[str, tuple[str, Sequence[str], Parts]],
                  policy: PredictorPolicy) -> dict[tuple[str, int], Encoder]:
    """One encoder a search and fold, fitted on its train rows only; those of a predictor set in the same passes."""
    found, kinds = {}, {}
    for name, (predictor_set, predictors, parts) in searches.items():
        kinds.setdefault((predictor_set, tuple(predictors)), []).extend((name, f, train) for f, (train, _) in enumerate(parts))
    for kind, own in kinds.items():
        found |= {(name, f): e for (name, f, _), e in zip(own, fit_encoders(df, [train for *_, train in own], policy, *kind))}
    return found


def search_all(
    df: DataFrame, label: str, policy: PredictorPolicy, searches: Mapping[str, tuple[str, Sequence[str], Parts]],
    trials: Sequence[BoostedParams], seed: int, block: Sequence[str], minimum_trees: int = 1, maximum_trees: int = 1500,
    high_threshold: float = 32.0, weights=None, patience: int = PATIENCE, observe=None,
) -> dict[str, Selection]:
    """Several searches at once: by name, a predictor set, its predictors and the inner folds.

    Every candidate is fitted on every fold of every search in the same passes over the rows and stops ``patience`` trees after its
    best validation error. Candidates are ranked by grouped MAE at their best tree count.
    """
    weights = None if weights is None else (tuple(weights[0]), tuple(weights[1]))
    wanted, at = [], []
    encoders = fold_encoders(df, searches, policy)
    for name, (_, _, parts) in searches.items():
        for f, (train, held) in enumerate(parts):
            for t, params in enumerate(trials):
                wanted.append(Wanted(encoders[name, f], label, train, params, seed + f, held, patience, weights))
                at.append((name, f, t))
    fits, long = fit_together(df, wanted, block, observe, board=True)
    grouped = {r["model"]: r["grouped_mae"] for r in grouped_mae(long, block).collect()}  # one row a model
    high = {r["model"]: r["high_mae"] for r in high_value_mae(long, threshold=high_threshold).collect()}
    discard(long)
    board: dict[str, dict[int, list[dict]]] = {name: {t: [] for t in range(len(trials))} for name in searches}
    for i, ((name, f, t), fit) in enumerate(zip(at, fits)):
        board[name][t].append({"trial": t, "fold": f, "grouped_mae": grouped[i], "high_mae": high[i],
                               "trees": best_tree_count(fit.curve, patience), "fitted": len(fit.trees)})
    out = {}
    for name, rows in board.items():
        means = {t: sum(s["grouped_mae"] for s in own) / len(own) for t, own in rows.items()}
        best = min(means, key=lambda t: (means[t], t))
        count = clamp_count([s["trees"] for s in rows[best]], minimum_trees, maximum_trees)
        out[name] = Selection(trials[best], count, means[best], [s for own in rows.values() for s in own])
    return out


def fold_parts(n_folds: int, folds: str = "folds") -> Parts:
    return [(in_part(f, "train", folds), in_part(f, "validation", folds)) for f in range(n_folds)]


def search(
    df: DataFrame, label: str, policy: PredictorPolicy, predictors: Sequence[str],
    trials: Sequence[BoostedParams], seed: int, block: Sequence[str], n_folds: int, folds: str = "folds",
    predictor_set: str = "core", **limits,
) -> Selection:
    """Score every candidate on every fold; ``df`` has the fold membership of each row in its array ``folds``, so a fold is a filter."""
    df = df.select(*dict.fromkeys([folds, label, *block, *predictors]))
    return search_all(df, label, policy, {"": (predictor_set, predictors, fold_parts(n_folds, folds))}, trials, seed, block, **limits)[""]


def refit(params: BoostedParams, trees: int) -> BoostedParams:
    return BoostedParams(**{**params.__dict__, "trees": trees})


def outer_rows(df: DataFrame, split: SplitDesign, inner_folds: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their outer ``folds``, written once, and the inner parts of the cells of every outer training part."""
    rows = materialise(with_frozen_folds(df, split), "outer")
    return rows, nested_parts(rows, split, inner_folds)


def outer_part(rows: DataFrame, fold: int, part: str) -> DataFrame:
    return rows.filter(in_part(fold, part)).drop("folds")


def inner_rows(rows: DataFrame, parts: DataFrame, split: SplitDesign, fold: int) -> DataFrame:
    """Training rows of an outer fold with their inner ``folds``: a lookup of cells, no shuffle on the id."""
    own = parts.filter(F.col("outer_fold") == fold).drop("outer_fold")
    return with_parts(outer_part(rows, fold, "train"), own, split)


def nested_rows(df: DataFrame, split: SplitDesign, inner_folds: int, with_final: bool) -> DataFrame:
    """Rows with their stored outer folds as ``outer``, their part in the inner folds of every outer training part as ``nested`` (one
    number an outer and inner fold: TRAIN, VALIDATION or 0), and the folds of all rows as ``final``. Written once; every fold of
    every level is a filter on it."""
    rows, parts = outer_rows(df, split, inner_folds)
    inner = split.inner(inner_folds)
    role = F.transform("folds", lambda x: F.when(x["part"] == "train", boosting.TRAIN).when(x["part"] == "validation", boosting.VALIDATION)
                       .otherwise(0).cast("tinyint"))
    outside = F.array_repeat(F.lit(0).cast("tinyint"), inner_folds)
    every = [F.coalesce(F.max(F.when(F.col("outer_fold") == f, role)), outside) for f in range(split.n_folds)]
    cells = parts.groupBy("block", "day", "event").agg(F.flatten(F.array(*every)).alias("folds"))
    out = with_parts(rows.withColumnRenamed("folds", "outer"), materialise(cells, "cells"), inner, how="left").withColumnRenamed("folds", "nested")
    if with_final:
        out = with_parts(out, dual_blocked_parts(rows, inner), inner).withColumnRenamed("folds", "final")
    return materialise(out, "nested")


def inner_parts(fold: int, inner_folds: int) -> Parts:
    """Inner train and validation rows of an outer fold of ``nested_rows``."""
    def of(f: int, part: int) -> Column:
        return F.coalesce(F.get("nested", F.lit(fold * inner_folds + f)) == part, F.lit(False))

    return [(of(f, boosting.TRAIN), of(f, boosting.VALIDATION)) for f in range(inner_folds)]


def nested_variants(
    df: DataFrame, split: SplitDesign, label: str, policy: PredictorPolicy, variants: Mapping[str, tuple[str, Sequence[str]]],
    trials: Sequence[BoostedParams], block: Sequence[str], inner_folds: int = 4, seed: int = 0, weights=None,
    select_final: bool = True, **limits,
) -> dict[str, tuple[DataFrame, Selection | None, list[Selection]]]:
    """Nested out-of-fold predictions of several predictor sets, by output column: the searches of all sets, outer folds and the
    final selection run in the same passes, and so do the refits."""
    rows = nested_rows(df, split, inner_folds, select_final)
    searches: dict[str, tuple[str, Sequence[str], Parts]] = {}
    for output, (kind, predictors) in variants.items():
        searches |= {f"{output}|{f}": (kind, predictors, inner_parts(f, inner_folds)) for f in range(split.n_folds)}
        if select_final:
            searches[f"{output}|final"] = (kind, predictors, fold_parts(inner_folds, "final"))
    found = search_all(rows, label, policy, searches, trials, seed, block, weights=weights, **limits)
    wanted, at = [], []
    steps = None if weights is None else (tuple(weights[0]), tuple(weights[1]))
    trains = [in_part(f, "train", "outer") for f in range(split.n_folds)]
    encoders = fold_encoders(rows, {output: (*variant, [(t, t) for t in trains]) for output, variant in variants.items()}, policy)
    for output in variants:
        for f, train in enumerate(trains):
            best = found[f"{output}|{f}"]
            wanted.append(Wanted(encoders[output, f], label, train, refit(best.params, best.tree_count), seed + f, weights=steps))
            at.append((output, f))
    fits, _ = fit_together(rows, wanted)
    tables: dict[str, list[DataFrame]] = {output: [] for output in variants}
    for (output, f), w, fit in zip(at, wanted, fits):
        held = FittedModel(fit.trees, w.encoder, len(fit.trees)).predict(rows.filter(in_part(f, "validation", "outer")), output)
        tables[output].append(held.select(split.id_column, output))
    return {output: (reduce(DataFrame.unionByName, own), found.get(f"{output}|final"), [found[f"{output}|{f}"] for f in range(split.n_folds)])
            for output, own in tables.items()}


def nested_out_of_fold(
    df: DataFrame, split: SplitDesign, label: str, policy: PredictorPolicy, predictors: Sequence[str],
    trials: Sequence[BoostedParams], block: Sequence[str], inner_folds: int = 4, seed: int = 0,
    predictor_set: str = "core", output: str = "direct_core", weights=None, select_final: bool = True, **limits,
) -> tuple[DataFrame, Selection | None, list[Selection]]:
    """Out-of-fold predictions of development rows with stored outer folds.

    Returns the table ``(id, output)``, the selection on all development rows, and the
    selection of each outer fold.
    """
    return nested_variants(df, split, label, policy, {output: (predictor_set, predictors)}, trials, block, inner_folds, seed, weights,
                           select_final, **limits)[output]


def fit_forest(train: DataFrame, label: str, policy: PredictorPolicy, predictors: Sequence[str], seed: int = 42,
               trees: int = 500, min_leaf: int = 2, depth: int = 30) -> FittedModel:
    """Random forest over all features at each node, to a depth of 30 as Spark's. A row's bags depend on all its columns, so equal rows share them."""
    encoder = fit_encoder(train, policy, predictors=predictors, kind="random_forest")
    fitted = forest.fit(train, encoder, label, F.xxhash64(*train.columns), seed, trees, min_leaf, depth)
    return FittedModel(fitted, encoder, trees, "random_forest")


def select_elastic_net(
    df: DataFrame, label: str, policy: PredictorPolicy, predictors: Sequence[str],
    block: Sequence[str], n_folds: int, folds: str = "folds",
) -> tuple[float, float, float]:
    """``(alpha, l1_ratio, score)`` with the smallest mean grouped MAE; ties by alpha, then ratio."""
    df = df.select(*dict.fromkeys([folds, label, *block, *predictors]))

    def one_fold(f: int) -> list[tuple[float, float, float]]:
        return candidate_scores(df.filter(in_part(f, "train", folds)), df.filter(in_part(f, "validation", folds)), label, policy, predictors, block)

    totals: dict[tuple[float, float], list[float]] = {}
    for rows in concurrently(df.sparkSession, [partial(one_fold, f) for f in range(n_folds)]):
        for a, r, score in rows:
            totals.setdefault((a, r), []).append(score)
    score, alpha, ratio = min((sum(v) / len(v), a, r) for (a, r), v in totals.items())
    return alpha, ratio, score


@dataclass
class ComponentModels:
    """Four regressors on one encoded table."""

    models: dict[str, FittedModel]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add one raw prediction column per target; the rows are encoded once for all four."""
        encoder = next(iter(self.models.values())).encoder
        if any(fitted.encoder != encoder for fitted in self.models.values()):
            raise ValueError("component models must share their encoder")
        df = encoder.with_array(df.drop(*[f"predicted_{name}" for name in self.models]), "__x")
        return df.withColumns({f"predicted_{name}": fitted.model.column("__x") for name, fitted in self.models.items()}).drop("__x")


def fit_components(
    train: DataFrame, policy: PredictorPolicy, predictors: Sequence[str], params: Mapping[str, BoostedParams] | BoostedParams,
    seed: int = 0,
) -> ComponentModels:
    """Fit the four targets; a missing target on any training row is an error."""
    labelled = train.withColumns({f"__{name}": e for name, e in component_targets().items()})
    gaps = labelled.agg(*[F.count_if(F.col(f"__{n}").isNull()).alias(n) for n in COMPONENT_TARGETS]).first().asDict()
    if any(gaps.values()):
        raise ValueError(f"component targets must be complete: {gaps}")
    encoder = fit_encoder(train, policy, predictors=predictors)
    everywhere = F.lit(True)
    wanted = [Wanted(encoder, f"__{name}", everywhere, params if isinstance(params, BoostedParams) else params[name], seed + offset)
              for offset, name in enumerate(COMPONENT_TARGETS)]
    fits, _ = fit_together(labelled, wanted)
    return ComponentModels({name: FittedModel(fit.trees, encoder, len(fit.trees)) for name, fit in zip(COMPONENT_TARGETS, fits)})


def with_component_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({f"__{name}": e for name, e in component_targets().items()})


def component_counts(
    df: DataFrame, policy: PredictorPolicy, predictors: Sequence[str], base: BoostedParams, parts: Mapping[str, Parts],
    seed: int = 0, patience: int = PATIENCE,
) -> dict[str, dict[str, BoostedParams]]:
    """By search and target: the median best tree count over its inner folds. All targets and folds are fitted together."""
    labelled = with_component_labels(df)
    wanted, at = [], []
    encoders = fold_encoders(df, {name: ("core", predictors, folds) for name, folds in parts.items()}, policy)
    for name, folds in parts.items():
        for f, (train, held) in enumerate(folds):
            for offset, target in enumerate(COMPONENT_TARGETS):
                wanted.append(Wanted(encoders[name, f], f"__{target}", train, base, seed + 100 * offset + f, held, patience))
                at.append((name, target))
    fits, _ = fit_together(labelled, wanted)
    counts: dict[tuple[str, str], list[int]] = {}
    for key, fit in zip(at, fits):
        counts.setdefault(key, []).append(best_tree_count(fit.curve, patience))
    return {name: {t: refit(base, clamp_count(counts[name, t], 1, 10**9)) for t in COMPONENT_TARGETS} for name in parts}


def component_tree_counts(
    df: DataFrame, policy: PredictorPolicy, predictors: Sequence[str], base: BoostedParams,
    n_folds: int, seed: int = 0, folds: str = "folds",
) -> dict[str, BoostedParams]:
    """Per target: the median best tree count over the inner validation folds."""
    return component_counts(df, policy, predictors, base, {"": fold_parts(n_folds, folds)}, seed)[""]


def components_by_fold(
    rows: DataFrame, policy: PredictorPolicy, predictors: Sequence[str], params: Sequence[Mapping[str, BoostedParams]], seed: int = 0,
) -> list[ComponentModels]:
    """The four models of every outer training part of ``nested_rows``, fitted together."""
    trains = [in_part(f, "train", "outer") for f in range(len(params))]
    labelled = with_component_labels(rows)
    encoders = fold_encoders(rows, {"": ("core", predictors, [(t, t) for t in trains])}, policy)
    at = [(f, offset, name) for f in range(len(params)) for offset, name in enumerate(COMPONENT_TARGETS)]
    wanted = [Wanted(encoders["", f], f"__{name}", trains[f], params[f][name], seed + f + offset) for f, offset, name in at]
    fits, _ = fit_together(labelled, wanted)
    models: list[dict[str, FittedModel]] = [{} for _ in params]
    for (f, _, name), w, fit in zip(at, wanted, fits):
        models[f][name] = FittedModel(fit.trees, w.encoder, len(fit.trees))
    return [ComponentModels(m) for m in models]


__all__ = [
    "BoostedParams", "BoostedTrees", "ComponentModels", "FittedModel", "LinearFit", "Selection", "best_tree_count", "candidates",
    "component_tree_counts", "fit_boosted", "fit_components", "fit_elastic_net", "fit_forest", "loss_curve",
    "first_trees", "fit_together", "nested_out_of_fold", "nested_variants", "search", "search_all", "select_elastic_net",
]
