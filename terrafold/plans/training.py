"""Out-of-fold tables of the comparison models on frozen outer folds."""

from __future__ import annotations

import statistics
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame

from ..functions.predictors import PredictorPolicy
from ..functions.satellite import Eligibility, eligible
from ..operators.folds import SplitDesign, in_part
from ..operators.models import (
    PATIENCE,
    BoostedParams,
    component_counts,
    components_by_fold,
    fit_elastic_net,
    fit_forest,
    inner_parts,
    inner_rows,
    nested_rows,
    nested_variants,
    outer_part,
    outer_rows,
    select_elastic_net,
)
from ..session import concurrently, materialise
from .scoring import with_components, with_simple_baselines


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def baseline_out_of_fold(
    df: DataFrame, split: SplitDesign, label: str, policy: PredictorPolicy, predictors: Sequence[str],
    block: Sequence[str], inner_folds: int = 4, forest_trees: int = 500, forest_depth: int = 30, seed: int = 0,
    rules: Eligibility | None = None,
) -> tuple[DataFrame, dict[str, float]]:
    """Simple, linear and forest baselines on every validation row, and the final linear setting.

    The final setting is the median of the fold choices.
    """
    rows, parts = outer_rows(df, split, inner_folds)
    columns = [split.id_column, "baseline_background_air_temperature", "baseline_heat_index",
               "baseline_regularized_linear", "baseline_random_forest"]
    if rules is not None:
        columns.append("baseline_satellite_lst_alone")
    used = dict.fromkeys([split.id_column, label, *block, *predictors])

    def one_fold(f: int) -> tuple[DataFrame, float, float]:
        train = materialise(inner_rows(rows, parts, split, f).select(*used, "folds"), "train")  # the fits read it many times
        alpha, ratio, _ = select_elastic_net(train, label, policy, predictors, block, inner_folds)
        linear = fit_elastic_net(train, label, policy, predictors, alpha, ratio)
        forest = fit_forest(train.drop("folds"), label, policy, predictors, seed + f, forest_trees, depth=forest_depth)
        held = linear.predict(with_simple_baselines(outer_part(rows, f, "validation"), rules), "baseline_regularized_linear")
        held = held.select(*dict.fromkeys(c for c in [*columns, *predictors] if c != "baseline_random_forest"))
        return forest.predict(held, "baseline_random_forest").select(*columns), alpha, ratio

    tables, alphas, ratios = zip(*concurrently(df.sparkSession, [partial(one_fold, f) for f in range(split.n_folds)]))
    return _union(tables), {"alpha": statistics.median(alphas), "l1_ratio": statistics.median(ratios)}


def component_out_of_fold(
    df: DataFrame, split: SplitDesign, policy: PredictorPolicy, predictors: Sequence[str],
    base: BoostedParams = BoostedParams(trees=1500), inner_folds: int = 4, seed: int = 0, patience: int = PATIENCE,
) -> DataFrame:
    """Component predictions, reconstructions and index on every validation row."""
    rows = nested_rows(df, split, inner_folds, with_final=False)
    parts = {str(f): inner_parts(f, inner_folds) for f in range(split.n_folds)}
    counts = component_counts(rows, policy, predictors, base, parts, seed, patience)
    models = components_by_fold(rows, policy, predictors, [counts[str(f)] for f in range(split.n_folds)], seed)
    tables = []
    for f, own in enumerate(models):
        scored = with_components(own.predict(rows.filter(in_part(f, "validation", "outer"))))
        tables.append(scored.select(split.id_column, *[c for c in scored.columns if c not in rows.columns]))
    return _union(tables)


def satellite_pair_out_of_fold(
    df: DataFrame, split: SplitDesign, label: str, policy: PredictorPolicy, core: Sequence[str],
    additions: Sequence[str], trials: Sequence[BoostedParams], block: Sequence[str], inner_folds: int = 4,
    seed: int = 0, rules: Eligibility = Eligibility(), **limits,
) -> DataFrame:
    """Enhanced and core models trained and scored on the same eligible rows."""
    rows = materialise(df.filter(eligible(df.columns, rules)), "eligible")
    found = nested_variants(
        rows, split, label, policy,
        {"direct_satellite_enhanced": ("satellite_enhanced", [*core, *additions]), "direct_core_eligible": ("core", core)},
        trials, block, inner_folds, seed, select_final=False, **limits,
    )
    return found["direct_satellite_enhanced"][0].join(found["direct_core_eligible"][0], split.id_column)
