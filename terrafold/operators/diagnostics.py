"""Training ranges, partial dependence and permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import finite, number
from ..functions.keys import stable_hash
from .order_stats import columns_quantiles, dense_index

ASSOCIATION_NOTE = "predictive association, not causation"


def training_ranges(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """``(feature, training_min, training_max)`` over finite values; one scan, no shuffle of rows."""
    ends = []
    for i, c in enumerate(predictors):
        ends += [F.min(finite(c)).alias(f"a{i}"), F.max(finite(c)).alias(f"b{i}")]
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("training_min"), F.col(f"b{i}").alias("training_max"))
        for i, c in enumerate(predictors)
    ]
    return df.agg(*ends).select(F.inline(F.array(*rows))).filter("training_min is not null")


def range_bounds(ranges: DataFrame) -> dict[str, tuple[float, float]]:
    """Fitted ranges as plan-time constants: one row per feature."""
    return {r["feature"]: (r["training_min"], r["training_max"]) for r in ranges.collect()}


def range_check(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows below and above the training range per feature; null counts for an absent column."""
    counts, rows = [], []
    for i, (c, (low, high)) in enumerate(bounds.items()):
        present = c in df.columns
        x = number(c) if present else F.lit(None).cast("double")
        counts += [F.count_if(x < low).alias(f"a{i}"), F.count_if(x > high).alias(f"b{i}")]
        hidden = F.lit(None).cast("bigint")
        rows.append(
            F.struct(
                F.lit(c).alias("feature"), F.lit(float(low)).alias("training_min"), F.lit(float(high)).alias("training_max"),
                (F.col(f"a{i}") if present else hidden).alias("below_count"),
                (F.col(f"b{i}") if present else hidden).alias("above_count"),
                F.lit(not present).alias("missing_column"),
            )
        )
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def extrapolation_count(columns: Sequence[str], bounds: Mapping[str, tuple[float, float]]) -> Column:
    """Number of features of a row outside their training range."""
    total = F.lit(0)
    for c, (low, high) in bounds.items():
        if c in columns:
            x = number(c)
            total = total + F.when((x < low) | (x > high), F.lit(1)).otherwise(F.lit(0))
    return total


def dependence_grid(df: DataFrame, feature: str, lower: float = 0.02, upper: float = 0.98, size: int = 30) -> list[float]:
    """Evenly spaced values between two exact quantiles of the finite values."""
    known = df.select(finite(feature).alias(feature))
    ends = columns_quantiles(known, [feature], [lower, upper])[feature]
    if ends is None:
        raise ValueError(f"{feature} has no finite values")
    low, high = ends
    if size < 2:
        return [low]
    return [low + (high - low) * i / (size - 1) for i in range(size)]


def partial_dependence(
    df: DataFrame,
    feature: str,
    predict: Callable[[DataFrame], DataFrame],
    recompute: Callable[[DataFrame], DataFrame] | None = None,
    grid: Sequence[float] | None = None,
    output: str = "prediction",
    size: int = 30,
) -> DataFrame:
    """``(feature, value, mean_prediction)``.

    Every row meets every grid value through an exploded literal array, and the average
    combines on the map side, so no row is shuffled. Derived columns are recomputed.
    """
    if feature not in df.columns:
        raise ValueError(f"{feature} is absent")
    values = list(grid) if grid is not None else dependence_grid(df, feature, size=size)
    numbered = F.array(*[F.struct(F.lit(i).alias("grid_no"), F.lit(float(v)).alias("grid_value")) for i, v in enumerate(values)])
    changed = df.drop(feature).select("*", F.inline(numbered)).withColumn(feature, F.col("grid_value"))
    if recompute is not None:
        changed = recompute(changed)
    return (
        predict(changed).groupBy("grid_no", "grid_value").agg(F.avg(number(output)).alias("mean_prediction"))
        .select(F.lit(feature).alias("feature"), "grid_no", F.col("grid_value").alias("value"), "mean_prediction")
    )


def permutation_importance(
    df: DataFrame, features: Sequence[str], label: str, predict: Callable[[DataFrame], DataFrame],
    seed: int = 0, id_column: str = "sample_id", output: str = "prediction",
    recompute: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """MAE increase when one column is shuffled: ``(feature, base_mae, shuffled_mae, importance)``.

    The shuffle is a seeded permutation: the i-th row by id takes the value of the i-th row
    by hash, both numbered without a global window. Rows without an id take no part.

    A row meets its donor once, whatever the number of features. It is then repeated by a literal array, once
    unchanged and once per feature with that column taken from the donor, so one prediction pass gives all errors.
    """
    features = list(features)
    keyed = df.withColumn("__h", stable_hash(id_column, seed, "permutation"))
    by_id = dense_index(keyed, id_column, "__slot")
    by_hash = dense_index(keyed, "__h", "__slot")
    given = [f"__v{i}" for i in range(len(features))]
    donors = keyed.select("__h", *[F.col(c).alias(v) for c, v in zip(features, given)]).join(by_hash, "__h").drop("__h")
    moved = df.join(by_id, id_column).join(donors, "__slot").drop("__slot")
    moved = moved.withColumn("__moved", F.explode(F.array(*[F.lit(i) for i in range(-1, len(features))])))
    moved = moved.withColumns(
        {c: F.when(F.col("__moved") == i, F.col(v)).otherwise(F.col(c)) for i, (c, v) in enumerate(zip(features, given))}
    ).drop(*given)
    if recompute is not None:
        moved = recompute(moved)
    errors = predict(moved).groupBy("__moved").agg(F.avg(F.abs(finite(output) - finite(label))).alias("mae"))
    # At most one row per feature from here on.
    wide = errors.groupBy().agg(*[F.max(F.when(F.col("__moved") == i, F.col("mae"))).alias(f"m{i + 1}")
                                  for i in range(-1, len(features))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("m0").alias("base_mae"), F.col(f"m{i}").alias("shuffled_mae"))
                     for i, c in enumerate(features, 1)])
    return wide.select(F.inline(rows)).withColumn("importance", F.col("shuffled_mae") - F.col("base_mae"))


def with_disagreement(df: DataFrame, direct: str, component: str, threshold: float | Column) -> DataFrame:
    """Absolute difference of two estimates, comparability, and a warning above the threshold."""
    a, b = finite(direct), finite(component)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    gap = F.abs(a - b)
    return df.withColumns(
        {
            "absolute_disagreement_c": gap,
            "comparable": a.isNotNull() & b.isNotNull(),
            "disagreement_warning": F.coalesce(gap > limit, F.lit(False)),
        }
    )
