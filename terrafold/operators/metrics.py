"""Accuracy reports from one scan of a long prediction table.

A wide table with one column per model is turned long by exploding an array of structs, so
every report is one partial plus one final aggregation whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import finite
from ..functions.heat import CATEGORY_LABELS, RECALL_THRESHOLDS_C, heat_category
from ..session import materialise
from .order_stats import average_ranks


def _truth() -> Column:
    return F.col("truth")


def _prediction() -> Column:
    return F.col("prediction")


def long_predictions(
    df: DataFrame, truth: str, models: Sequence[str], keep: Sequence[str | Column] = ()
) -> DataFrame:
    """``(keep, model, truth, prediction)``; non-finite numbers become null."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), finite(m).alias("prediction")) for m in models])
    return df.select(*keep, finite(truth).alias("truth"), F.inline(pairs))


def paired(df: DataFrame) -> DataFrame:
    return df.filter(_truth().isNotNull() & _prediction().isNotNull())


def _usable() -> Column:
    return _truth().isNotNull() & _prediction().isNotNull()


def _over_pairs(x: Column) -> Column:
    return F.when(_usable(), x)


def error_aggregates() -> list[Column]:
    """Support, omitted rows, MAE, RMSE, bias and R2 over paired finite rows."""
    error = _prediction() - _truth()
    n = F.count_if(_usable())
    spread = F.var_pop(_over_pairs(_truth())) * n
    squares = F.sum(_over_pairs(error * error))
    return [
        n.alias("n"),
        F.count_if(~_usable()).alias("n_omitted"),
        F.avg(_over_pairs(F.abs(error))).alias("mae"),
        F.sqrt(F.avg(_over_pairs(error * error))).alias("rmse"),
        F.when((n >= 2) & (spread > 0), F.lit(1.0) - squares / spread).alias("r2"),
        F.avg(_over_pairs(error)).alias("mean_bias"),
    ]


def regression_report(long: DataFrame, keys: Sequence[str] = ("model",), with_spearman: bool = True) -> DataFrame:
    """One row per key with the continuous metrics; null where a metric is undefined."""
    report = long.groupBy(*keys).agg(*error_aggregates())
    if not with_spearman:
        return report
    return report.join(spearman(long, keys), list(keys), "left")


def spearman(long: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Rank correlation with mean ranks for ties; null if a side is constant.

    The input is read once: its rows become counted (keys, truth, prediction) pairs in a written table. Both sides of
    the pairs are ranked in one pass, the side being one more key. Centred ranks keep the sums well conditioned.
    """
    keys = list(keys)
    pairs = materialise(paired(long).groupBy(*keys, "truth", "prediction").agg(F.count(F.lit(1)).alias("w")), "pairs")
    sides = F.array(
        F.struct(F.lit("t").alias("side"), _truth().alias("value")),
        F.struct(F.lit("p").alias("side"), _prediction().alias("value")),
    )
    ranks = average_ranks(pairs.select(*keys, "w", F.inline(sides)), "value", [*keys, "side"], F.col("w")).select(
        *keys, "side", "value", (F.col("avg_rank") - (F.col("n_total") + 1) / F.lit(2.0)).alias("centred")
    )
    # Both joins read the ranks: written once they are a scan with a true size, not the windows again.
    ranks = materialise(ranks, "ranks")
    truth_ranks = ranks.filter("side = 't'").select(*keys, F.col("value").alias("truth"), F.col("centred").alias("rt"))
    prediction_ranks = ranks.filter("side = 'p'").select(*keys, F.col("value").alias("prediction"), F.col("centred").alias("rp"))
    ranked = pairs.join(truth_ranks, [*keys, "truth"]).join(prediction_ranks, [*keys, "prediction"])
    w, rt, rp = F.col("w"), F.col("rt"), F.col("rp")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w * rt * rp).alias("stp"), F.sum(w * rt * rt).alias("stt"), F.sum(w * rp * rp).alias("spp")
    )
    defined = (F.col("stt") > 0) & (F.col("spp") > 0)
    return sums.select(
        *keys, F.when(defined, F.col("stp") / F.sqrt(F.col("stt") * F.col("spp"))).alias("spearman")
    )



def confusion(long: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """``(keys, true_label, predicted_label, n)`` with all 25 cells, zeros included.

    25 conditional counts in one aggregate; the cells are laid out by ``inline``.
    """
    t, p = heat_category(_truth()), heat_category(_prediction())
    cells = [(a, b) for a in CATEGORY_LABELS for b in CATEGORY_LABELS]
    labelled = paired(long).withColumns({"t": t, "p": p})
    counts = labelled.groupBy(*keys).agg(
        *[F.count_if((F.col("t") == a) & (F.col("p") == b)).alias(f"c{i}") for i, (a, b) in enumerate(cells)]
    )
    rows = [
        F.struct(F.lit(a).alias("true_label"), F.lit(b).alias("predicted_label"), F.col(f"c{i}").alias("n"))
        for i, (a, b) in enumerate(cells)
    ]
    return counts.select(*keys, F.inline(F.array(*rows)))


def confusion_wide(long: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Confusion counts with one column per predicted label."""
    return (
        confusion(long, keys).groupBy(*keys, "true_label")
        .pivot("predicted_label", list(CATEGORY_LABELS)).agg(F.sum("n"))
    )


def category_report(long: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Support, accuracy and macro F1 over all five labels from per-label counts."""
    t, p = heat_category(_truth()), heat_category(_prediction())
    labelled = long.withColumns({"t": F.when(_usable(), t), "p": F.when(_usable(), p)})
    aggregates = [
        F.count_if(_usable()).alias("n"),
        F.count_if(~_usable()).alias("n_omitted"),
        F.count_if(F.col("t") == F.col("p")).alias("hits"),
    ]
    for label in CATEGORY_LABELS:
        aggregates += [
            F.count_if(F.col("t") == label).alias(f"support_{label}"),
            F.count_if(F.col("p") == label).alias(f"predicted_{label}"),
            F.count_if((F.col("t") == label) & (F.col("p") == label)).alias(f"hits_{label}"),
        ]
    counts = labelled.groupBy(*keys).agg(*aggregates)
    f1 = [
        F.coalesce(
            F.try_divide(
                F.lit(2.0) * F.col(f"hits_{label}"),
                F.col(f"support_{label}") + F.col(f"predicted_{label}"),
            ),
            F.lit(0.0),
        )
        for label in CATEGORY_LABELS
    ]
    total = f1[0]
    for value in f1[1:]:
        total = total + value
    return counts.select(
        *keys, "n", "n_omitted",
        F.try_divide(F.col("hits").cast("double"), F.col("n")).alias("accuracy"),
        F.when(F.col("n") > 0, total / F.lit(float(len(CATEGORY_LABELS)))).alias("macro_f1"),
        *[f"support_{label}" for label in CATEGORY_LABELS],
    )


def recall_aggregates(thresholds: Sequence[float] = RECALL_THRESHOLDS_C) -> list[Column]:
    """Per threshold: recall (null without positives), availability and support."""
    out = []
    for c in thresholds:
        positive = _usable() & (_truth() >= c)
        support = F.count_if(positive)
        found = F.count_if(positive & (_prediction() >= c))
        name = f"recall_ge_{c:g}_c"
        out += [
            F.try_divide(found.cast("double"), support).alias(name),
            (support > 0).alias(f"{name}_available"),
            support.alias(f"{name}_positive_support"),
        ]
    return out


def threshold_recalls(
    long: DataFrame, keys: Sequence[str] = ("model",), thresholds: Sequence[float] = RECALL_THRESHOLDS_C
) -> DataFrame:
    """Long form: one row per key and threshold, with the reason when unavailable."""
    counts = long.groupBy(*keys).agg(F.count_if(_usable()).alias("n"), *recall_aggregates(thresholds))
    rows = [
        F.struct(
            F.lit(float(c)).alias("threshold_c"), F.col(f"recall_ge_{c:g}_c").alias("recall"),
            F.col(f"recall_ge_{c:g}_c_available").alias("available"),
            F.col(f"recall_ge_{c:g}_c_positive_support").alias("positive_support"),
        )
        for c in thresholds
    ]
    return counts.select(*keys, "n", F.inline(F.array(*rows))).withColumn(
        "reason",
        F.when(~F.col("available"), F.lit("no observed case reaches the threshold")),
    )


def high_value_aggregates(threshold: float = 32.0) -> list[Column]:
    high = _usable() & (_truth() >= threshold)
    return [
        F.avg(F.when(high, F.abs(_prediction() - _truth()))).alias("high_mae"),
        F.count_if(high).alias("high_support"),
    ]


def high_value_mae(long: DataFrame, keys: Sequence[str] = ("model",), threshold: float = 32.0) -> DataFrame:
    return long.groupBy(*keys).agg(*high_value_aggregates(threshold)).withColumn(
        "available", F.col("high_support") > 0
    )


def full_report(long: DataFrame, keys: Sequence[str] = ("model",), high_threshold: float = 32.0,
                with_spearman: bool = True) -> DataFrame:
    """Continuous, category, recall and high-value metrics; one scan without the rank part."""
    t, p = heat_category(_truth()), heat_category(_prediction())
    labelled = long.withColumns({"t": F.when(_usable(), t), "p": F.when(_usable(), p)})
    label_counts = []
    for label in CATEGORY_LABELS:
        label_counts += [
            F.count_if(F.col("t") == label).alias(f"support_{label}"),
            F.count_if(F.col("p") == label).alias(f"predicted_{label}"),
            F.count_if((F.col("t") == label) & (F.col("p") == label)).alias(f"hits_{label}"),
        ]
    counts = labelled.groupBy(*keys).agg(
        *error_aggregates(), F.count_if(F.col("t") == F.col("p")).alias("hits"),
        *label_counts, *recall_aggregates(), *high_value_aggregates(high_threshold),
    )
    f1 = F.aggregate(
        F.array(*[
            F.coalesce(F.try_divide(F.lit(2.0) * F.col(f"hits_{c}"),
                                    F.col(f"support_{c}") + F.col(f"predicted_{c}")), F.lit(0.0))
            for c in CATEGORY_LABELS
        ]),
        F.lit(0.0), lambda a, b: a + b,
    )
    report = counts.withColumns(
        {
            "accuracy": F.try_divide(F.col("hits").cast("double"), F.col("n")),
            "macro_f1": F.when(F.col("n") > 0, f1 / F.lit(float(len(CATEGORY_LABELS)))),
        }
    ).drop("hits", *[f"predicted_{c}" for c in CATEGORY_LABELS], *[f"hits_{c}" for c in CATEGORY_LABELS])
    if with_spearman:
        report = report.join(spearman(long, keys), list(keys), "left")
    return report


def by_subgroup(long: DataFrame, dimensions: Mapping[str, str | Column]) -> DataFrame:
    """Repeat each row once per dimension with ``subgroup_type`` and ``subgroup``."""
    entries = [
        F.struct(
            F.lit(name).alias("subgroup_type"),
            F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("missing")).alias("subgroup"),
        )
        for name, v in dimensions.items()
    ]
    columns = [c for c in ("model", "truth", "prediction", "lower", "upper") if c in long.columns]
    return long.select(*columns, F.inline(F.array(*entries)))


def subgroup_report(long: DataFrame, dimensions: Mapping[str, str | Column], with_spearman: bool = True) -> DataFrame:
    """Metrics and recalls per (model, subgroup type, subgroup) over paired rows.

    The observed heat category is always the first dimension.
    """
    keys = ["model", "subgroup_type", "subgroup"]
    grouped = by_subgroup(paired(long), {"observed_heat_category": heat_category(_truth()), **dimensions})
    report = grouped.groupBy(*keys).agg(*error_aggregates(), *recall_aggregates())
    if with_spearman:
        report = report.join(spearman(grouped, keys), keys, "left")
    return report


def error_sums(long: DataFrame, keys: Sequence[str], models: Sequence[str], rows: str = "rows") -> DataFrame:
    """One row a key: the rows behind it, paired or not, and ``errors``, an array of (model, abs_error, pairs).

    Where a table is to be joined by ``keys`` or repeated, this is done with the sums instead of the rows; ``grouped_mae`` reads them.
    """
    def of(m: str) -> Column:
        mine = F.when(F.col("model") == m, F.abs(_prediction() - _truth()))
        return F.struct(F.lit(m).alias("model"), F.sum(mine).alias("abs_error"), F.count(mine).alias("pairs"))

    return long.groupBy(*keys).agg(F.count_if(F.col("model") == models[0]).alias(rows), F.array(*[of(m) for m in models]).alias("errors"))


def grouped_mae(
    long: DataFrame, block: Sequence[str], keys: Sequence[str] = ("model",), candidates: Sequence[tuple[Mapping[str, object], Column]] | None = None,
) -> DataFrame:
    """Mean of the per-block mean absolute errors, so large blocks do not dominate.

    ``candidates``: constants of some of the keys and a prediction each. All are scored in the same aggregation of the rows,
    which need not be repeated for them; ``prediction`` is then not read. ``long`` may hold the sums of ``error_sums`` instead of
    truth and prediction.
    """
    if candidates is not None:
        named = set().union(*[constants for constants, _ in candidates])
        rest = [k for k in keys if k not in named]
        per_block = long.groupBy(*rest, *block).agg(*[F.avg(F.abs(p - _truth())).alias(f"e{i}") for i, (_, p) in enumerate(candidates)])
        means = [a for i in range(len(candidates)) for a in (F.avg(f"e{i}").alias(f"m{i}"), F.count(f"e{i}").alias(f"n{i}"))]
        scores = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in constants.items()], F.col(f"m{i}").alias("grouped_mae"), F.col(f"n{i}").alias("n_blocks"))
                           for i, (constants, _) in enumerate(candidates)])
        wide = per_block.groupBy(*rest).agg(*means)
        return wide.select(*rest, F.inline(scores)).filter("n_blocks > 0").select(*keys, "grouped_mae", "n_blocks")
    if "abs_error" in long.columns:
        mean = F.sum("abs_error") / F.sum("pairs")
        per_block = long.filter("pairs > 0").groupBy(*keys, *block).agg(mean.alias("block_mae"))
    else:
        per_block = paired(long).groupBy(*keys, *block).agg(F.avg(F.abs(_prediction() - _truth())).alias("block_mae"))
    return per_block.groupBy(*keys).agg(F.avg("block_mae").alias("grouped_mae"), F.count(F.lit(1)).alias("n_blocks"))


def identical_rows_report(df: DataFrame, truth: str, models: Sequence[str], **options) -> DataFrame:
    """The full report of several models on the rows where all of them are finite."""
    common = finite(truth).isNotNull()
    for m in models:
        common = common & finite(m).isNotNull()
    return full_report(long_predictions(df.filter(common), truth, models), **options)


def support_mismatches(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: rows on which exactly one of two predictions is finite."""
    a, b = finite(left).isNotNull(), finite(right).isNotNull()
    return df.agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"),
        F.count_if(b & ~a).alias("right_only"), (F.count_if(a != b) == 0).alias("identical"),
    )


def leaderboard(scores: DataFrame, candidate: Sequence[str], score: str = "grouped_mae") -> DataFrame:
    """Mean fold score per candidate; the candidate columns break ties in order."""
    return scores.groupBy(*candidate).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n_folds"))


def best_candidate(scores: DataFrame, candidate: Sequence[str], score: str = "grouped_mae") -> DataFrame:
    board = leaderboard(scores, candidate, score)
    best = F.min(F.struct("mean_score", *candidate)).alias("best")
    return board.agg(best).select("best.*")
