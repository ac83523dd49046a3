"""Split-conformal intervals: calibration, application and coverage reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import finite, is_finite, number
from .metrics import by_subgroup
from .order_stats import conformal_radius, linear_quantiles, refused_residuals

EXCHANGEABILITY_NOTE = "marginal coverage assumes calibration and future residuals are exchangeable"


def calibrate(
    df: DataFrame, truth: str, prediction: str, partition_role: str, alpha: float = 0.1, minimum_rows: int = 20
) -> DataFrame:
    """Radius from the calibration rows only; a residual that is not finite is an error."""
    if partition_role != "calibration":
        raise ValueError("calibration needs rows of the calibration role")
    residuals = df.select(F.abs(finite(truth) - finite(prediction)).alias("residual"))
    refused = refused_residuals(residuals, "residual").first()["refused"]
    if refused:
        raise ValueError(f"{refused} calibration rows lack a finite truth or prediction")
    return conformal_radius(residuals, "residual", alpha, minimum_rows)


def with_interval(df: DataFrame, prediction: str, radius: float | Column, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Symmetric bounds; null where the prediction is not finite."""
    p = finite(prediction)
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    return df.withColumns({lower: p - r, upper: p + r})


def unusable_predictions(df: DataFrame, prediction: str) -> DataFrame:
    return df.agg(F.count_if(~is_finite(prediction)).alias("refused"))


def _usable() -> Column:
    lower, upper = number("lower"), number("upper")
    return F.coalesce(is_finite("truth") & (lower <= upper), F.lit(False))


def interval_report(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Coverage and widths of ``(truth, lower, upper)``; infinite bounds are usable rows.

    The exact median width comes from value counts: with one radius there are few widths.
    """
    keys = keys or []
    width = F.col("upper") - F.col("lower")
    covered = (F.col("truth") >= F.col("lower")) & (F.col("truth") <= F.col("upper"))
    marked = df.withColumn("usable", _usable()).withColumn("width", F.when(F.col("usable"), width))
    report = marked.groupBy(*keys).agg(
        F.count_if("usable").alias("n"),
        F.count_if(~F.col("usable")).alias("n_omitted"),
        F.avg(F.when(F.col("usable"), covered.cast("double"))).alias("coverage"),
        F.avg("width").alias("mean_width"),
    )
    ranked = marked.filter("usable").select(*keys, "width")
    medians = linear_quantiles(ranked, "width", [0.5], keys).withColumnRenamed("q0", "median_width")
    # Two infinite neighbours interpolate to NaN; their median is infinite.
    medians = medians.withColumn(
        "median_width", F.when(F.isnan("median_width"), F.lit(float("inf"))).otherwise(F.col("median_width"))
    )
    if keys:
        return report.join(medians, keys, "left")
    one = F.lit(1).alias("one")
    return report.select("*", one).join(medians.select("*", one), "one", "left").drop("one")


def subgroup_interval_report(df: DataFrame, dimensions: Mapping[str, str | Column]) -> DataFrame:
    return interval_report(by_subgroup(df, dimensions), ["subgroup_type", "subgroup"])


def coverage_report(
    df: DataFrame, truth: str, prediction: str, radius: float, alpha: float, dimensions: Mapping[str, str | Column] | None = None
) -> DataFrame:
    """Overall row (``subgroup_type`` overall) and the subgroups, beside the nominal coverage."""
    base = with_interval(df.withColumn("truth", finite(truth)), prediction, radius)
    report = subgroup_interval_report(base, {"overall": F.lit("all"), **(dimensions or {})})
    return report.withColumn("nominal_coverage", F.lit(1.0 - alpha))
