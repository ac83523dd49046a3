"""Evaluation of a prediction table against its observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import number
from ..functions.heat import coast_distance_group, local_hour, sun_shade_group, time_of_day_group
from ..operators.bootstrap import WEIGHTINGS, block_bootstraps
from ..operators.joins import AlignmentError, join_predictions
from ..operators.metrics import full_report, identical_rows_report, long_predictions, subgroup_report, support_mismatches

DIRECT_COLUMNS = (
    "direct_core", "direct_satellite_enhanced", "direct_core_eligible",
    "direct_core_heat_weighted_secondary", "component_utci_c",
)


def prediction_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in DIRECT_COLUMNS or c.startswith("baseline_")]


def reporting_dimensions(columns: Sequence[str], negative_coast_is_missing: bool = False) -> dict[str, Column]:
    """Subgroup expressions for the columns a table has; stored groups come before derived ones."""
    out: dict[str, Column] = {}
    shade = sun_shade_group(columns, "sun_shade_group", "estimated_shade_fraction")
    if shade is not None:
        out["sun_vs_shade"] = shade
    if "land_cover_class" in columns:
        out["land_cover"] = F.col("land_cover_class")
    if "coast_distance_group" in columns:
        out["coast_distance"] = F.col("coast_distance_group")
    elif "distance_to_coast_m" in columns:
        out["coast_distance"] = coast_distance_group(
            number("distance_to_coast_m") / F.lit(1000.0), negative_is_missing=negative_coast_is_missing
        )
    if "time_of_day_group" in columns:
        out["time_of_day"] = F.col("time_of_day_group")
    elif {"hour_sin", "hour_cos"} <= set(columns):
        out["time_of_day"] = time_of_day_group(local_hour("hour_sin", "hour_cos"))
    return out


@dataclass(frozen=True)
class Evaluation:
    """Report tables of one evaluation."""

    joined: DataFrame
    metrics: DataFrame
    subgroups: DataFrame
    paired: DataFrame | None
    bootstrap: Mapping[str, DataFrame]


def evaluate(
    observations: DataFrame,
    predictions: DataFrame,
    target: str = "calculated_utci_c",
    id_column: str = "sample_id",
    block_column: str = "spatial_block_id",
    replicates: int = 2000,
    seed: int = 2026,
) -> Evaluation:
    """Exact id match, full metrics, subgroups, the identical-row comparison and four bootstraps."""
    joined = join_predictions(predictions, observations, id_column, target)
    models = prediction_columns(predictions.columns)
    dimensions = reporting_dimensions(joined.columns)
    named = {f"__{name}": expr for name, expr in dimensions.items()}
    long = long_predictions(joined.withColumns(named), target, models, list(named))
    # Dimension columns ride along; the reports read what they need from one scan each.
    metrics = full_report(long)
    groups = {name: f"__{name}" for name in dimensions}
    subgroups = subgroup_report(long, groups)
    if {"direct_satellite_enhanced", "direct_core_eligible"} <= set(models):
        if not support_mismatches(joined, "direct_satellite_enhanced", "direct_core_eligible").first()["identical"]:
            raise AlignmentError("enhanced and eligible-core predictions cover different rows")
    paired = None
    if {"direct_core", "component_utci_c"} <= set(models):
        paired = identical_rows_report(joined, target, ["direct_core", "component_utci_c"])
    bootstrap: dict[str, DataFrame] = {}
    needed = {"direct_core", "baseline_background_air_temperature", block_column, "site_id", "date"}
    if needed <= set(joined.columns):
        for name, location in (("spatial_day", block_column), ("site_day", "site_id")):
            found = block_bootstraps(
                joined, target, "direct_core", "baseline_background_air_temperature", [location, "date"],
                [("mae", weighting) for weighting in WEIGHTINGS], replicates, seed=seed,
            )
            bootstrap |= {f"{name}_{weighting}": table for (_, weighting), table in found.items()}
    return Evaluation(joined, metrics, subgroups, paired, bootstrap)
