"""Row-wise scoring of a table, batch or streaming: predictions, categories, intervals, warnings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basic import is_finite
from ..functions.heat import heat_category
from ..functions.physics import (
    COMPONENT_TARGETS,
    PlausibleBounds,
    heat_index,
    wind_to_ten_metres,
    with_reconstruction,
)
from ..functions.satellite import Eligibility, column_prediction, eligible
from ..functions.utci import thermal_index
from ..operators.diagnostics import extrapolation_count, with_disagreement
from ..operators.intervals import with_interval


@dataclass(frozen=True)
class WindSettings:
    """Neutral profile settings of the component estimate."""

    height_column: str = "measurement_height_m"
    roughness_m: float = 0.1
    displacement_m: float = 0.0
    neutral: bool = True
    minimum_height_m: float = 0.1
    maximum_height_m: float = 10.0
    sensitivity_m: Sequence[float] = (0.03, 0.1, 0.3, 0.5, 1.0)


def with_component_index(
    df: DataFrame, wind: WindSettings = WindSettings(), limits: Mapping[str, Sequence[float]] | None = None
) -> DataFrame:
    """Thermal index of reconstructed components; null unless every part is valid."""
    profile = wind_to_ten_metres(
        "pedestrian_wind_m_s_raw", wind.height_column, F.lit(wind.roughness_m), F.lit(wind.displacement_m),
        wind.neutral, wind.minimum_height_m, wind.maximum_height_m, wind.sensitivity_m,
    )
    usable = F.col("pedestrian_wind_valid")
    df = df.withColumns(
        {
            "wind_speed_10m_m_s_raw": F.when(usable, profile.speed),
            "wind_profile_applicable": usable & profile.applicable,
            "wind_profile_flags": F.when(usable, F.array_join(profile.flags, ";")).otherwise(
                F.lit("invalid_reconstructed_pedestrian_wind")
            ),
            "wind_speed_10m_sensitivity": F.when(usable, profile.sensitivity),
        }
    )
    index = thermal_index(
        "local_air_temperature_c_raw", "mean_radiant_temperature_c_raw", "wind_speed_10m_m_s_raw",
        "relative_humidity_percent_raw", limits=limits,
    )
    df = df.withColumn("__index", index)
    applicable = F.col("all_physical_values_valid") & F.col("wind_profile_applicable") & is_finite("__index")
    return df.withColumns(
        {"component_utci_c": F.when(applicable, F.col("__index")), "utci_applicable": applicable}
    ).drop("__index")


def with_components(
    df: DataFrame, bounds: PlausibleBounds = PlausibleBounds(), wind: WindSettings = WindSettings(),
    predicted: Sequence[str] = tuple(f"predicted_{c}" for c in COMPONENT_TARGETS), limits=None,
) -> DataFrame:
    """Reconstruction and component index from the four predicted columns."""
    return with_component_index(with_reconstruction(df, predicted=predicted, bounds=bounds), wind, limits)


def with_simple_baselines(df: DataFrame, rules: Eligibility | None = None) -> DataFrame:
    """Background air temperature, heat index, and the satellite value on eligible rows."""
    df = df.withColumns(
        {
            "baseline_background_air_temperature": column_prediction("background_air_temperature_c"),
            "baseline_heat_index": heat_index("background_air_temperature_c", "background_relative_humidity_pct"),
        }
    )
    if rules is not None:
        ok = eligible(df.columns, rules)
        df = df.withColumns(
            {"satellite_eligible": ok, "baseline_satellite_lst_alone": column_prediction(rules.value, ok)}
        )
    return df


@dataclass(frozen=True)
class ScoringPlan:
    """Frozen parts of a run that a scoring job applies."""

    direct: object
    components: object | None = None
    radius: float | None = None
    warning_threshold: float | None = None
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    anomaly: object | None = None
    wind: WindSettings = WindSettings()


def score(df: DataFrame, plan: ScoringPlan, id_column: str = "sample_id") -> DataFrame:
    """Operational predictions of a table without labels. No shuffle: also valid on a stream."""
    inputs = df.columns
    out = plan.direct.predict(df, "predicted_utci_c")
    out = out.withColumn("predicted_utci_category", heat_category("predicted_utci_c"))
    keep = [id_column, "predicted_utci_c", "predicted_utci_category"]
    if plan.components is not None:
        out = with_components(plan.components.predict(out), wind=plan.wind)
        keep += ["component_utci_c", "wind_profile_flags", "utci_applicable", "all_physical_values_valid"]
        if plan.warning_threshold is not None:
            out = with_disagreement(out, "predicted_utci_c", "component_utci_c", plan.warning_threshold)
            keep += ["absolute_disagreement_c", "disagreement_warning"]
    if plan.radius is not None:
        out = with_interval(out, "predicted_utci_c", plan.radius, "interval_lower_c", "interval_upper_c")
        keep += ["interval_lower_c", "interval_upper_c"]
    if plan.bounds:
        out = out.withColumn("feature_extrapolation_count", extrapolation_count(inputs, plan.bounds))
        keep.append("feature_extrapolation_count")
    if plan.anomaly is not None:
        out = plan.anomaly.score(out)
        keep += ["anomaly_score", "is_anomaly"]
    return out.select(*keep)


def score_eligible(df: DataFrame, model, rules: Eligibility = Eligibility(), id_column: str = "sample_id") -> DataFrame:
    """Predictions of the enhanced model on eligible rows; other rows stay with null."""
    ok = eligible(df.columns, rules)
    marked = df.withColumn("satellite_eligible", ok)
    scored = model.predict(marked, "__p")
    value = F.when(F.col("satellite_eligible"), F.col("__p"))
    return scored.select(
        id_column, "satellite_eligible", value.alias("predicted_utci_c"),
        heat_category(value).alias("predicted_utci_category"),
    )
