"""Moist-air and wind relations, component targets and their inversion.

An input outside a relation's domain gives null; ``domain_violations`` counts such rows
where a caller wants to refuse them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .basic import as_column, between, clamp, finite, is_finite, number

# Magnus coefficients (kPa, 1, degrees Celsius).
MAGNUS_SCALE, MAGNUS_SLOPE, MAGNUS_OFFSET = 0.61094, 17.625, 243.04

# Names of the four component targets.
AIR_DELTA = "local_minus_background_air_temperature_c"
VAPOR_PRESSURE = "local_vapor_pressure_kpa"
WIND_ADJUSTMENT = "pedestrian_wind_log_adjustment"
RADIANT_DELTA = "mrt_minus_local_air_temperature_c"
COMPONENT_TARGETS = (AIR_DELTA, VAPOR_PRESSURE, WIND_ADJUSTMENT, RADIANT_DELTA)


def _magnus(t: Column) -> Column:
    return F.lit(MAGNUS_SCALE) * F.exp(F.lit(MAGNUS_SLOPE) * t / (t + F.lit(MAGNUS_OFFSET)))


def saturation_vapor_pressure(air_temperature) -> Column:
    t = finite(air_temperature)
    return F.when(t > F.lit(-MAGNUS_OFFSET), _magnus(t))


def vapor_pressure_from_humidity(air_temperature, humidity, validate: bool = True) -> Column:
    rh = finite(humidity)
    value = saturation_vapor_pressure(air_temperature) * rh / F.lit(100.0)
    return F.when(between(rh, 0.0, 100.0), value) if validate else value


def humidity_from_vapor_pressure(air_temperature, vapor_pressure, clip: bool = False) -> Column:
    rh = F.lit(100.0) * finite(vapor_pressure) / saturation_vapor_pressure(air_temperature)
    return F.when(rh.isNotNull(), clamp(rh, 0.0, 100.0)) if clip else rh


def wind_log_ratio(local_wind, background_wind) -> Column:
    local, background = finite(local_wind), finite(background_wind)
    return F.when((local >= 0) & (background >= 0), F.log1p(local) - F.log1p(background))


def wind_from_log_ratio(adjustment, background_wind) -> Column:
    """Negative reconstructions are kept: they signal an invalid model output."""
    background = finite(background_wind)
    return F.when(background >= 0, F.expm1(finite(adjustment) + F.log1p(background)))


def domain_violations(df: DataFrame, **results: Column) -> DataFrame:
    """One row with, per named expression, the number of rows for which it is null."""
    return df.agg(*[F.count_if(expr.isNull()).alias(name) for name, expr in results.items()])


def heat_index(air_temperature, humidity) -> Column:
    """US National Weather Service heat index in degrees Celsius."""
    rh = number(humidity)
    f = number(air_temperature) * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)
    simple = (F.lit(0.5) * (f + 61.0 + (f - 68.0) * 1.2 + rh * 0.094) + f) / 2.0
    # Rothfusz regression coefficients.
    full = (
        F.lit(-42.379) + 2.04901523 * f + 10.14333127 * rh - 0.22475541 * f * rh
        - 0.00683783 * f * f - 0.05481717 * rh * rh + 0.00122874 * f * f * rh
        + 0.00085282 * f * rh * rh - 0.00000199 * f * f * rh * rh
    )
    dry = (F.lit(13.0) - rh) / 4.0 * F.sqrt(F.greatest(F.lit(0.0), (F.lit(17.0) - F.abs(f - 95.0)) / 17.0))
    humid = (rh - 85.0) / 10.0 * ((F.lit(87.0) - f) / 5.0)
    adjusted = (
        F.when((rh < 13) & (f >= 80) & (f <= 112), full - dry)
        .when((rh > 85) & (f >= 80) & (f <= 87), full + humid)
        .otherwise(full)
    )
    result = (F.when(simple < 80, simple).otherwise(adjusted) - 32.0) * 5.0 / 9.0
    return F.when(between(rh, 0.0, 100.0), result)


@dataclass(frozen=True)
class ComponentColumns:
    """Source columns of the component targets."""

    local_air: str = "measured_air_temperature_c"
    local_humidity: str = "measured_relative_humidity_pct"
    local_wind: str = "measured_pedestrian_wind_speed_m_s"
    radiant: str = "calculated_mrt_c"
    background_air: str = "background_air_temperature_c"
    background_wind: str = "background_wind_speed_m_s"


def component_targets(columns: ComponentColumns = ComponentColumns()) -> dict[str, Column]:
    """The four target expressions by name; null where a source value is invalid."""
    air = finite(columns.local_air)
    return {
        AIR_DELTA: air - finite(columns.background_air),
        VAPOR_PRESSURE: vapor_pressure_from_humidity(columns.local_air, columns.local_humidity),
        WIND_ADJUSTMENT: wind_log_ratio(columns.local_wind, columns.background_wind),
        RADIANT_DELTA: finite(columns.radiant) - air,
    }


@dataclass(frozen=True)
class PlausibleBounds:
    """Limits that only flag a reconstruction; nothing is clipped."""

    air: tuple[float, float] = (-50.0, 65.0)
    humidity: tuple[float, float] = (0.0, 100.0)
    wind: tuple[float, float] = (0.0, 40.0)
    radiant: tuple[float, float] = (-70.0, 120.0)

    def __post_init__(self) -> None:
        for low, high in (self.air, self.humidity, self.wind, self.radiant):
            if not (abs(low) < float("inf") and abs(high) < float("inf") and low < high):
                raise ValueError("bounds must be finite and increasing")


def with_reconstruction(
    df: DataFrame,
    background_air: str = "background_air_temperature_c",
    background_wind: str = "background_wind_speed_m_s",
    predicted: Sequence[str] = COMPONENT_TARGETS,
    bounds: PlausibleBounds = PlausibleBounds(),
) -> DataFrame:
    """Add raw, masked and per-variable valid columns rebuilt from four predictions."""
    air_delta, vapor, wind_delta, radiant_delta = (number(c) for c in predicted)
    base = df.withColumns(
        {
            "predicted_air_temperature_delta_c_raw": air_delta,
            "predicted_local_vapor_pressure_kpa_raw": vapor,
            "predicted_wind_log_adjustment_raw": wind_delta,
            "predicted_mrt_delta_c_raw": radiant_delta,
            "local_air_temperature_c_raw": number(background_air) + air_delta,
            "pedestrian_wind_m_s_raw": F.expm1(wind_delta + F.log1p(number(background_wind))),
        }
    )
    air = F.col("local_air_temperature_c_raw")
    # Pole of the Magnus form: no saturation value there.
    saturation = F.when(air != F.lit(-MAGNUS_OFFSET), _magnus(air))
    base = base.withColumns(
        {
            "relative_humidity_percent_raw": F.when(
                saturation > 0,
                F.lit(100.0) * F.col("predicted_local_vapor_pressure_kpa_raw") / saturation,
            ),
            "mean_radiant_temperature_c_raw": air + F.col("predicted_mrt_delta_c_raw"),
        }
    )
    vapor = F.col("predicted_local_vapor_pressure_kpa_raw")

    def inside(name: str, limits: tuple[float, float]) -> Column:
        return F.coalesce(is_finite(name) & between(F.col(name), *limits), F.lit(False))

    base = base.withColumns(
        {
            "air_temperature_valid": inside("local_air_temperature_c_raw", bounds.air),
            "vapor_pressure_valid": F.coalesce(
                is_finite(vapor) & is_finite(saturation) & (vapor >= 0) & (vapor <= saturation), F.lit(False)
            ),
            "relative_humidity_valid": inside("relative_humidity_percent_raw", bounds.humidity),
            "pedestrian_wind_valid": inside("pedestrian_wind_m_s_raw", bounds.wind),
            "mean_radiant_temperature_valid": inside("mean_radiant_temperature_c_raw", bounds.radiant),
        }
    )
    masks = {
        "local_air_temperature_c": ("air_temperature_valid", "local_air_temperature_c_raw"),
        # Replaces a prediction column of the same name; its value stays in the raw column.
        "local_vapor_pressure_kpa": ("vapor_pressure_valid", "predicted_local_vapor_pressure_kpa_raw"),
        "relative_humidity_percent": ("relative_humidity_valid", "relative_humidity_percent_raw"),
        "pedestrian_wind_m_s": ("pedestrian_wind_valid", "pedestrian_wind_m_s_raw"),
        "mean_radiant_temperature_c": ("mean_radiant_temperature_valid", "mean_radiant_temperature_c_raw"),
    }
    all_valid = F.lit(True)
    for valid in [
        "air_temperature_valid", "vapor_pressure_valid", "relative_humidity_valid",
        "pedestrian_wind_valid", "mean_radiant_temperature_valid",
    ]:
        all_valid = all_valid & F.col(valid)
    return base.withColumns(
        {
            **{name: F.when(F.col(ok), F.col(raw)) for name, (ok, raw) in masks.items()},
            "all_physical_values_valid": all_valid,
        }
    )


@dataclass(frozen=True)
class WindProfile:
    """Expressions of a neutral logarithmic profile to ten metres."""

    speed: Column
    applicable: Column
    flags: Column
    sensitivity: Column


TARGET_HEIGHT_M = 10.0


def wind_to_ten_metres(
    wind,
    height,
    roughness=0.1,
    displacement=0.0,
    neutral=True,
    minimum_height: float | None = None,
    maximum_height: float | None = None,
    sensitivity_roughness: Sequence[float] = (),
) -> WindProfile:
    """Neutral log-profile wind at ten metres with ordered flags and, per alternative
    roughness, the value it would give. A failed check makes the speed null."""
    for limit in (minimum_height, maximum_height):
        if limit is not None and not abs(limit) < float("inf"):
            raise ValueError("configured heights must be finite")
    if minimum_height is not None and maximum_height is not None and minimum_height > maximum_height:
        raise ValueError("the minimum height exceeds the maximum height")
    u, z, z0, d = finite(wind), finite(height), finite(roughness), finite(displacement)
    neutral = as_column(neutral) if not isinstance(neutral, bool) else F.lit(neutral)
    top = F.lit(TARGET_HEIGHT_M)

    def speed_for(rough: Column) -> Column:
        return u * (F.ln((top - d) / rough) / F.ln((z - d) / rough))

    complete = u.isNotNull() & z.isNotNull() & z0.isNotNull() & d.isNotNull()
    never = F.lit(False)
    checks = F.array_compact(
        F.array(
            F.when(u < 0, F.lit("negative_wind_speed")),
            F.when(z <= d, F.lit("measurement_not_above_displacement")),
            F.when(z < minimum_height if minimum_height is not None else never,
                   F.lit("measurement_below_configured_minimum")),
            F.when(z > maximum_height if maximum_height is not None else never,
                   F.lit("measurement_above_configured_maximum")),
            F.when(d >= top, F.lit("target_not_above_displacement")),
            F.when(z0 <= 0, F.lit("nonpositive_roughness_length"))
            .when(z - d <= z0, F.lit("measurement_not_above_roughness_sublayer"))
            .when(top - d <= z0, F.lit("target_not_above_roughness_sublayer")),
            F.when(~neutral, F.lit("neutral_stability_not_applicable")),
        )
    )
    flags = F.when(complete, checks).otherwise(F.array(F.lit("non_finite_input")))
    applicable = F.size(flags) == 0
    candidates = [float(c) for c in sensitivity_roughness if 0.0 < float(c) < float("inf")]
    entries = [
        F.when(
            applicable & (z - d > F.lit(c)) & (top - d > F.lit(c)),
            F.struct(F.lit(c).alias("roughness"), speed_for(F.lit(c)).alias("speed")),
        )
        for c in dict.fromkeys(candidates)
    ]
    empty = F.array().cast("array<struct<roughness:double,speed:double>>")
    sensitivity = F.map_from_entries(F.array_compact(F.array(*entries)) if entries else empty)
    return WindProfile(F.when(applicable, speed_for(z0)), applicable, flags, sensitivity)


