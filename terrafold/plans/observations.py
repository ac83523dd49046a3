"""Observation table derived from the ``events`` table.

Integer arithmetic on the event and user ids, without random draws; the text is valid in
Spark and in DuckDB, so queries and their SQL twins read the same rows. One row per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOUR = "(event_id % 24 + 5e-1)"
AIR = "15e0 + (event_id * 37 % 300) / 1e1"
LOCAL_AIR = f"({AIR} + (event_id % 7 - 3) / 1e1)"
UTCI = "18e0 + (event_id * 53 % 350) / 1e1"

OBSERVATION_COLUMNS: dict[str, str] = {
    "sample_id": "cast(event_id as string)",
    "site_id": "cast(user_id as string)",
    "date": "cast(cast(ts as date) as string)",
    "timestamp_utc": "concat(cast(cast(ts as date) as string), 'T12:00:00Z')",
    "longitude": "-122e0 + (user_id % 50) * 2e-2",
    "latitude": "375e-1 + floor(user_id / 50e0) * 2e-2",
    "weather_event_id": "case when day(ts) % 4 = 0 then null "
                        "else concat('w', cast(cast(floor((day(ts) - 1) / 2e0) as int) as string)) end",
    "quality_flag": "case when event_id % 29 = 0 then ' Suspect' else 'pass' end",
    "measurement_height_m": "case when event_id % 41 = 0 then 12e0 when event_id % 43 = 0 then 5e-2 else 2e0 end",
    "roughness_m": "case when event_id % 47 = 0 then 0e0 when event_id % 37 = 0 then 25e-1 else 1e-1 end",
    "neutral": "event_id % 31 <> 0",
    "background_air_temperature_c": AIR,
    "background_dew_point_c": f"{AIR} - (event_id * 11 % 100) / 1e1 + case when event_id % 53 = 0 then 15e0 else 0e0 end",
    "background_relative_humidity_pct": "case when event_id % 17 = 0 then null else cast(event_id * 13 % 101 as double) end",
    "background_wind_speed_m_s": "(event_id * 29 % 120) / 1e1",
    "background_shortwave_radiation_w_m2": "(event_id * 61 % 1100) * 1e0",
    "measured_air_temperature_c": LOCAL_AIR,
    "measured_relative_humidity_pct": "cast(event_id * 19 % 101 as double)",
    "measured_pedestrian_wind_speed_m_s": "case when event_id % 67 = 0 then -1e0 else (event_id * 23 % 120) / 2e1 end",
    "calculated_mrt_c": f"{LOCAL_AIR} + (event_id * 17 % 400) / 1e1 - 5e0",
    "calculated_utci_c": UTCI,
    "utci_category": f"case when event_id % 211 = 0 then 'strong' when {UTCI} < 26 then 'no_heat_stress' "
                     f"when {UTCI} < 32 then 'moderate' when {UTCI} < 38 then 'strong' "
                     f"when {UTCI} < 46 then 'very_strong' else 'extreme' end",
    "direct_core": f"case when event_id % 101 = 0 then cast('NaN' as double) "
                   f"else {UTCI} + (event_id * 31 % 41 - 20) / 1e1 end",
    "component_utci_c": f"case when event_id % 13 = 0 then null else {UTCI} + (event_id * 47 % 61 - 30) / 1e1 end",
    "estimated_shade_fraction": "case when event_id % 19 = 0 then null else (event_id * 7 % 101) / 1e2 end",
    "canopy_fraction": "(event_id * 43 % 101) / 1e2",
    "distance_to_coast_m": "case when event_id % 23 = 0 then null when event_id % 31 = 0 then -5e0 "
                           "else (event_id * 97 % 40000) * 1e0 end",
    "land_cover_class": "case event_id % 6 when 0 then 'built_up' when 1 then 'tree_canopy' when 2 then 'water' "
                        "when 4 then 'mixed' when 5 then 'unknown' end",
    "hour_sin": f"sin(2e0 * pi() * {HOUR} / 24e0)",
    "hour_cos": f"cos(2e0 * pi() * {HOUR} / 24e0)",
    "satellite_lst_c": "case when event_id % 5 = 0 then null else 20e0 + (event_id * 41 % 300) / 1e1 end",
    "satellite_lst_missing": "case when event_id % 59 = 0 then 0 when event_id % 5 = 0 then 1 else 0 end",
    "satellite_image_age_hours": "(event_id * 3 % 100) * 1e0",
    "satellite_thermal_source": "case event_id % 4 when 0 then 'landsat' when 1 then 'ECOSTRESS ' when 2 then 'modis' "
                                "else 'Landsat' end",
    "satellite_lst_quality_flag": "case event_id % 3 when 0 then 'good' when 1 then ' Acceptable' else 'poor' end",
    "satellite_cloud_fraction": "(event_id % 50) / 1e2",
    "satellite_overpass_hour_sin": f"sin(2e0 * pi() * {HOUR} / 24e0)",
    "satellite_overpass_hour_cos": f"cos(2e0 * pi() * {HOUR} / 24e0)",
}

# The same rows with faults that the quality rules must find.
FAULTS: dict[str, str] = {
    "sample_id": "case when event_id % 97 = 1 then cast(event_id - 1 as string) else cast(event_id as string) end",
    "date": "case when event_id % 71 = 0 then concat(cast(cast(ts as date) as string), ' 00:00') "
            "when event_id % 73 = 0 then '2024-02-30' else cast(cast(ts as date) as string) end",
    "timestamp_utc": "case when event_id % 61 = 0 then 'noon' when event_id % 59 = 0 "
                     "then concat(cast(cast(ts as date) as string), 'T12:00:00') when event_id % 67 = 0 "
                     "then concat(cast(cast(ts as date) as string), 'T12:00:00+02:00') "
                     "else concat(cast(cast(ts as date) as string), 'T12:00:00Z') end",
    "sensor_id": "case when event_id % 83 = 0 then ' ' when event_id % 89 = 0 then null else 's1' end",
    "calibration_version": "case when event_id % 79 = 0 then ' N/A ' when event_id % 103 = 0 then '-9999.0' else 'v1' end",
    "quality_flag": "case when event_id % 37 = 0 then 'odd' when event_id % 29 = 0 then ' Suspect' else 'pass' end",
    "split_role": "case when event_id % 41 = 0 then 'holdout' else 'unassigned' end",
    "land_cover_class": "case when event_id % 43 = 0 then 'lava' when event_id % 3 = 0 then null else 'water' end",
    "utci_category": "case when event_id % 47 = 0 then 'mild' when event_id % 211 = 0 then 'strong' "
                     f"when {UTCI} < 26 then 'no_heat_stress' when {UTCI} < 32 then 'moderate' "
                     f"when {UTCI} < 38 then 'strong' when {UTCI} < 46 then 'very_strong' else 'extreme' end",
    "background_relative_humidity_pct": "case when event_id % 53 = 0 then 120e0 when event_id % 57 = 0 "
                                        "then cast('NaN' as double) when event_id % 4 = 0 then null "
                                        "else cast(event_id * 13 % 101 as double) end",
    "background_wind_speed_m_s": "case when event_id % 91 = 0 then cast('Infinity' as double) "
                                 "else (event_id * 29 % 120) / 1e1 end",
    "elevation_m": "case when event_id % 93 = 0 then '12 m' when event_id % 87 = 0 then null "
                   "else cast(event_id % 900 as string) end",
    "albedo_proxy": "cast(null as double)",
    "ndvi": "case when event_id % 10 = 0 then 5e-1 else null end",
    "hour_sin": f"case when event_id % 77 = 0 then 2e-1 else sin(2e0 * pi() * {HOUR} / 24e0) end",
    "satellite_lst_missing": "case when event_id % 107 = 0 then 2 when event_id % 59 = 0 then 0 "
                             "when event_id % 5 = 0 then 1 else 0 end",
}


def observation_columns(faulty: bool = False) -> dict[str, str]:
    return {**OBSERVATION_COLUMNS, **FAULTS} if faulty else dict(OBSERVATION_COLUMNS)


def observation_sql(faulty: bool = False, table: str = "events") -> str:
    """The view as SQL text."""
    columns = ", ".join(f"{e} as {n}" for n, e in observation_columns(faulty).items())
    return f"select {columns} from {table}"


def observations(spark: SparkSession, sf_dir: str, faulty: bool = False) -> DataFrame:
    """The view as a DataFrame over ``events.parquet``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*[f"{e} as {n}" for n, e in observation_columns(faulty).items()])
