"""Queries for readers and table-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.predictors import PredictorPolicy
from ...operators import quality
from ...sources.tables import read_table
from .registry import FAULTY, faulty, r6, register

POLICY = PredictorPolicy(
    core=(
        "background_air_temperature_c", "background_dew_point_c", "background_relative_humidity_pct",
        "background_wind_speed_m_s", "ndvi", "albedo_proxy", "land_cover_class", "elevation_m", "hour_sin", "hour_cos",
    ),
    additions=("satellite_lst_c", "satellite_lst_missing", "satellite_image_age_hours", "satellite_cloud_fraction",
               "satellite_thermal_source", "satellite_lst_quality_flag",
               "satellite_overpass_hour_sin", "satellite_overpass_hour_cos"),
)
RULES = quality.QualityRules(policy=POLICY, strict_columns=False)

# Column and SQL predicate of its bad rows, by rule.
TEXT = ["sample_id", "site_id", "date", "timestamp_utc", "weather_event_id", "quality_flag", "utci_category",
        "land_cover_class", "satellite_thermal_source", "satellite_lst_quality_flag", "sensor_id",
        "calibration_version", "split_role", "elevation_m"]
NON_NULL_TEXT = ["sample_id", "site_id", "date", "timestamp_utc", "sensor_id", "calibration_version",
                 "quality_flag", "split_role", "utci_category"]
NON_NULL_NUMBER = ["latitude", "longitude", "measurement_height_m", "measured_air_temperature_c",
                   "measured_relative_humidity_pct", "measured_pedestrian_wind_speed_m_s", "calculated_mrt_c",
                   "calculated_utci_c"]
LIMITS = {
    "latitude": (-90, 90), "longitude": (-180, 180), "measurement_height_m": ("5e-324", 50),
    "measured_air_temperature_c": (-50, 65), "measured_relative_humidity_pct": (0, 100),
    "measured_pedestrian_wind_speed_m_s": (0, 40), "calculated_mrt_c": (-70, 120), "calculated_utci_c": (-100, 100),
    "background_air_temperature_c": (-80, 65), "background_dew_point_c": (-80, 65),
    "background_relative_humidity_pct": (0, 100), "background_wind_speed_m_s": (0, 75),
    "background_shortwave_radiation_w_m2": (0, 1400), "estimated_shade_fraction": (0, 1), "canopy_fraction": (0, 1),
    "distance_to_coast_m": (0, 5000000), "hour_sin": (-1, 1), "hour_cos": (-1, 1), "satellite_lst_c": (-80, 100),
    "satellite_lst_missing": (0, 1), "satellite_image_age_hours": (0, None), "satellite_cloud_fraction": (0, 1),
    "satellite_overpass_hour_sin": (-1, 1), "satellite_overpass_hour_cos": (-1, 1), "elevation_m": (-500, 9000),
    "albedo_proxy": (0, 1), "ndvi": (-1, 1),
}


def _num(c: str) -> str:
    return f"(case when not isnan(try_cast({c} as double)) then try_cast({c} as double) end)"


def _outside(c: str, low, high) -> str:
    tests = []
    if low is not None:
        tests.append(f"{_num(c)} < cast({low} as double)" if low != "5e-324" else f"{_num(c)} <= 0")
    if high is not None:
        tests.append(f"{_num(c)} > {high}")
    return " or ".join(tests)


ROLE_SET = "('unassigned', 'development', 'calibration', 'final_test')"
COVER_SET = ("('built_up', 'tree_canopy', 'low_vegetation', 'bare_ground', 'water', 'wetland', 'agriculture', "
             "'mixed', 'other', 'unknown')")
LABEL_SET = "('no_heat_stress', 'moderate', 'strong', 'very_strong', 'extreme')"
DERIVED = ("case when calculated_utci_c < 26 then 'no_heat_stress' when calculated_utci_c < 32 then 'moderate' "
           "when calculated_utci_c < 38 then 'strong' when calculated_utci_c < 46 then 'very_strong' else 'extreme' end")
STAMP = "try_cast(replace(timestamp_utc, 'Z', '+00:00') as timestamptz) is not null"
ZONE = r"regexp_matches(timestamp_utc, '\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$')"
ZERO = r"regexp_matches(timestamp_utc, '(Z|[+-]00:?00)$')"

BAD_ROWS: dict[str, list[tuple[str, str]]] = {
    "missing_nonnullable": [(c, f"{c} is null or trim({c}) = ''") for c in NON_NULL_TEXT]
    + [(c, f"{c} is null or isnan({c})") for c in NON_NULL_NUMBER],
    "textual_missing_sentinel": [
        (c, f"regexp_full_match(lower(trim({c})), '-?9999(\\.0)?|missing|null|n/?a')") for c in TEXT
    ],
    "wrong_dtype": [("elevation_m", "elevation_m is not null and try_cast(elevation_m as double) is null")],
    "nonfinite_numeric": [(c, f"isinf(try_cast({c} as double))") for c in LIMITS if c != "satellite_lst_missing"],
    "physical_range": [(c, _outside(c, *b)) for c, b in LIMITS.items()],
    "invalid_binary_indicator": [("satellite_lst_missing", "satellite_lst_missing not in (0, 1)")],
    "invalid_timestamp": [("timestamp_utc", f"not ({STAMP})")],
    "naive_timestamp": [("timestamp_utc", f"{STAMP} and not {ZONE}")],
    "non_utc_timestamp": [("timestamp_utc", f"{STAMP} and {ZONE} and not {ZERO}")],
    "invalid_local_date": [("date", "coalesce(strftime(try_cast(date as date), '%Y-%m-%d'), '') <> date")],
    "invalid_split_role": [("split_role", f"split_role not in {ROLE_SET}")],
    "invalid_quality_flag": [("quality_flag", "lower(trim(quality_flag)) not in ('pass', 'suspect', 'fail')")],
    "invalid_land_cover_class": [("land_cover_class", f"land_cover_class not in {COVER_SET}")],
    "invalid_utci_category": [("utci_category", f"utci_category not in {LABEL_SET}")],
    "category_threshold_mismatch": [("utci_category", f"utci_category <> {DERIVED}")],
    "dew_point_above_air_temperature": [
        ("background_dew_point_c", "background_dew_point_c > background_air_temperature_c + 1")
    ],
    "cyclic_pair_norm": [
        (a, f"not sqrt({a} * {a} + {b} * {b}) between 0.95 and 1.05")
        for a, b in (("hour_sin", "hour_cos"), ("satellite_overpass_hour_sin", "satellite_overpass_hour_cos"))
    ],
    "satellite_missingness_mismatch": [
        ("satellite_lst_missing", "(satellite_lst_c is null) <> (satellite_lst_missing = 1)")
    ],
}


def _counts(code: str):
    def run(spark, sf_dir):
        df = faulty(spark, sf_dir)
        rules = [r for r in quality.row_rules(df, RULES) if r.code == code]
        return quality.rule_counts(df, rules).select("column_name", "row_count")

    return run


for _code, _rules in BAD_ROWS.items():
    _cells = " union all ".join(
        f"select '{c}' as column_name, count(*) filter (where {p}) as row_count from obs" for c, p in _rules
    )
    register(f"quality_{_code}", _counts(_code), f"{FAULTY} {_cells}")


register(
    "quality_empty_table",
    lambda s, d: quality.empty_table(faulty(s, d).where("latitude > 90")).unionByName(quality.empty_table(faulty(s, d).where("latitude > 1e9")))
    .select("code", "row_count"),
    f"{FAULTY} select 'empty_table' as code, n as row_count from (select count(*) as n from obs where latitude > 90 union all "
    "select count(*) from obs where latitude > 1e9) where n = 0",
)

MISSING = list(POLICY.core)
_MISSING_SQL = " union all ".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null"
    + (f" or isnan({c})" if c not in ("land_cover_class", "elevation_m") else "")
    + f") as missing, count(*) as n from obs" for c in MISSING
)
register(
    "quality_missing_fraction",
    lambda s, d: quality.missing_fractions(faulty(s, d), MISSING).select(
        "column_name", "missing", r6("fraction").alias("fraction")),
    f"{FAULTY} select column_name, missing, round(missing / n, 6) + 0e0 as fraction from ({_MISSING_SQL})",
)
register(
    "quality_predictor_missingness",
    lambda s, d: quality.missingness_issues(faulty(s, d), RULES).select("severity", "code", "column_name", "row_count"),
    f"{FAULTY} select case when f < 0.8 then 'warning' else 'error' end as severity, "
    "case when f >= 1 then 'all_missing_predictor' when f >= 0.8 then 'excessive_predictor_missingness' "
    "else 'high_predictor_missingness' end as code, column_name, missing as row_count "
    f"from (select *, missing / n as f from ({_MISSING_SQL})) where f >= 0.2",
)
register(
    "quality_duplicate_sample_id",
    lambda s, d: quality.duplicate_members(faulty(s, d), ["sample_id"]),
    f"{FAULTY} select sample_id, count(*) as members from obs where sample_id is not null group by 1 having count(*) > 1",
)
register(
    "quality_duplicate_site_timestamp",
    lambda s, d: quality.duplicate_members(faulty(s, d), ["site_id", "timestamp_utc"], drop_null_keys=False),
    f"{FAULTY} select site_id, timestamp_utc, count(*) as members from obs group by 1, 2 having count(*) > 1",
)

_ALL_ISSUES = " union all ".join(
    f"select '{'warning' if code == 'cyclic_pair_norm' else 'error'}' as severity, '{code}' as code, "
    f"'{c}' as column_name, count(*) filter (where {p}) as row_count from obs"
    for code, rules in BAD_ROWS.items() for c, p in rules
)
_EVERY = (
    f"{FAULTY}, found as ({_ALL_ISSUES} union all "
    "select case when f < 0.8 then 'warning' else 'error' end, case when f >= 1 then 'all_missing_predictor' "
    "when f >= 0.8 then 'excessive_predictor_missingness' else 'high_predictor_missingness' end, column_name, missing "
    f"from (select *, missing / n as f from ({_MISSING_SQL})) where f >= 0.2 union all "
    "select 'error', 'duplicate_sample_id', 'sample_id', cast(coalesce(sum(m), 0) as bigint) from "
    "(select count(*) as m from obs group by sample_id having count(*) > 1) union all "
    "select 'warning', 'duplicate_site_timestamp', 'site_id,timestamp_utc', cast(coalesce(sum(m), 0) as bigint) from "
    "(select count(*) as m from obs group by site_id, timestamp_utc having count(*) > 1))"
)


def _row_issues(spark, sf_dir):
    return quality.validate(faulty(spark, sf_dir), RULES).select("severity", "code", "column_name", "row_count")


# Findings about the columns of the view itself.
_STATIC = ("select 'error' as severity, 'missing_required_column' as code, 'label_uncertainty_c' as column_name, cast(null as bigint) as row_count union all "
           "select 'error', 'missing_required_column', 'measured_globe_temperature_c', null union all "
           "select 'warning', 'spatial_block_not_yet_assigned', 'spatial_block_id', null")
_EVERY += f", every as (select * from found where row_count > 0 union all {_STATIC})"

register("quality_all_row_rules", _row_issues, f"{_EVERY} select * from every")
register(
    "quality_summary",
    lambda s, d: quality.summary(_row_issues(s, d)),
    f"{_EVERY} select count(*) filter (where severity = 'error') as error_count, "
    "count(*) filter (where severity = 'warning') as warning_count, "
    "count(*) filter (where severity = 'error') = 0 as is_valid from every",
)


def _examples(spark, sf_dir):
    df = faulty(spark, sf_dir)
    return quality.examples(df, quality.failing(df, quality.row_rules(df, RULES))).select("code", "column_name", "sample_id", "position")


_EXAMPLE_ROWS = " union all ".join(
    f"select '{code}' as code, '{c}' as column_name, sample_id, ts_order from keyed as obs where {p}"
    for code, rules in BAD_ROWS.items() for c, p in rules
)
register(
    "quality_examples", _examples,
    f"{FAULTY}, keyed as (select *, 0 as ts_order from obs), bad as ({_EXAMPLE_ROWS}) "
    "select code, column_name, sample_id, cast(position as int) as position from (select *, row_number() over "
    "(partition by code, column_name order by sample_id) as position from bad) where position <= 3",
)
# Schema and row findings together; unit and name rules have no SQL twin.
register(
    "quality_validate",
    lambda s, d: quality.validate(
        faulty(s, d), quality.QualityRules(policy=POLICY), {"latitude": "metre", "longitude": "deg"}
    ),
)


# ------------------------------------------------------------------------------ readers

def _orders(spark, sf_dir):
    df = read_table(spark, f"{sf_dir}/orders.parquet", ["o_orderstatus", "o_totalprice"])
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r6(F.max("o_totalprice")).alias("top"))


register(
    "source_read_parquet", _orders,
    "select o_orderstatus, count(*) as n, round(max(o_totalprice), 6) + 0e0 as top from orders group by 1",
)
