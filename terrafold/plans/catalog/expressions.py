"""Queries for row-wise expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import grid, heat, keys, physics, predictors, satellite, utci
from ...functions.basic import finite, number
from ...operators import diagnostics, intervals
from ...operators.quality import missing_fractions
from ..scoring import WindSettings, with_component_index, with_simple_baselines
from .registry import OBS, obs, r6, register, s6


def _project(columns, sql):
    """Query and twin of the form: sample_id plus expressions."""

    def run(spark, sf_dir):
        return obs(spark, sf_dir).select("sample_id", *[e().alias(n) for n, e in columns.items()])

    return run, f"{OBS} select sample_id, {sql} from obs"


def register_projection(name, columns, sql):
    register(name, *_project(columns, sql))


def category_sql(x: str) -> str:
    return (f"case when {x} is null or not isfinite({x}) then null when {x} < 26 then 'no_heat_stress' "
            f"when {x} < 32 then 'moderate' when {x} < 38 then 'strong' when {x} < 46 then 'very_strong' else 'extreme' end")


register_projection("expr_heat_category", {"category": lambda: heat.heat_category("direct_core")},
                    f"{category_sql('direct_core')} as category")

CHOSEN = predictors.PredictorPolicy(core=("hour_cos", "background_air_temperature_c", "land_cover_class", "canopy_fraction"))
register(
    "expr_select_predictors",
    lambda s, d: predictors.select_predictors(obs(s, d), CHOSEN, keep=["sample_id"]).withColumn("hour_cos", r6("hour_cos")),
    f"{OBS} select sample_id, round(hour_cos, 6) + 0e0 as hour_cos, background_air_temperature_c, land_cover_class, "
    "canopy_fraction from obs",
)


def _refused(spark, sf_dir):
    """Refused columns beside how many values each would have leaked."""
    df = obs(spark, sf_dir)
    findings = predictors.leakage_findings(spark, df.columns, predictors.PredictorPolicy())
    return findings.withColumn("reasons", F.array_join("reasons", "; ")).join(
        missing_fractions(df, df.columns), "column_name")


register("expr_leakage_findings", _refused)

PRODUCTS = {
    "shortwave_x_canopy_fraction": ("background_shortwave_radiation_w_m2", "canopy_fraction"),
    "distance_to_coast_x_background_wind": ("distance_to_coast_m", "background_wind_speed_m_s"),
}
register(
    "expr_products",
    lambda s, d: predictors.with_products(obs(s, d), PRODUCTS).select("sample_id", *[r6(c).alias(c) for c in PRODUCTS]),
    f"{OBS} select sample_id, "
    + ", ".join(s6(f"{a} * {b}", n) for n, (a, b) in PRODUCTS.items()) + " from obs",
)

ELIGIBLE_SQL = (
    "coalesce(satellite_lst_c is not null and satellite_lst_missing = 0 "
    "and satellite_image_age_hours between 0 and 72 and lower(trim(satellite_thermal_source)) in ('landsat', 'ecostress') "
    "and lower(trim(satellite_lst_quality_flag)) in ('good', 'acceptable') and satellite_cloud_fraction between 0 and 2e-1 "
    "and satellite_overpass_hour_sin between -1 and 1 and satellite_overpass_hour_cos between -1 and 1, false)"
)
register(
    "expr_satellite_eligibility",
    lambda s, d: (lambda o: o.select("sample_id", satellite.eligible(o.columns).alias("eligible")))(obs(s, d)),
    f"{OBS} select sample_id, {ELIGIBLE_SQL} as eligible from obs",
)


def _pair(spark, sf_dir):
    o = obs(spark, sf_dir)
    core, enhanced = satellite.eligible_pair(o.select("sample_id", "background_air_temperature_c"), o)
    return core.join(enhanced.select("sample_id", "satellite_lst_c"), "sample_id")


register(
    "expr_eligible_pair", _pair,
    f"{OBS} select sample_id, background_air_temperature_c, satellite_lst_c from obs where {ELIGIBLE_SQL}",
)

ES = "61094e-5 * exp(17625e-3 * {t} / ({t} + 24304e-2))"
register_projection(
    "expr_saturation_vapor_pressure",
    {"es_kpa": lambda: r6(physics.saturation_vapor_pressure("background_air_temperature_c"))},
    s6(ES.format(t="background_air_temperature_c"), "es_kpa"),
)
E_BG = f"{ES.format(t='background_air_temperature_c')} * background_relative_humidity_pct / 1e2"
register_projection(
    "expr_humidity_round_trip",
    {
        "e_kpa": lambda: r6(physics.vapor_pressure_from_humidity("background_air_temperature_c", "background_relative_humidity_pct")),
        "rh_back": lambda: r6(physics.humidity_from_vapor_pressure(
            "background_air_temperature_c",
            physics.vapor_pressure_from_humidity("background_air_temperature_c", "background_relative_humidity_pct"))),
        "rh_clipped": lambda: r6(physics.humidity_from_vapor_pressure("background_air_temperature_c", F.lit(3.0), clip=True)),
    },
    s6(E_BG, "e_kpa") + ", " + s6(f"1e2 * ({E_BG}) / ({ES.format(t='background_air_temperature_c')})", "rh_back") + ", "
    + s6(f"least(1e2, greatest(0e0, 3e2 / ({ES.format(t='background_air_temperature_c')})))", "rh_clipped"),
)
LOG_RATIO = ("case when measured_pedestrian_wind_speed_m_s >= 0 and background_wind_speed_m_s >= 0 then "
             "ln(1 + measured_pedestrian_wind_speed_m_s) - ln(1 + background_wind_speed_m_s) end")
register_projection(
    "expr_wind_log_ratio",
    {
        "ratio": lambda: r6(physics.wind_log_ratio("measured_pedestrian_wind_speed_m_s", "background_wind_speed_m_s")),
        "back": lambda: r6(physics.wind_from_log_ratio(
            physics.wind_log_ratio("measured_pedestrian_wind_speed_m_s", "background_wind_speed_m_s"),
            "background_wind_speed_m_s")),
    },
    s6(LOG_RATIO, "ratio") + ", " + s6(f"exp({LOG_RATIO} + ln(1 + background_wind_speed_m_s)) - 1", "back"),
)


def _profile():
    return physics.wind_to_ten_metres(
        "measured_pedestrian_wind_speed_m_s", "measurement_height_m", "roughness_m", F.lit(0.0), F.col("neutral"),
        0.1, 10.0, (0.03, 0.5, 3.0),
    )


_U, _Z, _Z0 = "measured_pedestrian_wind_speed_m_s", "measurement_height_m", "roughness_m"
FLAG_CHECKS = [
    (f"{_U} < 0", "negative_wind_speed"), (f"{_Z} <= 0", "measurement_not_above_displacement"),
    (f"{_Z} < 1e-1", "measurement_below_configured_minimum"), (f"{_Z} > 1e1", "measurement_above_configured_maximum"),
    (f"{_Z0} <= 0", "nonpositive_roughness_length"),
    (f"{_Z0} > 0 and {_Z} <= {_Z0}", "measurement_not_above_roughness_sublayer"),
    (f"{_Z0} > 0 and {_Z} > {_Z0} and 1e1 <= {_Z0}", "target_not_above_roughness_sublayer"),
    ("not neutral", "neutral_stability_not_applicable"),
]
FLAGS_SQL = "concat_ws(';', " + ", ".join(f"case when {p} then '{n}' end" for p, n in FLAG_CHECKS) + ")"


def _alternative(c: str) -> str:
    return f"case when flags = '' and {_Z} > {c} then {_U} * ln(1e1 / {c}) / ln({_Z} / {c}) end"


register(
    "expr_wind_profile",
    lambda s, d: obs(s, d).select(
        "sample_id", F.array_join(_profile().flags, ";").alias("flags"), _profile().applicable.alias("applicable"),
        r6(_profile().speed).alias("wind_10m"),
        *[r6(F.try_element_at(_profile().sensitivity, F.lit(c))).alias(n)
          for c, n in ((0.03, "at_003"), (0.5, "at_05"), (3.0, "at_3"))],
    ),
    f"{OBS}, flagged as (select *, {FLAGS_SQL} as flags from obs) select sample_id, flags, flags = '' as applicable, "
    + s6(f"case when flags = '' then {_U} * ln(1e1 / {_Z0}) / ln({_Z} / {_Z0}) end", "wind_10m") + ", "
    + s6(_alternative("3e-2"), "at_003") + ", " + s6(_alternative("5e-1"), "at_05") + ", "
    + s6(_alternative("3e0"), "at_3") + " from flagged",
)

UTCI_LIMITS = {"wind_10m_m_s": (1.0, 10.0)}
REASONS = [
    ("not background_air_temperature_c between -50 and 50", "air_temperature_out_of_range"),
    ("not calculated_mrt_c - background_air_temperature_c between -30 and 70", "mrt_minus_air_temperature_out_of_range"),
    ("not background_wind_speed_m_s between 1 and 10", "wind_10m_out_of_range"),
    ("not background_relative_humidity_pct between 0 and 100", "relative_humidity_out_of_range"),
]
_UTCI_ARGS = ("background_air_temperature_c", "calculated_mrt_c", "background_wind_speed_m_s", "background_relative_humidity_pct")
register(
    "expr_utci_applicability",
    lambda s, d: obs(s, d).select(
        "sample_id", F.array_join(utci.applicability_reasons(*_UTCI_ARGS, limits=UTCI_LIMITS), ";").alias("reasons"),
        utci.applies(*_UTCI_ARGS, limits=UTCI_LIMITS).alias("applicable"),
    ),
    f"{OBS}, r as (select sample_id, case when background_relative_humidity_pct is null then 'non_finite_input' else "
    "concat_ws(';', " + ", ".join(f"case when {p} then '{n}' end" for p, n in REASONS) + ") end as reasons from obs) "
    "select sample_id, reasons, reasons = '' as applicable from r",
)


def saturation_sql(t: str) -> str:
    k = f"({t} + 27315e-2)"
    terms = " + ".join(f"({c:.16e}) * pow({k}, {n - 2})" for n, c in enumerate(utci.SATURATION_TERMS))
    return f"(1e-2 * exp({utci.SATURATION_LOG:.16e} * ln({k}) + {terms}))"


def index_sql(source: str, t: str, r: str, v: str, rh: str, valid: str, keep: str) -> str:
    """CTE body that evaluates the polynomial over ``source``."""
    poly = utci.polynomial(_Sql("ta"), _Sql("va"), _Sql("dm"), _Sql("pa"), lambda c: _Sql(f"({c:.9e})"))
    return (
        f"select {keep}, case when ok then ta + {poly} end as idx from (select {keep}, {valid} as ok, {t} as ta, {v} as va, "
        f"{r} - {t} as dm, {saturation_sql(t)} * {rh} / 1e3 as pa from {source})"
    )


class _Sql(str):
    """SQL text with the two operations of a nested polynomial."""

    def __add__(self, other):
        return _Sql(f"({self}+{other})")

    def __mul__(self, other):
        return _Sql(f"({self}*{other})")


_VALID = ("coalesce(calculated_mrt_c - background_air_temperature_c between -30 and 70 and "
          "background_wind_speed_m_s between 0.5 and 17 and background_relative_humidity_pct between 0 and 100, false)")
register(
    "expr_thermal_index",
    lambda s, d: obs(s, d).select("sample_id", r6(utci.thermal_index(*_UTCI_ARGS)).alias("utci_c")),
    f"{OBS}, i as ({index_sql('obs', *_UTCI_ARGS, _VALID, 'sample_id')}) select sample_id, {s6('idx', 'utci_c')} from i",
)
_CLIPPED = (
    "select sample_id, ta, ta + least(70e0, greatest(-30e0, dm)) as tr, least(17e0, greatest(5e-1, va)) as v, rh from "
    "(select sample_id, background_air_temperature_c as ta, calculated_mrt_c - background_air_temperature_c as dm, "
    "background_wind_speed_m_s as va, background_relative_humidity_pct as rh from obs)"
)
register(
    "expr_thermal_index_clipped",
    lambda s, d: obs(s, d).select("sample_id", r6(utci.thermal_index(*_UTCI_ARGS, out_of_range="clip")).alias("utci_c")),
    f"{OBS}, c as ({_CLIPPED}), i as ({index_sql('c', 'ta', 'tr', 'v', 'rh', 'rh is not null', 'sample_id')}) "
    f"select sample_id, {s6('idx', 'utci_c')} from i",
)

TARGET_SQL = {
    "local_minus_background_air_temperature_c": "measured_air_temperature_c - background_air_temperature_c",
    "local_vapor_pressure_kpa": f"{ES.format(t='measured_air_temperature_c')} * measured_relative_humidity_pct / 1e2",
    "pedestrian_wind_log_adjustment": LOG_RATIO,
    "mrt_minus_local_air_temperature_c": "calculated_mrt_c - measured_air_temperature_c",
}
register(
    "expr_component_targets",
    lambda s, d: obs(s, d).select("sample_id", *[r6(e).alias(n) for n, e in physics.component_targets().items()]),
    f"{OBS} select sample_id, " + ", ".join(s6(e, n) for n, e in TARGET_SQL.items()) + " from obs",
)

# Stand-ins for model output: targets with a disturbance that breaks some physical limits.
DISTURBED = {
    "local_minus_background_air_temperature_c": "{e} + (cast(sample_id as bigint) % 50) * 1e0",
    "local_vapor_pressure_kpa": "{e} + (cast(sample_id as bigint) % 9 - 4) / 2e0",
    "pedestrian_wind_log_adjustment": "{e} + (cast(sample_id as bigint) % 11) / 4e0",
    "mrt_minus_local_air_temperature_c": "{e} + (cast(sample_id as bigint) % 60) * 1e0",
}


def _predicted(spark, sf_dir):
    df = obs(spark, sf_dir).withColumns(physics.component_targets())
    return df.withColumns({n: F.expr(t.format(e=n)) for n, t in DISTURBED.items()})


def _rebuilt(spark, sf_dir):
    return physics.with_reconstruction(_predicted(spark, sf_dir))


_P = {n: t.format(e=f"({TARGET_SQL[n]})") for n, t in DISTURBED.items()}
_ES_RAW = ES.format(t="ta")
REBUILT_SQL = (
    f"{OBS}, p as (select *, {_P['local_minus_background_air_temperature_c']} as da, {_P['local_vapor_pressure_kpa']} as ep, "
    f"{_P['pedestrian_wind_log_adjustment']} as wl, {_P['mrt_minus_local_air_temperature_c']} as dr from obs), "
    "q as (select *, background_air_temperature_c + da as ta, exp(wl + ln(1 + background_wind_speed_m_s)) - 1 as wv from p), "
    f"r as (select *, {_ES_RAW} as es, 1e2 * ep / ({_ES_RAW}) as rh, ta + dr as tm from q), "
    "v as (select *, coalesce(ta between -50 and 65, false) as ok_t, coalesce(ep >= 0 and ep <= es, false) as ok_e, "
    "coalesce(rh between 0 and 100, false) as ok_h, coalesce(wv between 0 and 40, false) as ok_w, "
    "coalesce(tm between -70 and 120, false) as ok_r from r)"
)
_RAW = {"predicted_air_temperature_delta_c_raw": "da", "predicted_local_vapor_pressure_kpa_raw": "ep",
        "predicted_wind_log_adjustment_raw": "wl", "predicted_mrt_delta_c_raw": "dr", "local_air_temperature_c_raw": "ta",
        "relative_humidity_percent_raw": "rh", "pedestrian_wind_m_s_raw": "wv", "mean_radiant_temperature_c_raw": "tm"}
_MASKED = {"local_air_temperature_c": ("ok_t", "ta"), "local_vapor_pressure_kpa": ("ok_e", "ep"),
           "relative_humidity_percent": ("ok_h", "rh"), "pedestrian_wind_m_s": ("ok_w", "wv"),
           "mean_radiant_temperature_c": ("ok_r", "tm")}
_OK = {"air_temperature_valid": "ok_t", "vapor_pressure_valid": "ok_e", "relative_humidity_valid": "ok_h",
       "pedestrian_wind_valid": "ok_w", "mean_radiant_temperature_valid": "ok_r"}
register(
    "expr_reconstruction",
    lambda s, d: _rebuilt(s, d).select(
        "sample_id", *[r6(c).alias(c) for c in (*_RAW, *_MASKED)], *_OK, "all_physical_values_valid"),
    f"{REBUILT_SQL} select sample_id, " + ", ".join(s6(e, n) for n, e in _RAW.items()) + ", "
    + ", ".join(s6(f"case when {ok} then {e} end", n) for n, (ok, e) in _MASKED.items()) + ", "
    + ", ".join(f"{e} as {n}" for n, e in _OK.items())
    + ", ok_t and ok_e and ok_h and ok_w and ok_r as all_physical_values_valid from v",
)
_CWIND = "case when ok_w and measurement_height_m between 1e-1 and 1e1 then wv * ln(1e2) / ln(measurement_height_m / 1e-1) end"
_CVALID = ("coalesce(ta between -50 and 50 and tm - ta between -30 and 70 and v10 between 0.5 and 17 "
           "and rh between 0 and 100, false)")
_CFLAGS = ("case when not ok_w then 'invalid_reconstructed_pedestrian_wind' else concat_ws(';', case when measurement_height_m "
           "< 1e-1 then 'measurement_below_configured_minimum' end, case when measurement_height_m > 1e1 then "
           "'measurement_above_configured_maximum' end, case when measurement_height_m <= 1e-1 then "
           "'measurement_not_above_roughness_sublayer' end) end")
register(
    "expr_component_index",
    lambda s, d: with_component_index(_rebuilt(s, d), WindSettings()).select(
        "sample_id", r6("wind_speed_10m_m_s_raw").alias("wind_10m"), "wind_profile_applicable", "wind_profile_flags",
        "utci_applicable", r6("component_utci_c").alias("index_c")),
    f"{REBUILT_SQL}, w as (select sample_id, ta, tm, rh, ok_t and ok_e and ok_h and ok_w and ok_r as all_ok, {_CWIND} as v10, "
    f"{_CFLAGS} as wind_profile_flags from v), i as ({index_sql('w', 'ta', 'tm', 'v10', 'rh', _CVALID, 'sample_id, v10, all_ok, wind_profile_flags')}) "
    f"select sample_id, {s6('v10', 'wind_10m')}, v10 is not null as wind_profile_applicable, wind_profile_flags, "
    f"all_ok and idx is not null as utci_applicable, {s6('case when all_ok then idx end', 'index_c')} from i",
)
register(
    "expr_disagreement",
    lambda s, d: diagnostics.with_disagreement(obs(s, d), "direct_core", "component_utci_c", 2.55).select(
        "sample_id", r6("absolute_disagreement_c").alias("gap"), "comparable", "disagreement_warning"),
    f"{OBS}, g as (select sample_id, case when isfinite(direct_core) then abs(direct_core - component_utci_c) end as x from obs) "
    f"select sample_id, {s6('x', 'gap')}, x is not null as comparable, coalesce(x > 2.55e0, false) as disagreement_warning from g",
)

HEAT_INDEX_SQL = (
    "select *, case when simple < 80 then simple when rh < 13 and f between 80 and 112 then ro - (13 - rh) / 4e0 * "
    "sqrt(greatest(0e0, (17 - abs(f - 95)) / 17e0)) when rh > 85 and f between 80 and 87 then ro + (rh - 85) / 1e1 * ((87 - f) / 5e0) "
    "else ro end as hf from (select *, (5e-1 * (f + 61 + (f - 68) * 12e-1 + rh * 94e-3) + f) / 2e0 as simple, -42.379e0 + 2.04901523e0 * f "
    "+ 10.14333127e0 * rh - 0.22475541e0 * f * rh - 0.00683783e0 * f * f - 0.05481717e0 * rh * rh + 0.00122874e0 * f * f * rh "
    "+ 0.00085282e0 * f * rh * rh - 0.00000199e0 * f * f * rh * rh as ro from (select *, background_air_temperature_c * 9 / 5e0 + 32 "
    "as f, background_relative_humidity_pct as rh from obs))"
)
register(
    "expr_heat_index",
    lambda s, d: obs(s, d).select(
        "sample_id", r6(physics.heat_index("background_air_temperature_c", "background_relative_humidity_pct")).alias("heat_index_c")),
    f"{OBS}, h as ({HEAT_INDEX_SQL}) select sample_id, {s6('(hf - 32) * 5 / 9e0', 'heat_index_c')} from h",
)
register(
    "expr_column_baselines",
    lambda s, d: with_simple_baselines(obs(s, d), satellite.Eligibility()).select(
        "sample_id", r6("baseline_background_air_temperature").alias("air"), "satellite_eligible",
        r6("baseline_satellite_lst_alone").alias("lst")),
    f"{OBS} select sample_id, {s6('background_air_temperature_c', 'air')}, {ELIGIBLE_SQL} as satellite_eligible, "
    f"{s6(f'case when {ELIGIBLE_SQL} then satellite_lst_c end', 'lst')} from obs",
)
register_projection(
    "expr_sample_weights",
    {"weight": lambda: heat.heat_weight("calculated_utci_c"), "two_level": lambda: heat.two_level_weight("calculated_utci_c")},
    "case when calculated_utci_c < 32 then 1e0 when calculated_utci_c < 38 then 15e-1 when calculated_utci_c < 46 then 2e0 "
    "else 3e0 end as weight, case when calculated_utci_c >= 38 then 2e0 else 1e0 end as two_level",
)
HOUR_SQL = ("(case when atan2(hour_sin, hour_cos) < 0 then atan2(hour_sin, hour_cos) + 2 * pi() "
            "else atan2(hour_sin, hour_cos) end) * 24e0 / (2 * pi())")
register_projection("expr_local_hour", {"hour": lambda: r6(heat.local_hour("hour_sin", "hour_cos"))}, s6(HOUR_SQL, "hour"))
TIME_SQL = (f"case when {HOUR_SQL} < 6 then 'night_22_06' when {HOUR_SQL} < 12 then 'morning_06_12' when {HOUR_SQL} < 18 "
            f"then 'afternoon_12_18' when {HOUR_SQL} < 22 then 'evening_18_22' else 'night_22_06' end")
register_projection(
    "expr_time_of_day",
    {"period": lambda: heat.time_of_day_group(heat.local_hour("hour_sin", "hour_cos")),
     "shifted": lambda: heat.time_of_day_group(F.col("distance_to_coast_m") / 1000.0 - 5.0)},
    f"{TIME_SQL} as period, case when distance_to_coast_m is null then 'missing' when h < 0 or h >= 24 then 'invalid_hour' "
    "when h < 6 or h >= 22 then 'night_22_06' when h < 12 then 'morning_06_12' when h < 18 then 'afternoon_12_18' "
    "else 'evening_18_22' end as shifted".replace("h < ", "distance_to_coast_m / 1e3 - 5 < ").replace("h >= ", "distance_to_coast_m / 1e3 - 5 >= "),
)


def coast_sql(negative: str) -> str:
    return ("case when distance_to_coast_m is null then 'missing' when distance_to_coast_m < 0 then '" + negative + "' "
            "when distance_to_coast_m / 1e3 < 5 then '0_to_5_km' when distance_to_coast_m / 1e3 < 20 then '5_to_20_km' else 'ge_20_km' end")


register_projection(
    "expr_coast_distance",
    {"bin": lambda: heat.coast_distance_group(F.col("distance_to_coast_m") / 1000.0),
     "interval_bin": lambda: heat.coast_distance_group(F.col("distance_to_coast_m") / 1000.0, negative_is_missing=True)},
    f"{coast_sql('invalid_negative')} as bin, {coast_sql('missing')} as interval_bin",
)
SHADE_SQL = ("case when estimated_shade_fraction is null then 'missing' when estimated_shade_fraction < 5e-1 then 'sun' "
             "else 'shade' end")
register(
    "expr_sun_shade",
    lambda s, d: (lambda o: o.select("sample_id", heat.sun_shade_group(
        o.columns, "sun_shade_group", "estimated_shade_fraction").alias("sun_vs_shade")))(obs(s, d)),
    f"{OBS} select sample_id, {SHADE_SQL} as sun_vs_shade from obs",
)
register(
    "expr_location_day",
    lambda s, d: obs(s, d).groupBy(keys.location_day("site_id", "date").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    .select("b.location", "b.day", "n"),
    f"{OBS} select site_id as location, date as day, count(*) as n from obs group by 1, 2",
)

_A, _E2, _E, _K = grid.SEMI_MAJOR_M, grid.ECCENTRICITY_SQ, grid.ECCENTRICITY, grid.SCALE
_SIN = "sin(radians(latitude))"
X_SQL = f"{_A * _K:.17e} * radians(longitude)"
Y_SQL = (f"{_A / (2 * _K):.17e} * {1 - _E2:.17e} * ({_SIN} / (1 - {_E2:.17e} * {_SIN} * {_SIN}) - "
         f"ln((1 - {_E:.17e} * {_SIN}) / (1 + {_E:.17e} * {_SIN})) / {2 * _E:.17e})")
BLOCK_SQL = (f"concat('EPSG6933_x', cast(cast(floor(({X_SQL}) / 5e2) as bigint) as varchar), '_y', "
             f"cast(cast(floor(({Y_SQL}) / 5e2) as bigint) as varchar))")
register(
    "expr_grid_block",
    lambda s, d: obs(s, d).select(
        "sample_id", F.round(grid.projected_xy("longitude", "latitude")[0], 3).alias("x_m"),
        F.round(grid.projected_xy("longitude", "latitude")[1], 3).alias("y_m"),
        grid.block_id("longitude", "latitude").alias("block")),
    f"{OBS} select sample_id, round({X_SQL}, 3) as x_m, round({Y_SQL}, 3) as y_m, {BLOCK_SQL} as block from obs",
)


def _part_supplied(spark, sf_dir):
    own = F.when(F.col("sample_id").cast("bigint") % 3 == 0, F.lit(None)).when(
        F.col("sample_id").cast("bigint") % 500 == 1, F.lit("EPSG6933_x0_y0")).otherwise(grid.block_id("longitude", "latitude"))
    return obs(spark, sf_dir).withColumn("spatial_block_id", own)


_SUPPLIED = (f"case when cast(sample_id as bigint) % 3 = 0 then null when cast(sample_id as bigint) % 500 = 1 then 'EPSG6933_x0_y0' "
             f"else {BLOCK_SQL} end")
register(
    "expr_fill_blocks", lambda s, d: grid.with_blocks(_part_supplied(s, d)).select("sample_id", "spatial_block_id"),
    f"{OBS} select sample_id, coalesce({_SUPPLIED}, {BLOCK_SQL}) as spatial_block_id from obs",
)
register(
    "expr_block_conflicts", lambda s, d: grid.block_findings(_part_supplied(s, d)),
    f"{OBS}, b as (select {BLOCK_SQL} as derived, {_SUPPLIED} as supplied from obs) select "
    "count(*) filter (where derived is null) as invalid_coordinates, count(*) filter (where supplied is null) as missing_blocks, "
    "count(*) filter (where supplied <> derived) as differing_blocks, count(*) filter (where supplied <> derived) as conflicts from b",
)
register(
    "expr_interval_bounds",
    lambda s, d: intervals.with_interval(obs(s, d), "direct_core", 1.75).select("sample_id", r6("lower").alias("lower"), r6("upper").alias("upper")),
    f"{OBS}, p as (select sample_id, case when isfinite(direct_core) then direct_core end as x from obs) "
    f"select sample_id, {s6('x - 175e-2', 'lower')}, {s6('x + 175e-2', 'upper')} from p",
)
RANGE = {"background_air_temperature_c": (18.0, 40.0), "background_relative_humidity_pct": (5.0, 95.0), "direct_core": (20.0, 50.0)}
register(
    "expr_extrapolation_count",
    lambda s, d: (lambda o: o.select("sample_id", diagnostics.extrapolation_count(o.columns, RANGE).alias("outside")))(obs(s, d)),
    f"{OBS} select sample_id, cast(" + " + ".join(
        f"(case when not isnan({c}) and ({c} < {a} or {c} > {b}) then 1 else 0 end)" for c, (a, b) in RANGE.items())
    + " as int) as outside from obs",
)
TIME_GROUP_SQL = ("case when trim(coalesce(weather_event_id, '')) <> '' then concat('event:', weather_event_id) "
                  "else concat('date:', date) end")
register_projection(
    "expr_time_group",
    {"time_group": lambda: keys.time_group("date", "weather_event_id"), "bare": lambda: keys.time_group("date", None, prefix_dates=False),
     "prefixed": lambda: keys.time_group("date")},
    f"{TIME_GROUP_SQL} as time_group, date as bare, concat('date:', date) as prefixed",
)
register(
    "expr_domain_violations",
    lambda s, d: physics.domain_violations(
        obs(s, d), vapour=physics.vapor_pressure_from_humidity("background_air_temperature_c", "background_relative_humidity_pct"),
        wind=physics.wind_log_ratio("measured_pedestrian_wind_speed_m_s", "background_wind_speed_m_s"),
        direct=finite("direct_core"), lst=number("satellite_lst_c")),
    f"{OBS} select count(*) filter (where background_relative_humidity_pct is null) as vapour, count(*) filter (where "
    "measured_pedestrian_wind_speed_m_s < 0) as wind, count(*) filter (where isnan(direct_core)) as direct, "
    "count(*) filter (where satellite_lst_c is null) as lst from obs",
)
