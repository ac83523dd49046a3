"""Scalar cases of the row-wise expressions."""

import math

import pytest
from pyspark.sql import functions as F

from terrafold.functions import grid, heat, keys, physics, predictors, satellite, utci


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(x):
    return F.lit(float(x))


def test_vapour_pressure_round_trip(spark):
    e = physics.vapor_pressure_from_humidity(lit(30), lit(50))
    r = one(spark, e=e, back=physics.humidity_from_vapor_pressure(lit(30), e))
    assert r.e == pytest.approx(2.118, abs=0.002) and r.back == pytest.approx(50)


def test_vapour_domain_gives_null(spark):
    r = one(spark, cold=physics.saturation_vapor_pressure(lit(-300)), wet=physics.vapor_pressure_from_humidity(lit(20), lit(101)),
            nan=physics.saturation_vapor_pressure(F.lit(float("nan"))), kept=physics.humidity_from_vapor_pressure(lit(20), lit(9)),
            clipped=physics.humidity_from_vapor_pressure(lit(20), lit(9), clip=True))
    assert r.cold is None and r.wet is None and r.nan is None and r.kept > 100 and r.clipped == 100


def test_wind_log_ratio_at_calm(spark):
    ratio = physics.wind_log_ratio(lit(1.5), lit(0))
    assert one(spark, v=physics.wind_from_log_ratio(ratio, lit(0))).v == pytest.approx(1.5)


def test_wind_profile(spark):
    p = physics.wind_to_ten_metres(lit(1), lit(2), lit(0.1), sensitivity_roughness=(0.03, 5.0))
    r = one(spark, v=p.speed, ok=p.applicable, f=p.flags, s=p.sensitivity)
    assert r.v == pytest.approx(math.log(100) / math.log(20)) and r.ok and r.f == [] and set(r.s) == {0.03}


def test_wind_profile_flags_in_order(spark):
    p = physics.wind_to_ten_metres(lit(-1), lit(2), lit(3), neutral=False, maximum_height=1.5)
    r = one(spark, v=p.speed, f=p.flags, s=p.sensitivity)
    assert r.v is None and r.s == {}
    assert r.f == ["negative_wind_speed", "measurement_above_configured_maximum",
                   "measurement_not_above_roughness_sublayer", "neutral_stability_not_applicable"]
    q = physics.wind_to_ten_metres(F.lit(float("inf")), lit(2), lit(0.1))
    assert one(spark, f=q.flags).f == ["non_finite_input"]
    with pytest.raises(ValueError):
        physics.wind_to_ten_metres(lit(1), lit(2), minimum_height=5, maximum_height=1)


def test_thermal_index_anchor_and_policies(spark):
    r = one(spark, anchor=utci.thermal_index(lit(25), lit(25), lit(1), lit(50)), calm=utci.thermal_index(lit(25), lit(25), lit(0.1), lit(50)),
            clip=utci.thermal_index(lit(25), lit(25), lit(0.1), lit(50), "clip"), half=utci.thermal_index(lit(25), lit(25), lit(0.5), lit(50)),
            why=utci.applicability_reasons(lit(25), lit(25), lit(0.1), lit(50)))
    assert r.anchor == pytest.approx(24.6, abs=0.05) and r.calm is None and r.clip == pytest.approx(r.half)
    assert r.why == ["wind_10m_out_of_range"]
    with pytest.raises(ValueError):
        utci.limits_within_domain({"wind_10m_m_s": (0.1, 17)})
    assert sum(len(v) for v in utci.coefficient_lines().values()) == 210


def test_categories_and_weights(spark):
    df = spark.createDataFrame([(25.999,), (26.0,), (32.0,), (38.0,), (46.0,), (float("nan"),), (float("inf"),)], "v double")
    assert [r.c for r in df.select(heat.heat_category("v").alias("c")).collect()] == [*heat.CATEGORY_LABELS, None, None]
    w = spark.createDataFrame([(31.9,), (32.0,), (37.9,), (38.0,), (46.0,)], "v double").select(heat.heat_weight("v").alias("w"))
    assert [r.w for r in w.collect()] == [1.0, 1.5, 1.5, 2.0, 3.0]
    with pytest.raises(ValueError):
        heat.step(F.lit(1.0), (2.0, 1.0), (1, 2, 3))


def test_heat_index(spark):
    r = one(spark, v=physics.heat_index(lit(32.2222), lit(70)), bad=physics.heat_index(lit(35), lit(101)), cool=physics.heat_index(lit(10), lit(50)))
    assert r.v == pytest.approx(41.1, abs=0.15) and r.bad is None and r.cool < 15


def test_groups(spark):
    hours = spark.createDataFrame([(5.9,), (6.0,), (12.0,), (18.0,), (22.0,), (24.0,), (-1.0,), (None,)], "h double")
    assert [r.g for r in hours.select(heat.time_of_day_group("h").alias("g")).collect()] == [
        "night_22_06", "morning_06_12", "afternoon_12_18", "evening_18_22", "night_22_06", "invalid_hour", "invalid_hour", "missing"]
    km = spark.createDataFrame([(0.0,), (5.0,), (20.0,), (-1.0,), (float("nan"),)], "d double")
    assert [r.g for r in km.select(heat.coast_distance_group("d").alias("g")).collect()] == [
        "0_to_5_km", "5_to_20_km", "ge_20_km", "invalid_negative", "missing"]
    assert one(spark, h=heat.local_hour(F.sin(F.lit(-0.5)), F.cos(F.lit(-0.5)))).h == pytest.approx(24 - 12 / math.pi * 0.5)
    with pytest.raises(ValueError):
        heat.coast_distance_group("d", (1.0, 5.0))


def test_grid(spark):
    x, y = grid.projected_xy(lit(-122.4194), lit(37.7749))
    r = one(spark, x=x, y=y, edge=grid.projected_xy(lit(180), lit(0))[0], b=grid.block_id(lit(-122.4194), lit(37.7749)), bad=grid.block_id(lit(200), lit(0)))
    assert r.x == pytest.approx(-11811792.5365, abs=1e-3) and r.y == pytest.approx(4484974.0501, abs=1e-3)
    assert r.edge == pytest.approx(17367530.445, abs=1e-2) and r.bad is None
    assert r.b == f"EPSG6933_x{math.floor(r.x / 500)}_y{math.floor(r.y / 500)}"
    with pytest.raises(ValueError):
        grid.block_id(lit(0), lit(0), crs="EPSG:4326")


def test_time_group_and_hash(spark):
    r = one(spark, a=keys.time_group(F.lit("2026-07-01"), F.lit(" ")), b=keys.time_group(F.lit("2026-07-01"), F.lit("w1")),
            c=keys.location_day(F.lit(None).cast("string"), F.lit("d")))
    assert (r.a, r.b, r.c) == ("date:2026-07-01", "event:w1", None)


@pytest.mark.parametrize("name", ["calculated_utci_c", "log_calculated_utci_c", "measured_air_temperature_c_squared", "site_id",
                                  "sensor_observed_wind", "timestamp_utc", "latitude", "outer_fold", "invented_weather_feature", "quality_flag"])
def test_leaky_names_are_refused(name):
    assert predictors.leakage_reasons(name, predictors.PredictorPolicy())


def test_allow_list():
    policy = predictors.PredictorPolicy()
    assert len(policy.core) == 92 and len(policy.additions) == 12
    assert not [c for c in policy.allowed("satellite_enhanced") if predictors.leakage_reasons(c, policy, "satellite_enhanced")]
    assert predictors.checked_predictors(["ndvi", "background_air_temperature_c"], policy) == ("background_air_temperature_c", "ndvi")
    with pytest.raises(predictors.LeakageError):
        predictors.checked_predictors(["ndvi", "ndvi"], policy)


def test_eligibility_needs_its_columns():
    with pytest.raises(ValueError):
        satellite.eligible(["satellite_lst_c"])


def test_expressions_stay_native(spark, sf_dir):
    """No Python node in row-wise plans, and only used columns are read."""
    from terrafold.plans.observations import observations

    df = observations(spark, sf_dir).select(heat.heat_category("calculated_utci_c").alias("c"), grid.block_id("longitude", "latitude").alias("b"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "props" not in plan and "event_type" not in plan
