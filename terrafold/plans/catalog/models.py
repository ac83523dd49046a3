"""Queries for encoding, models, scoring and diagnostics.

Every query reads its whole table, with five outer and four inner folds. Candidates have up to 300 trees; ``model_loss_curve`` stops 50 trees
after the best validation error as the library does, the nested searches stop EARLY trees after it, which keeps them to minutes here. The forest keeps 20 of 500 trees, 5 in the nested comparison. Model fits have
no SQL twin; encoding, dependence and importance do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import functions as F

from ...functions.grid import with_blocks
from ...functions.heat import CATEGORY_LABELS
from ...functions.physics import heat_index
from ...functions.predictors import PredictorPolicy
from ...functions.satellite import Eligibility, eligible
from ...operators import diagnostics, models
from ...operators.encode import fit_encoder
from ...operators.folds import COUNTED, SplitDesign, dual_blocked_parts, in_part, validation_fold, with_frozen_folds, with_parts
from ...operators.intervals import calibrate
from ...operators.isolation import fit_isolation_forest
from ...operators.linear import candidate_scores, fit_elastic_net
from ...operators.metrics import error_sums, full_report, grouped_mae, long_predictions
from ...operators.roles import assign_roles
from ...session import concurrently, materialise
from ..scoring import ScoringPlan, score, score_eligible, with_components, with_simple_baselines
from ..training import baseline_out_of_fold, component_out_of_fold, satellite_pair_out_of_fold
from .registry import OBS, obs, r6, register, s6

TARGET = "calculated_utci_c"
CORE = ("background_air_temperature_c", "background_relative_humidity_pct", "background_wind_speed_m_s",
        "background_shortwave_radiation_w_m2", "canopy_fraction", "hour_sin", "hour_cos", "land_cover_class")
ADDED = ("satellite_lst_c", "satellite_image_age_hours", "satellite_thermal_source")
POLICY = PredictorPolicy(core=CORE, additions=ADDED)
BLOCK = ["spatial_block_id", "date"]
SMALL = models.BoostedParams(trees=30, depth=4, step_size=0.3)
NESTED = models.BoostedParams(trees=300, depth=3, step_size=0.3)
FOLDS, INNER, EARLY = SplitDesign(n_folds=5, seed=42), 4, 6
# Columns of the observations that the model tables read; wide rows would be written several times over.
USED = (*CORE, TARGET)
RULES = tuple(Eligibility().required_columns())
COMPONENTS = (*CORE, "measured_air_temperature_c", "measured_relative_humidity_pct", "measured_pedestrian_wind_speed_m_s", "calculated_mrt_c",
              "measurement_height_m", "component_utci_c")


def _complete(spark, sf_dir):
    """Blocked rows with complete component sources."""
    return with_blocks(obs(spark, sf_dir)).filter("measured_pedestrian_wind_speed_m_s >= 0")


@dataclass(frozen=True)
class Narrow:
    """Tables of which a query reads some columns of the observations only."""

    sf_dir: str
    columns: tuple[str, ...]


def _development(spark, sf_dir, columns=None):
    """Complete rows, or some of their columns beside the keys, with their stored outer folds."""
    if isinstance(sf_dir, Narrow):
        sf_dir, columns = sf_dir.sf_dir, sf_dir.columns
    df = _complete(spark, sf_dir)
    return _with_outer_folds(df if columns is None else df.select(*dict.fromkeys(["sample_id", *BLOCK, "weather_event_id", *columns])))


def _with_outer_folds(df):
    df = materialise(df, "rows")
    rows = with_parts(df, dual_blocked_parts(df, FOLDS), FOLDS)
    return materialise(rows.withColumn("outer_fold", F.coalesce(validation_fold(), F.lit(-1))).drop("folds"), "development")


# ---------------------------------------------------------------------------------- encoding

ENCODED = ("background_air_temperature_c", "background_relative_humidity_pct", "background_wind_speed_m_s", "land_cover_class")


def _encoded(spark, sf_dir):
    df = obs(spark, sf_dir)
    encoder = fit_encoder(df, PredictorPolicy(core=ENCODED, additions=()), kind="linear")
    wide = encoder.transform(df, ["sample_id"])
    return wide.select("sample_id", *[r6(c).alias(c[2:]) for c in wide.columns[1:]])


_COVERS = ("__MISSING__", "built_up", "mixed", "tree_canopy", "unknown", "water")
_FILLED = ", ".join(f"coalesce({c}, (select median({c}) from obs)) as v{i}" for i, c in enumerate(ENCODED[:3]))
register(
    "encode_columns", _encoded,
    f"{OBS}, f as (select *, {_FILLED} from obs), m as (select "
    + ", ".join(f"avg(v{i}) as a{i}, stddev_pop(v{i}) as s{i}" for i in range(3)) + " from f) select sample_id, "
    + ", ".join(s6(f"(v{i} - a{i}) / s{i}", c) for i, c in enumerate(ENCODED[:3]))
    + ", case when background_relative_humidity_pct is null then 1e0 else 0e0 end as background_relative_humidity_pct__missing, "
    + ", ".join(f"case when coalesce(land_cover_class, '__MISSING__') = '{v}' then 1e0 else 0e0 end as land_cover_class_{v}" for v in _COVERS)
    + " from f, m",
)

# ------------------------------------------------------------------------------------ fits


def _direct(spark, sf_dir):
    df = obs(spark, sf_dir)
    fitted = models.fit_boosted(df, TARGET, POLICY, CORE, SMALL, 7)
    return fitted.predict(df, "direct").select("sample_id", r6("direct").alias("direct"))


register("model_direct_boosted", _direct)


def _weighted(spark, sf_dir):
    df = obs(spark, sf_dir)
    fitted = models.fit_boosted(df, TARGET, POLICY, CORE, SMALL, 7, weights=((32.0, 38.0, 46.0), (1.0, 1.5, 2.0, 3.0)))
    long = long_predictions(fitted.predict(df, "heat_weighted"), TARGET, ["heat_weighted"])
    return full_report(long, with_spearman=False).select("model", "n", *[f"support_{c}" for c in CATEGORY_LABELS], r6("mae").alias("mae"))


register("model_heat_weighted", _weighted)


def _loss_curve(spark, sf_dir):
    """Validation loss after each tree of every fold, with the chosen count."""
    rows = materialise(with_frozen_folds(_development(spark, sf_dir, USED), FOLDS), "folds")
    parts = models.fold_parts(FOLDS.n_folds)
    encoders = models.fold_encoders(rows, {"": ("core", CORE, parts)}, POLICY)
    fits, _ = models.fit_together(rows, [models.Wanted(encoders["", f], TARGET, train, NESTED, 7, held, models.PATIENCE) for f, (train, held) in enumerate(parts)])
    found = [(fold, i + 1, float(v), i + 1 == models.best_tree_count(fit.curve)) for fold, fit in enumerate(fits) for i, v in enumerate(fit.curve)]
    return spark.createDataFrame(found, "fold int, trees int, loss double, chosen boolean")


register("model_loss_curve", _loss_curve)


def _board(spark, sf_dir):
    df = _development(spark, sf_dir, USED)
    inner = FOLDS.inner(INNER)
    rows = materialise(with_parts(df, dual_blocked_parts(df, inner), inner), "inner")
    trials = models.candidates(2, 42, {"trees": ("int", 100, 300, 25), "depth": ("int", 3, 5, 1), "step_size": ("log", 0.1, 0.5)})
    best = models.search(rows, TARGET, POLICY, CORE, trials, 42, BLOCK, INNER, patience=EARLY)
    return spark.createDataFrame(best.scores).withColumn("selected_trees", F.lit(best.tree_count))


register("model_candidate_board", _board)


def _nested(spark, sf_dir):
    df = _development(spark, sf_dir, USED)
    table, final, _ = models.nested_out_of_fold(df, FOLDS, TARGET, POLICY, CORE, [NESTED], BLOCK, INNER, 42, patience=EARLY)
    return table.withColumn("final_trees", F.lit(final.tree_count))


register("model_nested_out_of_fold", _nested)


def _elastic_net(spark, sf_dir):
    df = with_blocks(obs(spark, sf_dir))
    return fit_elastic_net(df, TARGET, POLICY, CORE, 0.1, 0.5).predict(df, "linear").select("sample_id", r6("linear").alias("linear"))


register("model_elastic_net", _elastic_net)


def _linear_grid(spark, sf_dir):
    rows = materialise(with_frozen_folds(_development(spark, sf_dir, USED), FOLDS), "folds")

    def one_fold(fold):
        return candidate_scores(rows.filter(in_part(fold, "train")), rows.filter(in_part(fold, "validation")), TARGET, POLICY, CORE, BLOCK)

    grids = concurrently(spark, [partial(one_fold, fold) for fold in range(FOLDS.n_folds)], FOLDS.n_folds)
    found = [(fold, a, r, float(v)) for fold, scores in enumerate(grids) for a, r, v in scores]
    return spark.createDataFrame(found, "fold int, alpha double, l1_ratio double, grouped_mae double")


register("model_elastic_net_grid", _linear_grid)


def _forest(spark, sf_dir):
    df = obs(spark, sf_dir)
    fitted = models.fit_forest(df, TARGET, POLICY, CORE, trees=20)
    return fitted.predict(df.select("sample_id", *CORE), "forest").select("sample_id", r6("forest").alias("forest"))


register("model_random_forest", _forest)


def _components(spark, sf_dir):
    df = with_blocks(obs(spark, sf_dir))
    complete = df.filter("measured_pedestrian_wind_speed_m_s >= 0")  # labels are needed to fit, not to score
    scored = with_components(models.fit_components(complete, POLICY, CORE, SMALL, 7).predict(df))
    return scored.select("sample_id", "component_utci_c", "wind_profile_flags", "all_physical_values_valid", "utci_applicable")


register("model_components", _components)
register("model_component_out_of_fold",
         lambda s, d: component_out_of_fold(_development(s, Narrow(d, COMPONENTS)), FOLDS, POLICY, CORE, NESTED, INNER, 42, EARLY).drop("wind_speed_10m_sensitivity"))


def _baselines(spark, sf_dir):
    table, final = baseline_out_of_fold(_development(spark, Narrow(sf_dir, (*USED, *RULES))), FOLDS, TARGET, POLICY, CORE, BLOCK, INNER, forest_trees=5,
                                        rules=Eligibility())
    return table.withColumns({k: F.lit(v) for k, v in final.items()})


register("model_baseline_out_of_fold", _baselines)
register("model_satellite_pair",
         lambda s, d: satellite_pair_out_of_fold(_development(s, Narrow(d, (*USED, *ADDED, *RULES))), FOLDS, TARGET, POLICY, CORE, ADDED, [NESTED], BLOCK,
                                                 INNER, 42, patience=EARLY))


def _score(spark, sf_dir):
    """Every row scored; fits on development rows, the radius from rows of the calibration role."""
    df = with_blocks(obs(spark, sf_dir))
    rows = materialise(assign_roles(df, FOLDS), "roles")
    complete = rows.filter("measured_pedestrian_wind_speed_m_s >= 0")
    fitting, held = complete.filter("split_role = 'development'"), complete.filter("split_role = 'calibration'")
    direct = models.fit_boosted(fitting, TARGET, POLICY, CORE, SMALL, 7)
    components = models.fit_components(fitting, POLICY, CORE, SMALL, 7)
    radius = calibrate(direct.predict(held, "p"), TARGET, "p", "calibration").first()["radius"]
    bounds = diagnostics.range_bounds(diagnostics.training_ranges(fitting, [c for c in CORE if c != "land_cover_class"]))
    forest = fit_isolation_forest(fitting, fit_encoder(fitting, POLICY, predictors=CORE))
    return score(df, ScoringPlan(direct, components, radius, 3.0, bounds, forest))


register("model_batch_scoring", _score)


def _score_eligible(spark, sf_dir):
    df = obs(spark, sf_dir)
    rows = df.filter(eligible(df.columns))
    fitted = models.fit_boosted(rows, TARGET, POLICY, CORE + ADDED, SMALL, 7, "satellite_enhanced")
    return score_eligible(df, fitted)


register("model_eligible_scoring", _score_eligible)


def _anomalies(spark, sf_dir):
    df = obs(spark, sf_dir)
    forest = fit_isolation_forest(df, fit_encoder(df, POLICY, predictors=CORE))
    return forest.score(df).select("sample_id", r6("anomaly_score").alias("anomaly_score"), "is_anomaly")


register("model_isolation_forest", _anomalies)


def _inner_report(spark, sf_dir):
    """Grouped error of the simple baselines on every inner validation part."""
    names = ["baseline_background_air_temperature", "baseline_heat_index"]
    long = long_predictions(with_simple_baselines(_complete(spark, sf_dir)), TARGET, names, [*BLOCK, "weather_event_id"])
    # Rows of a cell share their folds: they are added up before the first join and not repeated for the outer folds.
    cells = error_sums(long, [*BLOCK, "weather_event_id"], names, COUNTED)
    rows, parts = models.outer_rows(_with_outer_folds(cells), FOLDS, INNER)
    trained = rows.drop("outer_fold").withColumn(
        "outer_fold", F.explode(F.filter("folds", lambda f: f["part"] == "train")["fold"])).drop("folds")
    validating = parts.withColumn("fold", validation_fold()).filter("fold is not null").drop("fold")
    held = with_parts(trained, validating, FOLDS.inner(INNER), ["outer_fold"]).withColumn("fold", validation_fold())
    return grouped_mae(held.select("outer_fold", "fold", *BLOCK, F.inline("errors")), BLOCK, ["model", "outer_fold", "fold"])


register("model_inner_baseline_error", _inner_report)

# ------------------------------------------------------------------------------ diagnostics


def _formula(df):
    return df.withColumn("prediction", heat_index("background_air_temperature_c", "background_relative_humidity_pct")
                         + F.col("shade_product") / 100.0)


def _recompute(df):
    return df.withColumn("shade_product", F.col("background_shortwave_radiation_w_m2") * F.col("canopy_fraction"))


def _dependence(feature):
    def run(spark, sf_dir):
        df = _recompute(obs(spark, sf_dir))
        curve = diagnostics.partial_dependence(df, feature, _formula, _recompute)
        return curve.select("feature", r6("value").alias("value"), r6("mean_prediction").alias("mean_prediction"))

    return run


_HI = ("case when simple < 80 then simple when rh < 13 and f between 80 and 112 then ro - (13 - rh) / 4e0 * sqrt(greatest(0e0, (17 - abs(f - 95)) / 17e0)) "
       "when rh > 85 and f between 80 and 87 then ro + (rh - 85) / 1e1 * ((87 - f) / 5e0) else ro end")


def formula_sql(source: str, keep: str) -> str:
    """``(keep, p)``: the formula over ``source`` with t, rh, sw, cf."""
    return (
        f"select {keep}, ({_HI} - 32) * 5 / 9e0 + sw * cf / 1e2 as p from (select *, (5e-1 * (f + 61 + (f - 68) * 12e-1 + rh * 94e-3) + f) / 2e0 as simple, "
        "-42.379e0 + 2.04901523e0 * f + 10.14333127e0 * rh - 0.22475541e0 * f * rh - 0.00683783e0 * f * f - 0.05481717e0 * rh * rh + 0.00122874e0 * f * f * rh "
        f"+ 0.00085282e0 * f * rh * rh - 0.00000199e0 * f * f * rh * rh as ro from (select *, t * 9 / 5e0 + 32 as f from {source}))"
    )


_ARGS = {"t": "background_air_temperature_c", "rh": "background_relative_humidity_pct", "sw": "background_shortwave_radiation_w_m2", "cf": "canopy_fraction"}
for _feature in ("background_air_temperature_c", "canopy_fraction", "background_shortwave_radiation_w_m2"):
    _args = ", ".join(f"{'value' if c == _feature else c} as {a}" for a, c in _ARGS.items())
    register(
        f"dependence_{_feature}", _dependence(_feature),
        f"{OBS}, q as (select quantile_cont({_feature}, 0.02) as lo, quantile_cont({_feature}, 0.98) as hi from obs), g as (select lo + (hi - lo) * i / 29e0 as value "
        f"from q, (select unnest(range(30)) as i)), x as (select value, {_args} from obs, g), y as ({formula_sql('x', 'value')}) "
        f"select '{_feature}' as feature, {s6('value', 'value')}, {s6('avg(p)', 'mean_prediction')} from y group by value",
    )

SHUFFLED = ("background_air_temperature_c", "canopy_fraction")


def _importance(spark, sf_dir):
    """Importance over all rows."""
    df = materialise(_recompute(obs(spark, sf_dir)), "rows")
    table = diagnostics.permutation_importance(df, SHUFFLED, TARGET, _formula, 5, recompute=_recompute)
    return table.select("feature", *[r6(c).alias(c) for c in ("base_mae", "shuffled_mae", "importance")])


_SHUFFLE_SQL = " union all ".join(
    f"select '{c}' as feature, (select avg(abs(p - y)) from base) as base_mae, avg(abs(p - y)) as shuffled_mae from ("
    + formula_sql(f"(select a.y, {', '.join(('b.' if col == c else 'a.') + col + ' as ' + arg for arg, col in _ARGS.items())} from n a join n b on a.i = b.j)", "y") + ")"
    for c in SHUFFLED
)
register(
    "importance_permutation", _importance,
    f"{OBS}, sm as (select *, calculated_utci_c as y from obs), n as (select *, row_number() over "
    "(order by sample_id) as i, row_number() over (order by sha256(concat('5|permutation|', sample_id))) as j from sm), "
    f"base as ({formula_sql('(select y, ' + ', '.join(f'{c} as {a}' for a, c in _ARGS.items()) + ' from n)', 'y')}), r as ({_SHUFFLE_SQL}) "
    f"select feature, {s6('base_mae', 'base_mae')}, {s6('shuffled_mae', 'shuffled_mae')}, {s6('shuffled_mae - base_mae', 'importance')} from r",
)
