"""Table-quality rules compiled into one aggregation.

Rules about names and types read only the schema. All row rules become counters of a single
``agg`` over one scan, turned long afterwards. Only the two duplicate rules shuffle, on
pre-aggregated keys. Offending examples are a second, separate pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.heat import CATEGORY_LABELS, CATEGORY_THRESHOLDS_C
from ..functions.predictors import LABEL_COLUMNS, METADATA_COLUMNS, PredictorPolicy

# Required columns by use of the table.
TRAINING_METADATA = (
    "sample_id", "site_id", "date", "timestamp_utc", "latitude", "longitude", "sensor_id",
    "measurement_height_m", "calibration_version", "quality_flag", "split_role",
)
PREDICTION_METADATA = (
    "sample_id", "date", "timestamp_utc", "latitude", "longitude", "measurement_height_m",
)
REQUIRED_LABELS = (
    "measured_air_temperature_c", "measured_relative_humidity_pct",
    "measured_pedestrian_wind_speed_m_s", "measured_globe_temperature_c", "calculated_mrt_c",
    "calculated_utci_c", "utci_category", "label_uncertainty_c",
)
OPTIONAL_COLUMNS = (
    "spatial_block_id", "weather_event_id", "timezone_name", "optional_wbgt_c", "wbgt_c",
    "sun_shade_group", "coast_distance_group", "time_of_day_group",
)
TEXT_COLUMNS = (
    "sample_id", "site_id", "date", "sensor_id", "spatial_block_id", "weather_event_id",
    "timezone_name", "calibration_version", "quality_flag", "split_role", "utci_category",
    "land_cover_class", "sun_shade_group", "coast_distance_group", "time_of_day_group",
    "satellite_thermal_source", "satellite_lst_quality_flag",
)

# Plausible range by column name; None leaves a side open.
RANGES: dict[str, tuple[float | None, float | None]] = {
    "latitude": (-90, 90), "longitude": (-180, 180),
    "measurement_height_m": (math.nextafter(0.0, 1.0), 50),
    "measured_air_temperature_c": (-50, 65), "measured_relative_humidity_pct": (0, 100),
    "measured_pedestrian_wind_speed_m_s": (0, 40), "measured_globe_temperature_c": (-60, 120),
    "calculated_mrt_c": (-70, 120), "calculated_mean_radiant_temperature_c": (-70, 120),
    "calculated_utci_c": (-100, 100), "optional_wbgt_c": (-50, 65), "wbgt_c": (-50, 65),
    "label_uncertainty_c": (0, 30), "background_surface_pressure_pa": (50_000, 110_000),
    "background_shortwave_radiation_w_m2": (0, 1_400),
    "background_weather_source_distance_m": (0, 500_000),
    "background_weather_age_minutes": (0, 10_080),
    "background_temperature_heating_rate_c_per_h": (-30, 30),
    "background_cumulative_hot_hours_24h": (0, 24), "elevation_m": (-500, 9_000),
    "slope_degrees": (0, 90), "distance_to_coast_m": (0, 5_000_000),
    "distance_to_major_road_m": (0, 5_000_000), "solar_elevation_degrees": (-90, 90),
    "satellite_lst_c": (-80, 100), "satellite_lst_minus_background_air_temperature_c": (-100, 100),
    "satellite_image_age_hours": (0, None), "satellite_view_zenith_degrees": (0, 90),
    "satellite_lst_quality_score": (0, 1), "satellite_cloud_fraction": (0, 1),
    "satellite_valid_pixel_fraction": (0, 1), "satellite_lst_missing": (0, 1),
    "background_dew_point_c": (-80, 65), "background_relative_humidity_pct": (0, 100),
    "background_cloud_cover_pct": (0, 100), "background_wind_speed_m_s": (0, 75),
    "ndvi": (-1, 1), "ndbi": (-1, 1), "ndwi": (-1, 1), "sky_view_factor": (0, 1),
    "albedo_proxy": (0, 1), "solar_elevation_x_shortwave": (-126_000, 126_000),
    "background_wind_x_sky_view_factor": (0, 75),
    "distance_to_coast_x_background_wind": (0, 375_000_000),
}

# Ranges of name families, the first match counts.
RANGE_FAMILIES: tuple[tuple[str, tuple[float | None, float | None]], ...] = (
    (r"ndvi_mean_\d+m", (-1, 1)),
    (r".*_(sin|cos)", (-1, 1)),
    (r".*fraction.*", (0, 1)),
    (r"(sky_view_factor|albedo_mean)_\d+m", (0, 1)),
    (r".*canopy_to_impervious_ratio.*", (0, None)),
    (r".*mean_building_height_m.*", (0, 1_000)),
    (r"background_air_temperature.*", (-80, 65)),
    (r"background_precipitation_.*", (0, 500)),
)

# Unit of each column and accepted spellings.
UNITS = {
    "latitude": "degree", "longitude": "degree", "measurement_height_m": "m",
    "measured_air_temperature_c": "degC", "measured_relative_humidity_pct": "%",
    "measured_pedestrian_wind_speed_m_s": "m/s", "measured_globe_temperature_c": "degC",
    "calculated_mrt_c": "degC", "calculated_utci_c": "degC", "optional_wbgt_c": "degC",
    "wbgt_c": "degC", "label_uncertainty_c": "degC", "background_air_temperature_c": "degC",
    "background_dew_point_c": "degC", "background_relative_humidity_pct": "%",
    "background_wind_speed_m_s": "m/s", "background_surface_pressure_pa": "Pa",
    "background_cloud_cover_pct": "%", "background_shortwave_radiation_w_m2": "W/m2",
    "background_precipitation_1h_mm": "mm", "background_precipitation_3h_mm": "mm",
    "background_weather_source_distance_m": "m", "background_weather_age_minutes": "min",
    "background_temperature_heating_rate_c_per_h": "degC/h",
    "background_cumulative_hot_hours_24h": "h", "elevation_m": "m", "slope_degrees": "degree",
    "distance_to_coast_m": "m", "distance_to_major_road_m": "m",
    "solar_elevation_degrees": "degree", "satellite_lst_c": "degC",
    "satellite_lst_minus_background_air_temperature_c": "degC",
    "satellite_image_age_hours": "h", "satellite_view_zenith_degrees": "degree",
}
UNIT_SPELLINGS = {
    "degc": ("degc", "c", "celsius", "°c"), "%": ("%", "percent", "pct"),
    "m/s": ("m/s", "m s-1", "ms-1"), "pa": ("pa",), "w/m2": ("w/m2", "w m-2"), "mm": ("mm",),
    "m": ("m", "meter", "metre"), "min": ("min", "minute"), "h": ("h", "hour"),
    "degree": ("degree", "degrees", "deg"), "degc/h": ("degc/h", "°c/h"),
}

# Closed vocabularies and paired columns.
QUALITY_FLAGS = ("pass", "suspect", "fail")
ROLES = ("unassigned", "development", "calibration", "final_test")
LAND_COVER = (
    "built_up", "tree_canopy", "low_vegetation", "bare_ground", "water", "wetland",
    "agriculture", "mixed", "other", "unknown",
)
CYCLIC_PAIRS = (
    ("aspect_sin", "aspect_cos"), ("solar_azimuth_sin", "solar_azimuth_cos"),
    ("hour_sin", "hour_cos"), ("day_of_year_sin", "day_of_year_cos"),
    ("satellite_overpass_hour_sin", "satellite_overpass_hour_cos"),
)
SENTINEL = r"(?i)^(-?9999(\.0)?|missing|null|n/?a)$"

ISSUE_SCHEMA = "severity string, code string, column_name string, row_count bigint, message string"


class SchemaError(ValueError):
    """The table broke at least one rule of severity ``error``."""


@dataclass(frozen=True)
class QualityRules:
    """What is required of a table and where the missingness limits lie."""

    policy: PredictorPolicy = field(default_factory=PredictorPolicy)
    predictor_set: str = "core"
    require_labels: bool = True
    require_role: bool = True
    require_block: bool = False
    strict_columns: bool = True
    roles: Sequence[str] = ROLES
    land_cover: Sequence[str] = LAND_COVER
    warn_missing: float = 0.2
    error_missing: float = 0.8

    def non_nullable(self) -> list[str]:
        names = list(TRAINING_METADATA + REQUIRED_LABELS if self.require_labels else PREDICTION_METADATA)
        if not self.require_role and "split_role" in names:
            names.remove("split_role")
        return names + (["spatial_block_id"] if self.require_block else [])

    def required(self) -> list[str]:
        return self.non_nullable() + list(self.policy.allowed(self.predictor_set))

    def known(self) -> set[str]:
        return {
            *METADATA_COLUMNS, *LABEL_COLUMNS, *TRAINING_METADATA, *REQUIRED_LABELS,
            *OPTIONAL_COLUMNS, *self.policy.allowed("satellite_enhanced"),
        }

    def limits(self) -> tuple[float, float]:
        ok = 0 <= self.warn_missing <= self.error_missing <= 1
        return (self.warn_missing, self.error_missing) if ok else (0.2, 0.8)


def plausible_range(column: str) -> tuple[float | None, float | None] | None:
    if column in RANGES:
        return RANGES[column]
    for pattern, bounds in RANGE_FAMILIES:
        if re.fullmatch(pattern, column):
            return bounds
    return None


@dataclass(frozen=True)
class RowRule:
    """A predicate, as SQL text, that marks bad rows of one column.

    Text keeps building hundreds of rules cheap: one parser call instead of a chain of calls
    into the JVM per rule.
    """

    severity: str
    code: str
    column: str
    bad: str
    message: str = ""


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _is_floating(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))


def _number(df: DataFrame, c: str) -> str:
    """SQL double, null for NaN or text that is not a number."""
    value = f"`{c}`" if isinstance(df.schema[c].dataType, T.DoubleType) else f"try_cast(`{c}` as double)"
    return f"nanvl({value}, cast(null as double))" if _is_text(df, c) or _is_floating(df, c) else value


def _missing(df: DataFrame, c: str) -> str:
    return f"(`{c}` is null or isnan(`{c}`))" if _is_floating(df, c) else f"(`{c}` is null)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _outside_set(x: str, allowed: Sequence[str]) -> str:
    return f"{x} not in ({', '.join(_text(v) for v in allowed)})"


def timestamp_problems(df: DataFrame, column: str) -> dict[str, str]:
    """Invalid, naive and non-UTC predicates of an instant column."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return {"naive_timestamp": f"`{column}` is not null"}
    if isinstance(kind, T.TimestampType):
        return {}
    text = f"trim(cast(`{column}` as string))"
    readable = f"try_to_timestamp({text}) is not null"
    # A bare date ends like an offset ("-07-20"), so a zone needs a time before it.
    zone = f"{text} rlike r'\\d{{2}}:\\d{{2}}.*(Z|[+-]\\d{{2}}:?\\d{{2}})$'"
    zero = f"{text} rlike r'(Z|[+-]00:?00)$'"
    return {
        "invalid_timestamp": f"`{column}` is not null and not ({readable})",
        "naive_timestamp": f"{readable} and not ({zone})",
        "non_utc_timestamp": f"{readable} and {zone} and not ({zero})",
    }


def invalid_day(column: str) -> str:
    """Text that does not survive a round trip as YYYY-MM-DD."""
    text = f"cast(`{column}` as string)"
    return f"`{column}` is not null and not (date_format(try_cast({text} as date), 'yyyy-MM-dd') <=> {text})"


def _category(x: str) -> str:
    steps = " ".join(f"when {x} < {bound} then '{label}'" for bound, label in zip(CATEGORY_THRESHOLDS_C, CATEGORY_LABELS))
    return f"case when {x} is null then null {steps} else '{CATEGORY_LABELS[-1]}' end"


def row_rules(df: DataFrame, rules: QualityRules) -> list[RowRule]:
    """Every row predicate that applies to the columns the table has."""
    has = set(df.columns)
    out: list[RowRule] = []

    def error(code: str, column: str, bad: str, message: str) -> None:
        out.append(RowRule("error", code, column, bad, message))

    for c in sorted(set(rules.non_nullable()) & has):
        blank = f"({_missing(df, c)} or trim(`{c}`) = '')" if _is_text(df, c) else _missing(df, c)
        error("missing_nonnullable", c, blank, "required value is missing or blank")

    known = rules.known()
    for c in df.columns:
        if _is_text(df, c):
            if c in known and c not in TEXT_COLUMNS + ("timestamp_utc",) + rules.policy.categorical:
                error("wrong_dtype", c, f"`{c}` is not null and try_cast(`{c}` as double) is null", "expected a number")
            error("textual_missing_sentinel", c, f"trim(`{c}`) rlike r'{SENTINEL}'", "a text stands for a missing value")
        bounds = plausible_range(c)
        if bounds is None or c in TEXT_COLUMNS:
            continue
        x = _number(df, c)
        if _is_text(df, c) or _is_floating(df, c):
            error("nonfinite_numeric", c, f"abs({x}) = double('infinity')", "infinite value")
        low, high = bounds
        sides = [f"{x} < {float(low)!r}D"] if low is not None else []
        sides += [f"{x} > {float(high)!r}D"] if high is not None else []
        error("physical_range", c, f"({' or '.join(sides)})", f"outside [{low}, {high}]")

    if "satellite_lst_missing" in has:
        flag = _number(df, "satellite_lst_missing")
        error("invalid_binary_indicator", "satellite_lst_missing", f"{flag} not in (0, 1)", "must be 0 or 1")
        if "satellite_lst_c" in has:
            error("satellite_missingness_mismatch", "satellite_lst_missing",
                  f"{_missing(df, 'satellite_lst_c')} <> coalesce({flag} = 1, false) and not {_missing(df, 'satellite_lst_missing')}",
                  "the indicator disagrees with the value")
    if "timestamp_utc" in has:
        for code, bad in timestamp_problems(df, "timestamp_utc").items():
            error(code, "timestamp_utc", bad, "use ISO-8601 with a zero offset")
    if "date" in has:
        error("invalid_local_date", "date", invalid_day("date"), "use YYYY-MM-DD")
    vocabularies = (
        ("invalid_split_role", "split_role", "`split_role`", rules.roles),
        ("invalid_quality_flag", "quality_flag", "lower(trim(`quality_flag`))", QUALITY_FLAGS),
        ("invalid_land_cover_class", "land_cover_class", "`land_cover_class`", rules.land_cover),
        ("invalid_utci_category", "utci_category", "`utci_category`", CATEGORY_LABELS),
    )
    for code, column, x, allowed in vocabularies:
        if column in has and allowed:
            error(code, column, _outside_set(x, allowed), "not in the closed vocabulary")
    if {"utci_category", "calculated_utci_c"} <= has and not _is_text(df, "calculated_utci_c"):
        # Infinite values have a category here, unlike in the reports.
        derived = _category(_number(df, "calculated_utci_c"))
        error("category_threshold_mismatch", "utci_category", f"`utci_category` <> ({derived})",
              "label disagrees with the continuous value")
    if {"background_dew_point_c", "background_air_temperature_c"} <= has:
        error("dew_point_above_air_temperature", "background_dew_point_c",
              f"{_number(df, 'background_dew_point_c')} > {_number(df, 'background_air_temperature_c')} + 1",
              "dew point exceeds air temperature by more than one degree")
    for sine, cosine in CYCLIC_PAIRS:
        if {sine, cosine} <= has:
            a, b = _number(df, sine), _number(df, cosine)
            out.append(RowRule("warning", "cyclic_pair_norm", sine,
                               f"sqrt({a} * {a} + {b} * {b}) not between 0.95D and 1.05D", "the pair is not of unit length"))
    return out


def rule_counts(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """Bad rows per rule, zero included, from one aggregation over one scan."""
    if not rules:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    counted = df.selectExpr(*[f"count_if({r.bad}) as r{i}" for i, r in enumerate(rules)])
    entries = ", ".join(
        f"named_struct('severity', {_text(r.severity)}, 'code', {_text(r.code)}, 'column_name', {_text(r.column)}, "
        f"'row_count', r{i}, 'message', {_text(r.message)})"
        for i, r in enumerate(rules)
    )
    return counted.selectExpr(f"inline(array({entries}))")


def missing_value(df: DataFrame, column: str) -> Column:
    """Null, or NaN for floating types."""
    return F.expr(_missing(df, column))


def missing_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing rows and fraction per column; fraction one for an empty table."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(missing_value(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing"),
            F.coalesce(F.try_divide(F.col(f"m{i}"), F.col("n")), F.lit(1.0)).alias("fraction"),
        )
        for i, c in enumerate(columns)
    ]
    return counted.select(F.inline(F.array(*entries)))


def missingness_issues(df: DataFrame, rules: QualityRules) -> DataFrame:
    present = [c for c in rules.policy.allowed(rules.predictor_set) if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    warn, error = rules.limits()
    f = F.col("fraction")
    code = (
        F.when(f >= 1.0, F.lit("all_missing_predictor"))
        .when(f >= error, F.lit("excessive_predictor_missingness"))
        .when(f >= warn, F.lit("high_predictor_missingness"))
    )
    graded = missing_fractions(df, present).withColumn("code", code).filter("code is not null")
    return graded.select(
        F.when(F.col("code") == "high_predictor_missingness", F.lit("warning")).otherwise(F.lit("error")).alias("severity"),
        "code", "column_name", F.col("missing").alias("row_count"),
        F.concat(F.lit("missing fraction "), F.round(f, 4).cast("string")).alias("message"),
    )


def duplicate_members(df: DataFrame, keys: Sequence[str], drop_null_keys: bool = True) -> DataFrame:
    """Keys that occur more than once with their row counts; partial counts precede the shuffle."""
    if drop_null_keys:
        df = df.dropna(subset=list(keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")


def _duplicate_issue(df: DataFrame, keys: Sequence[str], severity: str, code: str, drop_null_keys: bool) -> DataFrame:
    total = duplicate_members(df, keys, drop_null_keys).agg(F.coalesce(F.sum("members"), F.lit(0)).alias("row_count"))
    return total.select(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"),
        F.lit(",".join(keys)).alias("column_name"), F.col("row_count").cast("bigint"),
        F.lit("rows share a key").alias("message"),
    )


def schema_issues(df: DataFrame, rules: QualityRules, units: Mapping[str, str] | None = None) -> list[tuple]:
    """Findings that need only names, types and unit metadata."""
    issues: list[tuple] = []
    names = df.columns
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        issues.append(("error", "duplicate_column_names", ",".join(repeated), None, "column names repeat"))
    odd = [n for n in names if re.fullmatch(r"[a-z][a-z0-9_]*", n) is None]
    if odd:
        issues.append(("error", "invalid_column_names", ",".join(odd), None, "use lower snake_case"))
    for c in sorted(set(rules.required()) - set(names)):
        issues.append(("error", "missing_required_column", c, None, "required column is absent"))
    if "spatial_block_id" not in names and not rules.require_block:
        issues.append(("warning", "spatial_block_not_yet_assigned", "spatial_block_id", None, "derive blocks first"))
    unknown = sorted(set(names) - rules.known())
    if unknown and rules.strict_columns:
        issues.append(("error", "unknown_columns", ",".join(unknown), None, "not in the versioned schema"))
    if not 0 <= rules.warn_missing <= rules.error_missing <= 1:
        issues.append(("error", "invalid_missingness_config", None, None, "need 0 <= warn <= error <= 1"))
    text = set(TEXT_COLUMNS) | set(rules.policy.categorical)
    for name in dict.fromkeys(names):
        if names.count(name) > 1 or name == "timestamp_utc":
            continue
        kind = df.schema[name].dataType
        if name in text and not isinstance(kind, T.StringType):
            issues.append(("error", "wrong_dtype", name, None, f"expected text, found {kind.simpleString()}"))
        elif name not in text and name in rules.known() and not isinstance(
            kind, (T.NumericType, T.BooleanType, T.StringType)
        ):
            issues.append(("error", "wrong_dtype", name, None, f"expected a number, found {kind.simpleString()}"))
    supplied = dict(units or {})
    if units is None:
        supplied = {f.name: f.metadata["unit"] for f in df.schema.fields if "unit" in (f.metadata or {})}
    spelling = {s: unit for unit, all_spellings in UNIT_SPELLINGS.items() for s in all_spellings}
    for c, unit in supplied.items():
        if c in names and c in UNITS and spelling.get(str(unit).strip().lower()) != spelling.get(UNITS[c].lower()):
            issues.append(("error", "unit_mismatch", c, None, f"unit {unit!r} where {UNITS[c]!r} is required"))
    return issues


def validate(df: DataFrame, rules: QualityRules = QualityRules(), units: Mapping[str, str] | None = None) -> DataFrame:
    """All findings as ``(severity, code, column_name, row_count, message)``."""
    spark = df.sparkSession
    static = schema_issues(df, rules, units)
    found = spark.createDataFrame(static, ISSUE_SCHEMA)
    if any(code == "duplicate_column_names" for _, code, *_ in static):
        return found
    parts = [empty_table(df), rule_counts(df, row_rules(df, rules)), missingness_issues(df, rules)]
    if "sample_id" in df.columns:
        parts.append(_duplicate_issue(df, ["sample_id"], "error", "duplicate_sample_id", True))
    if {"site_id", "timestamp_utc"} <= set(df.columns):
        parts.append(_duplicate_issue(df, ["site_id", "timestamp_utc"], "warning", "duplicate_site_timestamp", False))
    for part in parts:
        found = found.unionByName(part)
    return found.filter((F.col("row_count") > 0) | F.col("row_count").isNull() | F.col("code").isin("empty_table", "all_missing_predictor"))


def empty_table(df: DataFrame) -> DataFrame:
    """The finding that a table has no row; no row if it has one."""
    return df.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("error").alias("severity"), F.lit("empty_table").alias("code"),
        F.lit(None).cast("string").alias("column_name"), F.col("n").alias("row_count"),
        F.lit("the table has no rows").alias("message"),
    )


def failing(df: DataFrame, rules: Sequence[RowRule]) -> list[RowRule]:
    """The rules broken by at least one row (one count per rule reaches the driver)."""
    broken = {(r["code"], r["column_name"]) for r in rule_counts(df, rules).filter("row_count > 0").collect()}
    return [r for r in rules if (r.code, r.column) in broken]


def examples(df: DataFrame, rules: Sequence[RowRule], id_column: str = "sample_id", limit: int = 3) -> DataFrame:
    """First offending ids per rule in id order.

    Only violations leave the generator, and the rank filter is applied inside every partition
    before the shuffle, so a rule broken by most rows still moves ``limit`` rows per task.
    """
    if not rules:
        none = F.lit(None).cast("string")
        return df.limit(0).select(F.col(id_column), none.alias("code"), none.alias("column_name"), none.alias("value"),
                                  F.lit(0).alias("position"))
    hits = ", ".join(
        f"case when {r.bad} then named_struct('code', {_text(r.code)}, 'column_name', {_text(r.column)}, "
        f"'value', cast(`{r.column}` as string)) end"
        for r in rules
    )
    broken = df.selectExpr(f"`{id_column}`", f"inline(array_compact(array({hits})))")
    order = Window.partitionBy("code", "column_name").orderBy(id_column)
    return broken.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def summary(issues: DataFrame) -> DataFrame:
    """Issue counts by severity with the overall verdict."""
    counts = issues.agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )
    return counts.withColumn("is_valid", F.col("error_count") == 0)


def require_valid(issues: DataFrame) -> DataFrame:
    """Raise with the list of errors (one row per rule and column), else return the issues."""
    errors = [r.asDict() for r in issues.filter("severity = 'error'").collect()]
    if errors:
        raise SchemaError(f"{len(errors)} schema errors: {errors}")
    return issues
