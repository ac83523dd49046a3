"""Eligibility of thermal imagery and the column-as-prediction baselines that use it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import id_mismatches, require_match
from .basic import as_column, between, finite, number

# Texts that declare a thermal value as present.
PRESENT_TOKENS = ("0", "0.0", "false", "no", "valid")


@dataclass(frozen=True)
class Eligibility:
    """Rules of the mask; ``None`` or an empty tuple switches a rule off."""

    value: str = "satellite_lst_c"
    missing_flag: str = "satellite_lst_missing"
    age_hours: str = "satellite_image_age_hours"
    source: str = "satellite_thermal_source"
    quality: str = "satellite_lst_quality_flag"
    cloud: str = "satellite_cloud_fraction"
    valid_pixels: str = "satellite_valid_pixel_fraction"
    overpass: Sequence[str] = ("satellite_overpass_hour_sin", "satellite_overpass_hour_cos")
    require_value: bool = True
    maximum_age_hours: float | None = 72.0
    allowed_sources: Sequence[str] = ("landsat", "ecostress")
    allowed_quality: Sequence[str] = ("good", "acceptable")
    maximum_cloud: float | None = 0.2
    minimum_valid_pixels: float | None = None
    require_overpass: bool = True

    def required_columns(self) -> list[str]:
        names = [self.value, self.missing_flag, self.age_hours]
        if self.allowed_sources:
            names.append(self.source)
        if self.allowed_quality:
            names.append(self.quality)
        if self.maximum_cloud is not None:
            names.append(self.cloud)
        if self.minimum_valid_pixels is not None:
            names.append(self.valid_pixels)
        if self.require_overpass:
            names.extend(self.overpass)
        return names


def _normalised(name: str) -> Column:
    return F.lower(F.trim(F.col(name).cast("string")))


def eligible(columns: Sequence[str], rules: Eligibility = Eligibility()) -> Column:
    """One boolean expression, never null. An absent rule column is an error."""
    absent = sorted(set(rules.required_columns()) - set(columns))
    if absent:
        raise ValueError(f"thermal rule columns are absent: {absent}")
    if rules.maximum_age_hours is not None and rules.maximum_age_hours < 0:
        raise ValueError("the maximum image age cannot be negative")
    tests = [_normalised(rules.missing_flag).isin(*PRESENT_TOKENS)]
    if rules.require_value:
        tests.append(finite(rules.value).isNotNull())
    tests.append(between(finite(rules.age_hours), 0.0, rules.maximum_age_hours))
    if rules.allowed_sources:
        tests.append(_normalised(rules.source).isin([s.strip().lower() for s in rules.allowed_sources]))
    if rules.allowed_quality:
        tests.append(_normalised(rules.quality).isin([q.strip().lower() for q in rules.allowed_quality]))
    if rules.maximum_cloud is not None:
        tests.append(between(number(rules.cloud), 0.0, rules.maximum_cloud))
    if rules.minimum_valid_pixels is not None:
        tests.append(number(rules.valid_pixels) >= F.lit(rules.minimum_valid_pixels))
    if rules.require_overpass:
        tests.extend(between(finite(c), -1.0, 1.0) for c in rules.overpass)
    result = F.lit(True)
    for test in tests:
        result = result & test
    return F.coalesce(result, F.lit(False))


def eligible_pair(
    core: DataFrame, enhanced: DataFrame, rules: Eligibility = Eligibility(), id_column: str = "sample_id"
) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the rows that are eligible in ``enhanced``; tables with different ids are refused."""
    require_match(id_mismatches(core, enhanced, id_column))
    kept = enhanced.filter(eligible(enhanced.columns, rules))
    return core.join(kept.select(id_column), id_column, "left_semi"), kept


def column_prediction(column, only_where: Column | None = None) -> Column:
    """A stored column taken as the prediction, optionally on eligible rows only."""
    value = number(as_column(column))
    return value if only_where is None else F.when(only_where, value)
