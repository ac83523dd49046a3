"""Preprocessing fitted on the training part only.

Fitted state is a few numbers per column and lives on the driver; applying it is a
projection of native expressions.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import number
from ..functions.predictors import PredictorPolicy, checked_predictors
from .order_stats import column_quantiles, parts_quantiles

# Accepted model kinds; only the linear ones are standardised.
TREE_KINDS = ("boosted_trees", "random_forest")
LINEAR_KINDS = ("linear",)


class EncodingError(ValueError):
    """Training values cannot be encoded."""


@dataclass(frozen=True)
class Encoder:
    """Fitted columns, medians, scales and category lists in output order."""

    kind: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    indicators: tuple[str, ...]
    medians: dict[str, float]
    centres: dict[str, float]
    scales: dict[str, float]
    categories: dict[str, list[str]]
    suffix: str = "__missing"
    missing_token: str = "__MISSING__"

    @property
    def predictors(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def feature_columns(self) -> dict[str, Column]:
        """Output name to expression: numeric, missing indicators, one-hot."""
        out: dict[str, Column] = {}
        for c in self.numeric:
            x = F.coalesce(self.checked(c), F.lit(self.medians[c]))
            if self.scales:
                x = (x - F.lit(self.centres[c])) / F.lit(self.scales[c])
            out[c] = x
        for c in self.indicators:
            out[c + self.suffix] = number(c).isNull().cast("double")
        for c in self.categorical:
            text = F.coalesce(F.col(c).cast("string"), F.lit(self.missing_token))
            for value in self.categories[c]:
                # A value unseen in training equals no category: all zeros.
                out[f"{c}_{value}"] = (text == F.lit(value)).cast("double")
        return out

    def arrays(self, raw: Mapping[str, np.ndarray]) -> list[np.ndarray]:
        """``feature_columns`` of a batch in a task: numbers (NaN where missing) and texts by column."""
        out = []
        for c in self.numeric:
            x = np.where(np.isnan(raw[c]), self.medians[c], raw[c])
            out.append((x - self.centres[c]) / self.scales[c] if self.scales else x)
        out += [np.isnan(raw[c]).astype(float) for c in self.indicators]
        for c in self.categorical:
            text = np.array([self.missing_token if v is None else v for v in raw[c]], object)
            out += [(text == value).astype(float) for value in self.categories[c]]
        return out

    def refusals(self, df: DataFrame) -> DataFrame:
        """One row: per numeric column, values that are present but no finite number (column names as in ``df``)."""
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

        def bad(c: str) -> Column:
            x = number(c)
            absent = F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False))
            return (x.isNull() & ~absent) | F.coalesce(F.abs(x) == float("inf"), F.lit(False))

        return df.agg(*[F.count_if(bad(c)).alias(c) for c in self.numeric])

    def require_numbers(self, df: DataFrame) -> DataFrame:
        """``df``, or an error if a numeric predictor holds text or an infinite value."""
        wrong = {k: v for k, v in self.refusals(df).first().asDict().items() if v}
        if wrong:
            raise EncodingError(f"not finite numbers: {wrong}")
        return df

    def checked(self, c: str) -> Column:
        """The number in a column; a present value that is no finite number fails the job."""
        x = number(c)
        text = F.lower(F.trim(F.col(c).cast("string")))
        bad = (x.isNull() & text.isNotNull() & ~text.isin("nan", "")) | F.coalesce(F.abs(x) == float("inf"), F.lit(False))
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{c} is not a finite number: "), text)).cast("double")).otherwise(x)

    @property
    def feature_names(self) -> list[str]:
        return list(self.feature_columns())

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Encoded columns beside ``keep``."""
        return df.select(*keep, *[e.alias(f"f_{n}") for n, e in self.feature_columns().items()])

    def with_features(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the feature vector for Spark ML."""
        named = {f"__f{i}": e for i, e in enumerate(self.feature_columns().values())}
        wide = df.withColumns(named)
        return VectorAssembler(inputCols=list(named), outputCol=output).transform(wide).drop(*named)

    def with_array(self, df: DataFrame, output: str = "x") -> DataFrame:
        return df.withColumn(output, F.array(*self.feature_columns().values()))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Encoder:
        state = json.loads(text)
        for name in ("numeric", "categorical", "indicators"):
            state[name] = tuple(state[name])
        return cls(**state)


def fit_encoder(
    train: DataFrame,
    policy: PredictorPolicy,
    predictor_set: str = "core",
    predictors: Sequence[str] | None = None,
    kind: str = "boosted_trees",
    add_indicators: bool = True,
    missing_token: str = "__MISSING__",
) -> Encoder:
    """Fit on ``train``. Text that is no number and infinite values are refused.

    Spark trees reject NaN, so they too get the median beside its missing indicator.
    """
    numeric, categorical = _chosen(train, policy, predictor_set, predictors, kind)
    checks = _checks(train, numeric, categorical, missing_token)
    row = train.agg(*checks).first().asDict()
    _require_numeric(row, numeric)
    found = column_quantiles(train, numeric) if numeric else {}
    medians = {c: m if m is not None else 0.0 for c, m in found.items()}
    centres: dict[str, float] = {}
    scales: dict[str, float] = {}
    if kind in LINEAR_KINDS and numeric:
        filled = {c: F.coalesce(number(c), F.lit(medians[c])) for c in numeric}
        moments = train.agg(
            *[F.avg(x).alias(f"a{i}") for i, x in enumerate(filled.values())],
            *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled.values())],
        ).first()
        centres = {c: moments[f"a{i}"] for i, c in enumerate(numeric)}
        scales = {c: moments[f"s{i}"] or 1.0 for i, c in enumerate(numeric)}
    return _encoder(row, kind, numeric, categorical, medians, centres, scales, policy, add_indicators, missing_token)


def fit_encoders(
    df: DataFrame, parts: Sequence[Column], policy: PredictorPolicy, predictor_set: str = "core", predictors: Sequence[str] | None = None,
    missing_token: str = "__MISSING__",
) -> list[Encoder]:
    """The ``fit_encoder`` of the rows of each part, for trees; all parts in the same passes over ``df``."""
    numeric, categorical = _chosen(df, policy, predictor_set, predictors, TREE_KINDS[0])
    mine = F.array_compact(F.array(*[F.when(rows, F.lit(p)) for p, rows in enumerate(parts)]))
    rows = df.select(F.explode(mine).alias("__part"), *numeric, *categorical)
    found = {r["__part"]: r.asDict() for r in rows.groupBy("__part").agg(*_checks(df, numeric, categorical, missing_token)).collect()}  # one row a part
    nothing = {f"{k}{i}": 0 for k in "mti" for i in range(len(numeric))} | {f"c{i}": [] for i in range(len(categorical))}
    for row in found.values():
        _require_numeric(row, numeric)
    medians = parts_quantiles(df, parts, numeric, 0.5)
    return [_encoder(found.get(p, nothing), TREE_KINDS[0], numeric, categorical, {c: 0.0 if (m := medians[p, c]) is None else m for c in numeric}, {}, {},
                     policy, True, missing_token) for p in range(len(parts))]


def _chosen(train: DataFrame, policy: PredictorPolicy, predictor_set: str, predictors: Sequence[str] | None,
            kind: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Numeric and categorical predictors."""
    if kind not in TREE_KINDS + LINEAR_KINDS:
        raise ValueError(f"unknown model kind {kind!r}")
    wanted = list(predictors) if predictors is not None else [
        c for c in policy.allowed(predictor_set) if c in train.columns
    ]
    if not wanted:
        raise EncodingError("no predictors")
    chosen = checked_predictors(wanted, policy, predictor_set)
    absent = [c for c in chosen if c not in train.columns]
    if absent:
        raise EncodingError(f"training table lacks {absent}")
    return tuple(c for c in chosen if c not in policy.categorical), tuple(c for c in chosen if c in policy.categorical)


def _checks(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], missing_token: str) -> list[Column]:
    types = {f.name: f.dataType.simpleString() for f in train.schema.fields}

    checks = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(numeric):
        x = number(c)
        absent_value = F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False))
        checks += [
            F.count_if(x.isNull()).alias(f"m{i}"),
            F.count_if(x.isNull() & ~absent_value).alias(f"t{i}"),
            F.count_if(F.abs(x) == float("inf")).alias(f"i{i}"),
        ]
    seen = [F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit(missing_token))).alias(f"c{i}")
            for i, c in enumerate(categorical)]  # one-hot columns: as many values as the model has features
    return checks + seen


def _require_numeric(row: Mapping[str, int], numeric: Sequence[str]) -> None:
    text = {c: row[f"t{i}"] for i, c in enumerate(numeric) if row[f"t{i}"]}
    infinite = {c: row[f"i{i}"] for i, c in enumerate(numeric) if row[f"i{i}"]}
    if text or infinite:
        raise EncodingError(f"not numeric: {text}; infinite: {infinite}")


def _encoder(row: Mapping, kind: str, numeric: tuple[str, ...], categorical: tuple[str, ...], medians: dict[str, float], centres: dict[str, float],
             scales: dict[str, float], policy: PredictorPolicy, add_indicators: bool, missing_token: str) -> Encoder:
    with_missing = {c for i, c in enumerate(numeric) if row[f"m{i}"]}
    explicit = set(policy.indicator_columns)
    indicators = tuple(c for c in numeric if c in (explicit or with_missing)) if add_indicators else ()
    categories = {c: sorted(row[f"c{i}"]) for i, c in enumerate(categorical)}
    encoder = Encoder(kind, numeric, categorical, indicators, medians, centres, scales, categories,
                      policy.missing_suffix, missing_token)
    check_provenance(encoder)
    return encoder


def check_provenance(encoder: Encoder) -> None:
    """Every output must come from a declared column."""
    for name in encoder.feature_names:
        parent = name.removesuffix(encoder.suffix)
        if not (name in encoder.numeric or parent in encoder.numeric
                or any(name.startswith(f"{c}_") for c in encoder.categorical)):
            raise EncodingError(f"output {name!r} has no declared parent")
