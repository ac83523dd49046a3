"""Saving and loading fitted models with their encoders."""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import SparkSession

from ..operators.boosting import BoostedTrees
from ..operators.encode import Encoder
from ..operators.forest import SUBTREE, Forest, Top
from ..operators.linear import LinearFit
from ..operators.models import FittedModel
from .tables import SourceError, exists

KINDS = {"RandomForestRegressionModel": RandomForestRegressionModel}
TREES = "tree int, feature array<int>, split array<double>, value array<double>"
TOPS = "tree int, feature array<int>, cut array<int>, below array<int>, value array<double>, depth array<int>, dealt array<boolean>"


def save_model(spark: SparkSession, fitted: FittedModel | LinearFit, path: str) -> str:
    """Model folder plus a one-row table with the encoder; an existing folder is refused."""
    if exists(spark, path):
        raise SourceError(f"{path} exists; frozen models are not overwritten")
    if isinstance(fitted, LinearFit):
        state = ("linear", fitted.encoder.to_json(), 0, "", fitted.intercept, list(fitted.coefficients),
                 fitted.alpha, fitted.l1_ratio)
    elif isinstance(fitted.model, BoostedTrees):
        trees = fitted.model
        rows = [(i, f.tolist(), s.tolist(), v.tolist()) for i, (f, s, v) in enumerate(zip(trees.feature, trees.split, trees.value))]
        spark.createDataFrame(rows, TREES).coalesce(1).write.parquet(f"{path}/model")
        state = ("boosted", fitted.encoder.to_json(), fitted.tree_count, fitted.variant, trees.start, list(fitted.curve), None, None)
    elif isinstance(fitted.model, Forest):
        tops = [(i, t.feature, t.cut, t.below, t.value, t.depth, t.dealt) for i, t in enumerate(fitted.model.tops)]
        spark.createDataFrame(tops, TOPS).coalesce(1).write.parquet(f"{path}/tops")
        edges = [(i, e.tolist()) for i, e in enumerate(fitted.model.edges)]
        spark.createDataFrame(edges, "feature int, edges array<double>").coalesce(1).write.parquet(f"{path}/edges")
        fitted.model.subtrees.write.parquet(f"{path}/model")
        state = ("forest", fitted.encoder.to_json(), fitted.tree_count, fitted.variant, None, None, None, None)
    else:
        fitted.model.write().save(f"{path}/model")
        state = (type(fitted.model).__name__, fitted.encoder.to_json(), fitted.tree_count, fitted.variant,
                 None, None, None, None)
    spark.createDataFrame(
        [state],
        "kind string, encoder string, tree_count int, variant string, intercept double, "
        "coefficients array<double>, alpha double, l1_ratio double",
    ).coalesce(1).write.parquet(f"{path}/state")
    return path


def load_model(spark: SparkSession, path: str) -> FittedModel | LinearFit:
    if not exists(spark, f"{path}/state"):
        raise SourceError(f"no stored model at {path}")
    s = spark.read.parquet(f"{path}/state").first()
    encoder = Encoder.from_json(s["encoder"])
    if s["kind"] == "linear":
        return LinearFit(encoder, s["intercept"], tuple(s["coefficients"]), s["alpha"], s["l1_ratio"])
    if s["kind"] == "boosted":
        rows = spark.read.schema(TREES).parquet(f"{path}/model").orderBy("tree").collect()  # one row a tree
        feature, split, value = (np.array([r[c] for r in rows]) for c in ("feature", "split", "value"))
        trees = BoostedTrees(s["intercept"], feature.astype(np.int32), split, value)
        return FittedModel(trees, encoder, s["tree_count"], s["variant"], tuple(s["coefficients"]))
    if s["kind"] == "forest":
        tops = [Top(*[list(v) for v in r[1:]], open=[]) for r in spark.read.schema(TOPS).parquet(f"{path}/tops").orderBy("tree").collect()]  # one row a tree
        edges = [np.array(r["edges"]) for r in spark.read.parquet(f"{path}/edges").orderBy("feature").collect()]  # one row a feature
        return FittedModel(Forest(tops, spark.read.schema(SUBTREE).parquet(f"{path}/model"), edges), encoder, s["tree_count"], s["variant"])
    return FittedModel(KINDS[s["kind"]].load(f"{path}/model"), encoder, s["tree_count"], s["variant"])
