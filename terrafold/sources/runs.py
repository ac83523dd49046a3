"""A whole run in one folder: every fitted part of a scoring plan, and a manifest with the digest of each part's tables.

Parts are written first and the manifest last, so a folder without a manifest is an unfinished run. Reading checks every part
against its digest before anything is scored. Folders are never overwritten.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.digests import table_digest
from ..operators.encode import Encoder
from ..operators.isolation import TREE_SCHEMA, IsolationForest
from ..operators.models import ComponentModels
from ..plans.scoring import ScoringPlan, WindSettings
from .models import TREES, load_model, save_model
from .tables import SourceError, exists

MANIFEST = "part string, kind string, digest string, rows bigint"
STATE = "settings string, notes string"


def _digest(spark: SparkSession, path: str, kind: str) -> tuple[str, int]:
    """Digest of a part's state table and its trees, and their rows."""
    tables = [spark.read.parquet(f"{path}/state")]
    if kind == "boosted":
        tables.append(spark.read.schema(TREES).parquet(f"{path}/model"))
    if kind == "forest":
        tables.append(spark.read.schema(TREE_SCHEMA).parquet(f"{path}/trees"))
    found = [table_digest(t.select(*[F.to_json(F.struct(*t.columns)).alias("row")])).first() for t in tables]
    return "|".join(str(r["digest"]) for r in found), sum(t.count() for t in tables)


def _save_forest(spark: SparkSession, forest: IsolationForest, path: str) -> None:
    rows = [(i, *[list(t[k]) for k in ("feature", "split", "left", "right", "size")]) for i, t in enumerate(forest.trees)]
    spark.createDataFrame(rows, TREE_SCHEMA).coalesce(1).write.parquet(f"{path}/trees")
    spark.createDataFrame([(forest.encoder.to_json(), forest.sample)], "encoder string, sample int").coalesce(1).write.parquet(f"{path}/state")


def _load_forest(spark: SparkSession, path: str) -> IsolationForest:
    state = spark.read.parquet(f"{path}/state").first()
    rows = spark.read.schema(TREE_SCHEMA).parquet(f"{path}/trees").orderBy("tree").collect()  # one row a tree
    trees = tuple({k: list(r[k]) for k in ("feature", "split", "left", "right", "size")} for r in rows)
    return IsolationForest(Encoder.from_json(state["encoder"]), trees, state["sample"])


def save_run(spark: SparkSession, plan: ScoringPlan, path: str, notes: Mapping[str, str] | None = None) -> str:
    """Write a plan; ``notes`` (text by name) go with it."""
    if exists(spark, path):
        raise SourceError(f"{path} exists; frozen runs are not overwritten")
    parts = {"direct": plan.direct}
    if plan.components is not None:
        parts |= {f"component_{name}": fitted for name, fitted in plan.components.models.items()}
    kinds = {}
    for name, fitted in parts.items():
        save_model(spark, fitted, f"{path}/{name}")
        kinds[name] = spark.read.parquet(f"{path}/{name}/state").first()["kind"]
    if plan.anomaly is not None:
        _save_forest(spark, plan.anomaly, f"{path}/anomaly")
        kinds["anomaly"] = "forest"
    settings = {"radius": plan.radius, "warning_threshold": plan.warning_threshold, "bounds": {k: list(v) for k, v in plan.bounds.items()},
                "wind": asdict(plan.wind)}
    spark.createDataFrame([(json.dumps(settings, sort_keys=True), json.dumps(dict(notes or {}), sort_keys=True))], STATE).coalesce(1).write.parquet(f"{path}/settings/state")
    kinds["settings"] = "settings"
    rows = [(name, kind, *_digest(spark, f"{path}/{name}", kind)) for name, kind in kinds.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return path


def load_run(spark: SparkSession, path: str) -> ScoringPlan:
    """The stored plan; a part that differs from the manifest is an error."""
    if not exists(spark, f"{path}/manifest"):
        raise SourceError(f"no finished run at {path}")
    parts = {r["part"]: r for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()}  # one row a part
    changed = [name for name, r in parts.items() if _digest(spark, f"{path}/{name}", r["kind"]) != (r["digest"], r["rows"])]
    if changed:
        raise SourceError(f"parts that differ from the manifest: {sorted(changed)}")
    settings = json.loads(spark.read.schema(STATE).parquet(f"{path}/settings/state").first()["settings"])
    prefix = "component_"
    models = {name.removeprefix(prefix): load_model(spark, f"{path}/{name}") for name in parts if name.startswith(prefix)}
    wind = settings["wind"] | {"sensitivity_m": tuple(settings["wind"]["sensitivity_m"])}
    return ScoringPlan(
        load_model(spark, f"{path}/direct"), ComponentModels(models) if models else None, settings["radius"], settings["warning_threshold"],
        {k: tuple(v) for k, v in settings["bounds"].items()}, _load_forest(spark, f"{path}/anomaly") if "anomaly" in parts else None,
        WindSettings(**wind),
    )


def notes(spark: SparkSession, path: str) -> dict[str, str]:
    return json.loads(spark.read.schema(STATE).parquet(f"{path}/settings/state").first()["notes"])
