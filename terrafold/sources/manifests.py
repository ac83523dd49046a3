"""Stored split manifests. JSON manifests carry a digest beside them that must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.digests import table_digest
from ..operators.folds import SplitDesign, SplitError
from ..operators.manifest import create_manifest, manifest_findings, require_manifest
from ..operators.roles import RoleDesign
from .tables import exists, format_of, same_path, write_table

MANIFEST_SCHEMA = (
    "sample_id string, site_id string, spatial_block_id string, date string, weather_event_id string, "
    "split_role string, outer_fold int, manifest_version string"
)


def _digest_path(path: str) -> str:
    return path.rstrip("/") + ".digest.parquet"


def write_manifest(manifest: DataFrame, path: str, overwrite: bool = False) -> str:
    """Write by suffix; the digest is a one-row side table."""
    write_table(manifest, path, overwrite=overwrite)
    if format_of(path) == "json":
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema.fields)
        side = table_digest(manifest, sorted(manifest.columns)).withColumn("columns", F.lit(columns))
        write_table(side, _digest_path(path), overwrite=overwrite)
    return path


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """Read a manifest; a JSON one whose digest is absent or differs is refused."""
    kind = format_of(path)
    if not exists(spark, path):
        raise SplitError(f"manifest {path} does not exist")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).schema(schema).csv(path)
    if not exists(spark, _digest_path(path)):
        raise SplitError(f"manifest {path} lacks its digest")
    stored = spark.read.parquet(_digest_path(path)).first()
    manifest = spark.read.schema(stored["columns"]).json(path)
    current = table_digest(manifest, sorted(manifest.columns)).first()
    if stored["digest"] != current["digest"]:
        raise SplitError(f"manifest {path} was modified or only partly written")
    return manifest


def read_or_create_manifest(
    data: DataFrame,
    path: str,
    split: SplitDesign = SplitDesign(),
    design: RoleDesign = RoleDesign(),
    create_if_missing: bool = False,
    overwrite: bool = False,
    source_path: str | None = None,
) -> DataFrame:
    """Reuse a valid stored manifest, or create one when that is asked for."""
    spark = data.sparkSession
    if source_path and same_path(spark, path, source_path):
        raise SplitError("the manifest path is the observation path")
    stored = exists(spark, path)
    if stored and not overwrite:
        manifest = read_manifest(spark, path)
        require_manifest(manifest_findings(manifest, data, split, design))
        return manifest
    if not stored and not (create_if_missing or overwrite):
        raise SplitError(f"manifest {path} does not exist and was not asked for")
    manifest = create_manifest(data, split, design)
    write_manifest(manifest, path, overwrite=overwrite)
    stored_manifest = read_manifest(spark, path)
    require_manifest(manifest_findings(stored_manifest, data, split, design))
    return stored_manifest
