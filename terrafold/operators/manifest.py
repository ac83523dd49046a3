"""The split manifest: one row per sample with its role and outer fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import block_findings, with_blocks
from ..session import materialise
from .folds import (
    SplitDesign,
    SplitError,
    dual_blocked_parts,
    frozen_parts,
    part_overlaps,
    require_disjoint,
    validation_fold,
    with_parts,
)
from .joins import attach_manifest, id_mismatches
from .roles import ALL_ROLES, RoleDesign, assign_roles, final_design, require_design, role_overlaps


def roles_for(df: DataFrame, split: SplitDesign, design: RoleDesign) -> DataFrame:
    """Supplied roles, or assigned ones when every row says ``unassigned``; a mix is an error."""
    if "split_role" not in df.columns:
        return assign_roles(df, split, design)
    role = F.trim(F.col("split_role"))
    given = role.isin(*ALL_ROLES)
    counts = df.agg(
        F.count_if(F.coalesce(given, F.lit(False))).alias("given"),
        F.count_if(F.coalesce(role == "unassigned", F.lit(False))).alias("open"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if counts["given"] + counts["open"] < counts["n"]:
        raise SplitError("split_role holds unsupported values")
    if counts["given"] and counts["open"]:
        raise SplitError("split_role mixes assigned and unassigned rows")
    if counts["given"]:
        return df.withColumn("split_role", role)
    return assign_roles(df.drop("split_role"), split, design)


def create_manifest(
    df: DataFrame,
    split: SplitDesign = SplitDesign(),
    design: RoleDesign = RoleDesign(),
    version: str = "1.0",
    check: bool = True,
) -> DataFrame:
    """Blocks, roles and outer folds for every row; ``outer_fold`` is -1 off development."""
    if block_findings(df, split.block_column).first()["conflicts"]:
        raise SplitError("supplied block ids disagree with the derived grid")
    roles = roles_for(with_blocks(df, split.block_column), split, design)
    columns = [split.id_column, "site_id", split.block_column, split.date_column]
    if split.event_column and split.event_column in df.columns:
        columns.append(split.event_column)
    kept = [*columns, "split_role"] + ([design.target] if design.target in df.columns else [])
    base = materialise(roles.select(*kept), "roles")
    if check:
        require_disjoint(role_overlaps(base, split))
        require_design(final_design(base, split, design))
    parts = dual_blocked_parts(base.filter("split_role = 'development'"), split)
    labelled = with_parts(base.select(*columns, "split_role"), parts, split, how="left")
    fold = F.when(F.col("split_role") == "development", validation_fold())
    return (
        labelled.withColumn("outer_fold", F.coalesce(fold, F.lit(-1))).drop("folds")
        .withColumn("manifest_version", F.lit(version))
    )


def manifest_findings(
    manifest: DataFrame, data: DataFrame, split: SplitDesign = SplitDesign(), design: RoleDesign = RoleDesign()
) -> DataFrame:
    """Every check of a stored manifest as ``(check_name, failures)``; all zero when valid."""
    compare = [c for c in (split.block_column, split.date_column) if c in manifest.columns and c in data.columns]
    match = id_mismatches(manifest, data, split.id_column, compare)
    found = match.select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("check_name"), F.col(c).cast("bigint").alias("failures")) for c in match.columns
        ]))
    )
    unknown = manifest.agg(
        F.count_if(~F.coalesce(F.col("split_role").isin(*ALL_ROLES), F.lit(False))).alias("failures")
    ).select(F.lit("unknown_roles").alias("check_name"), "failures")
    target = data.select(split.id_column, design.target) if design.target in data.columns else None
    working = manifest.join(target, split.id_column, "left") if target is not None else manifest
    working = materialise(working, "manifest")
    roles = role_overlaps(working, split).agg(F.sum("shared").alias("failures")).select(
        F.lit("keys_shared_by_roles").alias("check_name"), F.col("failures").cast("bigint"))
    checks = final_design(working, split, design).select(
        F.concat(F.lit("final_design_"), F.col("requirement")).alias("check_name"),
        F.when(F.col("passed"), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("failures"),
    )
    development = working.filter("split_role = 'development'")
    leaks = part_overlaps(frozen_parts(development, split)).agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("failures")).select(
        F.lit("keys_shared_by_folds").alias("check_name"), F.col("failures").cast("bigint"))
    for part in (unknown, roles, checks, leaks):
        found = found.unionByName(part)
    return found


def require_manifest(findings: DataFrame) -> None:
    failed = findings.filter("failures > 0").collect()  # one row per check
    if failed:
        raise SplitError(f"manifest is not valid: {[r.asDict() for r in failed]}")


def development_rows(data: DataFrame, manifest: DataFrame) -> DataFrame:
    return attach_manifest(data, manifest).filter("split_role = 'development'")
