"""Development, calibration and final roles, and the design the final role must meet."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import number
from ..functions.keys import day_text, is_blank, stable_hash, time_group
from ..session import materialise
from .folds import SplitDesign, SplitError, shared_keys
from .order_stats import hash_threshold

ALL_ROLES = ("development", "calibration", "final_test", "embargo")


@dataclass(frozen=True)
class RoleDesign:
    """Fractions and minima of the locked partitions."""

    final_fraction: float = 0.15
    calibration_fraction: float = 0.15
    minimum_sites: int = 4
    hot_threshold_c: float = 32.0
    minimum_hot: int = 1
    preferred_hot: int = 2
    target: str = "calculated_utci_c"
    site_column: str = "site_id"

    def __post_init__(self) -> None:
        if not (0 < self.final_fraction < 1 and 0 < self.calibration_fraction < 1):
            raise ValueError("fractions must lie between zero and one")


@dataclass(frozen=True)
class RoleRule:
    """Fitted selection: hash thresholds, and the few chosen hot time groups by name.

    Roles are expressions of the block and the time group, so rows need no join.
    """

    seed: int
    final_block: str
    calibration_block: str
    hot_times: tuple[str, ...]
    final_time: str
    calibration_time: str

    def block_role(self, block: Column) -> Column:
        return (
            F.when(stable_hash(block, self.seed, "final_spatial") <= self.final_block, F.lit("final_test"))
            .when(stable_hash(block, self.seed, "calibration_spatial") <= self.calibration_block, F.lit("calibration"))
            .otherwise(F.lit("development"))
        )

    def time_role(self, time_key: Column) -> Column:
        hot = time_key.isin(list(self.hot_times)) if self.hot_times else F.lit(False)
        return (
            F.when(hot | (stable_hash(time_key, self.seed, "final_time") <= self.final_time), F.lit("final_test"))
            .when(stable_hash(time_key, self.seed, "calibration_time") <= self.calibration_time, F.lit("calibration"))
            .otherwise(F.lit("development"))
        )


def fit_roles(groups: DataFrame, design: RoleDesign, seed: int) -> RoleRule:
    """Select final then calibration groups from distinct ``(block, time_key, measure)``.

    Hot time groups come first into the final role; the rest follows the hash order.
    """
    blocks = groups.select("block").distinct()
    n = blocks.count()
    n_final = max(design.minimum_sites, math.ceil(n * design.final_fraction))
    n_calibration = max(1, math.ceil(n * design.calibration_fraction))
    if n < design.minimum_sites or n_final >= n or n_calibration >= n - n_final:
        raise SplitError(f"{n} blocks are too few for the configured spatial holdouts")
    final_block = hash_threshold(blocks, "block", n_final, seed, "final_spatial")
    rest = blocks.filter(stable_hash("block", seed, "final_spatial") > final_block)
    calibration_block = hash_threshold(rest, "block", n_calibration, seed, "calibration_spatial")

    times = groups.groupBy("time_key").agg(
        F.coalesce(F.max(F.col("measure") >= design.hot_threshold_c), F.lit(False)).alias("hot")
    )
    counts = times.agg(F.count(F.lit(1)).alias("n"), F.count_if("hot").alias("hot")).first()
    n, n_hot = counts["n"], counts["hot"]
    n_final = max(1, math.ceil(n * design.final_fraction))
    n_calibration = max(1, math.ceil(n * design.calibration_fraction))
    if n < 3 or n_final + n_calibration >= n:
        raise SplitError(f"{n} time groups are too few for the configured holdouts")
    if 0 < n_hot < design.minimum_hot:
        raise SplitError(f"only {n_hot} hot time groups")
    picked = min(n_hot, max(design.minimum_hot, design.preferred_hot))
    # The preferred number of hot groups is a setting, so this list is short.
    chosen = times.filter("hot").orderBy(stable_hash("time_key", seed, "final_hot_time")).limit(picked).collect()
    hot_times = tuple(r["time_key"] for r in chosen)
    others = times.filter(~F.col("time_key").isin(list(hot_times))) if hot_times else times
    final_time = hash_threshold(others, "time_key", max(n_final, picked) - picked, seed, "final_time")
    rest = others.filter(stable_hash("time_key", seed, "final_time") > final_time)
    calibration_time = hash_threshold(rest, "time_key", n_calibration, seed, "calibration_time")
    return RoleRule(seed, final_block, calibration_block, hot_times, final_time, calibration_time)


def assign_roles(df: DataFrame, split: SplitDesign, design: RoleDesign = RoleDesign()) -> DataFrame:
    """``df`` with ``split_role``: same role in space and time, else embargo.

    Selection reads distinct blocks and time groups; applying it to rows is a projection.
    """
    has_event = split.event_column is not None and split.event_column in df.columns
    block = F.col(split.block_column).cast("string")
    time_key = time_group(split.date_column, split.event_column if has_event else None)
    measure = number(design.target) if design.target in df.columns else F.lit(None).cast("double")
    groups = materialise(
        df.select(block.alias("block"), time_key.alias("time_key"), measure.alias("measure"), day_text(split.date_column).isNull().alias("undated"))
        .groupBy("block", "time_key").agg(F.max("measure").alias("measure"), F.max("undated").alias("undated")),
        "role-groups",
    )
    rule = fit_roles(groups, design, split.seed)

    def role(b: Column, t: Column) -> Column:
        return F.when(rule.block_role(b) == rule.time_role(t), rule.block_role(b)).otherwise(F.lit("embargo"))

    seen = groups.agg(
        F.count_if(F.col("block").isNull() | F.col("time_key").isNull() | F.col("undated")).alias("missing"),
        F.collect_set(role(F.col("block"), F.col("time_key"))).alias("roles"),  # four values at most
    ).first()
    if seen["missing"]:
        raise SplitError("blocks and dates cannot be missing")
    if not {"development", "calibration", "final_test"} <= set(seen["roles"]):
        raise SplitError(f"empty partitions; present roles are {sorted(seen['roles'])}")
    return df.withColumn("split_role", role(block, time_key))


def role_overlaps(df: DataFrame, split: SplitDesign, role_column: str = "split_role") -> DataFrame:
    """Keys shared by two of the three roles: ``(left_role, right_role, key_type, shared)``.

    Every key is reduced to its three role flags in one aggregation.
    """
    has_event = split.event_column is not None and split.event_column in df.columns
    kinds = [("block", split.block_column), ("date", split.date_column)]
    if has_event:
        kinds.append(("event", split.event_column))
    entries = F.array(*[F.struct(F.lit(k).alias("key_type"), F.col(c).cast("string").alias("v")) for k, c in kinds])
    roles = ("development", "calibration", "final_test")
    flags = (
        df.select(F.col(role_column).alias("r"), F.inline(entries)).filter(~is_blank("v"))
        .groupBy("key_type", "v").agg(*[F.max(F.col("r") == r).alias(r) for r in roles])
    )
    pairs = (("calibration", "development"), ("final_test", "development"), ("calibration", "final_test"))
    counts = flags.groupBy("key_type").agg(
        *[F.count_if(F.col(a) & F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = [
        F.struct(F.lit(a).alias("left_role"), F.lit(b).alias("right_role"), F.col(f"p{i}").alias("shared"))
        for i, (a, b) in enumerate(pairs)
    ]
    return counts.select("key_type", F.inline(F.array(*rows)))


def _distinct_keys(split: SplitDesign, design: RoleDesign) -> tuple[Column, Column, Column]:
    """Distinct sites, blocks and dates with a hot value."""
    hot = number(design.target) >= design.hot_threshold_c
    return (F.count_distinct(design.site_column), F.count_distinct(split.block_column),
            F.count_distinct(F.when(hot, F.col(split.date_column).cast("string"))))


def distinct_counts(df: DataFrame, split: SplitDesign, design: RoleDesign = RoleDesign(), role_column: str = "split_role") -> DataFrame:
    """Per role: its distinct sites, blocks and hot dates."""
    sites, blocks, hot_dates = _distinct_keys(split, design)
    return df.groupBy(role_column).agg(sites.alias("sites"), blocks.alias("blocks"), hot_dates.alias("hot_dates"))


def final_design(df: DataFrame, split: SplitDesign, design: RoleDesign = RoleDesign(), role_column: str = "split_role") -> DataFrame:
    """Checks of the final role as ``(requirement, observed, required, passed)``."""
    final = df.filter(F.col(role_column) == "final_test")
    hot = number(design.target) >= design.hot_threshold_c
    day = F.col(split.date_column).cast("string")
    sites, blocks, hot_dates = _distinct_keys(split, design)
    counts = final.agg(sites.alias("final_sites"), blocks.alias("final_blocks"), hot_dates.alias("hot_dates"))
    minima = {"final_sites": design.minimum_sites, "final_blocks": design.minimum_sites, "hot_dates": design.minimum_hot}
    met = counts.select(
        F.inline(
            F.array(*[
                F.struct(F.lit(name).alias("requirement"), F.col(name).alias("observed"), F.lit(low).cast("bigint").alias("required"))
                for name, low in minima.items()
            ])
        )
    ).withColumn("passed", F.col("observed") >= F.col("required"))
    compared = df.filter(F.col(role_column).isin("development", "calibration"))
    reused = shared_keys(final, compared, {"reused_final_sites": design.site_column})
    hot_days = final.filter(hot).select(day.alias("hot_day")).distinct()
    partial = (
        df.filter(~F.col(role_column).isin("final_test", "embargo")).select(day.alias("hot_day")).distinct()
        .join(hot_days, "hot_day", "left_semi").agg(F.count(F.lit(1)).alias("shared"))
        .select(F.lit("partly_final_hot_dates").alias("key_type"), "shared")
    )
    clean = reused.unionByName(partial).select(
        F.col("key_type").alias("requirement"), F.col("shared").alias("observed"),
        F.lit(0).cast("bigint").alias("required"), (F.col("shared") == 0).alias("passed"),
    )
    return met.unionByName(clean)


def require_design(checks: DataFrame) -> DataFrame:
    failed = checks.filter("not passed").collect()  # five rows at most
    if failed:
        raise SplitError(f"final design not met: {[r.asDict() for r in failed]}")
    return checks


def role_rows(
    df: DataFrame, role: str, allowed_flags: Sequence[str] = ("pass",), role_column: str = "split_role",
    flag_column: str = "quality_flag",
) -> DataFrame:
    """Rows of a role whose quality flag is allowed (trimmed, case-insensitive)."""
    flag = F.lower(F.trim(F.col(flag_column)))
    return df.filter((F.col(role_column) == role) & flag.isin([f.strip().lower() for f in allowed_flags]))


def evaluation_rows(
    df: DataFrame, role: str, split: SplitDesign, design: RoleDesign = RoleDesign(), allowed_flags: Sequence[str] = ("pass",),
    role_column: str = "split_role", flag_column: str = "quality_flag",
) -> DataFrame:
    """``role_rows`` that are fit to be evaluated: not empty, and for the final role its minima hold after the flag filter too."""
    kept = role_rows(df, role, allowed_flags, role_column, flag_column)
    if kept.isEmpty():
        raise SplitError(f"role {role!r} has no row with an allowed flag")
    if role == "final_test":
        others = df.filter(F.col(role_column) != role)
        require_design(final_design(kept.unionByName(others), split, design, role_column))
    return kept


def role_counts(df: DataFrame, allowed_flags: Sequence[str] = ("pass",), role_column: str = "split_role",
                flag_column: str = "quality_flag") -> DataFrame:
    """Per role: kept rows and rows excluded by their flag."""
    kept = F.coalesce(F.lower(F.trim(F.col(flag_column))).isin([f.strip().lower() for f in allowed_flags]), F.lit(False))
    return df.groupBy(role_column).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("excluded"))
