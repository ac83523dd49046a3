"""Equal-area grid blocks of WGS84 coordinates.

Ellipsoidal cylindrical equal-area projection with standard parallel 30 degrees (Snyder,
Map Projections, 1987), written as column arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .basic import finite

# WGS84 ellipsoid and the only projected system built here.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1.0 / 298.257223563
STANDARD_PARALLEL_DEG = 30.0
PROJECTED_CRS = "EPSG:6933"

ECCENTRICITY_SQ = 2.0 * FLATTENING - FLATTENING**2
ECCENTRICITY = math.sqrt(ECCENTRICITY_SQ)
SCALE = math.cos(math.radians(STANDARD_PARALLEL_DEG)) / math.sqrt(
    1.0 - ECCENTRICITY_SQ * math.sin(math.radians(STANDARD_PARALLEL_DEG)) ** 2
)


def projected_xy(longitude, latitude) -> tuple[Column, Column]:
    """Metres east and north; null outside the valid coordinate range."""
    lon, lat = finite(longitude), finite(latitude)
    valid = lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
    s = F.sin(F.radians(lat))
    es = F.lit(ECCENTRICITY) * s
    q = F.lit(1.0 - ECCENTRICITY_SQ) * (
        s / (F.lit(1.0) - es * es)
        - F.ln((F.lit(1.0) - es) / (F.lit(1.0) + es)) / F.lit(2.0 * ECCENTRICITY)
    )
    x = F.lit(SEMI_MAJOR_M * SCALE) * F.radians(lon)
    y = F.lit(SEMI_MAJOR_M / (2.0 * SCALE)) * q
    return F.when(valid, x), F.when(valid, y)


def block_id(
    longitude,
    latitude,
    block_size_m: float = 500.0,
    origin: tuple[float, float] = (0.0, 0.0),
    crs: str = PROJECTED_CRS,
) -> Column:
    """Identifier of the square block that holds a coordinate; null for invalid coordinates."""
    if crs != PROJECTED_CRS:
        raise ValueError(f"only {PROJECTED_CRS} is available; geographic systems have no metric grid")
    if not (math.isfinite(block_size_m) and block_size_m > 0):
        raise ValueError("the block size must be finite and positive")
    x, y = projected_xy(longitude, latitude)
    i = F.floor((x - F.lit(float(origin[0]))) / F.lit(float(block_size_m)))
    j = F.floor((y - F.lit(float(origin[1]))) / F.lit(float(block_size_m)))
    tag = crs.replace(":", "")
    return F.concat(F.lit(f"{tag}_x"), i.cast("string"), F.lit("_y"), j.cast("string"))


def with_blocks(
    df: DataFrame,
    block_column: str = "spatial_block_id",
    longitude: str = "longitude",
    latitude: str = "latitude",
    **grid,
) -> DataFrame:
    """Keep supplied block ids and derive the missing ones."""
    derived = block_id(longitude, latitude, **grid)
    if block_column in df.columns:
        return df.withColumn(block_column, F.coalesce(F.col(block_column), derived))
    return df.withColumn(block_column, derived)


def block_findings(
    df: DataFrame,
    block_column: str = "spatial_block_id",
    longitude: str = "longitude",
    latitude: str = "latitude",
    **grid,
) -> DataFrame:
    """One row: invalid coordinates, missing ids, and supplied ids that disagree.

    A conflict counts only when some ids are missing; a complete column is taken as it is.
    """
    derived = block_id(longitude, latitude, **grid)
    supplied = F.col(block_column) if block_column in df.columns else F.lit(None).cast("string")
    counts = df.agg(
        F.count_if(derived.isNull()).alias("invalid_coordinates"),
        F.count_if(supplied.isNull()).alias("missing_blocks"),
        F.count_if(supplied.isNotNull() & ~supplied.eqNullSafe(derived)).alias("differing_blocks"),
    )
    return counts.withColumn(
        "conflicts", F.when(F.col("missing_blocks") > 0, F.col("differing_blocks")).otherwise(F.lit(0))
    )
