"""Vectors of the whitening and the hard-negative search: which rows take part, and their arrays in Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``vector`` as doubles, without those whose vector is null, empty, or holds a null, NaN or infinity."""
    wide = rows.withColumn(vector, F.col(vector).cast("array<double>"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return wide.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~odd)


def dimension(rows: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, the smaller one of a tie; 0 if there is none."""
    found = (rows.groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "length").limit(1).first())
    return found["length"] if found else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors, all of one length, as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
