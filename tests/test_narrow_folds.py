"""Fold tables by sums and narrow rows: the same numbers with less to move."""

import os

from pyspark.sql import functions as F

from terrafold.operators.folds import COUNTED, SplitDesign, dual_blocked_parts
from terrafold.operators.metrics import error_sums, grouped_mae, long_predictions
from terrafold.plans.catalog import models
from terrafold.session import concurrently, intermediates, materialise


def table(spark):
    return spark.range(600).select(
        F.col("id").cast("string").alias("sample_id"), F.concat(F.lit("b"), F.col("id") % 12).alias("spatial_block_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7 % 10).cast("int")).cast("string").alias("date"),
        F.lit(None).cast("string").alias("weather_event_id"), (F.col("id") % 31).cast("double").alias("t"),
        F.when(F.col("id") % 12 > 0, (F.col("id") % 29).cast("double")).alias("p"), (F.col("id") % 23).cast("double").alias("q"))


def test_grouped_mae_of_sums_is_that_of_the_rows(spark):
    keys = ["spatial_block_id", "date", "weather_event_id"]
    long = long_predictions(table(spark), "t", ["p", "q"], keys)
    sums = error_sums(long, keys, ["p", "q"])
    assert sums.agg(F.sum("rows")).first()[0] == 600
    block = ["spatial_block_id", "date"]
    by_rows = {r["model"]: r for r in grouped_mae(long, block).collect()}
    by_sums = {r["model"]: r for r in grouped_mae(sums.select(*block, F.inline("errors")), block).collect()}
    assert by_rows.keys() == by_sums.keys() == {"p", "q"}
    for m in by_rows:
        assert by_rows[m]["n_blocks"] == by_sums[m]["n_blocks"]
        assert abs(by_rows[m]["grouped_mae"] - by_sums[m]["grouped_mae"]) < 1e-12


def test_parts_of_counted_cells_are_those_of_the_rows(spark):
    rows, design = table(spark), SplitDesign(n_folds=3, seed=5)
    cells = rows.groupBy("spatial_block_id", "date", "weather_event_id").agg(F.count(F.lit(1)).alias(COUNTED))
    assert cells.count() < rows.count()
    one, other = (sorted(map(str, dual_blocked_parts(df, design).drop("id").collect())) for df in (rows, cells))
    assert one == other


def test_development_rows_carry_the_asked_columns_only(spark, sf_dir):
    narrow = models._development(spark, sf_dir, ["canopy_fraction"])
    assert set(narrow.columns) == {"sample_id", "spatial_block_id", "date", "weather_event_id", "canopy_fraction", "outer_fold"}
    whole = models._development(spark, sf_dir).select("sample_id", "outer_fold")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, narrow.select("sample_id", "outer_fold").collect()))


def test_tables_written_in_overlapping_tasks_are_deleted(spark):
    def write(i):
        return lambda: materialise(spark.range(i + 1), "overlap")

    with intermediates(spark):
        tables = concurrently(spark, [write(i) for i in range(3)])
        paths = [t.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0] for t in tables]
        assert all(os.path.isdir("/" + p.lstrip("/")) for p in paths)
    assert not any(os.path.isdir("/" + p.lstrip("/")) for p in paths)
