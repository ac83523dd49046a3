"""Boosted models fitted in tasks of their own: the trees and scores of common passes."""

import pytest
from pyspark.sql import functions as F

from terrafold.functions.predictors import PredictorPolicy
from terrafold.operators import boosting, models
from terrafold.operators.encode import EncodingError
from terrafold.operators.folds import nested_folds
from terrafold.plans import catalog
from terrafold.session import intermediates

POLICY = PredictorPolicy(core=("a", "b", "kind"), additions=(), categorical=("kind",))


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(0, 9000, 1, 3).select(
        "id", (F.col("id") * 37 % 1009 / 100.0).alias("a"), F.when(F.col("id") % 17 != 0, F.col("id") * 61 % 499 / 50.0).alias("b"),
        F.when(F.col("id") % 3 == 0, F.lit("x")).when(F.col("id") % 3 == 1, F.lit("y")).alias("kind"), (F.col("id") % 9).cast("string").alias("block"))
    noise = F.abs(F.xxhash64("id")) % 100 / 30.0
    return df.withColumn("y", F.when(F.col("id") % 101 > 0, F.col("a") * 2 + F.coalesce("b", F.lit(0.0)) + noise)).cache()


def wanted(rows):
    parts = [(F.col("id") % 5 > f, F.col("id") % 5 == f) for f in range(2)]
    encoders = models.fold_encoders(rows, {"": ("core", POLICY.core, parts)}, POLICY)
    out = []
    for f, (train, held) in enumerate(parts):
        out.append(models.Wanted(encoders["", f], "y", train, models.BoostedParams(30, 3, 0.4, 0.7, 0.6), 5, held, 3))
        out.append(models.Wanted(encoders["", f], "y", train, models.BoostedParams(4, 8, 0.3, min_instances=9), 6, held, 50))
        out.append(models.Wanted(encoders["", f], "y", train, models.BoostedParams(3, 2, 0.3, min_info_gain=0.01), 7, None, None, ((9.0,), (1.0, 2.5))))
    return out


def test_models_fitted_alone_are_those_of_common_passes(spark, rows, monkeypatch):
    seen = {}
    for bound, name in ((boosting.ALONE, "alone"), (0, "passes")):
        monkeypatch.setattr(boosting, "ALONE", bound)
        rounds = []
        with intermediates(spark):
            fits, scores = models.fit_together(rows, wanted(rows), ["block"], lambda trees, active: rounds.append((trees, active)), board=True)
            seen[name] = fits, sorted(map(tuple, scores.select("model", "block", "truth", "prediction").collect())), rounds
    (one, some, rounds), (other, same, passes) = seen["alone"], seen["passes"]
    assert len(one) == len(other) == 6 and rounds == passes
    for a, b in zip(one, other):
        assert (a.trees.feature == b.trees.feature).all() and (a.trees.split == b.trees.split).all()
        assert a.trees.value == pytest.approx(b.trees.value, rel=1e-7) and a.curve == pytest.approx(b.curve, rel=1e-9)
    assert [r[:3] for r in some] == [r[:3] for r in same] and len(some) > 3000
    assert [r[3] for r in some] == pytest.approx([r[3] for r in same], rel=1e-7)


def test_small_models_take_no_pass_over_the_blocks(spark, rows, monkeypatch):
    def passed(*args):
        raise AssertionError("a pass for each level of each tree")

    monkeypatch.setattr(boosting, "level_sums", passed)
    with intermediates(spark):
        fits, scores = models.fit_together(rows, wanted(rows)[:1])
    assert scores is None and len(fits[0].curve) == len(fits[0].trees) > 3


def test_only_models_of_bounded_rows_are_fitted_alone():
    edges, model = [[[0.5]] * 14], boosting.Model(0, 0, 0, boosting.BoostedParams(), 1)
    assert boosting.fits_alone([(4_000_000, 300_000)], [model], edges)
    assert not boosting.fits_alone([(1, 0), (36_000_000, 0)], [model, model], edges)


def test_encoders_of_many_parts_share_their_passes(spark, rows):
    parts = [F.col("id") % 5 == 1, F.col("id") % 5 < 4, F.lit(None).cast("boolean"), F.col("id") < 3, F.col("b").isNull(), F.col("id") % 2 == 0]
    together = models.fit_encoders(rows, parts, POLICY, "core", POLICY.core)
    for part, encoder in zip(parts, together):
        assert encoder == models.fit_encoder(rows.filter(part), POLICY, "core", POLICY.core)
    with pytest.raises(EncodingError):
        models.fit_encoders(rows.withColumn("a", F.when(F.col("id") != 7, F.col("a")).otherwise(float("inf"))), parts, POLICY, "core", POLICY.core)


def test_many_encoders_take_as_many_jobs_as_one(spark, rows):
    def jobs(parts):
        spark.sparkContext.setJobGroup(f"encoders{len(parts)}", "")
        models.fit_encoders(rows, parts, POLICY, "core", POLICY.core)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"encoders{len(parts)}"))

    one = jobs([F.col("id") % 5 == 1])
    assert 0 < jobs([F.col("id") % 9 != f for f in range(9)]) < one + 5  # adaptive execution may run a job more
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_blocks_of_many_encodings_stay_small(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 40_000)
    encoder = models.fit_encoder(rows, POLICY, predictors=POLICY.core)
    y, encoders = F.col("y"), [encoder] * 4
    with intermediates(spark):
        table = boosting.binned(rows, F.xxhash64("id"), encoders, [F.lit(True)] * 4, [y], [F.lit(1)])
        sizes = [sum(map(len, r["bins"])) for r in table.blocks.select("bins").collect()]
    width = len(encoder.feature_names)
    assert sum(sizes) == 9000 * 4 * width and max(sizes) <= max(40_000, 1024 * 4 * width)


@pytest.mark.parametrize("name", ["loss_curve", "candidate_board", "nested_out_of_fold", "component_out_of_fold", "baseline_out_of_fold", "satellite_pair"])
def test_model_tables_write_the_columns_they_read(spark, sf_dir, monkeypatch, name):
    """All 39 columns of the observations were written two to four times before a fold was fitted."""
    written = []

    class Written(Exception):
        pass

    def fold(df):
        written.extend(df.columns)
        raise Written

    monkeypatch.setattr(catalog.models, "_with_outer_folds", fold)
    with pytest.raises(Written):
        catalog.queries()[f"model_{name}"](spark, sf_dir)
    assert {"sample_id", "spatial_block_id", "date", "weather_event_id", *catalog.models.CORE} <= set(written) and len(written) < 25


def test_inner_parts_are_those_of_the_long_table(spark, sf_dir):
    split, inner = catalog.models.FOLDS, 2
    df = catalog.models._development(spark, sf_dir, catalog.models.USED)
    rows = models.nested_rows(df, split, inner, with_final=False)
    outer, _ = models.outer_rows(df, split, inner)
    long = {tuple(r) for r in nested_folds(outer, split, inner).filter("part <> 'embargo'").select("sample_id", "outer_fold", "fold", "part").collect()}
    marks = {(f, i, part): mark.cast("int") for f in range(split.n_folds) for i, both in enumerate(models.inner_parts(f, inner))
             for part, mark in zip(("train", "validation"), both)}
    found = rows.select("sample_id", *[m.alias(f"{f}_{i}_{part}") for (f, i, part), m in marks.items()]).collect()
    assert {(r["sample_id"], f, i, part) for r in found for f, i, part in marks if r[f"{f}_{i}_{part}"]} == long
