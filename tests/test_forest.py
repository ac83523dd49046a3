"""The library's own forest: deep trees whose work follows the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions.predictors import PredictorPolicy
from terrafold.operators import forest, models
from terrafold.sources.models import load_model, save_model

POLICY = PredictorPolicy(core=("a", "b", "kind"), additions=(), categorical=("kind",))


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("sample_id"), (F.col("id") * 37 % 1009 / 100.0).alias("a"),
        F.when(F.col("id") % 17 != 0, F.col("id") * 61 % 499 / 50.0).alias("b"),
        F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise(F.lit("y")).alias("kind"))
    noise = F.abs(F.xxhash64("sample_id")) % 100 / 100.0
    return df.withColumn("y", F.col("a") * 2 + F.coalesce("b", F.lit(0.0)) + F.when(F.col("kind") == "x", 5.0).otherwise(0.0) + noise)


def fitted(rows, **settings):
    return models.fit_forest(rows, "y", POLICY, ["a", "b", "kind"], trees=5, **settings)


def values(model, rows):
    return {r["sample_id"]: r["p"] for r in model.predict(rows, "p").select("sample_id", "p").collect()}


def test_nodes_dealt_to_tasks_give_the_forest_of_whole_passes(spark, rows, monkeypatch):
    whole = fitted(rows)
    assert all(len(t.feature) == 1 and t.dealt == [True] for t in whole.model.tops)
    monkeypatch.setattr(forest, "LOCAL", 200)
    cut = fitted(rows)
    assert all(len(t.feature) > 20 for t in cut.model.tops)
    a, b = values(whole, rows), values(cut, rows)
    assert a.keys() == b.keys() and len(a) == 3000
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_forest_fits_rows_it_has_not_seen(rows):
    seen = F.abs(F.xxhash64("sample_id", F.lit(1))) % 4 > 0
    held = rows.filter(~seen)
    p = fitted(rows.filter(seen)).predict(held, "p")
    got = p.agg(F.count("p").alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("e"), F.stddev("y").alias("s")).first()
    assert got["n"] == held.count() and got["e"] < 0.1 * got["s"]


def test_depth_and_second_fit(spark, rows):
    assert len({round(v, 9) for v in values(models.fit_forest(rows, "y", POLICY, ["a", "b", "kind"], trees=1, depth=3), rows).values()}) <= 8
    assert len(set(values(fitted(rows, depth=0), rows).values())) == 1
    one, other = values(fitted(rows), rows), values(fitted(rows), rows)
    assert max(abs(one[k] - other[k]) for k in one) < 1e-9


def test_repeated_rows_and_missing_labels(spark, rows):
    twice = rows.limit(50).unionByName(rows.limit(50).withColumn("sample_id", F.lit(None).cast("string")))
    assert fitted(rows.withColumn("y", F.when(F.col("a") < 5, F.col("y")))).predict(twice, "p").filter("p is not null").count() == 100
    with pytest.raises(ValueError):
        fitted(rows.limit(1).withColumn("y", F.lit(None).cast("double")))
    assert set(values(fitted(rows.limit(1)), rows.limit(1)).values()) == {rows.first()["y"]}


def test_stored_forest_predicts_the_same(spark, rows, tmp_path):
    model = fitted(rows)
    again = load_model(spark, save_model(spark, model, str(tmp_path / "forest")))
    assert values(again, rows) == pytest.approx(values(model, rows), abs=1e-12)


def test_grown_tree_splits_every_node_that_gains():
    x = np.arange(64, dtype=np.uint8).reshape(1, -1)
    feature, cut, below, value = forest.grown(x, np.arange(64.0), np.ones(64, np.uint8), 30, 1)
    assert len(feature) == 127 and sorted(value[feature < 0]) == list(range(64))
    assert (value[forest.walked(x, feature, cut, below)] == np.arange(64)).all()
    assert len(forest.grown(x, np.full(64, 0.1), np.ones(64, np.uint8), 30, 1)[0]) == 1


def test_a_table_of_some_ten_thousand_rows_takes_no_pass_a_level(spark, monkeypatch):
    df = spark.range(40_000).select((F.col("id") * 37 % 1009 / 100.0).alias("a"), (F.col("id") % 61 / 1.0).alias("b"), F.lit("x").alias("kind"),
                                    (F.col("id") * 31 % 997 / 10.0).alias("y"))

    def passed(*args):
        raise AssertionError("a pass over all rows for a level")

    monkeypatch.setattr(forest, "level_splits", passed)
    assert fitted(df, depth=4).model.subtrees.count() == 5


def test_a_level_reads_only_trees_with_open_nodes(monkeypatch):
    drawn = []

    def bagged(hashes, seed, tree):
        drawn.append(tree)
        return np.ones(len(hashes), np.uint8)

    monkeypatch.setattr(forest, "bagged", bagged)
    hashes, y, x = np.arange(8, dtype=np.uint64), np.arange(8.0), np.arange(8, dtype=np.uint8)
    block = forest.Block((hashes.tobytes(), y.tobytes(), np.ones(8).tobytes(), np.ones(8, np.uint8).tobytes(), [x.tobytes()], [], []), [1])
    assert [(t, rows.tolist()) for t, rows, *_ in forest.node_rows(block, [forest.Top() for _ in range(9)], 1, [2, 5])] == [(t, list(range(8))) for t in (2, 5)]
    assert drawn == [2, 5]


def test_counted_and_sorted_levels_choose_the_same_splits():
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 64, 6000), rng.integers(0, 64, 6000), rng.integers(0, 2, 6000)]).astype(np.uint8)
    y, w = x[0] * 0.3 + x[1] % 7 + rng.integers(0, 9, 6000) / 4.0, rng.integers(1, 4, 6000).astype(np.uint8)
    feature, cut, below, value = forest.grown(x, y, w, 30, 2)
    rows, node = [np.arange(6000)], [0]
    while node:  # every split beside all cuts of all features
        own, at = rows.pop(), node.pop()
        assert value[at] == pytest.approx(np.average(y[own], weights=w[own]))
        if feature[at] < 0:
            continue

        def gain(f, c):
            left = x[f, own] <= c
            n = w[own][left].sum(), w[own][~left].sum()
            if min(n) < 2:
                return -1.0
            return sum(np.average(y[own][s], weights=w[own][s]) ** 2 * m for s, m in zip((left, ~left), n))

        every = {(f, c): gain(f, c) for f in range(3) for c in np.unique(x[f, own])[:-1].tolist()} if len(own) < 400 or at == 0 else {}
        assert gain(feature[at], cut[at]) >= max(every.values(), default=-1) - 1e-6
        right = x[feature[at], own] > cut[at]
        rows += [own[~right], own[right]]
        node += [below[at], below[at] + 1]


def test_predictions_of_many_rows_are_dealt_by_their_bytes(spark, rows, monkeypatch):
    few = fitted(rows)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert few.model.partitions(3000) == (least, least)
    walkers, adders = few.model.partitions(36_000_000)
    assert walkers > 36_000_000 * 5 * 4 / forest.TASK_BYTES and adders > 36_000_000 * 5 * 12 / forest.TASK_BYTES - 1
    want = values(few, rows)
    monkeypatch.setattr(forest, "TASK_BYTES", 10_000)
    assert few.model.partitions(3000)[0] > least and values(few, rows) == pytest.approx(want, abs=1e-12)
