"""Invariants and brute-force checks of the operators."""

import hashlib
import math
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrafold.functions.grid import with_blocks
from terrafold.functions.predictors import PredictorPolicy
from terrafold.operators import (bootstrap, diagnostics, digests, folds, intervals, isolation, joins, linear, manifest, metrics, models, order_stats, quality,
                                 roles)
from terrafold.operators.encode import Encoder, EncodingError, fit_encoder
from terrafold.operators.isolation import fit_isolation_forest, mean_path
from terrafold.plans.evaluation import evaluate
from terrafold.plans.observations import observations
from terrafold.plans.scoring import ScoringPlan
from terrafold.session import work_folder
from terrafold.sources import manifests as stored
from terrafold.sources import models as model_store
from terrafold.sources import tables
from terrafold.streaming.scoring import read_observations, start_scoring

SPLIT = folds.SplitDesign(n_folds=3, seed=42)
POLICY = PredictorPolicy(core=("background_air_temperature_c", "background_wind_speed_m_s", "background_relative_humidity_pct",
                               "canopy_fraction", "land_cover_class"), additions=())


@pytest.fixture(scope="module")
def obs(spark, sf_dir):
    return with_blocks(observations(spark, sf_dir)).cache()


@pytest.fixture(scope="module")
def target(obs):
    """Observations with a learnable target."""
    label = F.col("background_air_temperature_c") + 3 * F.col("background_wind_speed_m_s") - 5 * F.col("canopy_fraction")
    return obs.withColumn("y", label).cache()


def fresh(spark, name):
    return f"{work_folder(spark)}/test-{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------------------------ folds


def plain_greedy(sizes, n):
    totals, out = [0] * n, []
    for i, size in enumerate(sizes):
        fold = i if i < n else min(range(n), key=lambda f: (totals[f], f))
        totals[fold] += size
        out.append(fold)
    return out


def test_greedy_rule_and_carried_totals():
    rng = random.Random(1)
    sizes = [rng.choice([1, 2, 3, 500]) for _ in range(200)]
    want = plain_greedy(sizes, 4)
    assert folds.greedy_folds(sizes, [0] * 4) == want
    cut = 77
    totals = [sum(s for s, f in zip(sizes[:cut], want) if f == k) for k in range(4)]
    assert folds.greedy_folds(sizes[cut:], totals) == want[cut:]
    assert folds.greedy_folds(sizes[:2], [0] * 4) + folds.greedy_folds(sizes[2:], [sizes[0], sizes[1], 0, 0]) == want


def test_chunked_assignment_equals_one_chunk(spark):
    groups = spark.range(500).select(F.concat(F.lit("g"), "id").alias("group"), (F.col("id") % 17 + 1).alias("rows"))
    whole = {r.group: r.fold for r in folds.assign_groups(groups, 5, 7, "space").collect()}
    cut = {r.group: r.fold for r in folds.assign_groups(groups, 5, 7, "space", max_groups_per_task=60).collect()}
    assert whole == cut and len(set(whole.values())) == 5
    # Every chunk is one folder of the written table, and the result reads the assigned chunks, not the groups.
    files = folds.assign_groups(groups, 5, 7, "space", max_groups_per_task=60).inputFiles()
    assert {f.rsplit("/", 2)[-2] for f in files} == {f"chunk={c}" for c in range(9)}
    both = groups.withColumn("fold_no", F.lit(0)).unionByName(groups.filter("rows > 8").withColumn("fold_no", F.lit(1)))
    one = folds.assign_groups(both, 5, 7, "space", ["fold_no"])
    many = folds.assign_groups(both, 5, 7, "space", ["fold_no"], max_groups_per_task=60)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    with pytest.raises(folds.SplitError):
        folds.assign_groups(groups.limit(3), 5, 7, "space")


def test_pairing():
    with pytest.raises(folds.SplitError):
        folds.pair_folds({(0, 0): 5}, 2)
    assert folds.pair_folds({(0, 0): 5, (1, 1): 5, (0, 1): 9, (1, 0): 9}, 2) == (1, 0)


def test_folds_partition_rows_without_leaks(spark, obs):
    long = folds.split_with_embargo(obs, SPLIT)
    counts = {(r.fold, r.part): r["count"] for r in long.groupBy("fold", "part").count().collect()}
    for f in range(3):
        assert sum(counts.get((f, p), 0) for p in ("train", "validation", "embargo")) == obs.count()
        assert counts[f, "train"] and counts[f, "validation"]
    assert folds.fold_overlaps(obs, long, SPLIT).agg(F.sum("shared")).first()[0] == 0
    folds.require_disjoint(folds.fold_overlaps(obs, long, SPLIT))
    bad = long.withColumn("part", F.lit("train")).unionByName(long.withColumn("part", F.lit("validation")))
    with pytest.raises(folds.SplitError):
        folds.require_disjoint(folds.fold_overlaps(obs, bad, SPLIT))


def test_folds_do_not_depend_on_partitioning(spark, obs):
    want = digests.table_digest(folds.split_with_embargo(obs, SPLIT)).first()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert digests.table_digest(folds.split_with_embargo(obs.repartition(5, F.rand(3)), SPLIT)).first() == want
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_large_lookup_joins_without_broadcast(spark, obs, monkeypatch):
    import terrafold.session as session_module

    want = digests.table_digest(folds.split_with_embargo(obs, SPLIT)).first()
    monkeypatch.setattr(session_module, "BROADCAST_BYTES", -1)
    assert digests.table_digest(folds.split_with_embargo(obs, SPLIT)).first() == want


def test_manifest_round_trip_and_tampering(spark, obs, monkeypatch):
    split = folds.SplitDesign(n_folds=2, seed=42)
    data = obs.select("sample_id", "site_id", "spatial_block_id", "date", "weather_event_id", "longitude", "latitude", "calculated_utci_c")
    for suffix in ("parquet", "csv", "json"):
        path = fresh(spark, "manifest") + "." + suffix
        if suffix == "parquet":
            with pytest.raises(folds.SplitError):
                stored.read_or_create_manifest(data, path, split)
            made = stored.read_or_create_manifest(data, path, split, create_if_missing=True)
            again = stored.read_or_create_manifest(data, path, split)
            assert digests.table_digest(made).first() == digests.table_digest(again).first()
        else:
            stored.write_manifest(made, path)
            back = stored.read_manifest(spark, path)
            assert digests.table_digest(back, made.columns).first() == digests.table_digest(made).first()
    changed = back.withColumn("outer_fold", F.when(F.col("sample_id") == "1", F.lit(9)).otherwise(F.col("outer_fold")))
    tables.write_table(spark.createDataFrame(changed.collect(), changed.schema), path, overwrite=True)
    with pytest.raises(folds.SplitError):
        stored.read_manifest(spark, path)
    with pytest.raises(folds.SplitError):
        stored.read_or_create_manifest(data, path, split, source_path=path)
    roles_seen = {r.split_role for r in made.select("split_role").distinct().collect()}
    assert roles_seen == set(roles.ALL_ROLES)
    assert made.filter("split_role <> 'development' and outer_fold <> -1").count() == 0


def test_mixed_roles_are_refused(spark, obs):
    mixed = obs.withColumn("split_role", F.when(F.col("canopy_fraction") > 0.5, F.lit("development")).otherwise(F.lit("unassigned")))
    with pytest.raises(folds.SplitError):
        manifest.create_manifest(mixed, SPLIT)


# -------------------------------------------------------------------------------- statistics


def test_order_statistics_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=3001), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(7)
    q = order_stats.linear_quantiles(df, "v", [0.0, 0.025, 0.5, 1.0]).first()
    assert [q.q0, q.q1, q.q2, q.q3] == pytest.approx(list(np.quantile(x, [0.0, 0.025, 0.5, 1.0])))
    assert order_stats.upper_quantile(df, "v", 0.95).first().v == np.quantile(x, 0.95, method="higher")
    assert order_stats.column_quantiles(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"], 0.5, 50) == {
        "v": pytest.approx(np.median(x)), "w": None}


def test_several_quantiles_share_their_passes(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    df = spark.createDataFrame([(float(v), float(i % 7)) for i, v in enumerate(values)], "v double, w double").repartition(7)
    probabilities = [0.0, 0.02, 0.5, 0.98, 1.0]
    found = order_stats.columns_quantiles(df.withColumn("none", F.lit(None).cast("double")), ["v", "none", "w"], probabilities)
    assert found["none"] is None
    assert np.allclose(found["v"], np.quantile(values, probabilities), rtol=0, atol=1e-12)
    assert found["w"] == list(np.quantile(np.arange(4500) % 7, probabilities))
    assert order_stats.columns_quantiles(df.limit(0), ["v"], [0.5]) == {"v": None}
    assert order_stats.columns_quantiles(df.limit(1), ["v"], [0.1, 0.9])["v"][0] == order_stats.column_quantiles(df.limit(1), ["v"], 0.9)["v"]


def test_rank_correlation_with_ties_reads_its_input_once(spark):
    rng = np.random.default_rng(4)
    rows = [(f"m{i % 3}", None if i % 50 == 0 else float(rng.integers(0, 9)), float(rng.integers(-4, 5)) + 0.0) for i in range(2000)]
    # A group that holds most rows, a constant one, one of nulls only, and zeros of both signs.
    rows += [("m0", 5.0, -0.0 if i % 2 else 0.0) for i in range(3000)]
    rows += [("flat", 1.0, float(i)) for i in range(5)] + [("none", None, 1.0)]
    path = fresh(spark, "long")
    spark.createDataFrame(rows, "model string, truth double, prediction double").write.parquet(path)
    long = spark.read.parquet(path)
    out = metrics.spearman(long)
    assert not [f for f in out.inputFiles() if path in f]
    got = {r.model: r.spearman for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["model", "truth", "prediction"]).dropna()
    for model, part in pdf.groupby("model"):
        if model == "flat":
            assert got[model] is None
        else:
            assert got[model] == pytest.approx(part["truth"].rank().corr(part["prediction"].rank()), abs=1e-12)
    assert "none" not in got and len(got) == 4
    report = metrics.full_report(long)
    assert sum(path in f for f in report.inputFiles()) == len({f for f in long.inputFiles()})


def test_importance_joins_donors_once(spark):
    rows = [(f"s{i:03d}", float(i), float(i % 5), float(2 * i - i % 5)) for i in range(300)] + [("s999", None, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "sample_id string, a double, b double, y double")

    def predict(table):
        return table.withColumn("prediction", 2 * F.col("a") - F.col("b"))

    ids = sorted(r[0] for r in rows)
    by_hash = sorted(ids, key=lambda v: hashlib.sha256(f"9|permutation|{v}".encode()).hexdigest())
    row_of, donor = {r[0]: r for r in rows}, dict(zip(ids, by_hash))

    def error(column):
        errors = []
        for i in ids:
            a, b, y = row_of[i][1:]
            a, b = (row_of[donor[i]][1] if column == "a" else a), (row_of[donor[i]][2] if column == "b" else b)
            errors += [] if a is None else [abs(2 * a - b - y)]
        return sum(errors) / len(errors)

    table = diagnostics.permutation_importance(df, ["a", "b"], "y", predict, seed=9)
    got = {r.feature: r for r in table.collect()}
    for c in ("a", "b"):
        assert got[c].base_mae == pytest.approx(error(None)) and got[c].shuffled_mae == pytest.approx(error(c))

    def joins(features):
        plan = diagnostics.permutation_importance(df, features, "y", predict, seed=9)
        return plan._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(["a"]) == joins(["a", "b"]) > 0


def test_conformal_order_statistic(spark):
    nine = spark.createDataFrame([(i / 10,) for i in range(1, 10)], "r double")
    r = order_stats.conformal_radius(nine, "r", 0.1).first()
    assert (r.k, r.radius, r.bounded) == (9, 0.9, True)
    single = order_stats.conformal_radius(nine.limit(1), "r", 0.1).first()
    assert (single.k, single.radius, single.bounded) == (2, math.inf, False)
    assert order_stats.conformal_radius(nine, "r", 0.1, 20).first().bounded is False
    assert order_stats.conformal_radius(nine.filter("r > 5"), "r", 0.1).first().n_calibration == 0
    with pytest.raises(ValueError):
        intervals.calibrate(nine.withColumn("p", F.lit(float("nan"))), "r", "p", "calibration")
    with pytest.raises(ValueError):
        intervals.calibrate(nine, "r", "r", "development")


def test_hash_threshold_paths_agree(spark):
    groups = spark.range(5000).select(F.col("id").cast("string").alias("g"))
    direct = order_stats.hash_threshold(groups, "g", 1234, 1, "s")
    assert order_stats.hash_threshold(groups, "g", 1234, 1, "s", direct_limit=10) == direct
    from terrafold.functions.keys import stable_hash

    assert groups.filter(stable_hash("g", 1, "s") <= direct).count() == 1234
    assert order_stats.hash_threshold(groups, "g", 0, 1, "s") == ""
    assert order_stats.hash_ranks(groups, "g", 1, "s").filter("hash_rank < 1234").join(
        groups.filter(stable_hash("g", 1, "s") <= direct), "g").count() == 1234


def test_recall_without_positives(spark):
    long = spark.createDataFrame([("m", 37.0, 40.0)], "model string, truth double, prediction double")
    r = metrics.threshold_recalls(long, thresholds=[38.0]).first()
    assert r.recall is None and not r.available and r.positive_support == 0 and "no observed case" in r.reason


def test_metrics_of_empty_and_constant_groups(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", float("nan"), 1.0), ("c", 5.0, None)]
    long = metrics.long_predictions(spark.createDataFrame(rows, "g string, t double, p double"), "t", ["p"], ["g"])
    out = {r.g: r for r in metrics.full_report(long, ["g"]).collect()}
    assert out["a"].r2 is None and out["a"].spearman is None and out["a"].mae == 1.5 and out["a"].n == 2
    for g in ("b", "c"):
        assert out[g].n == 0 and out[g].n_omitted == 1 and out[g].mae is None and out[g].accuracy is None and out[g].macro_f1 is None


def test_bootstrap_against_brute_force(spark):

    rng = np.random.default_rng(5)
    rows = [(f"s{i % 7}", f"d{i % 3}", float(t), float(t + a), float(t + b))
            for i, (t, a, b) in enumerate(zip(rng.normal(size=80), rng.normal(size=80), rng.normal(size=80) * 2))]
    df = spark.createDataFrame(rows, "s string, d string, t double, m double, b double")
    got = bootstrap.block_bootstrap(df, "t", "m", "b", ["s", "d"], replicates=30, seed=9).first()
    blocks = {}
    for s, d, t, m, b in rows:
        blocks.setdefault(f"{s}|{d}", []).append((abs(m - t), abs(b - t)))
    names = sorted(blocks)
    samples = []
    for r in range(30):
        picked = []
        for j in range(len(names)):
            h = hashlib.sha256(f"9|{r}|{j // 4}".encode()).hexdigest()
            picked += blocks[names[int(h[15 * (j % 4):15 * (j % 4) + 15], 16) % len(names)]]
        samples.append(np.mean([p[1] for p in picked]) - np.mean([p[0] for p in picked]))
    assert [got.lower, got.upper] == pytest.approx(list(np.quantile(samples, [0.025, 0.975])))
    with pytest.raises(ValueError):
        bootstrap.block_bootstrap(df.filter("s = 's0' and d = 'd0'"), "t", "m", "b", ["s", "d"])
    # ranges of three blocks give the totals of one range
    indexed = bootstrap.indexed_blocks(bootstrap.block_statistics(df, "t", "m", "b", ["s", "d"]), ["s", "d"])
    one, many = (bootstrap.replicate_sums(indexed, len(names), 30, 9, size).orderBy("replicate").collect() for size in (bootstrap.RANGE, 3))
    assert [list(r) for r in one] == [pytest.approx(list(r)) for r in many]
    plan = bootstrap.replicate_sums(indexed, len(names), 30, 9)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(position" not in plan


def test_bootstrap_above_one_range_draws_once(spark):
    rows = [(f"s{i}", "d", float(i % 5), float(i % 5 + i % 3), float(i % 7)) for i in range(41)]
    df = spark.createDataFrame(rows, "s string, d string, t double, m double, b double")
    indexed = bootstrap.indexed_blocks(bootstrap.block_statistics(df, "t", "m", "b", ["s", "d"]), ["s", "d"])
    by_position = sorted(indexed.select("position", *bootstrap.SUMS).collect())
    sums = np.array([list(r)[1:] for r in by_position], float)
    want = [sums[bootstrap.positions(9, r, 0, 11, 41)[:41]].sum(0).tolist() for r in range(40)]
    for found in (bootstrap.replicate_sums(indexed, 41, 40, 9, 4),
                  bootstrap._drawn_in_slices(indexed, 41, 40, 9, 4, 10).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in bootstrap.SUMS])):
        got = found.select("replicate", *bootstrap.SUMS).orderBy("replicate").collect()
        assert [list(r)[1:] for r in got] == [pytest.approx(w) for w in want]
    plan = bootstrap.replicate_sums(indexed, 41, 40, 9, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan  # every range of blocks used to go to every chunk of replicates, where all draws were made again


def test_draws_are_the_slices_of_digests():
    want = [int(hashlib.sha256(f"7|3|{j}".encode()).hexdigest()[15 * i:15 * i + 15], 16) % 1_000_003 for j in range(5, 90) for i in range(4)]
    assert bootstrap.positions(7, 3, 5, 90, 1_000_003).tolist() == want


def test_infinite_interval_widths(spark):
    rows = [(1.0, -math.inf, math.inf), (2.0, 1.0, 3.0), (3.0, 9.0, 1.0), (float("nan"), 0.0, 1.0)]
    r = intervals.interval_report(spark.createDataFrame(rows, "truth double, lower double, upper double")).first()
    assert (r.n, r.n_omitted, r.coverage, r.mean_width, r.median_width) == (2, 2, 1.0, math.inf, math.inf)


def test_digest_ignores_order_and_sees_one_cell(spark, obs):
    df = obs.select("sample_id", "site_id", "date")
    want = digests.table_digest(df).first()
    assert digests.table_digest(df.repartition(11).orderBy(F.desc("sample_id"))).first() == want
    changed = df.withColumn("date", F.when(F.col("sample_id") == "5", F.lit("x")).otherwise(F.col("date")))
    assert digests.table_digest(changed).first().digest != want.digest
    named = spark.createDataFrame([("a", want.digest)], "name string, digest string")
    digests.authorise_final(True, named, named)
    for unlock, other in ((False, named), (True, named.withColumn("digest", F.lit("0")))):
        with pytest.raises(digests.LockedError):
            digests.authorise_final(unlock, named, other)


def test_file_digests_stream_names_as_they_are(spark, tmp_path):
    sizes = {"a%20b.bin": 0, "plain.bin": digests.PIECE_BYTES, "long é.gz": 3 * digests.PIECE_BYTES + 17}
    want = {}
    for name, size in sizes.items():
        content = random.Random(size).randbytes(size)
        (tmp_path / name).write_bytes(content)
        want[name] = (size, hashlib.sha256(content).hexdigest())
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.digest) for r in digests.file_digests(spark, str(tmp_path)).collect()}
    assert got == want


def test_joins_refuse_mismatches(spark, obs):
    left, right = obs.select("sample_id"), obs.filter("sample_id <> '3'").select("sample_id")
    with pytest.raises(joins.AlignmentError):
        joins.join_predictions(left, right)
    with pytest.raises(joins.AlignmentError):
        joins.join_predictions(left.unionByName(left), left)


# ------------------------------------------------------------------------------------ quality


def test_quality_findings(spark, obs):
    rules = quality.QualityRules(policy=POLICY, strict_columns=False)
    issues = quality.validate(obs.withColumn("Bad", F.lit(1)), rules, {"latitude": "metre", "longitude": "deg"})
    found = {(r.code, r.column_name) for r in issues.collect()}
    assert {("invalid_column_names", "Bad"), ("unit_mismatch", "latitude"), ("missing_required_column", "sensor_id")} <= found
    assert ("unit_mismatch", "longitude") not in found
    with pytest.raises(quality.SchemaError):
        quality.require_valid(issues)
    empty = {r.code for r in quality.validate(obs.limit(0), rules).collect()}
    assert {"empty_table", "all_missing_predictor"} <= empty
    odd = quality.schema_issues(obs, quality.QualityRules(policy=POLICY, warn_missing=0.9, error_missing=0.1))
    assert any(code == "invalid_missingness_config" for _, code, *_ in odd)


def test_rules_read_the_table_once(spark, sf_dir):
    df = observations(spark, sf_dir)
    rules = quality.row_rules(df, quality.QualityRules(policy=POLICY, strict_columns=False))
    plan = quality.rule_counts(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Python" not in plan


# ------------------------------------------------------------------------------------- models


def test_encoder(spark, target):
    train = target.filter("background_air_temperature_c < 40")
    encoder = fit_encoder(train, POLICY, kind="linear")
    assert "background_relative_humidity_pct__missing" in encoder.feature_names
    assert Encoder.from_json(encoder.to_json()) == encoder
    m = encoder.transform(train).agg(F.avg("f_canopy_fraction"), F.stddev_pop("f_canopy_fraction")).first()
    assert m[0] == pytest.approx(0, abs=1e-9) and m[1] == pytest.approx(1)
    unseen = train.withColumn("land_cover_class", F.lit("new"))
    hot = [c for c in encoder.transform(unseen).columns if c.startswith("f_land_cover")]
    assert encoder.transform(unseen).agg(*[F.sum(c) for c in hot]).first()[0] == 0
    with pytest.raises(EncodingError):
        fit_encoder(train.withColumn("canopy_fraction", F.lit(float("inf"))), POLICY)
    with pytest.raises(EncodingError):
        fit_encoder(train.withColumn("canopy_fraction", F.lit("leafy")), POLICY)


def test_encoder_medians(spark, target):
    encoder = fit_encoder(target, POLICY)
    exact = target.agg(*[F.median(c).alias(c) for c in encoder.numeric]).first().asDict()
    assert encoder.medians == pytest.approx(exact)


def test_encoder_refuses_bad_values_when_applied(spark, target):
    encoder = fit_encoder(target, POLICY)
    for value in (F.lit("abc"), F.lit(float("inf"))):
        bad = target.withColumn("canopy_fraction", value)
        assert encoder.refusals(bad).first()["canopy_fraction"] == bad.count()
        with pytest.raises(EncodingError):
            encoder.require_numbers(bad)
        with pytest.raises(Exception, match="not a finite number"):
            encoder.transform(bad).collect()
    assert encoder.require_numbers(target.withColumn("canopy_fraction", F.lit(None).cast("double"))).count() == target.count()


def test_first_trees_are_a_prefix_of_the_model(spark, target):
    full = models.fit_boosted(target, "y", POLICY, POLICY.core, models.BoostedParams(trees=3, depth=2, step_size=0.5), 1)
    curve = models.loss_curve(full, target, "y")
    for count in (1, 2, 3):
        error = models.first_trees(full, count).predict(target, "p").agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
        assert error == pytest.approx(curve[count - 1])


def test_search_stops_after_the_best_count_and_scores_there(spark, target):
    """Candidates of one search are fitted together, stop ``patience`` trees after the best, and are ranked at their best count."""
    noisy = target.withColumn("y", F.col("y") + F.pmod(F.xxhash64("sample_id"), F.lit(100)) / 10)
    rows = folds.with_parts(noisy, folds.dual_blocked_parts(noisy, SPLIT), SPLIT).cache()
    trials = [models.BoostedParams(trees=40, depth=2, step_size=0.05), models.BoostedParams(trees=40, depth=5, step_size=1.5)]
    seen = []
    best = models.search(rows, "y", POLICY, POLICY.core, trials, 1, ["spatial_block_id", "date"], SPLIT.n_folds, patience=4,
                         observe=lambda trees, active: seen.append((trees, active)))
    assert all(s["fitted"] <= min(40, s["trees"] + 4) for s in best.scores) and len(best.scores) == 2 * SPLIT.n_folds
    assert any(s["fitted"] < 40 for s in best.scores) and seen[0] == (0, 6) and seen[-1][1] < 6
    at_best = {t: np.mean([s["grouped_mae"] for s in best.scores if s["trial"] == t]) for t in (0, 1)}
    assert best.objective == pytest.approx(min(at_best.values()))
    # the same fit alone: the same trees, and the error that the search was given
    train, held = rows.filter(folds.in_part(0, "train")), rows.filter(folds.in_part(0, "validation"))
    alone = models.fit_boosted(train, "y", POLICY, POLICY.core, trials[0], 1, validation=held, patience=4)
    score = next(s for s in best.scores if (s["trial"], s["fold"]) == (0, 0))
    assert alone.tree_count == score["trees"] and len(alone.curve) == score["fitted"]
    long = metrics.long_predictions(alone.predict(held, "m"), "y", ["m"], ["spatial_block_id", "date"])
    assert metrics.grouped_mae(long, ["spatial_block_id", "date"]).first()["grouped_mae"] == pytest.approx(score["grouped_mae"], rel=1e-6)


def test_first_split_beside_brute_force(spark):
    """The root split is the one that most reduces the variance of the residuals' signs over all cuts of all features."""
    rng = np.random.default_rng(8)
    rows = [(f"r{i}", float(a), float(b), float(3 * (a > 6) + (b > 2) + rng.normal() / 5)) for i, (a, b) in enumerate(rng.integers(0, 12, size=(400, 2)))]
    df = spark.createDataFrame(rows, "sample_id string, canopy_fraction double, background_wind_speed_m_s double, y double").repartition(5)
    policy = PredictorPolicy(core=("canopy_fraction", "background_wind_speed_m_s"), additions=())
    fitted = models.fit_boosted(df, "y", policy, policy.core, models.BoostedParams(1, 1, 1.0, 1.0, 1.0), 3)
    x, y = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    sign = np.sign(y - fitted.model.start)

    def gain(f, cut):
        left = x[:, f] <= cut
        return sum(sign[s].sum() ** 2 / s.sum() for s in (left, ~left) if s.sum())

    best = max(((gain(f, c), -f, -c) for f in (0, 1) for c in np.unique(x[:, f])[:-1]))
    names = fitted.encoder.feature_names
    assert [names[fitted.model.feature[0, 0]], fitted.model.split[0, 0]] == [policy.core[-best[1]], -best[2]]
    left = x[:, -best[1]] <= -best[2]
    scale = np.abs(y - fitted.model.start).mean()
    assert fitted.model.value[0, 1:] == pytest.approx([scale * sign[left].mean(), scale * sign[~left].mean()])


def test_trees_do_not_depend_on_refresh_or_gathering(spark, target, monkeypatch):
    from terrafold.operators import boosting

    params = models.BoostedParams(trees=7, depth=3, step_size=0.3, subsample=0.6)
    one = models.fit_boosted(target, "y", POLICY, POLICY.core, params, 5).model
    monkeypatch.setattr(boosting, "REFRESH", 2)
    monkeypatch.setattr(boosting, "GATHER", 0)
    two = models.fit_boosted(target, "y", POLICY, POLICY.core, params, 5).model
    assert (one.feature == two.feature).all() and (one.split == two.split).all() and one.value == pytest.approx(two.value, rel=1e-6)


def test_weights_and_odd_rows_of_boosting(spark, target):
    heavy = models.fit_boosted(target, "y", POLICY, POLICY.core, models.BoostedParams(trees=3, depth=2), 1, weights=((40.0,), (1.0, 3.0)))
    assert heavy.variant == "secondary_heat_weighted" and heavy.model.start == pytest.approx(target.agg(F.percentile_approx("y", 0.5)).first()[0], abs=0.2)
    gaps = target.withColumn("y", F.when(F.col("sample_id") != "1", F.col("y"))).withColumn("canopy_fraction", F.lit(None).cast("double"))
    assert len(models.fit_boosted(gaps, "y", POLICY, POLICY.core, models.BoostedParams(trees=2, depth=2), 1).model) == 2
    with pytest.raises(ValueError):
        models.fit_boosted(target.filter("false").withColumn("land_cover_class", F.lit("x")), "y", POLICY, POLICY.core, models.BoostedParams(trees=1), 1)


def test_model_paths_do_not_shuffle_on_the_id(spark, target):
    rows = folds.with_parts(target, folds.dual_blocked_parts(target, SPLIT), SPLIT)
    nested = folds.nested_folds(rows, SPLIT, 2)
    for df in (nested, rows.filter(folds.in_part(0, "train"))):
        assert "hashpartitioning(sample_id" not in df._jdf.queryExecution().executedPlan().toString()


def test_attaching_refuses_repeated_and_unknown_ids(spark):
    data = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, v int")
    plan = spark.createDataFrame([("a", "development"), ("b", "final_test")], "sample_id string, split_role string")
    assert joins.attach_manifest(data, plan).count() == 2
    for bad_data, bad_plan in ((data, plan.union(plan)), (data.union(data), plan), (data, plan.limit(1))):
        with pytest.raises(joins.AlignmentError):
            joins.attach_manifest(bad_data, bad_plan)


def test_infinite_labels_are_equal(spark):
    both = spark.createDataFrame([("a", float("inf")), ("b", float("nan")), ("c", 1.0), ("d", float("-inf"))], "sample_id string, y double")
    assert joins.label_differences(both, both, "y").first()["differing"] == 0
    assert joins.join_predictions(both.withColumn("p", F.lit(0.0)), both, label="y").count() == 4
    moved = both.withColumn("y", F.when(F.col("sample_id") == "a", float("-inf")).otherwise(F.col("y")))
    assert joins.label_differences(both, moved, "y").first()["differing"] == 1


def test_unequal_pairs_and_unfit_roles_are_refused(spark, obs):
    from terrafold.functions import satellite

    with pytest.raises(joins.AlignmentError):
        satellite.eligible_pair(obs.filter("sample_id <> '5'"), obs)
    rows = roles.assign_roles(obs, SPLIT)
    assert roles.evaluation_rows(rows, "development", SPLIT).count() > 0
    with pytest.raises(folds.SplitError):
        roles.evaluation_rows(rows, "development", SPLIT, allowed_flags=("none",))
    with pytest.raises(folds.SplitError):
        roles.evaluation_rows(rows, "final_test", SPLIT, roles.RoleDesign(minimum_sites=10 ** 6))
    with pytest.raises(folds.SplitError):
        roles.assign_roles(obs.withColumn("date", F.when(F.col("sample_id") != "1", F.col("date"))).withColumn("weather_event_id", F.lit("w1")), SPLIT)


def test_intermediates_are_deleted_by_their_owner(spark):
    import os

    from terrafold.session import intermediates, materialise

    with intermediates(spark):
        table = materialise(spark.range(5), "owned")
        path = table.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert table.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_instants_do_not_change_digests_with_the_zone(spark):
    df = spark.sql("select timestamp_micros(id * 1000001) as t from range(5)")
    first = digests.table_digest(df).first()["digest"]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert digests.table_digest(df).first()["digest"] == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_elastic_net_optimality(spark, target):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = x @ np.array([2.0, -1.0, 0.0, 0.5]) + rng.normal(size=400)
    z = np.column_stack([np.ones(400), x, y])
    for alpha, ratio in ((0.1, 1.0), (0.3, 0.5), (1.0, 0.0)):
        b, w = linear.solve(z.T @ z, alpha, ratio)
        gradient = -x.T @ (y - b - x @ w) / 400 + alpha * (1 - ratio) * w
        for g, v in zip(gradient, w):
            assert abs(g + alpha * ratio * np.sign(v)) < 1e-6 if v else abs(g) <= alpha * ratio + 1e-6
    fitted = linear.fit_elastic_net(target, "y", POLICY, POLICY.core, 1e-6, 0.5)
    error = fitted.predict(target).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert error < 1e-3


def test_boosted_trees_learn_and_are_stored(spark, target):
    params = models.BoostedParams(trees=8, depth=4, step_size=0.4)
    fitted = models.fit_boosted(target, "y", POLICY, POLICY.core, params, 1)
    scored = fitted.predict(target)
    mae = scored.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    base = target.agg(F.avg(F.abs(F.col("y") - 36))).first()[0]
    assert mae < 0.6 * base
    again = models.fit_boosted(target, "y", POLICY, POLICY.core, params, 1).predict(target)
    assert digests.table_digest(scored, ["sample_id", "prediction"]).first() == digests.table_digest(again, ["sample_id", "prediction"]).first()
    path = fresh(spark, "model")
    model_store.save_model(spark, fitted, path)
    back = model_store.load_model(spark, path).predict(target)
    assert digests.table_digest(back, ["sample_id", "prediction"]).first() == digests.table_digest(scored, ["sample_id", "prediction"]).first()
    with pytest.raises(tables.SourceError):
        model_store.save_model(spark, fitted, path)
    assert models.loss_curve(fitted, target, "y")[-1] < models.loss_curve(fitted, target, "y")[0]


def test_stored_run_scores_alike_in_a_new_session(spark, target):
    from terrafold.plans.scoring import WindSettings, score
    from terrafold.sources import runs

    rows = target.filter("measured_pedestrian_wind_speed_m_s >= 0")
    params = models.BoostedParams(trees=3, depth=3, step_size=0.4)
    encoder = fit_encoder(rows, POLICY)
    plan = ScoringPlan(models.fit_boosted(rows, "y", POLICY, POLICY.core, params, 1), models.fit_components(rows, POLICY, POLICY.core, params, 2), 1.25,
                       3.0, {"canopy_fraction": (0.1, 0.9)}, fit_isolation_forest(rows, encoder, trees=5, sample=32), WindSettings(roughness_m=0.2))
    path = fresh(spark, "run")
    runs.save_run(spark, plan, path, {"seed": "1"})
    other = spark.newSession()
    back = runs.load_run(other, path)
    assert (back.radius, back.warning_threshold, back.bounds, back.wind) == (1.25, 3.0, {"canopy_fraction": (0.1, 0.9)}, plan.wind)
    want = digests.table_digest(score(target, plan)).first()
    assert digests.table_digest(score(target, back)).first() == want
    assert runs.notes(spark, path) == {"seed": "1"}
    with pytest.raises(tables.SourceError):
        runs.save_run(spark, plan, path)
    damaged = fresh(spark, "run")
    runs.save_run(spark, ScoringPlan(linear.fit_elastic_net(target, "y", POLICY, POLICY.core, 0.01, 0.5)), damaged)
    assert runs.load_run(spark, damaged).components is None
    spark.createDataFrame([("linear", "{}", 0, "", 0.0, [1.0], 0.0, 0.0)], "kind string, encoder string, tree_count int, variant string, intercept double, "
                          "coefficients array<double>, alpha double, l1_ratio double").write.mode("append").parquet(f"{damaged}/direct/state")
    with pytest.raises(tables.SourceError, match="direct"):
        runs.load_run(spark, damaged)


def test_tree_count_rules(spark):
    assert models.best_tree_count([5, 4, 3, 4, 4, 1], patience=2) == 3
    assert models.best_tree_count([5, 4, 3, 2], patience=2) == 4
    for counts, want in (((120, 200, 250), 300), ((501, 500), 501), ((1600, 1700), 1500)):
        assert models.clamp_count(counts, 300, 1500) == want
        df = spark.createDataFrame([(c,) for c in counts], "t int")
        assert order_stats.selected_tree_count(df, "t", 300, 1500).first().tree_count == want
    assert models.candidates(3, 1) == models.candidates(3, 1) != models.candidates(3, 2)


def test_isolation_forest_finds_the_outlier(spark, target):
    odd = target.limit(1).withColumns({"sample_id": F.lit("odd"), "background_air_temperature_c": F.lit(500.0), "background_wind_speed_m_s": F.lit(900.0)})
    rows = target.unionByName(odd)
    forest = fit_isolation_forest(rows, fit_encoder(rows, POLICY), trees=60, sample=128)
    worst = forest.score(rows).orderBy("anomaly_score").first()
    assert worst.sample_id == "odd" and worst.is_anomaly
    assert mean_path(2) == 1.0 and mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_stacked_trees_give_the_path_of_each_tree():
    draw = np.random.default_rng(3)
    trees = tuple(isolation.grow(draw.normal(size=(n, 4)), n) for n in (1, 2, 40, 256))
    x = draw.normal(size=(700, 4))

    def walk(row, t):
        node = depth = 0
        while t["feature"][node] >= 0:
            node = t["left" if row[t["feature"][node]] <= t["split"][node] else "right"][node]
            depth += 1
        return depth + float(mean_path(t["size"][node]))

    want = [np.mean([walk(row, t) for t in trees]) for row in x]
    assert isolation.stacked(trees).mean_depth(x) == pytest.approx(want)


def test_partial_dependence_of_a_line(spark, target):
    curve = diagnostics.partial_dependence(target, "canopy_fraction", lambda d: d.withColumn("prediction", F.col("canopy_fraction") * 2), size=5)
    assert all(r.mean_prediction == pytest.approx(2 * r.value) for r in curve.collect()) and curve.count() == 5


# ------------------------------------------------------------------------- sources and plans


def test_sources(spark, obs, sf_dir):
    for bad in (None, " ", f"{sf_dir}/absent.parquet", f"{sf_dir}/orders.txt"):
        with pytest.raises(tables.SourceError):
            tables.read_table(spark, bad)
    small = obs.select("sample_id", "canopy_fraction")
    for suffix in ("csv", "parquet"):
        path = fresh(spark, "table") + "." + suffix
        tables.write_table(small, path)
        back = tables.typed(tables.read_table(spark, path), {"canopy_fraction": "double"})
        assert digests.table_digest(back).first() == digests.table_digest(small).first()
        with pytest.raises(tables.SourceError):
            tables.write_table(small, path)
        with pytest.raises(tables.SourceError):
            tables.write_table(small, path, inputs=[path], overwrite=True)


def test_evaluation_bundle(spark, obs):
    predictions = obs.select("sample_id", "calculated_utci_c", "direct_core", "component_utci_c",
                             F.col("background_air_temperature_c").alias("baseline_background_air_temperature"))
    result = evaluate(obs.drop("direct_core", "component_utci_c"), predictions, replicates=10)
    assert result.metrics.count() == 3 and result.paired.count() == 2 and set(result.bootstrap) == {
        "spatial_day_observation_weighted", "spatial_day_block_balanced", "site_day_observation_weighted", "site_day_block_balanced"}
    kinds = {r.subgroup_type for r in result.subgroups.select("subgroup_type").distinct().collect()}
    assert kinds == {"observed_heat_category", "sun_vs_shade", "land_cover", "coast_distance", "time_of_day"}
    with pytest.raises(joins.AlignmentError):
        evaluate(obs.withColumn("calculated_utci_c", F.col("calculated_utci_c") + 1), predictions, replicates=10)


def test_streaming_scoring_equals_batch(spark, target):
    fitted = linear.fit_elastic_net(target, "y", POLICY, POLICY.core, 0.01, 0.5)
    plan = ScoringPlan(fitted, radius=1.5, bounds={"canopy_fraction": (0.1, 0.9)})
    source, sink = fresh(spark, "in"), fresh(spark, "out")
    target.repartition(4).write.parquet(source)
    query = start_scoring(read_observations(spark, source, target.schema, 2), plan, sink, f"s{uuid.uuid4().hex}")
    query.awaitTermination(120)
    from terrafold.plans.scoring import score

    want = digests.table_digest(score(target, plan)).first()
    assert digests.table_digest(spark.read.parquet(sink), score(target, plan).columns).first() == want


def test_boosting_passes_use_the_cores_and_send_only_open_trees(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 60, (500, 4))
    feature, split, value = rng.integers(-1, 4, (6, 31)), rng.integers(0, 60, (6, 31)).astype(float), rng.normal(size=(6, 31))
    feature[:, 15:] = -1
    for i in range(1, 31):
        feature[:, i] = np.where(feature[:, (i - 1) // 2] < 0, -1, feature[:, i])
    for columns in (x.astype(np.uint8), x + 0.5):
        for part, f, s, v in zip(models.boosting.staged(columns, feature, split, value), feature, split, value):
            assert (part == v[models.boosting.reached(columns, np.arange(500), f, s, 31)]).all()
    rows = spark.range(0, 40_000, 1, 1).select(F.col("id"), (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("y"))
    encoder = models.fit_encoder(rows, models.PredictorPolicy(core=("a",), additions=()), predictors=("a",))
    table = models.boosting.binned(rows, F.xxhash64("id"), [encoder], [F.lit(True)], [F.col("y")], [F.lit(1)])
    assert table.few(table.blocks).rdd.getNumPartitions() > 1  # one file of blocks kept all but one core idle in every pass
    g = models.boosting.Growing(0, models.boosting.Model(0, 0, 0, models.BoostedParams(), 1), 0.0, 3, trees=[(0, 0, i) for i in range(9)], pending=2)
    assert len(g.sent().trees) == 2 and g.sent().before == 7


def test_candidates_are_scored_without_repeated_rows(spark):
    rows = [(f"s{i % 5}" if i % 11 else None, i % 2, None if i % 7 == 0 else float(i), float(i * 3 % 8) if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:9], "site string, fold int, truth double, prediction double")
    grid = [({"alpha": a}, F.col("prediction") * a) for a in (0.5, 2.0)]
    got = metrics.grouped_mae(df, ["site"], ["alpha", "fold"], grid)
    long = df.select("*", F.explode(F.array(F.lit(0.5), F.lit(2.0))).alias("alpha")).withColumn("prediction", F.col("prediction") * F.col("alpha"))
    want = metrics.grouped_mae(long, ["site"], ["alpha", "fold"])
    assert got.columns == want.columns
    for g, w in zip(got.orderBy("alpha", "fold").collect(), want.orderBy("alpha", "fold").collect(), strict=True):
        assert list(g) == pytest.approx(list(w))
    from terrafold.plans import catalog
    plan = catalog.queries()["metric_leaderboard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Relation") and "Generate" not in plan[plan.rindex("Aggregate"):]  # rows are not repeated
