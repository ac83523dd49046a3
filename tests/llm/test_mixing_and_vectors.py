"""Source mixing, embedding whitening and hard negatives beside brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import counted, words
from pyspark.sql import functions as F

from terrafold.llm import hard_negatives, mixing, whitening

DOCS = "doc_id long, text string, lang string, source string, size string, src string"


def documents(spark, rows):
    """With columns of names that the operator uses itself."""
    return spark.createDataFrame([(i, t, "en", s, "x", None) for i, t, s in rows], DOCS)


def water_level(sizes, weights=(5, 2, 1), percent=150, repeats=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values()) * percent / 100
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] >= repeats * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def mixed(spark, rows, **settings):
    return mixing.mix(documents(spark, rows), **settings).collect()


def check_mix(rows, out, percent=150):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = water_level(dict(sizes), percent=percent)
    assert Counter((r.doc_id, r.size, r.source) for r in out) == Counter((i, len(words(t)), s) for i, t, s in rows)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s] + 0.5), s


def corpus(n, seed=1):
    rng = random.Random(seed)
    text = lambda: None if rng.random() < 0.05 else " ".join(["w"] * int(rng.paretovariate(0.8)))[:60_000]
    return [(i, text(), rng.choice(["b", "b", "b", "é", "", "a", None, "\U0001f600"])) for i in range(n)]


def test_mix_meets_targets(spark):
    rows = corpus(600)
    out = mixed(spark, rows)
    check_mix(rows, out)
    again = mixing.mix(documents(spark, rows[::-1]).repartition(7)).collect()
    assert counted(out) == counted(again)


def test_smaller_mix_is_contained(spark):
    rows = corpus(300, 2)
    less, more = (Counter(), Counter())
    for percent, into in ((60, less), (90, more)):
        out = mixed(spark, rows, percent=percent)
        check_mix(rows, out, percent)
        into.update({r.doc_id: r.taken for r in out})
    # a source whose bound is not reached in both mixes only rises
    assert all(less[i] <= more[i] for i in less)


def test_mix_of_copies_and_odd_rows(spark):
    same = [(7, "one two three", "hot")] * 500
    rows = same + [(None, "x y", "hot"), (None, None, None), (1, "", "empty"), (2, " \t\n", "empty"), (3, "z" * 100_000, "one"), (3, "other text", "one")]
    check_mix(rows, mixed(spark, rows))
    assert mixed(spark, []) == []
    assert [(r.size, r.taken, r.target) for r in mixed(spark, [(1, None, "s"), (2, "", None)])] == [(0, 0, 0.0)] * 2
    with pytest.raises(ValueError):
        mixing.mix(documents(spark, rows), percent=201)


def test_many_sources(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 17)), f"s{i % 211:03}") for i in range(900)]
    check_mix(rows, mixed(spark, rows))


VECTORS = "vec_id long, embedding array<float>, label int, n long, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], VECTORS)


def test_jacobi_beside_lapack():
    rng = np.random.default_rng(3)
    for p, rank in ((1, 1), (2, 2), (7, 3), (33, 33), (64, 12)):
        b = rng.normal(size=(p, rank)) * np.logspace(0, -4, rank)
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        values, axes = whitening.jacobi(factor)
        want = np.linalg.eigvalsh(a)[::-1][:rank]
        assert factor.shape[1] >= rank and np.allclose(factor @ factor.T, a, atol=1e-14)
        assert np.allclose(values[:rank], want, rtol=1e-6, atol=1e-16) and np.allclose(axes[:, :rank].T @ axes[:, :rank], np.eye(rank), atol=1e-12)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_whitening_beside_brute_force(spark):
    rng = np.random.default_rng(4)
    data = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    odd = [(900, None, 1), (901, [1.0] * 11 + [None], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] + [0.0] * 11, 1), (904, [], 1), (905, [1.0], 1)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)] + [(5, data[5].tolist(), 0), (None, data[6].tolist(), None)]
    out = whitening.whiten(vectors(spark, rows + odd)).collect()
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v, _ in rows]
    n, p = len(x), 12
    sums = [sum(r[d] for r in x) for d in range(p)]
    centred = (np.array(x) * n - np.array(sums)) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(out) == 8 * n and {r.n for r in out} == {n}
    want = Counter()
    for (i, _, _), r in zip(rows, x):
        want[i, sum((n * a - s) ** 2 for a, s in zip(r, sums))] += 8
    assert Counter((r.vec_id, r.deviation) for r in out) == want
    found = {(r.vec_id, r.component): r for r in out}
    for c in range(8):
        mine = np.array([found[i, c + 1].whitened for i in range(300)])
        theirs = centred[:300] @ axes[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
        assert found[0, c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert all(0 <= r.identity_error < 1e-9 for r in out)


def test_whitening_of_few_and_flat_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0)])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0], 0) for i in range(9)])).collect() == []
    two = whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 5.0], 0)])).collect()
    assert [(r.vec_id, r.component, abs(r.whitened), r.explained, r.deviation) for r in two] == [(1, 1, 1.0, 1.0, 2048 ** 2), (2, 1, 1.0, 1.0, 2048 ** 2)]
    big = whitening.whiten(vectors(spark, [(1, [3e38, 0.0], 0), (2, [-3e38, 0.0], 0), (3, [0.0, 1.0], 0)])).collect()
    assert {r.component for r in big} == {1, 2} or {r.component for r in big} == {1}
    assert all(r.deviation is None for r in big if r.vec_id != 3)


def brute(rows, every=100):
    def fine(v):
        return v and all(c is not None and np.isfinite(c) for c in v)

    rows = [(i, v, y) for i, v, y in rows if y is not None and fine(v)]
    if not rows:
        return Counter()
    length = Counter(len(v) for _, v, _ in rows)
    width = min(length, key=lambda k: (-length[k], k))
    rows = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], y) for i, v, y in rows if len(v) == width]
    out = Counter()
    for a, q, y in rows:
        if a is None or a % every:
            continue
        scored = sorted(((-sum(s * t for s, t in zip(q, v)), i is None, i or 0, z) for i, v, z in rows if i != a))
        own = [x for x in scored if x[3] == y][:5]
        for s, null, i, _ in own:
            fit = [x for x in scored if x[3] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out.update([(a, None if null else i, k + 1, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(fit)])
    return out


def mined(spark, rows, **settings):
    return counted(hard_negatives.mine(vectors(spark, rows), **settings).collect())


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, width))
    return [(int(i), (centre[i % 4] + 0.3 * rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("width", [3, 64, 70])
def test_hard_negatives_beside_brute_force(spark, width):
    rows = clustered(700, width, width)
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, rows_per_block=50, anchors_per_block=2) == want


def test_hard_negatives_in_rounds(spark, monkeypatch):
    rows = clustered(900, 8, 5)
    monkeypatch.setattr(hard_negatives, "ROUND_BYTES", 1)
    assert mined(spark, rows, anchors_per_block=4) == brute(rows)


def test_hard_negatives_of_ties_and_odd_rows(spark):
    same = [(i, [1.0, 0.5], i % 2) for i in range(1, 120)]
    assert mined(spark, [(0, [1.0, 0.5], 0), *same]) == brute([(0, [1.0, 0.5], 0), *same])
    rows = clustered(300, 5, 9)
    rows += [rows[100], rows[101], rows[102], (100, rows[3][1], 2), (None, rows[100][1], 1), (None, rows[100][1], 0), (400, None, 1), (500, [1.0], 1),
             (600, [None, 1.0, 1.0, 1.0, 1.0], 1), (700, [float("nan")] * 5, 1), (800, [float("-inf")] * 5, 1), (900, rows[0][1], None), (1000, [], 0),
             (1100, [0.0] * 5, 0), (1200, [-c for c in rows[0][1]], 0)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == Counter()
    assert mined(spark, [(0, [1.0], 1)]) == Counter()


def test_intervals_hold_every_score():
    rng = np.random.default_rng(6)
    for width in (1, 5, 64, 130):
        values = rng.integers(-400, 400, size=(200, width)).astype(np.int64)
        values[:3] = 0
        turn = hard_negatives.rotation(width)
        rows = hard_negatives.Rows(np.arange(200), np.zeros(200, np.int64), values, *hard_negatives.coded(values.astype(float), turn))
        anchors = hard_negatives.Anchors(np.arange(40), np.arange(40), np.zeros(40, np.int64), values[:40], *hard_negatives.rounded(values[:40].astype(float), turn))
        lower, upper = hard_negatives.intervals(anchors, rows)
        score = values[:40] @ values.T
        assert (lower <= score).all() and (score <= upper).all()
        if width == 64:
            assert np.mean(upper - lower) < 1.4 * np.mean(np.outer(np.linalg.norm(values[:40], axis=1), np.linalg.norm(values, axis=1)))


def test_moved_labels(spark):
    rows = spark.createDataFrame([(7, 9), (14, 3), (8, 9), (None, 1), (21, None)], "vec_id long, label int")
    assert [(r.vec_id, r.label) for r in hard_negatives.with_moved_labels(rows).orderBy(F.col("vec_id")).collect()] == [(None, 1), (7, 0), (8, 9), (14, 4), (21, None)]
