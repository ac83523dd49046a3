"""Exact global ranks and order statistics without an unpartitioned window.

Equal values are counted first, so a value held by a third of all rows is one row. The
counts are range-partitioned and written; bucket totals give offsets, and a window inside
each bucket finishes the running total.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.basic import finite, number
from ..functions.keys import stable_hash
from ..session import materialise

BUCKET = "__bucket"


def cumulative_counts(
    df: DataFrame, value: str, keys: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """``(keys, value, n, cum, n_total)``: rows equal to the value, rows up to and including
    it, and all rows of the key."""
    keys = list(keys)
    counted = df.groupBy(*keys, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("bigint").alias("n")
    )
    ranged = materialise(
        counted.repartitionByRange(*keys, value).withColumn(BUCKET, F.spark_partition_id()), "counts"
    )
    totals = ranged.groupBy(*keys, BUCKET).agg(F.sum("n").alias("bucket_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    # One row per (keys, bucket), so these windows see at most one row per range partition.
    offsets = totals.select(
        *keys, BUCKET,
        F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("offset"),
        F.sum("bucket_n").over(whole).alias("n_total"),
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("running", F.sum("n").over(inside))
        .join(offsets, [*keys, BUCKET])
        .select(*keys, value, "n", (F.col("offset") + F.col("running")).alias("cum"), "n_total")
    )


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Rank of each distinct value, ties sharing their mean rank; ``weight`` tells how many rows a row stands for."""
    return cumulative_counts(df, value, keys, weight).withColumn(
        "avg_rank", F.col("cum") - (F.col("n") - 1) / F.lit(2.0)
    )


def kth_smallest(df: DataFrame, value: str, k: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, value)`` of the k-th smallest row (one-based); ``k`` may use ``n_total``."""
    reached = cumulative_counts(df, value, keys).filter(F.col("cum") >= k)
    return reached.groupBy(*keys).agg(F.min(value).alias(value))


def upper_quantile(df: DataFrame, value: str, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Order statistic at zero-based index ceil(q (n-1)): the quantile that never interpolates down."""
    position = F.ceil(F.lit(q) * (F.col("n_total") - 1)) + 1
    return kth_smallest(df, value, position, keys)


def linear_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles: one column ``q<i>`` per probability.

    Both neighbours of every position come from one pass over the cumulative counts.
    """
    keys = list(keys)
    total = F.col("n_total")
    picks = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (total - 1)
        low = F.floor(position) + 1
        high = F.ceil(position) + 1
        picks += [
            F.min(F.when(F.col("cum") >= low, F.col(value))).alias(f"low{i}"),
            F.min(F.when(F.col("cum") >= high, F.col(value))).alias(f"high{i}"),
            F.first(position - F.floor(position)).alias(f"part{i}"),
        ]
    found = cumulative_counts(df, value, keys).groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * F.col(f"part{i}")).alias(f"q{i}")
            for i in range(len(probabilities))
        ],
    )


def refused_residuals(df: DataFrame, residual: str) -> DataFrame:
    """One row: residuals that are missing, not finite or negative."""
    r = finite(residual)
    return df.agg(F.count_if(r.isNull() | (r < 0)).alias("refused"))


def conformal_radius(
    df: DataFrame, residual: str, alpha: float = 0.1, minimum_rows: int | None = None
) -> DataFrame:
    """One row: n, the rank k = ceil((n+1)(1-alpha)), the k-th residual, and whether it is bounded.

    Too few rows for the rank, or fewer than the configured minimum, give an infinite radius.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie strictly between zero and one")
    if minimum_rows is not None and minimum_rows <= 0:
        raise ValueError("the minimum row count must be positive")

    def rank(n: Column) -> Column:
        return F.ceil((n + 1) * F.lit(1.0 - alpha)).cast("bigint")

    usable = df.select(finite(residual).alias("residual")).filter("residual >= 0")
    head = cumulative_counts(usable, "residual").agg(
        F.coalesce(F.max("n_total"), F.lit(0)).cast("bigint").alias("n_calibration"),
        F.min(F.when(F.col("cum") >= rank(F.col("n_total")), F.col("residual"))).alias("kth"),
    )
    n = F.col("n_calibration")
    bounded = rank(n) <= n
    if minimum_rows is not None:
        bounded = bounded & (n >= minimum_rows)
    return head.select(
        F.lit(alpha).alias("alpha"), "n_calibration", rank(n).alias("k"),
        F.when(bounded, F.col("kth")).otherwise(F.lit(float("inf"))).alias("radius"),
        bounded.alias("bounded"),
    )


def hash_ranks(groups: DataFrame, group: str, seed: int, salt: str, rank: str = "hash_rank") -> DataFrame:
    """Zero-based position of each distinct group in the order of its seeded hash.

    The hash itself cuts the groups into 4096 even buckets, so no sampling and no global
    sort is needed: bucket sizes give offsets, and each window holds 1/4096 of the groups.
    """
    hashed = groups.withColumn("__hash", stable_hash(group, seed, salt)).withColumn(
        BUCKET, F.substring("__hash", 1, 3)
    )
    sizes = hashed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(BUCKET, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(BUCKET).orderBy("__hash", group)
    return (
        hashed.withColumn("position", F.row_number().over(inside))
        .join(F.broadcast(offsets), BUCKET)  # at most 4096 rows
        .withColumn(rank, (F.col("offset") + F.col("position") - 1).cast("bigint"))
        .drop("__hash", BUCKET, "offset", "position")
    )


def hash_threshold(groups: DataFrame, group: str, count: int, seed: int, salt: str, direct_limit: int = 10_000) -> str:
    """Largest hash among the first ``count`` distinct groups in hash order.

    Membership is then the expression ``stable_hash(group) <= threshold``: no rank and no
    join. A large count is found through the sizes of 4096 hash buckets and the head of one.
    """
    if count <= 0:
        return ""
    hashed = groups.select(stable_hash(group, seed, salt).alias("h"))
    if count > direct_limit:
        sizes = hashed.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(sizes, key=lambda r: r["b"]):  # at most 4096 rows
            if r["n"] >= count:
                hashed = hashed.filter(F.substring("h", 1, 3) == r["b"])
                break
            count -= r["n"]
    return hashed.orderBy("h").limit(count).agg(F.max("h").alias("h")).first()["h"] or ""


def dense_index(df: DataFrame, key: str, index: str = "position") -> DataFrame:
    """Zero-based index of unique keys in key order, without one global window."""
    ranked = cumulative_counts(df, key)
    return ranked.select(key, (F.col("cum") - 1).alias(index))


def hash_sample(df: DataFrame, n: int, seed: int, id_column: str = "sample_id") -> DataFrame:
    """Deterministic sample of ``n`` rows: the smallest seeded hashes of the id.

    Independent of partitioning, unlike ``DataFrame.sample``. The limit is the feature.
    """
    order = stable_hash(id_column, seed, "sample")
    return df.withColumn("__order", order).orderBy("__order").limit(n).drop("__order")


def selected_tree_count(counts: DataFrame, column: str, minimum: int = 1, maximum: int | None = None,
                        keys: Sequence[str] = ()) -> DataFrame:
    """Median of the fold tree counts, halves rounded up, clamped to the refit range."""
    if minimum < 1 or (maximum is not None and maximum < minimum):
        raise ValueError("invalid tree-count bounds")
    value = F.floor(F.median(column) + 0.5)
    value = F.greatest(F.lit(minimum), value)
    if maximum is not None:
        value = F.least(F.lit(maximum), value)
    return counts.groupBy(*keys).agg(value.cast("bigint").alias("tree_count"))




def column_quantiles(
    df: DataFrame, columns: Sequence[str], probability: float = 0.5, accuracy: int = 1000
) -> dict[str, float | None]:
    """Exact linear-interpolated quantile of many numeric columns; None where all is missing."""
    found = columns_quantiles(df, columns, [probability], accuracy)
    return {c: None if q is None else q[0] for c, q in found.items()}


def columns_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 1000
) -> dict[str, list[float] | None]:
    """Exact linear-interpolated quantiles of many numeric columns, one per probability; None where all is missing.

    A sketch with a guaranteed rank error brackets each quantile, the rows below the bracket are counted, and only
    values inside it (some 4/accuracy of the rows) are shuffled. All probabilities share the three passes, and the
    result is a few numbers per column.
    """
    if not columns or not probabilities:
        return {c: [] for c in columns}
    slack = 2.0 / accuracy
    ends = F.array(*[F.lit(end) for p in probabilities for end in (max(0.0, p - slack), min(1.0, p + slack))])
    first = df.agg(
        *[F.percentile_approx(number(c), ends, accuracy).alias(f"e{i}") for i, c in enumerate(columns)],
        *[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(columns)],
    ).first()
    known = [i for i in range(len(columns)) if first[f"n{i}"]]
    if not known:
        return dict.fromkeys(columns)
    # A bracket is a column and a probability; its number tells both.
    wide = len(probabilities)
    bracket = {i * wide + j: (i, first[f"e{i}"][2 * j], first[f"e{i}"][2 * j + 1]) for i in known for j in range(wide)}
    below = df.agg(*[F.count_if(number(columns[i]) < low).alias(f"b{b}") for b, (i, low, _) in bracket.items()]).first()
    entries = F.array_compact(
        F.array(*[
            F.when(number(columns[i]).between(low, high), F.struct(F.lit(b).alias("bracket"), number(columns[i]).alias("value")))
            for b, (i, low, high) in bracket.items()
        ])
    )
    inside = cumulative_counts(df.select(F.inline(entries)), "value", ["bracket"])
    before = F.create_map(*[F.lit(v) for b in bracket for v in (b, below[f"b{b}"])])
    place = F.create_map(*[F.lit(v) for b, (i, _, _) in bracket.items()
                           for v in (b, float(probabilities[b % wide]) * (first[f"n{i}"] - 1))])
    position = place[F.col("bracket")]
    reached = F.col("cum") + before[F.col("bracket")]
    picks = inside.groupBy("bracket").agg(
        F.min(F.when(reached >= F.floor(position) + 1, F.col("value"))).alias("low"),
        F.min(F.when(reached >= F.ceil(position) + 1, F.col("value"))).alias("high"),
        F.first(position - F.floor(position)).alias("part"),
    ).collect()  # one row per bracket
    found = {r["bracket"]: r["low"] + (r["high"] - r["low"]) * r["part"] for r in picks}
    return {c: [found[i * wide + j] for j in range(wide)] if i in known else None for i, c in enumerate(columns)}


def parts_quantiles(df: DataFrame, parts: Sequence[Column], columns: Sequence[str], probability: float,
                    knots: int = 128) -> dict[tuple[int, str], float | None]:
    """``column_quantiles`` of the rows of each part, by (part, column); a row may be in many parts.

    One sketch of all rows gives the ends of intervals, a pass counts the rows of every part in them, and only the values of the
    interval with a part's quantile (some 1/knots of its rows) are shuffled.
    """
    out: dict[tuple[int, str], float | None] = dict.fromkeys((p, c) for p in range(len(parts)) for c in columns)
    if not out:
        return out
    shares = F.array(*[F.lit(k / knots) for k in range(1, knots)])
    numbers = [number(c).alias(f"x{i}") for i, c in enumerate(columns)]
    sketch = df.select(*numbers).agg(*[F.percentile_approx(f"x{i}", shares, 10 * knots).alias(f"x{i}") for i in range(len(columns))]).first()
    ends, n_parts = [np.unique(np.array(s or [0.0], float)) for s in sketch], len(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(p, i): np.zeros(len(own) + 1, np.int64) for p in range(n_parts) for i, own in enumerate(ends)}
        for batch in batches:
            here = [np.flatnonzero(batch.column(len(ends) + p).to_numpy(zero_copy_only=False)) for p in range(n_parts)]
            for i, own in enumerate(ends):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                place = np.where(np.isnan(x), len(own) + 1, np.searchsorted(own, x))
                for p, rows in enumerate(here):
                    total[p, i] += np.bincount(place[rows], minlength=len(own) + 2)[:-1]
        found = [(p, i, k, n) for (p, i), counts in total.items() for k, n in enumerate(counts.tolist()) if n]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["p", "i", "k", "n"])

    inside = [F.coalesce(rows, F.lit(False)).alias(f"p{p}") for p, rows in enumerate(parts)]
    counted = df.select(*numbers, *inside).mapInArrow(count, "p bigint, i bigint, k bigint, n bigint").groupBy("p", "i", "k").agg(F.sum("n").alias("n"))
    histogram = {(p, i): np.zeros(len(own) + 1, np.int64) for p in range(n_parts) for i, own in enumerate(ends)}
    for r in counted.collect():  # at most ``knots`` numbers a part and column
        histogram[r["p"], r["i"]][r["k"]] = r["n"]
    # A bracket is a part and a column; its number tells both.
    bracket: dict[int, tuple[float, float, int, float]] = {}
    for (p, i), counts in histogram.items():
        if counts.any():
            cum, position = counts.cumsum(), probability * (int(counts.sum()) - 1)
            low, high = (int(np.searchsorted(cum, rank + 1)) for rank in (math.floor(position), math.ceil(position)))
            all_ends = [-math.inf, *ends[i].tolist(), math.inf]
            bracket[p * len(columns) + i] = all_ends[low], all_ends[high + 1], int(cum[low] - counts[low]), position
    if not bracket:
        return out
    mine = F.array_compact(F.array(*[F.when(rows, F.lit(p)) for p, rows in enumerate(parts)]))

    def end(i: int, side: int) -> Column:
        own = [bracket.get(p * len(columns) + i) for p in range(len(parts))]
        return F.array(*[F.lit(None if b is None else b[side]).cast("double") for b in own])[F.col("part")]

    entries = F.array_compact(F.array(*[
        F.when((F.col(f"x{i}") > end(i, 0)) & (F.col(f"x{i}") <= end(i, 1)), F.struct((F.col("part") * len(columns) + i).alias("bracket"), F.col(f"x{i}").alias("value")))
        for i in range(len(columns))]))
    values = cumulative_counts(df.select(F.explode(mine).alias("part"), *numbers).select(F.inline(entries)), "value", ["bracket"])
    before, place = (F.create_map(*[F.lit(v) for b, found in bracket.items() for v in (b, found[k])])[F.col("bracket")] for k in (2, 3))
    reached = F.col("cum") + before
    picks = values.groupBy("bracket").agg(
        F.min(F.when(reached >= F.floor(place) + 1, F.col("value"))).alias("low"),
        F.min(F.when(reached >= F.ceil(place) + 1, F.col("value"))).alias("high"),
        F.first(place - F.floor(place)).alias("part"),
    ).collect()  # one row a bracket
    return out | {(r["bracket"] // len(columns), columns[r["bracket"] % len(columns)]): r["low"] + (r["high"] - r["low"]) * r["part"] for r in picks}


def disagreement_threshold(
    df: DataFrame, direct: str, component: str, source_partition: str, quantile: float = 0.95, minimum_pairs: int = 20
) -> DataFrame:
    """One row ``(threshold_c, n_pairs)`` from development out-of-fold rows."""
    if source_partition not in ("development_oof", "development_out_of_fold_predictions"):
        raise ValueError("the threshold is learned from development out-of-fold rows only")
    if not 0.0 < quantile < 1.0 or minimum_pairs <= 0:
        raise ValueError("quantile must lie in (0, 1) and the minimum be positive")
    gaps = df.select(F.abs(finite(direct) - finite(component)).alias("gap")).filter("gap is not null")
    cumulative = cumulative_counts(gaps, "gap")
    rank = F.ceil(F.lit(quantile) * (F.col("n_total") - 1)) + 1
    found = cumulative.agg(
        F.min(F.when(F.col("cum") >= rank, F.col("gap"))).alias("threshold_c"),
        F.coalesce(F.max("n_total"), F.lit(0)).cast("bigint").alias("n_pairs"),
    )
    return found.withColumn("enough_pairs", F.col("n_pairs") >= minimum_pairs)
