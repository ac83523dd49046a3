"""Paired block bootstrap on per-block sufficient statistics.

A replicate needs only how often each block was drawn, so rows are reduced to one record
per block first. Draw ``j`` of replicate ``r`` is a slice of a SHA-256 digest, hence the
result does not depend on partitioning and any SQL engine can repeat it. The law is that
of the usual bootstrap: ``n_blocks`` independent uniform draws with replacement.

No draw is a row. The sums of up to ``RANGE`` blocks are packed into one record; it goes to every chunk of
replicates, where the draws are made as arrays, counted, and multiplied with the sums. Above a million blocks the draws
of a replicate are still made once: their counts are cut into slices of neighbouring blocks and meet the sums of their
slice, so the work grows with the blocks. Only above ``HELD`` blocks are draws made again, once for every further ``HELD``,
which keeps a task's memory fixed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import finite
from ..session import materialise
from .order_stats import dense_index

DRAWS_PER_DIGEST = 4
#: Blocks whose sums are in a task at once, and digests made at once.
RANGE, DIGESTS = 1 << 20, 1 << 16
#: Blocks of a slice of counts, and blocks that a task counts at once, four bytes each.
SLICE, HELD = 1 << 15, 1 << 26
#: Replicates of a task.
CHUNK = 32
METRICS = ("mae", "rmse")
WEIGHTINGS = ("observation_weighted", "block_balanced")
SUMS = ("n", "model_abs", "base_abs", "model_sq", "base_sq")
GAINS = tuple(f"gain_{m}" for m in METRICS)


def block_statistics(
    df: DataFrame, truth: str, model: str, baseline: str, block: Sequence[str]
) -> DataFrame:
    """Per block: rows and sums of absolute and squared errors of both predictions.

    Rows with a missing number or a missing block part are left out.
    """
    t, m, b = finite(truth), finite(model), finite(baseline)
    usable = t.isNotNull() & m.isNotNull() & b.isNotNull()
    for c in block:
        usable = usable & F.col(c).isNotNull()
    rows = df.filter(usable)
    return rows.groupBy(*block).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(m - t)).alias("model_abs"), F.sum(F.abs(b - t)).alias("base_abs"),
        F.sum((m - t) * (m - t)).alias("model_sq"), F.sum((b - t) * (b - t)).alias("base_sq"),
    )


def indexed_blocks(blocks: DataFrame, block: Sequence[str]) -> DataFrame:
    """Blocks numbered from zero in key order, materialised."""
    keyed = blocks.withColumn("block_key", F.concat_ws("|", *[F.col(c).cast("string") for c in block]))
    keyed = materialise(keyed.drop(*block), "blocks")
    return materialise(keyed.join(dense_index(keyed, "block_key"), "block_key"), "blocks")


def positions(seed: int, replicate: int, first: int, last: int, n_blocks: int) -> np.ndarray:
    """Positions drawn by the digests ``first`` to ``last - 1`` of a replicate, four a digest: 15 hexadecimal digits each."""
    stem = f"{seed}|{replicate}|".encode()
    words = np.frombuffer(b"".join(sha256(stem + b"%d" % j).digest() for j in range(first, last)), ">u8").astype(np.uint64).reshape(-1, 4)

    def bits(word: int, kept: int, after: int) -> np.ndarray:
        """The last ``kept`` bits of a word and the first ``after`` of the next."""
        low = words[:, word] & np.uint64((1 << kept) - 1)
        return (low << np.uint64(after)) | (words[:, word + 1] >> np.uint64(64 - after)) if after else low

    values = np.stack([words[:, 0] >> np.uint64(4), bits(0, 4, 56), bits(1, 8, 52), bits(2, 12, 48)], 1)
    return (values.ravel() % np.uint64(n_blocks)).astype(np.int64)


def packed_ranges(blocks: DataFrame, size: int = RANGE) -> DataFrame:
    """``(range, sums)``: the sums of neighbouring blocks in order of position, 7 numbers a block."""
    numbered = blocks.select((F.col("position") / size).cast("bigint").alias("range"), "position",
                             *[F.col(c).cast("double").alias(c) for c in SUMS],
                             *[(_loss(m, "base", F.col("n")) - _loss(m, "model", F.col("n"))).alias(g) for m, g in zip(METRICS, GAINS)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            ranges = batch.column(0).to_numpy()
            table = np.column_stack([batch.column(i).to_numpy() for i in range(2, batch.num_columns)])
            for r in np.unique(ranges).tolist():
                if at not in (None, r):
                    yield one(at, held)
                    held = []
                at = r
                held.append(table[ranges == r])
        if held:
            yield one(at, held)

    def one(r: int, held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int64()), "sums": pa.array([np.concatenate(held).tobytes()], pa.binary())})

    return (numbered.repartition("range").sortWithinPartitions("range", "position").mapInArrow(pack, "range bigint, sums binary"))


def replicate_sums(blocks: DataFrame, n_blocks: int, replicates: int, seed: int, size: int = RANGE) -> DataFrame:
    """``(replicate, sums, gains)``: totals over the blocks that each replicate draws; above ``size`` blocks by slices."""
    drawn = _drawn_whole(blocks, n_blocks, replicates, seed) if n_blocks <= size else _drawn_in_slices(blocks, n_blocks, replicates, seed, min(SLICE, size))
    return drawn.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in (*SUMS, *GAINS)])


TOTALS = "replicate bigint, " + ", ".join(f"{c} double" for c in (*SUMS, *GAINS))


def _totals(replicates: Sequence[int], totals: Sequence[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(replicates), pa.int64()), *(pa.array(c) for c in np.array(totals).T)], ["replicate", *SUMS, *GAINS])


def draws(seed: int, replicate: int, n_blocks: int) -> Iterator[np.ndarray]:
    """The positions that a replicate draws, ``DIGESTS`` digests at a time."""
    digests = -(-n_blocks // DRAWS_PER_DIGEST)
    for first in range(0, digests, DIGESTS):
        yield positions(seed, replicate, first, min(digests, first + DIGESTS), n_blocks)[: n_blocks - first * DRAWS_PER_DIGEST]


def _drawn_whole(blocks: DataFrame, n_blocks: int, replicates: int, seed: int) -> DataFrame:
    """Totals of every replicate, made where the sums of all blocks are one record."""
    width = len(SUMS) + len(GAINS)
    chunks = -(-replicates // CHUNK)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, chunk in zip(*(batch.column(c).to_pylist() for c in ("sums", "chunk"))):
                sums = np.frombuffer(blob).reshape(-1, width)
                mine = range(chunk * CHUNK, min(replicates, (chunk + 1) * CHUNK))
                totals = []
                for replicate in mine:
                    count = np.zeros(len(sums), np.int64)
                    for found in draws(seed, replicate, n_blocks):
                        count += np.bincount(found, minlength=len(sums))
                    totals.append(count @ sums)
                yield _totals(mine, totals)

    spread = (packed_ranges(blocks, n_blocks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
              .repartition(max(blocks.sparkSession.sparkContext.defaultParallelism, chunks), "range", "chunk"))
    return spread.mapInArrow(draw, TOTALS)


def _drawn_in_slices(blocks: DataFrame, n_blocks: int, replicates: int, seed: int, size: int, held: int = HELD) -> DataFrame:
    """Totals of every replicate and slice of ``size`` blocks: counts of the draws, made once, meet the sums of their slice."""
    width = len(SUMS) + len(GAINS)
    slices, window = -(-n_blocks // size), -(-held // size) * size
    windows = -(-n_blocks // window)
    spark = blocks.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                replicate, low = task // windows, task % windows * window
                counts = np.zeros(min(window, n_blocks - low), np.int32)
                for found in draws(seed, replicate, n_blocks):
                    if windows > 1:
                        found = found[(found >= low) & (found < low + window)] - low
                    np.add.at(counts, found, np.int32(1))
                for first in range(0, len(counts), size * 256):
                    parts = [counts[at:at + size] for at in range(first, min(len(counts), first + size * 256), size)]
                    start = (low + first) // size
                    yield pa.RecordBatch.from_pydict({
                        "range": pa.array(range(start, start + len(parts)), pa.int64()), "replicate": pa.array([replicate] * len(parts), pa.int64()),
                        "data": pa.array([packed(p) for p in parts], pa.binary())})

    def packed(counts: np.ndarray) -> bytes:
        """Counts in as few bytes each as the largest needs; nearly all are 0 to 3, so by Huffman code they take two bits."""
        coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
        return coder.compress(counts.astype(np.min_scalar_type(counts.max())).tobytes()) + coder.flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for batch in batches:
            mine, totals = [], []
            for r, replicate, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if replicate < 0:
                    at, sums = r, np.frombuffer(blob).reshape(-1, width)
                    continue
                if r != at:
                    raise ValueError(f"no sums of slice {r}")
                data = zlib.decompress(blob)
                mine.append(replicate)
                totals.append(np.frombuffer(data, f"u{len(data) // len(sums)}").astype(float) @ sums)
            if mine:
                yield _totals(mine, totals)

    tasks = spark.range(0, replicates * windows, 1, max(spark.sparkContext.defaultParallelism, replicates * windows // 4))
    counted = tasks.mapInArrow(count, "range bigint, replicate bigint, data binary")
    own = packed_ranges(blocks, size).select("range", F.lit(-1).cast("bigint").alias("replicate"), F.col("sums").alias("data"))
    together = own.unionAll(counted).repartition(min(20_000, slices), "range").sortWithinPartitions("range", "replicate")
    return together.mapInArrow(add, TOTALS)


def _loss(metric: str, sums: str, n) -> Column:
    if metric == "mae":
        return F.col(f"{sums}_abs") / n
    return F.sqrt(F.col(f"{sums}_sq") / n)


def improvement_samples(sums: DataFrame, n_blocks: int, metric: str, weighting: str) -> DataFrame:
    """``(replicate, improvement)`` of the model over the baseline, from ``replicate_sums``."""
    if weighting == "block_balanced":
        return sums.select("replicate", (F.col(f"gain_{metric}") / n_blocks).alias("improvement"))
    return sums.select("replicate", (_loss(metric, "base", F.col("n")) - _loss(metric, "model", F.col("n"))).alias("improvement"))


def point_improvement(blocks: DataFrame, metric: str, weighting: str) -> DataFrame:
    if weighting == "block_balanced":
        gain = _loss(metric, "base", F.col("n")) - _loss(metric, "model", F.col("n"))
        sums = blocks.agg(F.avg(gain).alias("point"), F.sum("n").alias("n_observations"),
                          F.count(F.lit(1)).alias("n_blocks"))
        return sums
    sums = blocks.agg(
        *[F.sum(c).alias(c) for c in ("n", "model_abs", "base_abs", "model_sq", "base_sq")],
        F.count(F.lit(1)).alias("n_blocks"),
    )
    return sums.select(
        (_loss(metric, "base", F.col("n")) - _loss(metric, "model", F.col("n"))).alias("point"),
        F.col("n").alias("n_observations"), "n_blocks",
    )


def block_bootstraps(
    df: DataFrame,
    truth: str,
    model: str,
    baseline: str,
    block: Sequence[str],
    kinds: Sequence[tuple[str, str]],
    replicates: int = 2000,
    confidence: float = 0.95,
    seed: int = 2026,
) -> dict[tuple[str, str], DataFrame]:
    """One row for each (metric, weighting) of ``kinds``; all of them share one pass over the rows and the same draws."""
    if any(metric not in METRICS or weighting not in WEIGHTINGS for metric, weighting in kinds):
        raise ValueError("unknown metric or weighting")
    if replicates <= 0 or not 0.0 < confidence < 1.0:
        raise ValueError("replicates must be positive and confidence inside (0, 1)")
    blocks = indexed_blocks(block_statistics(df, truth, model, baseline, block), block)
    n_blocks = blocks.count()
    if n_blocks < 2:
        raise ValueError("at least two non-empty blocks are needed")
    sums = replicate_sums(blocks, n_blocks, replicates, seed)
    if len(kinds) > 1:
        sums = materialise(sums, "replicates")
    tail = (1.0 - confidence) / 2.0

    def report(metric: str, weighting: str) -> DataFrame:
        # ``percentile`` is exact and holds one number per replicate.
        interval = improvement_samples(sums, n_blocks, metric, weighting).agg(
            F.percentile("improvement", F.lit(tail)).alias("lower"),
            F.percentile("improvement", F.lit(1.0 - tail)).alias("upper"),
            F.count(F.lit(1)).alias("n_bootstrap"),
        )
        one = F.lit(1).alias("one")
        joined = point_improvement(blocks, metric, weighting).select("*", one).join(interval.select("*", one), "one")
        return joined.select(
            F.lit(metric).alias("metric"), F.lit(weighting).alias("weighting"), "point", "lower", "upper",
            F.lit(confidence).alias("confidence"), "n_bootstrap",
            F.col("n_observations").cast("bigint"), "n_blocks", F.lit(seed).alias("seed"),
        )

    return {kind: report(*kind) for kind in kinds}


def block_bootstrap(
    df: DataFrame,
    truth: str,
    model: str,
    baseline: str,
    block: Sequence[str],
    metric: str = "mae",
    weighting: str = "observation_weighted",
    replicates: int = 2000,
    confidence: float = 0.95,
    seed: int = 2026,
) -> DataFrame:
    """One row: point improvement with its percentile interval; positive favours the model."""
    kind = (metric, weighting)
    return block_bootstraps(df, truth, model, baseline, block, [kind], replicates, confidence, seed)[kind]
