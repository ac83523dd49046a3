"""Dual-blocked folds in space and time with embargo.

Rows are reduced once to *cells*: distinct (block, date, event) with their row counts. Fold
assignment, pairing, held keys and the part of every cell are computed on cells, and rows
meet the result in one lookup join. ``partition`` columns (for instance the outer fold) let
all inner splits run in the same jobs.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import day_text, is_blank, stable_hash, time_group
from ..session import join_lookup, materialise, new_folder

INNER_SEED_OFFSET = 10_007
#: Rows that a row of a table stands for, where it has been summed up by its keys.
COUNTED = "rows_counted"


class SplitError(ValueError):
    """A split cannot be formed or breaks an invariant."""


@dataclass(frozen=True)
class SplitDesign:
    """Columns, counts and seed of a dual-blocked split."""

    n_folds: int = 5
    seed: int = 0
    embargo_days: int = 0
    id_column: str = "sample_id"
    block_column: str = "spatial_block_id"
    date_column: str = "date"
    event_column: str | None = "weather_event_id"

    def __post_init__(self) -> None:
        if self.n_folds < 2:
            raise ValueError("at least two folds are needed")
        if self.embargo_days < 0:
            raise ValueError("the embargo cannot be negative")

    def inner(self, n_folds: int) -> SplitDesign:
        """Design of the splits inside a training part."""
        return SplitDesign(
            n_folds, self.seed + INNER_SEED_OFFSET, self.embargo_days, self.id_column,
            self.block_column, self.date_column, self.event_column,
        )

    def time_salt(self, df: DataFrame) -> str:
        return "weather_event" if self.event_column and self.event_column in df.columns else "date"


# ---------------------------------------------------------------- balanced group assignment


def greedy_folds(rows: Sequence[int], totals: Sequence[int]) -> list[int]:
    """Fold of each group in order: the first groups take the folds in turn, each later one
    goes to the fold with the smallest row total, ties to the lowest fold.

    ``totals`` are the fold sizes reached before the first of these groups.
    """
    heap = [(int(t), f) for f, t in enumerate(totals) if t > 0]
    heapq.heapify(heap)
    chosen = []
    for n in rows:
        total, fold = (0, len(heap)) if len(heap) < len(totals) else heapq.heappop(heap)
        heapq.heappush(heap, (total + int(n), fold))
        chosen.append(fold)
    return chosen


def assign_groups(
    groups: DataFrame,
    n_folds: int,
    seed: int,
    salt: str,
    partition: Sequence[str] = (),
    max_groups_per_task: int = 1_000_000,
) -> DataFrame:
    """``(partition, group, fold)`` from ``(partition, group, rows)``, one record per group.

    The rule depends on the order of groups, so it runs over the *group* table only. That
    table is cut along the hash order into chunks of bounded size, written one folder a chunk. Each
    chunk is read and assigned once; the fold totals that enter it are the only state carried on.
    """
    partition = list(partition)
    hashed = groups.filter(~is_blank("group")).withColumn("h", stable_hash("group", seed, salt))
    sizes = groups.groupBy(*partition).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_blank("group")).alias("blank")
    ).collect()
    for s in sizes:
        if s["blank"]:
            raise SplitError(f"{salt} groups contain missing or blank values")
        if s["n"] < n_folds:
            raise SplitError(f"need {n_folds} distinct {salt} groups, found {s['n']}")
    if not sizes or not sizes[0]["n"]:
        raise SplitError(f"no {salt} groups")
    largest = max(s["n"] for s in sizes)
    n_chunks = max(1, -(-largest // max_groups_per_task))
    # The first 12 hex digits are uniform, so equal ranges of them hold equally many groups.
    place = F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    chunked = hashed.withColumn("chunk", F.floor(place * n_chunks).cast("int"))
    keys = [*partition, "chunk"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunked.select(*keys, "group", "rows", "h").schema)

    def run(table: DataFrame, start: dict[tuple, list[int]]) -> DataFrame:
        def one_chunk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ordered = pdf.sort_values("h", kind="stable")
            return ordered.assign(fold=greedy_folds(ordered["rows"], start[tuple(int(k) for k in key)]))

        return table.select(*keys, "group", "rows", "h").groupBy(*keys).applyInPandas(one_chunk, f"{fields}, fold int")

    names = [tuple(s[p] for p in partition) for s in sizes]
    totals = {name: [0] * n_folds for name in names}
    if n_chunks == 1:
        return run(chunked, {(*name, 0): t for name, t in totals.items()}).select(*partition, "group", "fold")
    spark = groups.sparkSession
    waiting, done = new_folder(spark, "chunks"), new_folder(spark, "folds")
    chunked.repartition(*keys).write.partitionBy("chunk").parquet(waiting)
    stored = spark.read.schema(chunked.schema).parquet(waiting)
    for c in range(n_chunks):
        assigned = run(stored.filter(F.col("chunk") == c), {(*name, c): t for name, t in totals.items()})
        part = f"{done}/chunk={c}"
        assigned.select(*partition, "group", "rows", "fold").write.parquet(part)
        gained = spark.read.schema(assigned.drop("chunk", "h").schema).parquet(part)
        for g in gained.groupBy(*partition, "fold").agg(F.sum("rows").alias("rows")).collect():  # one row a fold
            totals[tuple(g[p] for p in partition)][g["fold"]] += g["rows"]
    return spark.read.schema(assigned.drop("h").schema).parquet(done).select(*partition, "group", "fold")


def balanced_folds(df: DataFrame, group: str, n_folds: int, seed: int, salt: str) -> DataFrame:
    """Whole groups to folds, balancing rows: ``(group, rows, fold)``."""
    groups = df.groupBy(F.col(group).cast("string").alias("group")).agg(F.count(F.lit(1)).alias("rows"))
    groups = materialise(groups, "groups")
    return groups.join(assign_groups(groups, n_folds, seed, salt), "group")


# ------------------------------------------------------------------------------ the splitter


def cells_of(df: DataFrame, design: SplitDesign, partition: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Distinct (partition, block, day, event, time group) with row counts, materialised.

    Rows of ``df`` may stand for several: a column ``COUNTED`` then tells for how many.
    """
    has_event = design.event_column is not None and design.event_column in df.columns
    event = F.col(design.event_column).cast("string") if has_event else F.lit(None).cast("string")
    keyed = df.select(
        *partition,
        F.col(design.block_column).cast("string").alias("block"),
        day_text(design.date_column).alias("day"),
        F.when(~is_blank(event), event).alias("event"),
        time_group(design.date_column, event if has_event else None, prefix_dates=False).alias("time_key"),
        *extra,
        *([COUNTED] if COUNTED in df.columns else []),
    )
    names = [c for c in keyed.columns if c not in {"measure", COUNTED}]
    rows = F.sum(COUNTED) if COUNTED in keyed.columns else F.count(F.lit(1))
    measure = [F.max("measure").alias("measure")] if "measure" in keyed.columns else []
    cells = keyed.groupBy(*names).agg(rows.alias("rows"), *measure)
    return materialise(cells, "cells")


def pair_folds(counts: dict[tuple[int, int], int], n: int) -> tuple[int, ...]:
    """Time fold for each block fold: the largest smallest intersection, then the most even.

    ``counts`` has at most n x n entries. Every assignment is scored for at most eight folds, every shift of the
    identity for more; all of them at once, one row of an array each. The first of equals wins.
    """
    size = np.array([[counts.get((b, t), 0) for t in range(n)] for b in range(n)])
    every = list(itertools.permutations(range(n))) if n <= 8 else np.add.outer(np.arange(n), np.arange(n)) % n
    assignment = np.asarray(every)
    rows = size[np.arange(n), assignment]
    least, spread = rows.min(axis=1), np.ptp(rows, axis=1)
    best = int(np.lexsort((*rows.T[::-1], spread, -least))[0])
    if least[best] <= 0:
        raise SplitError("no non-empty intersection of block and time folds; reduce the fold count")
    return tuple(int(t) for t in assignment[best])


def contingency(cells: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Rows by (block fold, time fold)."""
    return cells.groupBy(*partition, "block_fold", "time_fold").agg(F.sum("rows").alias("rows"))


def folded_cells(cells: DataFrame, design: SplitDesign, salt: str, partition: Sequence[str] = ()) -> DataFrame:
    """Cells with ``block_fold``, ``time_fold`` and ``fold`` (null off the paired diagonal)."""
    partition = list(partition)
    by_block = cells.groupBy(*partition, F.col("block").alias("group")).agg(F.sum("rows").alias("rows"))
    by_time = cells.groupBy(*partition, F.col("time_key").alias("group")).agg(F.sum("rows").alias("rows"))
    blocks = materialise(
        assign_groups(by_block, design.n_folds, design.seed, "spatial_block", partition)
        .select(*partition, F.col("group").alias("block"), F.col("fold").alias("block_fold")), "blocks")
    times = materialise(
        assign_groups(by_time, design.n_folds, design.seed, salt, partition)
        .select(*partition, F.col("group").alias("time_key"), F.col("fold").alias("time_fold")), "times")
    both = join_lookup(join_lookup(cells, blocks, [*partition, "block"], "inner"), times, [*partition, "time_key"], "inner")
    table: dict[tuple, dict[tuple[int, int], int]] = {}
    for r in contingency(both, partition).collect():  # at most n x n rows per partition
        table.setdefault(tuple(r[p] for p in partition), {})[r["block_fold"], r["time_fold"]] = r["rows"]
    pairs = [
        (*name, f, t) for name, counts in table.items() for f, t in enumerate(pair_folds(counts, design.n_folds))
    ]
    kinds = ", ".join([f"{p} int" for p in partition] + ["block_fold int", "paired int"])
    paired = F.broadcast(cells.sparkSession.createDataFrame(pairs, kinds))
    return (
        both.join(paired, [*partition, "block_fold"])
        .withColumn("fold", F.when(F.col("time_fold") == F.col("paired"), F.col("block_fold")))
        .drop("paired")
    )


def held_keys(held: DataFrame, partition: Sequence[str], embargo_days: int = 0) -> DataFrame:
    """``(partition, key_type, key, folds)``: in which folds a block, day or event is held.

    At most one array entry per fold.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("key_type"), F.col(k).alias("key")) for k in ("block", "day", "event")])
    found = held.select(*partition, "fold", F.inline(entries)).filter("key is not null").distinct()
    if embargo_days:
        # A range of days becomes single days, so the embargo stays an equality join.
        near = F.transform(
            F.sequence(F.lit(-embargo_days), F.lit(embargo_days)),
            lambda shift: F.date_format(F.date_add(F.col("key").try_cast("date"), shift), "yyyy-MM-dd"),
        )
        days = found.filter("key_type = 'day'").withColumn("key", F.explode(near))
        found = found.filter("key_type <> 'day'").unionByName(days)
    return found.groupBy(*partition, "key_type", "key").agg(F.collect_set("fold").alias("folds"))


def cell_parts(cells: DataFrame, design: SplitDesign, partition: Sequence[str] = ()) -> DataFrame:
    """Cells with ``folds``: an array of (fold, part), part being validation, train, or
    embargo when a key is shared.

    ``cells`` carries ``fold`` (null where a cell validates nothing).
    """
    partition = list(partition)
    held = cells.filter("fold is not null").select(*partition, "block", "day", "event", "fold")
    keys = materialise(held_keys(held, partition, design.embargo_days), "held")
    out = cells
    for key in ("block", "day", "event"):
        of_type = keys.filter(F.col("key_type") == key).select(
            *partition, F.col("key").alias(key), F.col("folds").alias(f"{key}_folds"))
        out = join_lookup(out, of_type, [*partition, key])
    empty = F.array().cast("array<int>")
    restricted = F.array_union(
        F.coalesce("block_folds", empty), F.array_union(F.coalesce("day_folds", empty), F.coalesce("event_folds", empty))
    )
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(design.n_folds - 1)),
        lambda f: F.struct(
            f.alias("fold"),
            F.when(F.col("fold") == f, F.lit("validation"))
            .when(F.array_contains(F.col("restricted"), f), F.lit("embargo"))
            .otherwise(F.lit("train")).alias("part"),
        ),
    )
    names = [c for c in cells.columns if c not in {"fold", "block_fold", "time_fold"}]
    return out.withColumn("restricted", restricted).select(*names, parts.alias("folds"))


def require_parts(parts: DataFrame, n_folds: int, partition: Sequence[str] = ()) -> None:
    """Every fold needs training and validation rows."""
    counts = parts.select(*partition, "rows", F.inline("folds")).groupBy(*partition, "fold").agg(
        *[F.sum(F.when(F.col("part") == p, F.col("rows")).otherwise(0)).alias(p) for p in ("train", "validation")]
    )
    empty = counts.filter("train = 0 or validation = 0").collect()  # at most one row per fold
    if empty:
        raise SplitError(f"folds without training or validation rows: {[r.asDict() for r in empty]}")


def with_parts(
    df: DataFrame, parts: DataFrame, design: SplitDesign, partition: Sequence[str] = (), how: str = "inner"
) -> DataFrame:
    """``df`` with the ``folds`` array of its cell: one lookup join, no shuffle on the row id."""
    has_event = design.event_column is not None and design.event_column in df.columns
    event = F.col(design.event_column).cast("string") if has_event else F.lit(None).cast("string")
    keys = {
        "__block": F.col(design.block_column).cast("string"),
        "__day": day_text(design.date_column),
        "__event": F.when(~is_blank(event), event).otherwise(F.lit("")),
    }
    lookup = parts.select(
        *partition, F.col("block").alias("__block"), F.col("day").alias("__day"),
        F.coalesce("event", F.lit("")).alias("__event"), "folds",
    )
    return join_lookup(df.withColumns(keys), lookup, [*partition, *keys], how).drop(*keys)


def attach_parts(df: DataFrame, parts: DataFrame, design: SplitDesign, partition: Sequence[str] = ()) -> DataFrame:
    """Rows x folds: ``(id, partition, fold, part)`` from the materialised parts of their cells."""
    return with_parts(df, parts, design, partition).select(*partition, design.id_column, F.inline("folds"))


def validation_fold() -> Column:
    """The fold whose validation part holds the row, null if none does."""
    return F.try_element_at(F.filter("folds", lambda f: f["part"] == "validation"), F.lit(1))["fold"]


def split_with_embargo(df: DataFrame, design: SplitDesign, partition: Sequence[str] = ()) -> DataFrame:
    """Long fold table ``(partition, id, fold, part)``; part is train, validation or embargo.

    Validation is a block fold crossed with its paired time fold. A row that shares a block,
    day or event with the validation part, or lies within the embargo days, trains nowhere
    in that fold.
    """
    parts = dual_blocked_parts(df, design, partition)
    return attach_parts(df, parts, design, partition)


def dual_blocked_parts(df: DataFrame, design: SplitDesign, partition: Sequence[str] = ()) -> DataFrame:
    cells = cells_of(df, design, partition)
    if cells.filter("block is null or day is null").limit(1).count():
        raise SplitError("blocks and dates cannot be missing or unreadable")
    folded = folded_cells(cells, design, design.time_salt(df), partition)
    parts = materialise(cell_parts(folded, design, partition), "parts")
    require_parts(parts, design.n_folds, partition)
    return parts


def frozen_parts(df: DataFrame, design: SplitDesign, fold_column: str = "outer_fold") -> DataFrame:
    """Rebuild parts of cells from stored validation labels; a negative label holds nothing."""
    label = F.col(fold_column).try_cast("double")
    bad = df.filter(label.isNull() | (label != F.round(label))).limit(1).count()
    if bad:
        raise SplitError(f"{fold_column} values must be whole numbers")
    marked = df.withColumn("__fold", F.when(label >= 0, label.cast("int")))
    cells = cells_of(marked, design, ["__fold"]).withColumnRenamed("__fold", "fold")
    missing = set(range(design.n_folds)) - {
        r["fold"] for r in cells.select("fold").distinct().filter("fold is not null").collect()
    }
    if missing:
        raise SplitError(f"no validation rows for folds {sorted(missing)}")
    parts = materialise(cell_parts(cells.withColumn("label", F.coalesce("fold", F.lit(-1))), design), "parts")
    require_parts(parts, design.n_folds)
    return parts


def with_frozen_folds(df: DataFrame, design: SplitDesign, fold_column: str = "outer_fold") -> DataFrame:
    """``df`` with a ``folds`` array rebuilt from stored labels; its cells are joined once, not its ids."""
    parts = frozen_parts(df, design, fold_column)
    marked = df.withColumn("label", F.greatest(F.col(fold_column).cast("int"), F.lit(-1)))
    return with_parts(marked, parts, design, ["label"]).drop("label")


def frozen_folds(df: DataFrame, design: SplitDesign, fold_column: str = "outer_fold") -> DataFrame:
    """Long fold table from stored labels, as ``split_with_embargo`` gives it."""
    return with_frozen_folds(df, design, fold_column).select(design.id_column, F.inline("folds"))


def in_part(fold: int, part: str, folds: str = "folds") -> Column:
    """Whether the row belongs to a part of a fold, from its array."""
    return F.array_contains(folds, F.struct(F.lit(fold).alias("fold"), F.lit(part).alias("part")))


def nested_base(rows: DataFrame, design: SplitDesign) -> DataFrame:
    """A row for each outer fold that trains on the row of ``rows`` (which has its outer ``folds``): id, keys, outer_fold."""
    columns = [c for c in (design.id_column, COUNTED) if c in rows.columns] + [design.block_column, design.date_column]
    if design.event_column and design.event_column in rows.columns:
        columns.append(design.event_column)
    return rows.select(*columns, F.explode(F.filter("folds", lambda f: f["part"] == "train")["fold"]).alias("outer_fold"))


def nested_parts(rows: DataFrame, design: SplitDesign, inner_folds: int = 4) -> DataFrame:
    """Parts of the cells of every outer training part, by ``outer_fold``, in one pass."""
    return dual_blocked_parts(nested_base(rows, design), design.inner(inner_folds), ["outer_fold"])


def nested_folds(rows: DataFrame, design: SplitDesign, inner_folds: int = 4) -> DataFrame:
    """Inner splits of every outer training part: ``(outer_fold, id, fold, part)``; ``rows`` has its outer ``folds``."""
    return attach_parts(nested_base(rows, design), nested_parts(rows, design, inner_folds), design.inner(inner_folds), ["outer_fold"])


# -------------------------------------------------------------------------------- invariants


def shared_keys(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``(key_type, shared)``: distinct values of each key present on both sides.

    One scan of each side marks the values it holds; the marks combine before the shuffle, which carries keys and not rows.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("key_type"), F.col(c).cast("string").alias("v")) for n, c in keys.items()])

    def side(df: DataFrame, at_left: bool) -> DataFrame:
        return df.select(F.inline(entries)).filter(~is_blank("v")).select("*", F.lit(at_left).alias("l"), F.lit(not at_left).alias("r"))

    flags = side(left, True).unionByName(side(right, False)).groupBy("key_type", "v").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    named = left.sparkSession.createDataFrame([(n,) for n in keys], "key_type string")
    counts = flags.groupBy("key_type").agg(F.count_if(F.col("l") & F.col("r")).alias("shared"))
    return named.join(F.broadcast(counts), "key_type", "left").select("key_type", F.coalesce("shared", F.lit(0)).alias("shared"))


def fold_overlaps(df: DataFrame, folds: DataFrame, design: SplitDesign) -> DataFrame:
    """Leakage check per fold: blocks, dates and events on both the train and validation side."""
    has_event = design.event_column is not None and design.event_column in df.columns
    kinds = [("block", design.block_column), ("date", design.date_column)]
    if has_event:
        kinds.append(("event", design.event_column))
    sides = folds.filter("part <> 'embargo'").join(df.select(design.id_column, *[c for _, c in kinds]), design.id_column)
    entries = F.array(*[F.struct(F.lit(k).alias("key_type"), F.col(c).cast("string").alias("v")) for k, c in kinds])
    seen = (
        sides.select("fold", "part", F.inline(entries)).filter(~is_blank("v"))
        .groupBy("fold", "key_type", "v")
        .agg(F.max(F.col("part") == "train").alias("t"), F.max(F.col("part") == "validation").alias("h"))
    )
    return seen.groupBy("fold", "key_type").agg(F.count_if(F.col("t") & F.col("h")).alias("shared"))


def part_overlaps(parts: DataFrame) -> DataFrame:
    """The check of ``fold_overlaps`` on cells instead of rows."""
    entries = F.array(*[F.struct(F.lit(n).alias("key_type"), F.col(c).alias("v"))
                        for n, c in (("block", "block"), ("date", "day"), ("event", "event"))])
    sides = parts.select("block", "day", "event", F.inline("folds")).filter("part <> 'embargo'")
    seen = (
        sides.select("fold", "part", F.inline(entries)).filter("v is not null")
        .groupBy("fold", "key_type", "v")
        .agg(F.max(F.col("part") == "train").alias("t"), F.max(F.col("part") == "validation").alias("h"))
    )
    return seen.groupBy("fold", "key_type").agg(F.count_if(F.col("t") & F.col("h")).alias("shared"))


def require_disjoint(overlaps: DataFrame) -> DataFrame:
    bad = overlaps.filter("shared > 0").collect()  # one row per fold and key type at most
    if bad:
        raise SplitError(f"shared keys: {[r.asDict() for r in bad]}")
    return overlaps
