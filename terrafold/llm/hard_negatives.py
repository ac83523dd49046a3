"""Hard-negative mining by rotated one-bit codes with a deterministic residual interval.

Component x becomes the integer floor(256 x); the score of two rows is the inner product of these. Anchors are the rows whose id is
divisible by ``every``. An anchor's positives are its ``positives`` best rows of the same label. For each of them the
``negatives`` best rows of other labels with a score between ``low`` percent of the positive's score and all of it are returned.

1. Codes, written once. A vector v is turned by a fixed random rotation, R v; its code holds the signs of R v, which stand for the unit
   vector c = sign / sqrt(D). Stored with it are the alignment a = <R v, c> and the norm r of the residual R v - a c.
2. Rows are packed into blocks of ``rows_per_block``, anchors into blocks of at most ``anchors_per_block``. An anchor R q
   is rounded to ``PLANES`` bits a dimension, kept as bit planes, so that <R q, c> is a sum of popcounts of planes and code, off by at most the
   norm of the rounding residual (Cauchy-Schwarz, as c has norm 1). With t in that range,
   <q, v> = a t + <R q - t c, R v - a c> lies within a t -+ r sqrt(|q|^2 - t^2), by Cauchy-Schwarz again.
   These bounds always hold; so what an interval rules out can't be a result, and the results are exact.
3. Each pair of blocks meets in a task: every row block passes every anchor block, which is broadcast in rounds of bounded
   size (``ROUND_BYTES``) and joined by block number, so no row is shuffled. A pair is scored in integers if its interval passes the bounds of the
   label, the score range and the worst of the best rows found so far in the task. Only these best few are kept and sent on.
4. First all rows give the positives. Their scores, written and packed with the anchors' blocks, are the ranges of the second pass.

Not taking part: rows with a null label, a null or empty vector, null or non-finite components, or another length than the most
frequent one. A null id comes last in ties, is no anchor and not divisible by anything. Rows of the anchor's own id are neither its positives nor its
negatives. Repeated rows are rows of their own: they count as often as they occur, and a repeated anchor returns its rows again. Scaled
components beyond 2^62 / D in square are held there (2^28 for 64 dimensions). A negative positive score has no negatives.
An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_batches, id_value, stored
from .vectors import dimension, matrix, usable

SCALE, EVERY = 256, 100
POSITIVES = NEGATIVES = 5
LOW_PERCENT = 80
#: Bits of a rounded anchor component.
PLANES = 6
ROWS, ANCHORS = 2048, 256
#: Anchor blocks that one round broadcasts.
ROUND_BYTES = 32 << 20
#: Pairs scored at once, and bytes of the vectors of a block of rows (wide vectors make smaller blocks).
PAIRS, BLOCK_BYTES = 1 << 14, 4 << 20
LAST = np.iinfo(np.int64).max

BLOCK = "n int, ids binary, labels binary, values binary, codes binary, align binary, residual binary"
ANCHOR_BLOCK = "block int, keys binary, ids binary, labels binary, values binary"


class Rows(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray    # integers, one row a vector
    codes: np.ndarray     # packed signs of the rotated vector
    align: np.ndarray
    residual: np.ndarray


class Anchors(NamedTuple):
    keys: np.ndarray      # of the anchors, unlike any other row's
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    planes: np.ndarray    # (anchor, plane, words of bits)
    low: np.ndarray       # value of a component whose planes are 0
    step: np.ndarray      # worth of the lowest plane
    off: np.ndarray       # norm of what the rounding leaves
    norm: np.ndarray


def rotation(width: int, seed: int = 13) -> np.ndarray:
    """A random rotation, the same in every run."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def integers(values: np.ndarray) -> np.ndarray:
    most = float(int((2 ** 62 / max(1, values.shape[1])) ** 0.5))
    return np.clip(np.floor(values * SCALE), -most, most).astype(np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words."""
    pad = -bits.shape[-1] % 64
    whole = np.concatenate((bits, np.zeros((*bits.shape[:-1], pad), bool)), -1)
    return np.packbits(whole, -1, bitorder="little").view("<u8")


def coded(values: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignment, residual norm) of integer vectors; the norm is rounded up."""
    turned = values @ turn.T
    align = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    residual = np.sqrt(np.maximum((turned * turned).sum(1) - align * align, 0))
    return packed(turned > 0), align, residual * (1 + 1e-9) + 1e-6


def rounded(values: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(planes, low, step, off, norm) of anchors."""
    turned = values @ turn.T
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << PLANES) - 1), 1e-12)
    level = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, (1 << PLANES) - 1).astype(np.int64)
    off = np.linalg.norm(turned - low[:, None] - level * step[:, None], axis=1)
    planes = np.stack([packed(level >> j & 1 > 0) for j in range(PLANES)], 1)
    return planes, low, step, off * (1 + 1e-9) + 1e-6, np.linalg.norm(turned, axis=1) * (1 + 1e-9)


def intervals(anchors: Anchors, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores of all anchors with all rows, from popcounts of planes and codes."""
    width = rows.values.shape[1]
    ones = np.bitwise_count(rows.codes).sum(1).astype(float)
    weighted = np.zeros((len(anchors.ids), len(rows.ids)))  # sum of levels where the sign is positive
    level_sum = np.zeros(len(anchors.ids))
    for j in range(anchors.planes.shape[1]):
        for w in range(rows.codes.shape[1]):
            weighted += np.bitwise_count(anchors.planes[:, j, w][:, None] & rows.codes[:, w][None]).astype(float) * (1 << j)
        level_sum += np.bitwise_count(anchors.planes[:, j]).sum(1) * float(1 << j)
    signed = anchors.low[:, None] * (2 * ones - width)[None] + anchors.step[:, None] * (2 * weighted - level_sum[:, None])
    t = signed / np.sqrt(width)
    off = anchors.off[:, None]
    norm = anchors.norm[:, None]
    closest = np.where(np.abs(t) <= off, 0.0, np.abs(t) - off)
    spread = rows.residual[None] * np.sqrt(np.maximum(norm * norm - closest * closest, 0)) + rows.align[None] * off
    spread += 1e-9 * (norm * (rows.align + rows.residual)[None] + 1)
    middle = rows.align[None] * t
    return middle - spread, middle + spread


def scores(anchors: Anchors, rows: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs, some at a time."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), PAIRS):
        b = slice(a, a + PAIRS)
        out[b] = np.einsum("ij,ij->i", anchors.values[i[b]], rows.values[j[b]])
    return out


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, few: int) -> np.ndarray:
    """Positions of the first ``few`` of each group by falling score, then id."""
    order = np.lexsort((ids, -score, group))
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return order[place < few]


class Ranges(NamedTuple):
    """Score ranges asked for, at most ``slots`` an anchor; those not used are empty (low above high)."""
    same: bool            # rows of the anchor's label, or of others
    low: np.ndarray       # (anchor, slot)
    high: np.ndarray


class Best:
    """The best rows of each range of a block's anchors that a task has met so far."""

    def __init__(self, anchors: Anchors, ranges: Ranges, few: int):
        self.anchors, self.ranges, self.few = anchors, ranges, few
        self.group = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.worst = np.full(ranges.low.shape, -np.inf)  # a row below it has no chance; at it, the smaller id wins

    def meet(self, rows: Rows) -> None:
        anchors, ranges, slots = self.anchors, self.ranges, self.ranges.low.shape[1]
        lower, upper = intervals(anchors, rows)
        asked = (anchors.labels[:, None] == rows.labels[None]) == ranges.same
        asked &= anchors.ids[:, None] != rows.ids[None]
        chance = np.zeros(asked.shape, bool)
        for s in range(slots):
            least = np.maximum(ranges.low[:, s], self.worst[:, s])[:, None]
            chance |= (upper >= least) & (lower <= ranges.high[:, s][:, None])
        i, j = np.nonzero(asked & chance)
        if not len(i):
            return
        score = scores(anchors, rows, i, j)
        group, found, ids = [self.group], [self.score], [self.ids]
        for s in range(slots):
            keep = (score >= ranges.low[i, s]) & (score <= ranges.high[i, s]) & (score >= self.worst[i, s])
            group.append(i[keep] * slots + s)
            found.append(score[keep])
            ids.append(rows.ids[j[keep]])
        group, found, ids = map(np.concatenate, (group, found, ids))
        keep = best(group, found, ids, self.few)
        self.group, self.score, self.ids = group[keep], found[keep], ids[keep]
        full = np.flatnonzero(np.bincount(self.group, minlength=self.worst.size) >= self.few)
        last = np.searchsorted(self.group, full, "right") - 1  # groups are in order, and their worst row comes last
        self.worst.ravel()[full] = self.score[last]

    def found(self) -> pa.RecordBatch:
        slots = self.ranges.low.shape[1]
        return pa.RecordBatch.from_pydict({
            "anchor_key": pa.array(self.anchors.keys[self.group // slots]), "slot": pa.array((self.group % slots).astype(np.int32)),
            "score": pa.array(self.score), "row_id": pa.array(self.ids)})


def row_blocks(rows: DataFrame, width: int, turn, size: int) -> DataFrame:
    """Rows of (vec_id, label, vector) packed by ``size``, with their codes. ``turn`` is a broadcast."""
    def pack(ids, labels, values):
        codes, align, residual = coded(values.astype(float), turn.value)
        parts = (ids, labels, values, codes, align, residual)
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)],
                                          ["n", "ids", "labels", "values", "codes", "align", "residual"])

    def read(batches):
        yield from (pack(*x) for x in portions(batches, width, size))

    return rows.mapInArrow(read, BLOCK)


def portions(batches, width: int, size: int):
    """(ids, labels, integer vectors) of ``size`` rows each, the last of fewer."""
    held: list[tuple] = []
    for batch in batches:
        if batch.num_rows:
            held.append((id_value(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), integers(matrix(batch.column(2), width))))
        while sum(len(x[0]) for x in held) >= size:
            whole = [np.concatenate(x) for x in zip(*held)]
            yield tuple(x[:size] for x in whole)
            held = [tuple(x[size:] for x in whole)]
    if sum(len(x[0]) for x in held):
        yield tuple(np.concatenate(x) for x in zip(*held))


def anchor_blocks(anchors: DataFrame, width: int, size: int) -> tuple[DataFrame, int]:
    """(the anchors, dealt out evenly and packed by ``size``; the number of blocks). A block's number is its partition's."""
    n = anchors.count()
    count = max(1, -(-n // size))

    def read(batches):
        block, at = TaskContext.get().partitionId(), 0
        for ids, labels, values in portions(batches, width, size):
            keys = (np.int64(block) << np.int64(32)) + np.arange(at, at + len(ids))
            at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, ids, labels, values))],
                                             ["block", "keys", "ids", "labels", "values"])

    return stored(anchors.repartition(count).mapInArrow(read, ANCHOR_BLOCK)), count


def passed(blocks: DataFrame, asked: DataFrame, count: int, width: int, turn, same: bool, few: int, slots: int, size: int) -> DataFrame:
    """(anchor_key, slot, score, row_id): each task's best rows. ``asked``: anchor blocks with lows and highs of their ranges."""
    columns = ["keys", "ids", "labels", "values", "lows", "highs"]

    def read(batches):
        kept: dict[bytes, Best] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows = rows_of(row[:6], width)
                if row[6] not in kept:
                    kept[row[6]] = Best(anchors_of(row[6:10], width, turn.value), Ranges(same, *(np.frombuffer(x, np.int64).reshape(-1, slots) for x in row[10:])), few)
                kept[row[6]].meet(rows)
        for state in kept.values():
            yield state.found()

    a_block = size * (width * 8 + 8 * (3 + 2 * slots))
    per_round = max(1, ROUND_BYTES // a_block)
    out = None
    for first in range(0, count, per_round):
        last = min(count, first + per_round) - 1
        part = asked.where(F.col("block").between(first, last))  # at most ROUND_BYTES
        met = (blocks.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(F.broadcast(part.withColumnsRenamed({c: f"a_{c}" for c in columns})), "block")
               .select("ids", "labels", "values", "codes", "align", "residual", *(f"a_{c}" for c in columns)))
        one = met.mapInArrow(read, "anchor_key long, slot int, score long, row_id long")
        if per_round < count:
            one = stored(one)  # round by round, so that one broadcast is held at a time
        out = one if out is None else out.union(one)
    return out


def rows_of(parts, width: int) -> Rows:
    ids, labels, values, codes, align, residual = parts
    n = len(ids) // 8
    return Rows(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(values, np.int64).reshape(n, width),
                np.frombuffer(codes, "<u8").reshape(n, -1), np.frombuffer(align), np.frombuffer(residual))


def anchors_of(parts, width: int, turn: np.ndarray) -> Anchors:
    keys, ids, labels = (np.frombuffer(x, np.int64) for x in parts[:3])
    values = np.frombuffer(parts[3], np.int64).reshape(-1, width)
    return Anchors(keys, ids, labels, values, *rounded(values.astype(float), turn))


def first_of(found: DataFrame, few: int) -> DataFrame:
    """The best ``few`` rows over all tasks, with their rank; a task has sent at most ``few`` of a range."""
    order = Window.partitionBy("anchor_key", "slot").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)


def with_ranges(anchors: DataFrame, chosen: DataFrame | None, slots: int, low_percent: int) -> DataFrame:
    """Anchor blocks with the lows and highs of their ranges: everything, or those of the positives' scores."""
    def open_(batches):
        for batch in batches:
            lows = [np.full(len(k) // 8 * slots, -LAST, np.int64).tobytes() for k in batch.column(1).to_pylist()]
            highs = [np.full(len(k) // 8 * slots, LAST, np.int64).tobytes() for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lows, pa.binary()), pa.array(highs, pa.binary())], [*batch.schema.names, "lows", "highs"])

    def of_positives(batches):
        for batch in batches:
            *own, lists = (c.to_pylist() for c in batch.columns)
            lows, highs = [], []
            for keys, found in zip(own[1], lists):
                ids = np.frombuffer(keys, np.int64)
                low, high = np.full((len(ids), slots), LAST), np.full((len(ids), slots), -LAST)
                for x in found or ():
                    at = int(np.searchsorted(ids, x["anchor_key"]))
                    if at < len(ids) and ids[at] == x["anchor_key"]:
                        low[at, x["rank"] - 1], high[at, x["rank"] - 1] = -(-low_percent * x["score"] // 100), x["score"]
                lows.append(low.tobytes())
                highs.append(high.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lows, pa.binary()), pa.array(highs, pa.binary())], [*batch.schema.names[:-1], "lows", "highs"])

    kind = f"{ANCHOR_BLOCK}, lows binary, highs binary"
    if chosen is None:
        return anchors.mapInArrow(open_, kind)
    lists = (chosen.groupBy(F.shiftright("anchor_key", 32).cast("int").alias("block"))  # at most a block's anchors times the slots
             .agg(F.collect_list(F.struct("anchor_key", "rank", "score")).alias("found")))
    return anchors.join(lists, "block", "left").mapInArrow(of_positives, kind)


def mine(embeddings: DataFrame, vector: str = "embedding", label: str = "label", ids: str = "vec_id", every: int = EVERY,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, rows_per_block: int = ROWS,
         anchors_per_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    arrow_batches(spark)
    rows = embeddings.select(F.col(ids).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    rows = usable(rows.where(F.col("label").isNotNull()), "vector")
    width = dimension(rows, "vector")
    if not width:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.where(F.size("vector") == width)
    rows_per_block, anchors_per_block = (max(1, min(x, BLOCK_BYTES // (8 * width))) for x in (rows_per_block, anchors_per_block))
    turn = spark.sparkContext.broadcast(rotation(width))
    blocks = stored(row_blocks(rows, width, turn, rows_per_block))
    anchors, count = anchor_blocks(rows.where(F.col("vec_id") % every == 0), width, anchors_per_block)
    first = passed(blocks, with_ranges(anchors, None, 1, low_percent), count, width, turn, True, positives, 1, anchors_per_block)
    chosen = stored(first_of(first, positives).select("anchor_key", "rank", "score", F.col("row_id").alias("positive")))
    asked = stored(with_ranges(anchors, chosen, positives, low_percent))
    second = first_of(passed(blocks, asked, count, width, turn, False, negatives, positives, anchors_per_block), negatives)

    def names(batches):
        for batch in batches:
            for keys, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict({"anchor_key": pa.array(np.frombuffer(keys, np.int64)), "anchor_id": pa.array(np.frombuffer(own, np.int64))})

    named = anchors.select("keys", "ids").mapInArrow(names, "anchor_key long, anchor_id long")
    found = second.select("anchor_key", (F.col("slot") + 1).alias("at"), "rank", F.col("row_id").alias("negative"), F.col("score").alias("negative_score"))
    pairs = chosen.select("anchor_key", F.col("rank").alias("at"), "positive", F.col("score").alias("positive_score"))
    return (pairs.join(found, ["anchor_key", "at"]).join(named, "anchor_key")
            .select("anchor_id", known("positive").alias("positive_id"), "rank", known("negative").alias("negative_id"), "positive_score", "negative_score"))


def known(name: str):
    """An id; the largest long stands for null."""
    return F.when(F.col(name) != int(LAST), F.col(name))


def with_moved_labels(embeddings: DataFrame, label: str = "label", ids: str = "vec_id") -> DataFrame:
    """Where the id is divisible by 7, the label goes one up, and from 9 to 0."""
    return embeddings.withColumn(label, F.when(F.col(ids) % 7 == 0, ((F.col(label) + 1) % 10).cast("int")).otherwise(F.col(label)))
