"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams (1 to 3) of the whole text, lower case, every run of other characters than letters as one
space. Document frequencies are counted over all training rows in one scan. The weights are fitted by follow-the-regularised-leader
(per-coordinate steps, L1 and L2 penalties, so most weights are exactly zero) on at most ``max_train`` labelled rows, those with the
smallest hash of their id, and for each label the first ``per_label`` rows in that order, so a rare language is learned however large
the table is. Every fifth row of a label calibrates the one temperature. Prediction is a scan: every whole text, any size.

Bounds: the feature space (SLOTS counters) is of fixed size; the weights are SLOTS x languages. Labels are the distinct values among
all training rows with a letter.

Nulls and ties: a null text or one without a letter is ``und`` with score 0. A null label is not learned from. Equal scores go to
the first label in sorted order. Without any training row everything is ``und``. Repeated rows are predicted alike. Other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_batches, release, sketch_rows, sketch_sum, stored

SLOTS = 1 << 15
ORDERS = (1, 2, 3)
MAX_TRAIN = 4000
PER_LABEL = 50
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_map() -> np.ndarray:
    """For each code point itself if it is a letter, else the space."""
    if not _letters:
        code = np.arange(0x110000, dtype=np.uint32)
        letter = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)
        _letters.append(np.where(letter, code, 32).astype(np.uint32))
    return _letters[0]


def character_slots(text: str) -> np.ndarray:
    """Slots of all character n-grams of a text; empty if it has no letter."""
    code = letter_map()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = np.concatenate(([32], code[keep], [32])).astype(np.uint32)
    if (code == 32).all():
        return np.zeros(0, np.int64)
    out = []
    for n in ORDERS:
        mixed = np.zeros(len(code) - n + 1, np.uint32)
        for i in range(n):
            mixed = (mixed ^ code[i:i + len(mixed)]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        out.append((mixed + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(17))
    return np.concatenate(out).astype(np.int64)


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of a whole text, long ones piece by piece so that memory stays small."""
    total = np.zeros(SLOTS, np.int64)
    for a in range(0, len(text), 1 << 20):
        total += np.bincount(character_slots(text[a:a + (1 << 20)]), minlength=SLOTS)
    slot = np.flatnonzero(total)
    return slot, total[slot]


class Model(NamedTuple):
    labels: list[str]
    idf: np.ndarray       # per slot
    weight: np.ndarray    # slots x labels, float32
    bias: np.ndarray
    temperature: float


def vector(slot: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf[slot]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list, labels: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int):
    """FTRL-proximal weights and bias for rows of (slots, values, label index)."""
    z, n = np.zeros((SLOTS + 1, labels)), np.zeros((SLOTS + 1, labels))
    draw = np.random.default_rng(seed)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            slot, x, y = rows[i]
            at, x = np.append(slot, SLOTS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(SLOTS + 1))
    return w[:-1].astype(np.float32), w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on held-back rows, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(ids: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(ids.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, text: str = "text", ids: str = "doc_id", lang: str = "lang", max_train: int = MAX_TRAIN,
          per_label: int = PER_LABEL, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-4, epochs: int = 4, seed: int = 7) -> Model:
    spark = docs.sparkSession
    arrow_batches(spark)
    known = (docs.where(~held_out(F.col(ids)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
             .select(F.col(ids).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")))

    def frequencies(batches):
        counts = np.zeros(SLOTS * 2, np.uint64)  # second half: number of rows, in its first counter
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts[term_counts(value)[0]] += np.uint64(1)
                counts[SLOTS] += np.uint64(1)
        yield sketch_rows(counts)

    counted = sketch_sum(known.select("text").mapInArrow(frequencies, "part int, counts binary"), SLOTS * 2)
    rows_in_all = int(counted[SLOTS])
    idf = np.log((1.0 + rows_in_all) / (1.0 + counted[:SLOTS])) + 1.0
    hashed = known.withColumn("h", F.xxhash64("doc_id"))
    last = hashed.select("h").orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    # One number a language. The rank is cut before the shuffle, so a label of a third of all rows is no large group.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    lettered = hashed.where(F.col("text").rlike("\\p{L}")).select("lang", "h")
    first = {r.lang: r.h for r in lettered.withColumn("place", place).where(F.col("place") <= per_label).groupBy("lang").agg(F.max("h").alias("h")).collect()}

    def sample(batches):
        for batch in batches:
            order, texts, lang_ = (c.to_pylist() for c in batch.columns)
            found = [term_counts(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(order, pa.int64()), "slot": pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary()),
                "count": pa.array([np.minimum(c, 1 << 30).astype(np.int32).tobytes() for _, c in found], pa.binary()),
                "lang": pa.array(lang_, pa.string())})

    fitted = []
    if last is not None:
        own = F.lit(None).cast("long") if not first else F.create_map(*[F.lit(x) for pair in sorted(first.items()) for x in pair])[F.col("lang")]
        rows_of = stored(hashed.where((F.col("h") <= last) | F.coalesce(F.col("h") <= own, F.lit(False))).select("h", "text", "lang").mapInArrow(
            sample, "h long, slot binary, count binary, lang string"))
        general = rows_of.orderBy("h", "lang", "slot").limit(max_train)
        place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "slot"))
        by_label = rows_of.withColumn("place", place).where(F.col("place") <= per_label).drop("place")
        taken = {(r.h, r.lang, bytes(r.slot)): r for part in (general, by_label) for r in part.collect()}  # bounded by the two settings
        fitted = [taken[k] for k in sorted(taken) if k[2]]
        release(rows_of)
    labels = sorted({r.lang for r in fitted})
    rows = []
    for r in fitted:
        slot = np.frombuffer(bytes(r.slot), np.int32).astype(np.int64)
        rows.append((slot, vector(slot, np.frombuffer(bytes(r["count"]), np.int32), idf), labels.index(r.lang)))
    seen = Counter()
    fit_on, held_back = [], []
    for row in rows:
        seen[row[2]] += 1
        (fit_on if seen[row[2]] % 5 else held_back).append(row)
    weight, bias = (fit_ftrl(fit_on, len(labels), alpha, beta, l1, l2, epochs, seed) if rows
                    else (np.zeros((SLOTS, 0), np.float32), np.zeros(0)))
    logits = np.array([x @ weight[s] + bias for s, x, _ in held_back])
    return Model(labels, idf, weight, bias, calibrate(logits, np.array([y for *_, y in held_back], np.int64)))


def predict(docs: DataFrame, model: Model, text: str = "text", ids: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(tuple(model))
    rows = docs.select(F.col(ids).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), held_out(F.col(ids)).alias("held_out"))

    def score(batches):
        m = Model(*shared.value)
        for batch in batches:
            names, scores = [], []
            for value in batch.column(1).to_pylist():
                slot, count = term_counts(value) if value else (np.zeros(0, np.int64), None)
                if not len(slot) or not m.labels:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = softmax((vector(slot, count, m.idf) @ m.weight[slot] + m.bias) / m.temperature)
                names.append(m.labels[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(2),
                                              "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, text: str = "text", ids: str = "doc_id", lang: str = "lang", **settings) -> DataFrame:
    return predict(docs, train(docs, text, ids, lang, **settings), text, ids)
