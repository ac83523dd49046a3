"""Spark helpers of the operators: shared tables, count sketches, components, sessions."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder

#: Counters of a sketch. Its size is fixed, so it may be sent to every task (8 bytes a counter) whatever the corpus holds.
SKETCH = 1 << 20
#: Rows that one table of a sketch is cut into for the sum.
SKETCH_PARTS = 16


def arrow_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes as well as by rows, for long texts in small Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster's machines share; a cluster that names none is refused."""
    return f"{work_folder(spark)}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: later stages survive lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("llm-"):
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_value(ids: pa.Array) -> np.ndarray:
    """Integer ids; null counts as the largest and so comes last."""
    return ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def sketch_rows(counts: np.ndarray):
    """A task's counters as rows (part, counts), to be added up by ``sketch_sum``."""
    step = len(counts) // SKETCH_PARTS
    return pa.RecordBatch.from_pydict({
        "part": pa.array(range(SKETCH_PARTS), pa.int32()),
        "counts": pa.array([_pack(counts[i * step:(i + 1) * step]) for i in range(SKETCH_PARTS)], pa.binary()),
    })


def _pack(counts: np.ndarray) -> bytes:
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if int(counts.max(initial=0)) <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.uint64)


def sketch_sum(rows: DataFrame, size: int = SKETCH) -> np.ndarray:
    """Add up the sketches of all tasks. The result has ``size`` counters, however large the corpus is."""
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = _unpack(blob)
                total[part] = total[part] + counts if part in total else counts
        if total:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(list(total), pa.int32()),
                "counts": pa.array([_pack(c) for c in total.values()], pa.binary()),
            })

    summed = rows.repartition(SKETCH_PARTS, "part").mapInArrow(add, "part int, counts binary")
    out = np.zeros(size, np.uint64)
    step = size // SKETCH_PARTS
    for part, blob in summed.collect():  # SKETCH_PARTS parts of fixed size
        out[part * step:(part + 1) * step] += _unpack(bytes(blob))
    return out


def sketch_slot(value: np.ndarray, size: int = SKETCH) -> np.ndarray:
    return (value >> np.uint64(40)).astype(np.int64) & (size - 1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge table can reach.

    Alternating large-star and small-star steps: every step hangs nodes to the smallest neighbour they know, so chains
    shrink to stars in a logarithmic number of steps. Each step is one aggregation and one join on the node, combined
    on the map side, and its table is written to the shared folder. Only one number a step reaches the driver.
    """
    spark = edges.sparkSession
    now = stored(edges.where(F.col(a) != F.col(b))
                 .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    if now.isEmpty():
        return spark.createDataFrame([], f"node {dict(edges.dtypes)[a]}, component {dict(edges.dtypes)[a]}")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(below, "u").select("v", "m").where("v <> m").toDF("u", "v")
                 .union(below.select("u", F.col("m").alias("v"))).distinct())
        then = stored(small)
        # done when no node stands both above and below an edge and nothing changed
        left = then.select("v").join(then.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        many = then.groupBy("u").count().where("count > 1").limit(1).count()
        now = then
        if not left and not many:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


#: Bits of a membership bitmap (2 MB). Its size is fixed; a fuller one only lets more rows through to the exact join after it.
BITS = 1 << 24


def _bit(value: np.ndarray) -> np.ndarray:
    return (value.astype(np.uint64) >> np.uint64(17)).astype(np.int64) & (BITS - 1)


def bitmap(values: DataFrame) -> np.ndarray:
    """Packed bits of the hashes in the only column of ``values``, built in SKETCH_PARTS tasks of one fixed share each."""
    step = BITS // SKETCH_PARTS

    def fill(batches):
        shares: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _bit(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64))
            for part in np.unique(at // step).tolist():
                share = shares.setdefault(part, np.zeros(step, bool))
                share[at[at // step == part] - part * step] = True
        for part, share in shares.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(share).tobytes()], pa.binary())})

    def unite(batches):
        shares: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = np.frombuffer(blob, np.uint8)
                shares[part] = shares[part] | bits if part in shares else bits
        for part, bits in shares.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(BITS // 8, np.uint8)
    united = values.mapInArrow(fill, "part int, bits binary").repartition(SKETCH_PARTS, "part").mapInArrow(unite, "part int, bits binary")
    for part, bits in united.collect():  # one share of fixed size a part
        out[part * step // 8:(part + 1) * step // 8] = np.frombuffer(bytes(bits), np.uint8)
    return out


def id_hash(ids: np.ndarray) -> np.ndarray:
    """Spread integer ids, which may be consecutive, over the bits of a bitmap."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """Bitmap of the integer ids in the only column."""
    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": pa.array(id_hash(id_value(batch.column(0))).view(np.int64))})

    return bitmap(ids.mapInArrow(hashed, "h long"))


def perhaps(ids: str, bits):
    """Column: whether a broadcast bitmap may hold the id. Only the id is sent to Python, not the row."""
    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, id_hash(x.fillna(np.iinfo(np.int64).max).to_numpy(np.int64))))

    return test(F.col(ids))


def in_bitmap(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = _bit(value)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
