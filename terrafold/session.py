"""Session-level helpers: the shared work folder and materialised intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup is hinted for broadcast only while its rows times their width stay under this bound.
BROADCAST_BYTES = 32 << 20

_owned: ContextVar[list[str] | None] = ContextVar("owned_intermediates", default=None)


class SharedFolderError(RuntimeError):
    """A cluster without a folder that all its machines share."""


def work_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A local session without either uses its warehouse folder; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = found.get() if found.isDefined() else None
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise SharedFolderError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = spark.conf.get("spark.sql.warehouse.dir")
    return configured.rstrip("/")


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Own the tables that ``materialise`` writes inside the block, and delete them at its end.

    Read or write the final result before the block ends: a lazy result still reads them.
    """
    token = _owned.set([])
    try:
        yield
    finally:
        paths = _owned.get() or []
        _owned.reset(token)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing reads any more."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("terrafold-"):
            _delete(df.sparkSession, folder)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a cache this survives the loss of executors, and the file sizes give the
    planner a true estimate for the join strategy.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new intermediate table in the shared folder, for tables written part by part."""
    path = f"{work_folder(spark)}/terrafold-{name}-{uuid.uuid4().hex}"
    owned = _owned.get()
    if owned is not None:
        owned.append(path)
    return path


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` to a materialised ``lookup`` with unique keys.

    The lookup's rows and the length of their JSON text are added up first, one small scan. Up to ``BROADCAST_BYTES``
    it is broadcast, so the big side is not shuffled; beyond that the join is a shuffled join whose hot keys
    adaptive execution splits.
    """
    if _text_bytes(lookup) <= BROADCAST_BYTES:
        lookup = F.broadcast(lookup)
    return rows.join(lookup, keys, how)


def _text_bytes(df: DataFrame) -> int:
    """Bytes of all rows as JSON, which names every field and so is no less than a row takes in memory."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.sum(F.octet_length("j"))).first()[0] or 0


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the wide expressions of this library profit from.

    HotSpot compiles no method above 8000 bytes of bytecode, and Spark by default keeps fused
    stages up to 65535. Rule tables and metric reports produce such stages; with this limit
    Spark evaluates them as many small compiled methods (2-3 times faster here).
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def concurrently(spark: SparkSession, tasks: Sequence[Callable], parallelism: int = 4) -> list:
    """Results of independent driver-side tasks whose Spark jobs may overlap.

    Fits on different folds leave executors idle between their short stages; a few of them
    at once fill the gaps. Tables that a task writes belong to the caller's ``intermediates``.
    """
    run = inheritable_thread_target(spark)(lambda task: task[0].run(task[1]))
    with ThreadPool(min(parallelism, max(1, len(tasks)))) as pool:
        return pool.map(run, [(copy_context(), task) for task in tasks], chunksize=1)
