"""Order-independent table digests and their comparison.

Every row is hashed; slices of the row hashes are summed. The sums do not depend on order
or partitioning, combine before the shuffle, and never gather rows in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs as fs
from pyarrow import NativeFile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICES = 4
DIGITS = 15
PIECE_BYTES = 1 << 20
#: Above this a file is not handed over whole by Spark's binary reader, which ends at 2 GB.
READER_BYTES = 1 << 30


def _value_text(value: Column, kind: str) -> Column:
    """Text of a value that no session setting changes: instants are microseconds since the epoch."""
    if kind == "timestamp":
        return F.unix_micros(value).cast("string")
    return value.cast("string")


def row_text(columns: Sequence[str], types: Mapping[str, str] = {}) -> Column:  # noqa: B006
    """Unambiguous text of a row: each value with its length, a missing one as ``-``."""
    parts = []
    for c in sorted(columns):
        text = _value_text(F.col(c), types.get(c, ""))
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *parts)


def table_digest(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, n_rows, digest)``; equal for equal multisets of rows, whatever their order."""
    columns = list(columns or df.columns)
    hashed = df.select(*keys, F.sha2(row_text(columns, dict(df.dtypes)), 256).alias("h"))
    slices = [
        F.sum(F.conv(F.substring("h", 1 + i * DIGITS, DIGITS), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
        for i in range(SLICES)
    ]
    sums = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *slices)
    text = F.concat_ws("|", F.col("n_rows").cast("string"),
                       *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(SLICES)])
    return sums.select(*keys, "n_rows", F.sha2(text, 256).alias("digest"))


def file_digests(spark: SparkSession, path: str, reader_bytes: int = READER_BYTES) -> DataFrame:
    """(path, length, digest) of each file: SHA-256 of its bytes.

    Only names and lengths are listed on the driver. A file on a mounted file system, and one of more than
    ``reader_bytes`` in any store that Arrow opens (HDFS, S3, GCS, Azure), is read by a task in pieces of a megabyte,
    whatever its size. Smaller files of other stores come through Spark's binary reader, which needs no client library.
    """
    listed = spark.read.format("binaryFile").load(path)
    by_reader = ~F.col("path").startswith("file:") & (F.col("length") <= reader_bytes)
    files = listed.select("path", "length", by_reader.alias("by_reader")).collect()  # names, no content
    pieces = [(r["path"], r["length"]) for r in files if not r["by_reader"]]
    # The reader lists files without content, but makes no rows of them.
    named = {re.sub("^file:/+", "file:/", unquote(f)) for f in listed.inputFiles()}
    empty = [(f, 0, hashlib.sha256(b"").hexdigest()) for f in sorted(named - {r["path"] for r in files})]
    schema = "path string, length long, digest string"
    out = listed.filter(by_reader).select("path", "length", F.sha2("content", 256).alias("digest"))
    if pieces:
        table = spark.createDataFrame(pieces, "path string, length long").repartition(len(pieces))
        streamed = table.mapInPandas(_stream_digests, schema)
        out = streamed if len(pieces) == len(files) else streamed.unionByName(out)
    return out.unionByName(spark.createDataFrame(empty, schema)) if empty else out


def open_stream(name: str) -> NativeFile:
    """The bytes of a file by its full name, read in order. The name is no encoded URI: a percent sign stands for itself."""
    store, place = name.split(":", 1)
    if store == "file":
        return fs.LocalFileSystem().open_input_stream("/" + place.lstrip("/"), compression=None)
    authority, _, rest = place.removeprefix("//").partition("/")
    system, root = fs.FileSystem.from_uri(f"{'s3' if store == 's3a' else store}://{authority}/")
    return system.open_input_stream(f"{root.rstrip('/')}/{rest}", compression=None)


def _stream_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for name in batch["path"]:
            digest = hashlib.sha256()
            with open_stream(name) as file:
                while piece := file.read(PIECE_BYTES):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield batch.assign(digest=found)


def digest_differences(expected: DataFrame, observed: DataFrame, name: str = "name") -> DataFrame:
    """Named digests that differ or exist on one side only."""
    left = expected.select(name, F.col("digest").alias("expected"))
    right = observed.select(name, F.col("digest").alias("observed"))
    return left.join(right, name, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("observed")))


class LockedError(RuntimeError):
    """The final role may not be read."""


def authorise_final(unlock: bool, expected: DataFrame, observed: DataFrame, name: str = "name") -> None:
    """Refuse the final evaluation unless it is unlocked and no digest changed."""
    if not unlock:
        raise LockedError("the final role is locked; pass unlock=True once all decisions are frozen")
    changed = [r.asDict() for r in digest_differences(expected, observed, name).collect()]  # one row per input
    if changed:
        raise LockedError(f"frozen inputs changed: {changed}")
