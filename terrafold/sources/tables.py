"""Readers and writers of observation, prediction and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json"}


class SourceError(ValueError):
    """An input is absent or has an unsupported format, or an output may not be written."""


def format_of(path: str, default: str | None = None) -> str:
    """Format by suffix; a folder or pattern without one needs ``default``."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, kind in FORMATS.items():
        if name.endswith(suffix):
            return kind
    if default:
        return default
    raise SourceError(f"unsupported format of {path!r}; give a csv, parquet or json path")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def same_path(spark: SparkSession, a: str, b: str) -> bool:
    pa, fa = _hadoop_path(spark, a)
    pb, fb = _hadoop_path(spark, b)
    return fa.makeQualified(pa).toString() == fb.makeQualified(pb).toString()


def read_table(
    spark: SparkSession, path: str | None, columns: Sequence[str] | None = None, format: str | None = None
) -> DataFrame:
    """Read an explicitly named CSV or Parquet table.

    Folders and patterns are allowed, since a partitioned table is one. CSV columns are read
    as text, so that textual stand-ins for missing values stay visible to the rules.
    """
    if path is None or not str(path).strip():
        raise SourceError("an explicit path is required; nothing is searched for")
    kind = format or format_of(path)
    if kind not in ("csv", "parquet"):
        raise SourceError(f"observations are read from csv or parquet, not {kind}")
    if not exists(spark, path):
        raise SourceError(f"{path} does not exist")
    try:
        if kind == "csv":
            df = spark.read.option("header", True).option("inferSchema", False).csv(path)
        else:
            df = spark.read.parquet(path)
    except AnalysisException as error:
        raise SourceError(f"cannot read {path}: {error}") from error
    return df.select(*columns) if columns else df


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Give text columns their types; unreadable text becomes null (count it first with the rules)."""
    return df.withColumns({c: df[c].try_cast(t) for c, t in types.items() if c in df.columns})


def with_roles(df: DataFrame, roles: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Attach column metadata such as role and unit to the schema."""
    fields = {f.name: f for f in df.schema.fields}
    return df.select(
        *[df[c].alias(c, metadata=dict(roles[c])) if c in roles else df[c] for c in fields]
    )


def refuse_existing(spark: SparkSession, path: str, inputs: Sequence[str] = ()) -> None:
    """An output may neither exist nor be one of the inputs."""
    for source in inputs:
        if same_path(spark, path, source):
            raise SourceError(f"{path} is an input and is not overwritten")
    if exists(spark, path):
        raise SourceError(f"{path} exists; frozen results are not overwritten")


def write_table(
    df: DataFrame, path: str, inputs: Sequence[str] = (), partition_by: Sequence[str] = (), overwrite: bool = False
) -> str:
    """Write by suffix. Without ``overwrite`` an existing output is refused."""
    spark = df.sparkSession
    for source in inputs:
        if same_path(spark, path, source):
            raise SourceError(f"{path} is an input and is not overwritten")
    kind = format_of(path)
    if not overwrite:
        refuse_existing(spark, path)
    if kind == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        if nested:
            raise SourceError(f"csv cannot hold nested columns {nested}; export them as JSON text")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
    return path
