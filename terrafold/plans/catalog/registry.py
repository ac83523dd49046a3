"""Registry of queries and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import tune
from ..observations import observation_sql, observations

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_TWINS: dict[str, str] = {}

OBS = f"with obs as ({observation_sql()})"
FAULTY = f"with obs as ({observation_sql(faulty=True)})"

LINES = (
    "with lines as (select cast(l_suppkey as varchar) as site, cast(cast(l_shipdate as date) as varchar) as day, "
    "l_quantity as truth, l_quantity * (1e0 + l_discount - l_tax) as prediction, l_quantity * 97e-2 as baseline, "
    "l_returnflag, l_linestatus from lineitem)"
)


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = run
    if sql is not None:
        _TWINS[name] = sql


def queries() -> dict[str, Query]:
    def tuned(run: Query) -> Query:
        return lambda spark, sf_dir: run(tune(spark), sf_dir)

    return {name: tuned(run) for name, run in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_TWINS)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir)


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir, faulty=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measured and predicted quantities of a site on a day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("site"),
        F.col("l_shipdate").cast("date").cast("string").alias("day"),
        F.col("l_quantity").alias("truth"),
        (F.col("l_quantity") * (F.lit(1.0) + F.col("l_discount") - F.col("l_tax"))).alias("prediction"),
        (F.col("l_quantity") * F.lit(0.97)).alias("baseline"),
        "l_returnflag", "l_linestatus",
    )


def r6(x: Column | str) -> Column:
    """Six decimals, negative zero as zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def rounded(df: DataFrame, keep: list[str], measures: list[str]) -> DataFrame:
    return df.select(*keep, *[r6(m).alias(m) for m in measures])


def s6(text: str, name: str) -> str:
    return f"round({text}, 6) + 0e0 as {name}"
