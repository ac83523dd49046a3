"""The scoring plan on a stream of observations.

Every step of ``plans.scoring.score`` is row-wise, so the same function serves a streaming
table; there is no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import ScoringPlan, score
from ..session import work_folder


def read_observations(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def start_scoring(stream: DataFrame, plan: ScoringPlan, output: str, name: str, available_now: bool = True) -> StreamingQuery:
    """Append scored rows as Parquet; progress is kept in the shared work folder."""
    checkpoint = f"{work_folder(stream.sparkSession)}/stream-{name}"
    writer = (
        score(stream, plan).writeStream.queryName(name).outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", output).format("parquet")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
