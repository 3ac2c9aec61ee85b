"""Scoring of streams: models are data and expressions, so batch operators apply unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from assaylake.session import new_path


def parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def score_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], label: str = "scored") -> DataFrame:
    """Run a stateless transformation over everything available now into a Parquet sink, and read it back.

    Sink and checkpoint lie in the shared folder, so a restart continues exactly once.
    """
    spark = stream.sparkSession
    path, state = new_path(spark, label), new_path(spark, f"{label}-state")
    scored = transform(stream)
    query = scored.writeStream.format("parquet").option("checkpointLocation", state).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(scored.schema).parquet(path)
