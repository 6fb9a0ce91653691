"""Where metrics go, and streams that come from Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import prometheus


def export(df: DataFrame, kind: str, path: str) -> None:
    """Metrics (name, labels, value) as text under `path`: log (JSON lines) or prometheus (exposition format)."""
    if kind == "log":
        df.write.mode("append").json(path)
    elif kind == "prometheus":
        prometheus(df).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown exporter: {kind}")


def from_kafka(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of message texts in `value`, for streaming.jobs.ingest; needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def metadata_to_json(df: DataFrame, column: str = "metadata") -> DataFrame:
    return df.withColumn(column, F.to_json(column))


def metadata_from_json(df: DataFrame, column: str = "metadata") -> DataFrame:
    """Text to VARIANT; what isn't JSON becomes null."""
    return df.withColumn(column, F.try_parse_json(column))
