"""Following an event log as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.crawl import EVENT


def tail_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the crawl events that are appended to a folder of JSON lines."""
    return spark.readStream.schema(EVENT).json(path)


def count_by_type(events: DataFrame) -> DataFrame:
    """Running counts of events by type."""
    return events.groupBy("type").count()
