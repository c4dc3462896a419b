"""A library that grows by arriving files: new documents are taken once, repeats are reported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def first_of_each(docs: DataFrame, order: str = "path") -> DataFrame:
    """The first document of each docref in the order of its path. Combined before the shuffle."""
    return docs.groupBy("docref").agg(F.min_by(F.struct(*[c for c in docs.columns if c != "docref"]), order).alias("d")).select("docref", "d.*")


def watch(spark: SparkSession, folder: str, schema: StructType, key: str = "docref", files: int = 64) -> DataFrame:
    """A stream of the documents under a folder, each key once while it is within the state's reach."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)
    return stream.dropDuplicates([key])


def follow(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]):
    """Start a query that hands every batch of new documents to `each`; all that is there is taken, then it ends."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type in windows of event time."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
