"""The stateless operators on streams, and profiles of them over event time.

Normalization, parsing and pair features are projections, so they are the same on a stream. Profiles
become windowed aggregations behind a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tessera.functions.parsing import parse
from tessera.operators.addresses import extract, normalize


def files(spark: SparkSession, path: str, schema: StructType | str, at_once: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)


def normalized(stream: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """Elements with tags to normalized addresses; ``cities`` is a static table."""
    return normalize(extract(stream), cities)


def parsed(stream: DataFrame, column: str) -> DataFrame:
    return stream.withColumn("parsed", parse(F.col(column)))


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", measures: dict | None = None) -> DataFrame:
    """Counts (and measures) by window and key; rows later than the watermark are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    each = stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in (measures or {}).items()))
    return each.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", *(measures or {}))


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events of one key that are less than ``gap`` apart."""
    each = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return each.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_in_time(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, to Parquet, once; the checkpoint lets a later call go on from there."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def each_batch(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A batch function for every micro-batch, as for upserts."""
    return stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
