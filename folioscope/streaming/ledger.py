"""At-most-once admission and durations over windows of a request ledger that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import count_if


def admitted(requests: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """The first request of each key within the delay that is waited for late rows; works on tables too."""
    if requests.isStreaming:
        return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return requests.dropDuplicates(list(keys))


def windowed_durations(requests: DataFrame, time: str, delay: str, length: str, *keys: str) -> DataFrame:
    """Completed and failed requests of each window, and the completed ones' least, greatest and summed duration."""
    rows = requests.withWatermark(time, delay) if requests.isStreaming else requests
    done = F.col("status") == "COMPLETE"
    took = F.when(done, F.col("duration_ms"))
    found = rows.groupBy(F.window(time, length), *keys).agg(count_if(done).alias("n"), count_if(~done).alias("failed"), F.min(took).alias("min_ms"), F.max(took).alias("max_ms"), F.sum(took).alias("total_ms"))
    return found.select(F.col("window.start").alias("start"), *keys, "n", "failed", "min_ms", "max_ms", "total_ms")


def stream_of(spark, path: str, schema, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """A folder's Parquet files as a stream, a few at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(path)
